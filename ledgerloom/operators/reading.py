"""Account lines of a batch of texts. Runs inside Python workers on Arrow columns.

All lines of a batch meet a pattern in one call, and accounts stay columns until they are dealt to
their texts, so nothing is done line by line.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from ledgerloom.operators.tree import grown

# workers get these few functions with the job and need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "\x01"
_LINE_ENDS = r"[\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: Unicode white space as the members of a class, and with the separators of files.
_WHITE = r"\t-\r\x{85}\p{Z}"
_SPACE = rf"[{_WHITE}\x1c-\x1f]"
#: White space and decimal digits beyond ASCII.
_WIDE = r"\x{85}|[^\P{Z} ]|[^\P{Nd}0-9]"
_BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_TEXT, _CENTS = pa.string(), pa.int64()
ACCOUNT = pa.struct(
    [
        ("seq", pa.int32()), ("codigo", _TEXT), ("classificacao", _TEXT), ("descricao", _TEXT), ("saldo_anterior", _CENTS),
        ("natureza_anterior", _TEXT), ("debito", _CENTS), ("credito", _CENTS), ("saldo_atual", _CENTS), ("natureza", _TEXT),
    ]
)
LINE = pa.struct([("seq", pa.int32()), ("texto", _TEXT)])


# -- lines and patterns ------------------------------------------------------------------


def _replaced(texts: pa.Array, pattern: str, by: str) -> pa.Array:
    """Most batches have nothing to replace, which the search tells sooner."""
    return pc.replace_substring_regex(texts, pattern, by) if pc.any(pc.match_substring_regex(texts, pattern)).as_py() else texts


def held_lines(texts: pa.Array, single_blanks: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lines that can hold an account at all, the place of their text and their number in it."""
    ended = _replaced(pc.replace_substring(texts, "\r\n", "\n"), _LINE_ENDS, "\n")
    parts = pc.split_pattern(ended, "\n")
    sizes = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)
    own = np.repeat(np.arange(len(texts)), sizes)
    seq = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    lines = _replaced(pc.list_flatten(parts), MARK, "")
    held = pc.match_substring_regex(lines, ",[0-9][0-9]")
    lines, kept = lines.filter(held), held.to_numpy(zero_copy_only=False)
    if single_blanks:
        lines = pc.utf8_trim(pc.replace_substring_regex(lines, f"{_SPACE}+", " "), " ")
    return lines, own[kept], seq[kept]


def is_narrow(lines: pa.Array) -> bool:
    """Whether all digits and white space of the lines are ASCII's, so that classes of those alone find the same."""
    wide = lines.filter(pc.invert(pc.string_is_ascii(lines)))
    return not pc.any(pc.match_substring_regex(wide, _WIDE)).as_py()


def _linear(pattern: str, groups: int, narrow: bool = False) -> str | None:
    """The pattern for the linear matcher of Arrow, digits and white space being Unicode's (narrow: ASCII's, which
    match in half the time) and groups named by their numbers; None when it needs more than that matcher has."""
    blanks, digit, other = (r"\t-\r ", r"\d", r"\D") if narrow else (_WHITE, r"\p{Nd}", r"\P{Nd}")
    out, number, inside, i = [], 0, False, 0
    while i < len(pattern):
        char = pattern[i]
        if char == "\\":
            pair = pattern[i : i + 2]
            if pair[1:] in "wWbB" or (pair == r"\S" and inside):
                return None
            white = blanks if inside else f"[{blanks}]"
            out.append({r"\d": digit, r"\D": other, r"\s": white, r"\S": f"[^{blanks}]"}.get(pair, pair))
            i += 2
            continue
        if char == "[":
            if inside:
                return None
            inside = True
        elif char == "]":
            inside = False
        elif char == "(" and not inside and pattern[i + 1 : i + 2] != "?":
            number += 1
            char = f"(?P<g{number}>"
        out.append(char)
        i += 1
    changed = "".join(out)
    try:
        fits = pc.extract_regex(pa.array([""], _TEXT), changed).type.num_fields == groups == number
    except pa.ArrowInvalid:
        return None
    return changed if fits else None


def groups_of(lines: pa.Array, pattern: str, groups: int, narrow: bool = False) -> tuple[np.ndarray, list[pa.Array]]:
    """Which lines the pattern is found in, and what its groups hold there. narrow: see :func:`is_narrow`."""
    linear = _linear(pattern, groups, narrow)
    if linear is not None:
        found = pc.extract_regex(lines, linear)
        hit = found.is_valid()
        return hit.to_numpy(zero_copy_only=False), found.filter(hit).flatten()
    search = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern)).search
    matches = [search(line) for line in lines.to_pylist()]
    rows = [m for m in matches if m]
    hit = np.fromiter((m is not None for m in matches), bool, len(matches))
    return hit, [pa.array([m.group(g) or "" for m in rows], _TEXT) for g in range(1, groups + 1)]


def _shaped(lines: pa.Array, shape: str, implied: bool) -> pa.Array:
    """Whether the signature of a line fits: a mark for each number and one blank for each gap."""
    if implied:
        # elsewhere each number of the pattern ends at a mark of its own, so that the match has told it already
        unsure = pc.match_substring_regex(lines, r"#|,\p{Nd}{2},")
        if not pc.any(unsure).as_py():
            return pc.invert(unsure)
    signs = pc.replace_substring_regex(pc.replace_substring(lines, "#", ""), r"[\p{Nd}.]+,\p{Nd}{2}", "#")
    signs = pc.replace_substring_regex(signs, f"[{_WHITE}]+", " ")
    try:
        return pc.match_substring_regex(signs, shape)
    except pa.ArrowInvalid:
        search = re.compile(shape, re.ASCII).search
        return pa.array([search(s) is not None for s in signs.to_pylist()], pa.bool_())


def _one_amount(text: str) -> int | None:
    bare = text.strip("".join(map(chr, range(33))) + "\x7f")
    value = int(bare) if re.fullmatch("[+-]?[0-9]+", bare) else None
    return value if value is not None and -(2**63) <= value < 2**63 else None


def cents(texts: pa.Array) -> pa.Array:
    """``1.234,56`` to 123456; null for what is no whole number of eight bytes."""
    bare = pc.replace_substring(pc.replace_substring(texts, ".", ""), ",", "")
    if len(bare) == 0 or (pc.all(pc.ascii_is_decimal(bare)).as_py() and pc.max(pc.binary_length(bare)).as_py() <= 18):
        return bare.cast(_CENTS)
    return pa.array([_one_amount(t) for t in bare.to_pylist()], _CENTS)


# -- accounts ----------------------------------------------------------------------------


def accounts_in(lines: pa.Array, own: np.ndarray, seq: np.ndarray, layout: tuple, narrow: bool) -> tuple[pa.StructArray, np.ndarray]:
    """Accounts of the lines that a layout (pattern, groups, shape, whether that is implied) fits, and the places of their texts."""
    pattern, names, shape, implied = layout
    hit, groups = groups_of(lines, pattern, len(names), narrow)
    own, seq = own[hit], seq[hit]
    if shape is not None:
        fits = _shaped(lines.filter(pa.array(hit)), shape, implied)
        if not pc.all(fits).as_py():
            groups = [g.filter(fits) for g in groups]
            own, seq = own[fits.to_numpy(zero_copy_only=False)], seq[fits.to_numpy(zero_copy_only=False)]
    empty = pa.repeat(pa.scalar("", _TEXT), len(own))
    field = lambda name: groups[names.index(name)] if name in names else empty
    present = lambda c: pc.if_else(pc.equal(c, ""), pa.scalar(None, _TEXT), c)
    columns = [
        pa.array(seq, pa.int32()), field("codigo"), present(field("classificacao")), pc.utf8_trim(field("descricao"), _BLANKS),
        cents(field("anterior")), present(field("natureza_anterior")), cents(field("debito")), cents(field("credito")),
        cents(field("atual")), field("natureza"),
    ]
    return pa.StructArray.from_arrays(columns, fields=list(ACCOUNT)), own


def reconciles(accounts: pa.StructArray) -> np.ndarray:
    """Previous balance + debits - credits gives the balance. Exact in cents."""
    field = dict(zip((f.name for f in ACCOUNT), accounts.flatten()))
    credit_before = pc.fill_null(pc.equal(field["natureza_anterior"], "C"), False)
    before = pc.if_else(credit_before, pc.negate(field["saldo_anterior"]), field["saldo_anterior"])
    expected = pc.subtract_checked(pc.add_checked(before, field["debito"]), field["credito"])
    signed = pc.if_else(pc.equal(field["natureza"], "D"), field["saldo_atual"], pc.negate(field["saldo_atual"]))
    return pc.fill_null(pc.equal(expected, signed), False).to_numpy(zero_copy_only=False)


def _dealt(items: pa.Array, sizes: np.ndarray, null: np.ndarray) -> pa.ListArray:
    """Items in the order of their texts as one list a text; null where the text is."""
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(ends, items, mask=pa.array(null) if null.any() else None)


def _places(numbers: np.ndarray, missing: np.ndarray) -> pa.Array:
    return pa.array(numbers, pa.int64(), mask=missing)


class Reading:
    """What every layout finds in a batch of texts. With ``every`` unset, a layout after one that
    fits every account of a text is not tried on it, and measures nothing."""

    def __init__(self, texts: pa.Array, layouts: list[tuple], every: bool):
        self.null = texts.is_null().to_numpy(zero_copy_only=False)
        lines, own, seq = held_lines(texts, False)
        n, narrow = len(texts), is_narrow(lines)
        self.accounts, self.own, self.holds, self.found, self.held = [], [], [], [], []
        undecided = np.ones(n, bool)
        for layout in layouts:
            live = undecided[own]
            if not live.all():
                lines, own, seq = lines.filter(pa.array(live)), own[live], seq[live]
            accounts, whose = accounts_in(lines, own, seq, layout, narrow)
            holds = reconciles(accounts)
            found, held = np.bincount(whose, minlength=n), np.bincount(whose[holds], minlength=n)
            self.accounts.append(accounts)
            self.own.append(whose)
            self.holds.append(holds)
            self.found.append(found)
            self.held.append(held)
            if not every:
                undecided &= (found == 0) | (found != held)

    def measures(self) -> pa.ListArray:
        count = len(self.found)
        column = lambda counts: pa.array(
            np.stack(counts, 1).ravel(), pa.int32(), mask=np.repeat(self.null, count) if self.null.any() else None
        )
        pairs = pa.StructArray.from_arrays([column(self.found), column(self.held)], ["contas", "reconciliadas"])
        return _dealt(pairs, np.full(len(self.null), count), np.zeros(len(self.null), bool))

    def elected(self) -> np.ndarray:
        """Index of the layout to trust: the first perfect one, else the one with most reconciled
        accounts (earlier on ties); -1 when none found an account."""
        found, held = np.stack(self.found), np.stack(self.held)
        perfect = (found > 0) & (found == held)
        scores = np.where(found > 0, held, -1)
        best = np.where(scores.max(0) >= 0, scores.argmax(0), -1)
        return np.where(perfect.any(0), perfect.argmax(0), best)

    def outcome(self, names: list[str], with_trees: bool = False) -> pa.StructArray:
        """What is read from each text; with_trees: next to the tree of its accounts, which has none where one does not reconcile."""
        choice = self.elected()
        trusted = [choice[whose] == k for k, whose in enumerate(self.own)]
        accounts = pa.concat_arrays([a.filter(pa.array(t)) for a, t in zip(self.accounts, trusted)])
        own = np.concatenate([whose[t] for whose, t in zip(self.own, trusted)])
        holds = np.concatenate([h[t] for h, t in zip(self.holds, trusted)])
        order = np.argsort(own, kind="stable")
        accounts, own, holds = accounts.take(pa.array(order)), own[order], holds[order]
        bad = np.flatnonzero(~holds)
        whose, first = np.unique(own[bad], return_index=True)
        failure, sound = np.zeros(len(choice), np.int64), np.ones(len(choice), bool)
        failure[whose], sound[whose] = bad[first], False
        read = pa.StructArray.from_arrays(
            [
                pa.array(names, _TEXT).take(_places(choice, choice < 0)),
                _dealt(accounts, np.bincount(own, minlength=len(choice)), self.null),
                self.measures(),
                accounts.take(_places(failure, sound)),
            ],
            ["layout", "contas", "medidas", "falha"],
        )
        if not with_trees:
            return read
        usable = sound[own]
        counts = np.bincount(own[usable], minlength=len(choice))
        return pa.StructArray.from_arrays([read, grown(_dealt(accounts.filter(pa.array(usable)), counts, self.null))], ["leitura", "arvore"])


# -- functions of a batch, for the columns of layouts.py --------------------------------------


def parser(names: list[str], layouts: list[tuple], with_trees: bool = False):
    def parsed(texts: pa.Array) -> pa.Array:
        return Reading(texts.cast(_TEXT), layouts, every=False).outcome(names, with_trees)

    return parsed


def measurer(layouts: list[tuple]):
    def measured(texts: pa.Array) -> pa.Array:
        return Reading(texts.cast(_TEXT), layouts, every=True).measures()

    return measured


def liner(single_blanks: bool):
    def lined(texts: pa.Array) -> pa.Array:
        lines, own, seq = held_lines(texts.cast(_TEXT), single_blanks)
        rows = pa.StructArray.from_arrays([pa.array(seq, pa.int32()), lines], fields=list(LINE))
        return _dealt(rows, np.bincount(own, minlength=len(texts)), texts.is_null().to_numpy(zero_copy_only=False))

    return lined


def finder(layout: tuple):
    def found(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        seq, lines = pc.list_flatten(lists).flatten()
        own = np.repeat(np.arange(len(lists)), sizes)
        lines = lines.cast(_TEXT)
        accounts, own = accounts_in(lines, own, seq.to_numpy(zero_copy_only=False), layout, is_narrow(lines))
        return _dealt(accounts, np.bincount(own, minlength=len(lists)), lists.is_null().to_numpy(zero_copy_only=False))

    return found
