"""Text keys. Everything here is a Column expression that runs in the JVM."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.vocab import CONTROL_CHARS

# Unicode white space: Java's \s alone covers the ASCII part only.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
_SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# the class comes first, as a pattern that begins with alternatives tries them at every letter
NEWLINE = r"[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029](?:(?<=\r)\n)?"

_HANGUL = range(0xAC00, 0xD7A4)


@lru_cache(maxsize=1)
def _mark_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition without combining marks, derived from the Unicode data.

    Returns the two strings ``translate`` wants (one-to-one, then deletions) and the
    characters that open into several.
    """
    one_from, one_to, dropped, several = [], [], [], {}
    for point in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF or point in _HANGUL:
            continue
        char = chr(point)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if plain == char:
            continue
        if len(plain) == 1:
            one_from.append(char)
            one_to.append(plain)
        elif plain:
            several[char] = plain
        else:
            dropped.append(char)
    return "".join(one_from + dropped), "".join(one_to), several


def _utf16(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _open_char(char: Column, several: dict[str, str]) -> Column:
    # one literal, folded to a map once, instead of thousands of expression nodes
    packed = "\x01".join(f"{k}\x02{v}" for k, v in several.items())
    table = F.str_to_map(F.lit(packed), F.lit("\x01"), F.lit("\x02"))
    syllable = F.ascii(char) - F.lit(0xAC00)
    tail = syllable % 28
    jamo = F.concat(
        _utf16((F.lit(0x1100) + F.floor(syllable / 588)).cast("bigint")),
        _utf16((F.lit(0x1161) + F.floor((syllable % 588) / 28)).cast("bigint")),
        F.when(tail > 0, _utf16((F.lit(0x11A7) + tail).cast("bigint"))).otherwise(F.lit("")),
    )
    return F.when(char.rlike("^[\\x{ac00}-\\x{d7a3}]$"), jamo).otherwise(
        F.coalesce(F.element_at(table, char), char)
    )


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once, however often ``body`` names it.

    Long expressions built from longer ones would otherwise be copied at every mention.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """``value`` as it is. It counts as not repeatable, so no filter or projection above it has it evaluated again."""
    return F.when(F.spark_partition_id() >= 0, value)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def collapse(c: Column) -> Column:
    """Inner white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def drop_marks(c: Column) -> Column:
    """Letters without their accents; ligatures and other compatibility characters opened."""
    source, target, several = _mark_tables()

    def plain(text: Column) -> Column:
        # a table look-up per character is far cheaper than a regex class of a thousand members
        opens = (F.translate(text, "".join(several), "") != text) | text.rlike(r"[\x{ac00}-\x{d7a3}]")
        opened = F.array_join(F.transform(F.split(text, ""), lambda ch: _open_char(ch, several)), "")
        # more bytes than characters: not plain ASCII
        return F.when(
            F.octet_length(text) != F.length(text), F.translate(F.when(opens, opened).otherwise(text), source, target)
        ).otherwise(text)

    return bind(c, plain)


def category_key(c: Column) -> Column:
    key = bind(drop_marks(F.lower(strip(c))), lambda k: F.when(k != "", k))
    return F.coalesce(key, F.lit("outros"))


def lower_key(c: Column) -> Column:
    return drop_marks(F.lower(strip(c)))


def upper_key(c: Column) -> Column:
    """Upper-case key used by the upload pipeline; null gives an empty string."""
    cleaned = F.regexp_replace(strip(c), CONTROL_CHARS, "")
    spaced = F.regexp_replace(cleaned, f"{SPACE}+", " ")
    return F.coalesce(F.upper(drop_marks(spaced)), F.lit(""))


def upper_collapsed(c: Column) -> Column:
    """Upper case with single blanks; accents stay."""
    return collapse(F.upper(c))


def clean_cell(c: Column) -> Column:
    return collapse(F.regexp_replace(c, CONTROL_CHARS, ""))


def short_name(c: Column) -> Column:
    cut = lambda name: F.concat(F.regexp_replace(F.substring(name, 1, 35), f"{SPACE}+$", ""), F.lit("..."))
    return bind(strip(c), lambda name: F.when(F.length(name) <= 38, name).otherwise(cut(name)))


def quoted(words) -> str:
    """Alternation that matches the words literally."""
    return "|".join("\\Q" + w + "\\E" for w in words)


def has_any(c: Column, words, whole_word: bool = False) -> Column:
    """One of the words is inside the text. Plain searches beat a regex of alternatives, which
    tries every word at every letter."""
    if whole_word:
        return c.rlike(f"(?U)\\b(?:{quoted(words)})\\b")
    # a word that contains another one of the list adds nothing
    needed = [w for w in words if not any(o != w and o in w for o in words)]
    return reduce(lambda a, b: a | b, [c.contains(w) for w in needed])


def lines(text: Column) -> Column:
    return F.split(text, NEWLINE)
