"""Repair of conversations whose turns are damaged: the cheapest edits after which roles alternate.

Rows are dealt by conversation and sorted by turn; each task streams them and carries a small dynamic
programme over how far the repaired roles have come (nothing, a system turn, a user turn, a full pair)
from one Arrow batch to the next. A state of the programme is its costs above the least and the order of
its edit strings; there are few of those, so every step is looked up after its first use, and what a row
leaves behind is the two-byte number of its step. These numbers, and the digests of texts met before, go
to a file of the task's own when a conversation is long, so that memory does not grow with it.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import scratch
from ledgerloom.llm.labelled import remainder

#: Bytes of steps that a task keeps in memory for one conversation, and digests of texts that it keeps before they go to its file.
IN_MEMORY, DIGESTS = 1 << 20, 1 << 16
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"

#: How far the repaired roles have come, and where one more user or assistant turn takes them.
NOTHING, SYSTEM, USER, PAIR = range(4)
ADDED = {NOTHING: USER, SYSTEM: USER, PAIR: USER, USER: PAIR}
ROLE_OF = {USER: "user", PAIR: "assistant"}
#: Edits and what each costs; a truncated row that stays costs one more.
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
FINE, TRUNCATED, GONE = range(3)
#: No state this much above the least can end better: from any state two insertions and a deletion do what another could.
MARGIN = 8
#: Insertions that may precede a row or the end; more would only add pairs.
MOST_INSERTED = 2

#: A state of the programme: for each of the four roles' states None, or (cost above the least, rank of its edits among the states).
State = tuple[tuple[int, int] | None, ...]
START: State = ((0, 0), None, None, None)


def _kept(at: int, initial: str) -> int | None:
    """Where a kept row with this initial leads."""
    if initial == "s":
        return SYSTEM if at == NOTHING else None
    if initial == "u":
        return USER if at != USER else None
    return PAIR if initial == "a" and at == USER else None


@lru_cache(maxsize=None)
def step(state: State, initial: str, fault: int) -> tuple[State, int, tuple[tuple[int, str] | None, ...]]:
    """(next state, cost of the least, for each of its states where it comes from and the edits since) of one row.

    Strings of equal cost that lead to one state: none begins another, as every further edit of such a string
    would be an insertion and cost more. So the lesser stays the lesser, and rank and last edits decide.
    """
    best: list[tuple[int, int, str, int] | None] = [None] * 4
    for source, known in enumerate(state):
        if known is None:
            continue
        cost, rank = known
        at, edits = source, ""
        for _ in range(MOST_INSERTED + 1):
            options = [(DELETE, at, COST[DELETE])]
            if fault != GONE:
                options.append((REROLE, ADDED[at], COST[REROLE] + fault))
                if (kept := _kept(at, initial)) is not None:
                    options.append((KEEP, kept, COST[KEEP] + fault))
            for edit, target, more in options:
                found = (cost + more, rank, edits + edit, source)
                if best[target] is None or found < best[target]:
                    best[target] = found
            at, edits, cost = ADDED[at], edits + INSERT, cost + COST[INSERT]
    least = min(b[0] for b in best if b)
    best = [b if b and b[0] <= least + MARGIN else None for b in best]
    order = sorted((b[1], b[2]) for b in best if b)
    after = tuple((b[0] - least, order.index((b[1], b[2]))) if b else None for b in best)
    return after, least, tuple((b[3], b[2]) if b else None for b in best)


@lru_cache(maxsize=None)
def ending(state: State) -> tuple[int, int, str]:
    """(cost, state, insertions) of the cheapest end: nothing at all, or a full pair."""
    inserted = {NOTHING: "", PAIR: "", USER: INSERT, SYSTEM: INSERT * 2}
    cost, _, edits, at = min((known[0] + COST[INSERT] * len(inserted[at]), known[1], inserted[at], at) for at, known in enumerate(state) if known)
    return cost, at, edits


class Seen:
    """Digests met before in this conversation; sorted runs of them lie in a file beyond the first few."""

    def __init__(self):
        self.new: set[bytes] = set()
        self.runs: list[np.ndarray] = []

    def add(self, digest: bytes) -> bool:
        """Whether the digest was there."""
        if digest in self.new:
            return True
        key = np.frombuffer(digest, "S16")[0] if self.runs else None
        for run in self.runs:
            at = int(np.searchsorted(run, key))
            if at < len(run) and run[at] == key:
                return True
        self.new.add(digest)
        if len(self.new) >= DIGESTS:
            run = np.sort(np.array(list(self.new), "S16"))
            with tempfile.TemporaryFile() as file:
                file.write(run.tobytes())
                file.flush()
                self.runs.append(np.memmap(file, "S16", "r", shape=run.shape))
            self.new = set()
        return False


class Conversation:
    """One conversation's programme while its rows come in."""

    def __init__(self, key: str | None):
        self.key, self.state, self.cost = key, START, 0
        self.steps, self.rows = tempfile.SpooledTemporaryFile(IN_MEMORY), 0
        self.waiting: list[int] = []
        self.texts = {NOTHING: hashlib.sha256()}
        self.seen = Seen()
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.before: str | None = None
        self.turns = self.first = self.last = None

    def row(self, turn: int | None, role: str, text: str, blank: bool, truncated: bool, digest: bytes, number: Numbers) -> None:
        if turn is not None:
            if self.turns is None:
                self.turns, self.first, self.last = 1, turn, turn
            elif turn != self.last:
                self.turns, self.last = self.turns + 1, turn
        again, initial = self.seen.add(digest), role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.faults["illegal"] += 1
        self.before = initial
        fault = FINE
        if blank or again:
            self.faults["blank" if blank else "duplicate"] += 1
            fault = GONE
        elif truncated:
            self.faults["truncated"] += 1
            fault = TRUNCATED
        self.state, more, origins = step(self.state, initial if initial in ("s", "u", "a") else "", fault)
        self.cost += more
        self.waiting.append(number(origins))
        if len(self.waiting) == 4096:
            self.flush()
        self.rows += 1
        self.texts = {at: self._hashed(*origin, role, text) for at, origin in enumerate(origins) if origin}

    def _hashed(self, source: int, edits: str, role: str, text: str):
        """The digest of the repaired text that one state stands for, one row further."""
        out, at = self.texts[source].copy(), source
        for edit in edits:
            if edit == DELETE:
                continue
            if edit == KEEP:
                out.update((("\n" if at != NOTHING else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                continue
            line = "\n" if at != NOTHING else ""
            at = ADDED[at]
            out.update((line + ROLE_OF[at] + ":" + (text if edit == REROLE else "")).encode("utf-8", "surrogatepass"))
        return out

    def flush(self) -> None:
        self.steps.write(np.array(self.waiting, "<u2").tobytes())
        self.waiting = []

    def audit(self, at: int, end: str, number: Numbers) -> str:
        """The edits in order, followed backwards through the steps from the state at the end."""
        self.flush()
        out, high, block = [end], self.rows, IN_MEMORY // 2
        while high:
            low = max(high - block, 0)
            self.steps.seek(2 * low)
            for k in reversed(np.frombuffer(self.steps.read(2 * (high - low)), "<u2").tolist()):
                at, edits = number.origins[k][at]
                out.append(edits)
            high = low
        return "".join(reversed(out))

    def result(self, number: Numbers) -> dict:
        more, at, end = ending(self.state)
        audit = self.audit(at, end, number)
        digest = self.texts[at].copy()
        for _ in end:
            line = "\n" if at != NOTHING else ""
            at = ADDED[at]
            digest.update((line + ROLE_OF[at] + ":").encode())
        gaps = 0 if self.turns is None else min(self.last - self.first + 1 - self.turns, 2**63 - 1)
        self.steps.close()
        return {"key": self.key, "gaps": gaps, **self.faults, "cost": self.cost + more, "audit": audit, "repaired_sha256": digest.hexdigest()}


class Numbers:
    """Steps as numbers."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.origins: list[tuple] = []

    def __call__(self, origins: tuple) -> int:
        if (k := self.known.get(origins)) is None:
            k = self.known[origins] = len(self.origins)
            self.origins.append(origins)
        return k


_REPORT = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COLUMNS = [field.split()[0] for field in _REPORT.split(", ")]


def _audited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    number, now = Numbers(), None
    for batch in batches:
        done = []
        columns = [batch[c].tolist() for c in ("key", "no_key", "turn", "no_turn", "present", "role", "text", "blank", "truncated", "digest")]
        for key, no_key, turn, no_turn, present, role, text, blank, truncated, digest in zip(*columns, strict=True):
            key = None if no_key else key
            if now is None or now.key != key:
                if now is not None:
                    done.append(now.result(number))
                now = Conversation(key)
            if present:
                now.row(None if no_turn else turn, role, text, blank, truncated, digest, number)
        if done:
            yield pd.DataFrame(done, columns=_COLUMNS)
    if now is not None:
        yield pd.DataFrame([now.result(number)], columns=_COLUMNS)


def _rows(conversations: DataFrame, key: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    """The rows that tasks see; nulls of role and text are one space, nulls of keys and turns are told by flags."""
    filled = conversations.select(
        F.col(key).alias("own"),
        F.col(turn).cast("long").alias("own_turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(name) for name, c in (("role", role), ("text", text))],
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"),
    )
    shown = F.rtrim("text", F.lit(_SPACES))
    return filled.select(
        "own",
        "own_turn",
        F.coalesce(F.col("own").cast("string"), F.lit("")).alias("key"),
        F.col("own").isNull().alias("no_key"),
        F.coalesce("own_turn", F.lit(0)).alias("turn"),
        F.col("own_turn").isNull().alias("no_turn"),
        "present",
        "role",
        "text",
        (shown == "").alias("blank"),
        (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
        F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))).alias("digest"),
    )


def _order() -> list[Column]:
    """Rows of a conversation: by turn, nulls first; those of one turn by role and text."""
    return [F.col("own_turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]


def audit_conversations(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """One row a conversation: key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first, rows of one turn by role and text. present: a condition; rows without
    it only make their conversation known, and one without other rows has zeros, an empty audit and the digest
    of nothing. A null key is a conversation of its own, a null role or text one space, turns are whole numbers.
    Of a row's faults the first counts: blank, duplicate (role and text came earlier), truncated (does not end in
    . ! or ?). The audit names the cheapest edits (K, R, D, I) after which the initials of roles are nothing or an
    optional system turn and pairs of user and assistant; the least in ASCII order of equally cheap ones. A role
    without an initial fits nowhere. Repeated rows are duplicates; other columns are left out; an empty table
    gives an empty table. One task streams a conversation, whatever its length, in bounded memory but for its audit.
    """
    scratch.text_batches(conversations.sparkSession)
    rows = _rows(conversations, key, turn, role, text, present)
    dealt = rows.repartition("own").sortWithinPartitions("own", *_order()).drop("own", "own_turn")
    out = dealt.mapInPandas(_audited, _REPORT)
    # a key is null where no_key said so; its text gives back the key's own type
    return out.withColumn("key", F.col("key").cast(conversations.schema[key].dataType)).withColumnRenamed("key", key)


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The repaired rows of conversations whose audit comes before their rows."""
    key, audit, at, place, state, out = None, "", 0, 0, NOTHING, []

    def add(edit: str, turn: int | None, role: str, text: str) -> None:
        nonlocal place
        out.append((key, place, turn, role, text, edit))
        place += 1

    def inserted() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == INSERT:
            at, state = at + 1, ADDED[state]
            add(INSERT, None, ROLE_OF[state], "")

    names = ["key", "place", "turn", "role", "text", "edit"]
    for batch in batches:
        for own, no_key, turn, no_turn, present, role, text, edits in zip(*[batch[c].tolist() for c in ("key", "no_key", "turn", "no_turn", "present", "role", "text", "edits")], strict=True):
            if isinstance(edits, str):
                inserted()
                key, audit, at, place, state = None if no_key else own, edits, 0, 0, NOTHING
                continue
            if not present:
                continue
            inserted()
            edit, at = audit[at], at + 1
            turn = None if no_turn else turn
            if edit == KEEP:
                state = SYSTEM if role[0] == "s" else USER if role[0] == "u" else PAIR
                add(KEEP, turn, role, text)
            elif edit == REROLE:
                state = ADDED[state]
                add(REROLE, turn, ROLE_OF[state], text)
        if out:
            yield pd.DataFrame(out, columns=names).astype({"turn": "Int64"})
            out = []
    inserted()
    if out:
        yield pd.DataFrame(out, columns=names).astype({"turn": "Int64"})


def repaired_conversations(conversations: DataFrame, audits: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """The rows of repaired conversations: key, place (from 0), turn (null if inserted), role, text, edit.

    audits: the table that audit_conversations made of the same rows; each conversation's audit travels as its
    first row. Deleted rows are absent, and conversations of which nothing stays.
    """
    rows = _rows(conversations, key, turn, role, text, present).withColumn("edits", F.lit(None).cast("string"))
    first = audits.select(F.col(key).alias("own"), F.col("audit").alias("edits"))
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in rows.schema.fields if f.name not in ("own", "edits")}
    nothing |= {"key": F.coalesce(F.col("own").cast("string"), F.lit("")), "no_key": F.col("own").isNull(), "present": F.lit(False), "turn": F.lit(0).cast("long"), "no_turn": F.lit(True)}
    both = rows.unionByName(first.select("own", "edits", *[c.alias(name) for name, c in nothing.items()]))
    dealt = both.repartition("own").sortWithinPartitions("own", F.col("edits").isNull(), *_order())
    out = dealt.select("key", "no_key", "turn", "no_turn", "present", "role", "text", "edits").mapInPandas(_edited, "key string, place long, turn long, role string, text string, edit string")
    return out.withColumn("key", F.col("key").cast(conversations.schema[key].dataType)).withColumnRenamed("key", key)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: rows as the check sum of conversation and turn damages them."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    rows = conversations.select("conv_id", "turn", filled[2].alias("role"), filled[3].alias("text"), F.concat(filled[0], F.lit(":"), filled[1]).alias("name"))
    rows = rows.withColumn("damage", remainder("name", 20))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("damage") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("damage") != 0).alias("present"), copies.alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was wrong in every conversation after damage, and its cheapest repair."""
    return audit_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), present=F.col("present"))


def _moves() -> str:
    """All (state, role's initial that it needs, edits, next state, cost, lines before) of one row, as SQL rows; a row that must go takes no other than D."""
    out = []
    for source in range(4):
        at, edits, lines = source, "", []
        for k in range(MOST_INSERTED + 1):
            options = [("", "D", at, COST[DELETE]), ("", "R", ADDED[at], COST[REROLE])]
            options += [(i, "K", kept, COST[KEEP]) for i in "sua" if (kept := _kept(at, i)) is not None]
            out += [f"({source}, '{needs}', '{edits}{edit}', {target}, {cost + k * COST[INSERT]}, {lines}, '{ROLE_OF.get(target, '')}')" for needs, edit, target, cost in options]
            at, edits = ADDED[at], edits + INSERT
            lines = [*lines, ROLE_OF[at] + ":"]
    return ",\n  ".join(out)


OP13_SQL = rf"""
WITH RECURSIVE
crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
kinds AS (SELECT name, xor(list_reduce(list_concat([4294967295], list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind
  FROM (SELECT DISTINCT name FROM named), crc),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM named JOIN kinds USING (name) WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged),
judged AS MATERIALIZED (SELECT *, left(role, 1) AS initial, CASE
    WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
    WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN '' ELSE 'truncated' END AS fault,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY n), 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM numbered),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (illegal) AS illegal, max(n) AS rows FROM judged GROUP BY conv_id),
moves(source, needs, edits, target, cost, before, made) AS (VALUES
  {_moves()}),
states(conv_id, n, state, best) AS (
  SELECT conv_id, 0::BIGINT, 0, struct_pack(cost := 0::BIGINT, audit := '', out := []::VARCHAR[]) FROM counts
  UNION ALL
  SELECT s.conv_id, j.n, m.target, min(struct_pack(
      cost := s.best.cost + m.cost + CASE WHEN right(m.edits, 1) <> 'D' AND j.fault = 'truncated' THEN 1 ELSE 0 END,
      audit := s.best.audit || m.edits,
      out := list_concat(s.best.out, m.before, CASE right(m.edits, 1) WHEN 'D' THEN []::VARCHAR[]
        WHEN 'K' THEN [j.role || ':' || j.text] ELSE [m.made || ':' || j.text] END)))
  FROM states s JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.n = s.n + 1
  JOIN moves m ON m.source = s.state AND (m.needs = '' OR m.needs = j.initial)
  WHERE right(m.edits, 1) = 'D' OR j.fault NOT IN ('blank', 'duplicate')
  GROUP BY s.conv_id, j.n, m.target),
ended AS (SELECT s.conv_id, min(struct_pack(cost := s.best.cost + 2 * len(e.edits), audit := s.best.audit || e.edits,
    out := list_concat(s.best.out, e.lines))) AS best
  FROM states s JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.rows = s.n
  JOIN (VALUES (0, '', []::VARCHAR[]), (1, 'II', ['user:', 'assistant:']), (2, 'I', ['assistant:']), (3, '', [])) e(state, edits, lines) ON e.state = s.state
  GROUP BY s.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(array_to_string(best.out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""
