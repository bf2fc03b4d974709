"""Repair of conversations against a plain search over whole edit strings."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import scratch, turn_repair

FOLDER = "/root/testdata/sf0.001"
SHOWN = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def faults(rows):
    """The first fault of each (turn, role, text)."""
    seen, out = set(), []
    for _, role, text in rows:
        shown = SHOWN.findall(text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, edits, repaired lines): per number of rows and last initial, the least (cost, edits) of all, strings kept whole."""
    def spread(now):
        work = list(now.items())
        while work:
            last, (cost, edits, lines) = work.pop()
            for initial, role in (("u", "user"), ("a", "assistant")):
                if (to := NEXT[last].get(initial)) and (to not in now or (cost + 2, edits + "I") < now[to][:2]):
                    now[to] = (cost + 2, edits + "I", [*lines, f"{role}:"])
                    work.append((to, now[to]))
        return now

    now = spread({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, found, strict=True):
        after = {}
        for last, (cost, edits, lines) in now.items():
            options = [(last, cost + 3, "D", lines)]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if to := NEXT[last].get(role[:1]):
                    options.append((to, cost + more, "K", [*lines, f"{role}:{text}"]))
                for initial, name in (("u", "user"), ("a", "assistant")):
                    if to := NEXT[last].get(initial):
                        options.append((to, cost + 2 + more, "R", [*lines, f"{name}:{text}"]))
            for to, total, edit, kept in options:
                if to not in after or (total, edits + edit) < after[to][:2]:
                    after[to] = (total, edits + edit, kept)
        now = spread(after)
    return min((now[last] for last in ("", "a") if last in now), key=lambda x: x[:2])


def plain(rows):
    """{conversation: report} of [(conv_id, turn, role, text, present)]."""
    by = defaultdict(list)
    for key, turn, role, text, present in rows:
        own = by[key]
        if present:
            own.append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for key, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        found, turns = faults(own), [r[0] for r in own if r[0] is not None]
        cost, audit, lines = cheapest(own, found)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[key] = (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, digest, lines)
    return out


def plainly_damaged(rows):
    out = []
    for key, turn, role, text in rows:
        names = [" " if x is None else x for x in (key, turn, role, text)]
        kind, role, text = zlib.crc32(f"{names[0]}:{names[1]}".encode()) % 20, names[2], names[3]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(key, turn, "user" if kind == 4 else role, text, kind != 0)] * (2 if kind == 3 else 1)
    return out


def reports(frame):
    return {r[0]: tuple(r)[1:] for r in frame.collect()}


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = turn_repair.op13_conversation_repair(spark, FOLDER)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert reports(got) == {key: found[:-1] for key, found in plain(plainly_damaged(rows)).items()}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, t, r, x) for t, r, x in [(0, "system", "Be brief."), (1, "user", "Why?"), (1, "user", "Why?"), (2, "assistant", "So."), (9, "assistant", "cut of")]]
    rows += [(2, None, None, None), (2, None, "user", "Hi."), (3, None, "tool", "x."), (3, None, "", "x."), (None, 0, "user", "A."), (None, None, "assistant", "B!"), (None, 3, "User", "C?")]
    rows += [(4, -(2**62), "user", "A."), (4, 2**62, "assistant", "B."), (5, 0, "system", "S."), (6, 0, "user", " \n\t"), (6, 0, "user", " "), (7, 2**60 + 1, "user", "é\x00."), (7, 2**60, "a", "ß! ")]
    rows += [(8, t, "tool" if t % 7 else "user", f"Turn {t % 900}." if t % 5 else f"Turn {t}") for t in range(4000)]
    rows += [(9, 0, "user", "long " * 300_000 + "."), (9, 1, "assistant", "x" * 2_000_000)]
    rows += [(100 + c, t, "user" if t % 2 == 0 else "assistant", f"{t} is fine.") for c in range(40) for t in range(c % 6)]
    frame = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, audit string, present int")
    return rows, frame


def test_odd_rows(spark, odd):
    rows, frame = odd
    want = plain([(*r, True) for r in rows])
    assert reports(turn_repair.audit_conversations(frame)) == {k: v[:-1] for k, v in want.items()}
    assert reports(turn_repair.audit_conversations(turn_repair.damaged(frame), present=F.col("present"))) == {k: v[:-1] for k, v in plain(plainly_damaged(rows)).items()}
    assert turn_repair.audit_conversations(frame.limit(0)).count() == 0
    gone = turn_repair.audit_conversations(frame.where("conv_id in (1, 2)"), present=F.lit(None).cast("boolean"))
    assert reports(gone) == {k: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in (1, 2)}


def test_repaired_rows_are_those_of_the_digest(spark, odd):
    rows, frame = odd
    want = plain([(*r, True) for r in rows])
    made = defaultdict(dict)
    for r in turn_repair.repaired_conversations(frame, scratch.stored(turn_repair.audit_conversations(frame), "audits")).collect():
        made[r["conv_id"]][r["place"]] = r
    for key, found in want.items():
        own = [made[key][k] for k in range(len(made.get(key, {})))]
        assert [f"{r['role']}:{r['text']}" for r in own] == found[-1]
        assert "".join(r["edit"] for r in own) == found[6].replace("D", "")


ROLES = st.sampled_from(["system", "user", "assistant", "tool", "", "s", "ua"])
TEXTS = st.sampled_from(["Yes.", "No", " ", "a!", "b? \n", "c"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ROLES, TEXTS), max_size=14))
@example([("tool", f"{k}.") for k in range(14)])
def test_streamed_programme_is_the_plain_one(turns):
    rows = [(k, role, text) for k, (role, text) in enumerate(turns)]
    number, now = turn_repair.Numbers(), turn_repair.Conversation("x")
    for turn, role, text in rows:
        shown = text.rstrip()
        now.row(turn, role, text, not shown, not shown.endswith((".", "!", "?")), hashlib.md5(f"{role}\0{text}".encode()).digest(), number)
    found = now.result(number)
    cost, audit, lines = cheapest(rows, faults(rows))
    assert (found["cost"], found["audit"], found["repaired_sha256"]) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))


def test_long_conversations_go_to_files(monkeypatch):
    monkeypatch.setattr(turn_repair, "IN_MEMORY", 64)
    monkeypatch.setattr(turn_repair, "DIGESTS", 8)
    turns = [(k, "user" if k % 3 else "tool", f"{k % 60}." if k % 11 else "") for k in range(9000)]
    number, now = turn_repair.Numbers(), turn_repair.Conversation("x")
    for turn, role, text in turns:
        now.row(turn, role, text, not text, False, hashlib.md5(f"{role}\0{text}".encode()).digest(), number)
    assert len(now.seen.runs) > 5 and now.steps._rolled and len(number.origins) < 200
    found = now.result(number)
    want = faults(turns)
    cost, audit, lines = cheapest(turns, want)
    assert (found["cost"], found["audit"], found["duplicate"]) == (cost, audit, want.count("duplicate"))
