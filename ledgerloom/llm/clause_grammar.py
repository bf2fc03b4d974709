"""The grammar of toxic clauses as weighted finite-state transducers.

A lexicon transducer reads words and writes classes (insult, threat, target, negation, report); phrases
are paths of several arcs, the longest one from the left wins, and a contraction is a phrase whose second
arc asks for an apostrophe alone. Behind it stand three transducers over classes that copy what they read
and weigh it: is somebody addressed, is the clause reported, is a negation near. The first two do not know
yet what the rest of the clause brings, so they start in a guess and accept only if the guess comes true.
They are composed once into one table; the weight of a clause is that of its accepted path.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa

from ledgerloom.llm import words

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Factors of an addressed, a denied and a reported insult; reach of a negation in words; weight of a seed.
ADDRESSED, DENIED, REPORTED, REACH, SEED_WEIGHT = 1.25, 0.25, 0.6, 3, 1.0

# Seed words and phrases, fixed.
SEEDS = {
    INSULT: "idiot, idiots, moron, morons, stupid, loser, losers, scum, trash, pathetic, worthless, disgusting, clown, vermin, filth, "
    "piece of trash, waste of space, good for nothing, son of a bitch, shut up, hau ab, ta gueule, hijo de puta",
    THREAT: "kill, hurt, beat, destroy, die, shoot, stab, burn, töten, umbringen, tuer, frapper, matar, golpear, "
    "watch your back, come after, hunt down, make you pay, going to regret, mach dich fertig, bring dich um, va te faire payer, te voy a",
    TARGET: "you, your, yours, u, he, she, they, them, du, dich, ihr, euch, vous, toi, te, tu, té, tú, usted, ustedes, people like, all of them, leute wie, des gens comme, gente como",
    NEGATION: "not, no, never, neither, nor, nobody, isn't, aren't, wasn't, don't, nicht, kein, keine, nie, pas, jamais, ni, nunca, no longer, far from, by no means, anything but, nicht mehr, loin de, ni mucho menos",
    REPORT: "said, says, claimed, reported, quoted, wrote, called, sagte, sagt, meinte, dit, disait, selon, dijo, dice, según, according to, in the words of, as quoted, laut aussage, d'après, de acuerdo con",
}

WORD, STEM, AIMED, INNER = (np.uint64(k) for k in range(4))
_TAGS = ~np.uint64(3)
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?;\n"]] = True


@dataclass
class Transducer:
    """Next state and factor by state and class (-1: no arc), starts, and which states accept. Classes are copied."""

    step: np.ndarray
    factor: np.ndarray
    starts: np.ndarray
    final: np.ndarray

    @cached_property
    def padded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """step, factor and final with a row behind the others, which -1 finds, and the states after 0 to REACH + 1 other words."""
        step = np.vstack([self.step, np.full(self.step.shape[1], -1)])
        skip = [np.append(np.arange(len(self.step)), -1)]
        for _ in range(REACH + 1):
            skip.append(step[skip[-1], OTHER])
        return step, np.vstack([self.factor, np.zeros(self.factor.shape[1])]), np.append(self.final, False), np.array(skip)

    def weigh(self, bounds: np.ndarray, place: np.ndarray, kind: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The weight of each clause, whose symbols are those from bounds[i] to bounds[i + 1]; all clauses go a symbol at a time."""
        step, factor, final, skip = self.padded
        sizes = np.diff(bounds)
        order = np.argsort(-sizes, kind="stable")
        falling = -sizes[order]
        state = np.tile(self.starts, (len(sizes), 1))
        total = np.zeros(state.shape)
        for t in range(int(sizes.max(initial=0))):
            live = order[: np.searchsorted(falling, -t, "left")]
            at = bounds[live] + t
            gap = np.minimum(place[at] - place[at - 1] - 1, REACH + 1) if t else np.zeros(len(at), np.int64)
            here, read = skip[gap[:, None], state[live]], kind[at][:, None]
            total[live] += factor[here, read] * weight[at][:, None]
            state[live] = step[here, read]
        return (total * final[state]).sum(axis=1)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """b behind a: states are pairs, factors multiply, and both have to accept."""
    n = len(b.step)
    step = np.where((a.step[:, None] >= 0) & (b.step[None] >= 0), a.step[:, None] * n + b.step[None], -1)
    return Transducer(
        step.reshape(-1, step.shape[2]),
        (a.factor[:, None] * b.factor[None]).reshape(-1, step.shape[2]),
        (a.starts[:, None] * n + b.starts[None]).ravel(),
        (a.final[:, None] & b.final[None]).ravel(),
    )


def foreseen(kind: int, without: dict[int, float], having: dict[int, float]) -> Transducer:
    """Factors by whether the clause has the class anywhere. States: it has none; it will have one; it has had one."""
    step = np.tile(np.arange(3)[:, None], (1, 6))
    step[:, kind] = [-1, 2, 2]
    factor = np.ones((3, 6))
    for row, given in zip(factor, (without, having, having), strict=True):
        for k, x in given.items():
            row[k] = x
    return Transducer(step, factor, np.array([0, 1]), np.array([True, False, True]))


def near(kind: int, reach: int, having: dict[int, float]) -> Transducer:
    """Factors of the classes up to reach words behind one; the state counts the words that are left."""
    step = np.tile(np.maximum(np.arange(reach + 1) - 1, 0)[:, None], (1, 6))
    step[:, kind] = reach
    factor = np.ones((reach + 1, 6))
    for k, x in having.items():
        factor[1:, k] = x
    return Transducer(step, factor, np.array([0]), np.ones(reach + 1, bool))


CLAUSE = reduce(
    compose,
    [
        foreseen(TARGET, {THREAT: 0.0}, {INSULT: ADDRESSED, THREAT: ADDRESSED}),
        foreseen(REPORT, {}, {INSULT: REPORTED, THREAT: REPORTED}),
        near(NEGATION, REACH, {INSULT: DENIED, THREAT: DENIED}),
    ],
)
# targets, negations and reports weigh nothing themselves
CLAUSE.factor[:, [OTHER, TARGET, NEGATION, REPORT]] = 0


@dataclass
class Text:
    """The words of some texts: bytes, spans, words before each row, keys, and which an apostrophe alone parts from the one before."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    keys: np.ndarray
    joined: np.ndarray
    breaks: np.ndarray

    def clause(self, at: np.ndarray) -> np.ndarray:
        """A number for the clause of each word, rising from one clause or row to the next."""
        return np.searchsorted(self.breaks, self.starts[at]) + np.searchsorted(self.bounds, at, "right")

    def stems(self, sizes: range):
        """(positions of the words that are longer, keys of their first bytes) by size."""
        for size in sizes:
            at = np.flatnonzero(self.ends - self.starts > size)
            yield at, words.hashes(self.data, self.starts[at], self.starts[at] + size, True) & _TAGS | STEM


def read(data: np.ndarray, offsets: np.ndarray) -> Text:
    """Words of ASCII letters, digits and other characters; typographic apostrophes count as plain ones, which end a word."""
    at = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80) & (data[2:] == 0x99))
    if len(at):
        data = data.copy()
        data[at[:, None] + np.arange(3)] = 0x27
    starts, ends, bounds = words.spans(data, offsets, words.ALNUM)
    joined = np.zeros(len(starts), bool)
    if len(starts) > 1:
        gap = starts[1:] - ends[:-1]
        joined[1:] = (gap == 1) | (gap == 3)
        joined[bounds[:-1][bounds[:-1] < len(starts)]] = False
        at = np.flatnonzero(joined)
        joined[at] = (data[ends[at - 1]] == 0x27) & (data[starts[at] - 1] == 0x27) & (data[(ends[at - 1] + starts[at]) // 2] == 0x27)
    return Text(data, starts, ends, bounds, words.hashes(data, starts, ends, True) & _TAGS | WORD, joined, np.flatnonzero(_BREAK[data]))


@dataclass
class Lexicon:
    """Arcs, sorted by key, with the state that each leads to; class and weight by state (OTHER: not final)."""

    arcs: np.ndarray
    to: np.ndarray
    kinds: np.ndarray
    weights: np.ndarray
    depth: int
    onward: np.ndarray = field(init=False)
    maybe: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.onward = np.zeros(len(self.kinds), bool)
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.arcs >> np.uint64(46)).astype(np.int64)] = True

    def follow(self, keys: np.ndarray) -> np.ndarray:
        """The state that each arc leads to, -1 where there is none."""
        out = np.full(len(keys), -1)
        some = np.flatnonzero(self.maybe[(keys >> np.uint64(46)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.arcs, keys[some]), len(self.arcs) - 1)
        out[some] = np.where(self.arcs[at] == keys[some], self.to[at], -1)
        return out

    def match(self, text: Text, stems: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, class, weight) of what the texts match, by place; a phrase stands at its last word, its other words are silent."""
        state = self.follow(text.keys)
        first = np.flatnonzero((state >= 0) & self.onward[state])
        opened = state[first]
        state[first[self.kinds[opened] == OTHER]] = -1
        for at, keys in text.stems(stems):
            stem = self.follow(keys)
            old = np.where(state[at] >= 0, self.weights[state[at]], -np.inf)
            better = (stem >= 0) & (self.weights[stem] > old)
            state[at[better]] = stem[better]
        size, found = np.zeros(len(first), np.int64), np.full(len(first), -1)
        alive, clause = np.arange(len(first)), text.clause(first)
        for k in range(1, self.depth):
            alive = alive[first[alive] + k < len(text.keys)]
            alive = alive[text.clause(first[alive] + k) == clause[alive]]
            here, word = opened[alive], first[alive] + k
            after = self.follow(arc(here, text.keys[word], text.joined[word]))
            plain = (after < 0) & text.joined[word]
            after[plain] = self.follow(arc(here[plain], text.keys[word[plain]], np.zeros(plain.sum(), bool)))
            alive, after = alive[after >= 0], after[after >= 0]
            opened[alive] = after
            ends = self.kinds[after] != OTHER
            size[alive[ends]], found[alive[ends]] = k, after[ends]
            alive = alive[self.onward[after]]
        taken = -1
        for i in np.flatnonzero(size).tolist():
            start, end = int(first[i]), int(first[i] + size[i])
            if start > taken:
                state[start:end] = -1
                state[end] = found[i]
                taken = end
        place = np.flatnonzero(state >= 0)
        return place, self.kinds[state[place]], self.weights[state[place]]


def arc(states: np.ndarray, keys: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """The key of the arc from an inner state by a word, with or without an apostrophe before it."""
    return words.mix(keys + words.mix(states.astype(np.uint64) * np.uint64(2) + joined + np.uint64(1))) & _TAGS | INNER


def phrase(text: str) -> Text:
    return read(*words.buffer(pa.array([text])))


def lexicon(learnt: dict[int, tuple[int, float]] | None = None) -> Lexicon:
    """Seeds and learnt entries (key of a word or stem -> class, weight) as one transducer; what is learnt replaces seeds of one word."""
    arcs: dict[int, int] = {}
    kinds, weights, onward, depth = [], [], set(), 1

    def state() -> int:
        kinds.append(OTHER)
        weights.append(0.0)
        return len(kinds) - 1

    for kind, seeds in SEEDS.items():
        for own in seeds.split(", "):
            for form in dict.fromkeys([own, own.replace("'", "")]):
                text, at = phrase(form), -1
                for key, joined in zip(text.keys, text.joined, strict=True):
                    if at >= 0:
                        onward.add(at)
                        key = arc(np.array([at]), np.array([key]), np.array([joined]))[0]
                    at = arcs[int(key)] if int(key) in arcs else arcs.setdefault(int(key), state())
                kinds[at], weights[at] = kind, SEED_WEIGHT
                depth = max(depth, len(text.keys))
    for key, (kind, weight) in (learnt or {}).items():
        at = arcs[key] if key in arcs else arcs.setdefault(key, state())
        kinds[at], weights[at] = kind, weight
    keys = np.array(sorted(arcs), np.uint64)
    out = Lexicon(keys, np.array([arcs[k] for k in keys.tolist()]), np.array(kinds), np.array(weights), depth)
    out.onward[list(onward)] = True
    return out
