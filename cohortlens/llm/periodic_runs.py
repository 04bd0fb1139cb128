"""Runs of words that repeat themselves, found by catching squares as words are appended.

A square is a stretch followed by its copy, q words later. An interval of q >= 2b-1 words holds a whole
aligned block of b words, so at level k every completed block of b = 2^k words is a catcher for the
periods q in [2b-1, 4b-2]: together the levels have every period once. A newly completed window of b words
at t meets exactly two catchers of a level, those that begin between t-4b+2 and t-2b+1. Where window and catcher
are the same words, the comparison is carried on to both sides; words q apart that agree over q words in
all are a square, and squares of one period that touch are one run. A comparison that reaches the last word
stays live and is carried on when the next words come.

Equal windows are found by prefix sums of word numbers times powers, modulo 2^64, and every stretch that they
report is compared word by word before it counts. Work is n log n for n words, memory a few numbers a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import U64, arrow_map, fresh, mix, text_steps

# A run has at least this many words, and twice its period.
LEAST = 12

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
PERIODIC = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("collapsed", T.StringType()),
    ]
)

# An odd multiplier and its inverse modulo 2^64.
POWER = U64(0xD1342543DE82EF95)
INVERSE = U64(pow(int(POWER), -1, 1 << 64))


def _powers(base: U64, start: U64, n: int) -> np.ndarray:
    """start * base, start * base^2, ..."""
    out = np.full(n, base, U64)
    if n:
        out[0] = start * base
    return np.multiply.accumulate(out)


class SquareCatcher:
    """The runs of a growing sequence of word numbers (equal numbers: equal words)."""

    def __init__(self) -> None:
        self.words = np.empty(0, U64)
        self.sums = np.zeros(1, U64)
        self.inverse = np.ones(1, U64)
        self.power = U64(1)
        # Start, end and period of stretches whose words agree with those `period` later; live ones reach the end.
        self.found: dict[tuple[int, int], int] = {}

    def append(self, words: np.ndarray, longest: int | None = None) -> None:
        """Take further words; periods above half of `longest` (all, if None) are known not to occur."""
        if not len(words):
            return
        old = len(self.words)
        with np.errstate(over="ignore"):
            powers = _powers(POWER, self.power, len(words))
            added = np.cumsum(mix(words.astype(U64) + U64(1)) * powers) + self.sums[-1]
            self.inverse = np.concatenate([self.inverse, _powers(INVERSE, self.inverse[-1], len(words))])
        self.power = powers[-1]
        self.words = np.concatenate([self.words, words.astype(U64)])
        self.sums = np.concatenate([self.sums, added])
        n = len(self.words)
        live = [key for key, end in self.found.items() if end == old]
        if live:
            q = np.array([k[0] for k in live])
            start = np.array([k[1] for k in live])
            self._extend(start, np.full(len(live), old), q)
        b = 1
        while 3 * b - 1 <= n and (longest is None or 2 * b - 1 <= longest // 2):
            t = np.arange(max(0, old - b + 1), n - b + 1)
            newest = (t - (2 * b - 1)) // b * b
            windows = self._hash(t, b)
            for s in (newest, newest - b):
                real = np.flatnonzero(s >= 0)
                same = real[self._hash(s[real], b) == windows[real]]
                self._caught(s[same], t[same], b)
            b *= 2

    def _hash(self, at: np.ndarray, length) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[at + length] - self.sums[at]) * self.inverse[at]

    def _caught(self, s: np.ndarray, t: np.ndarray, b: int) -> None:
        """Windows of b words at t that equal the catchers at s."""
        if not len(s):
            return
        q = t - s
        order = np.lexsort((t, q))
        s, t, q = s[order], t[order], q[order]
        # The next window of the same period, and windows inside a known run of a divisor of the period.
        new = np.ones(len(t), bool)
        new[1:] = (q[1:] != q[:-1]) | (t[1:] > t[:-1] + b)
        s, t, q = s[new], t[new], q[new]
        known = self._runs()
        if len(known):
            known = known[np.argsort(known[:, 0], kind="stable")]
            far = np.maximum.accumulate(known[:, 1])
            holder = np.maximum.accumulate(np.where(known[:, 1] == far, np.arange(len(known)), 0))
            at = np.searchsorted(known[:, 0], s, "right") - 1
            inside = (at >= 0) & (far[at] >= t + b) & (q % known[holder[at], 2] == 0)
            s, t, q = s[~inside], t[~inside], q[~inside]
        if len(s):
            left = self._reach(s, t, -1)
            self._extend(s - left, t + b, q)

    def _extend(self, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> None:
        """Carry the comparison of [start, end) with the words q earlier on to the right, and keep what matters."""
        n = len(self.words)
        end = end + self._reach(end - q, end, 1)
        keep = (end - start >= 2 * q) | (end == n)
        for a, e, p in set(zip(start[keep].tolist(), end[keep].tolist(), q[keep].tolist())):
            for first, last in self._checked(a, e, p):
                if self.found.get((p, first), 0) < last:
                    self.found[p, first] = last
        for key in [k for k, e in self.found.items() if e < n and e - k[1] < 2 * k[0]]:
            del self.found[key]

    def _checked(self, start: int, end: int, q: int) -> list[tuple[int, int]]:
        """The stretch itself if its words agree; else (equal sums of different words) its true parts."""
        same = self.words[start : end - q] == self.words[start + q : end]
        if same.all():
            return [(start, end)]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        return [(start + int(a), start + int(e) + q) for a, e in zip(edge[0::2], edge[1::2])]

    def _reach(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        """How many words from a and b on (way 1), or before them (way -1), agree; a < b."""
        room = len(self.words) - b if way > 0 else a
        got = np.zeros(len(a), np.int64)
        step = 1
        active = np.arange(len(a))  # gallop, then close in
        reached = np.zeros(len(a), np.int64)
        while len(active):
            fits = active[got[active] + step <= room[active]]
            ok = fits[self._agree(a[fits], b[fits], got[fits], step, way)]
            got[ok] += step
            reached[ok] = step
            active = ok
            step *= 2
        step //= 2
        while step:
            fits = np.flatnonzero(got + step <= room)
            ok = fits[self._agree(a[fits], b[fits], got[fits], step, way)]
            got[ok] += step
            step //= 2
        return got

    def _agree(self, a, b, done, step, way) -> np.ndarray:
        if way > 0:
            return self._hash(a + done, step) == self._hash(b + done, step)
        return self._hash(a - done - step, step) == self._hash(b - done - step, step)

    def _runs(self) -> np.ndarray:
        """(start, end, period) of stretches that are at least two periods long."""
        rows = [(a, e, p) for (p, a), e in self.found.items() if e - a >= 2 * p]
        return np.array(rows, np.int64).reshape(-1, 3)

    def runs(self, least: int = LEAST) -> np.ndarray:
        """(start, end, smallest period) of all runs of at least `least` words, by start and period."""
        rows = self._runs()
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
        kept, shorter = [], {}
        for a, e, p in rows.tolist():
            # A multiple of a period has the same run, or an earlier state of it.
            here = shorter.setdefault(a, [])
            if not any(p % d == 0 and e <= end for end, d in here):
                here.append((e, p))
                kept.append((a, e, p))
        rows = np.array(kept, np.int64).reshape(-1, 3)
        return rows[rows[:, 1] - rows[:, 0] >= least]


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """The runs of each list of words, by word number.

    All lists are one sequence; a word of its own between two of them keeps runs from crossing.
    """
    if not texts:
        return []
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    known: dict[bytes, int] = {}
    number = known.setdefault
    ids = np.empty(starts[-1], np.int64)
    for a, words in zip(starts, texts):
        ids[a : a + len(words)] = np.fromiter((number(w, len(known)) for w in words), np.int64, len(words))
    ids[starts[1:] - 1] = len(known) + np.arange(len(texts))
    catcher = SquareCatcher()
    catcher.append(ids, int(sizes.max()))
    rows = catcher.runs(least)
    cuts = np.searchsorted(rows[:, 0], starts)
    return [rows[i:j] - np.array([a, a, 0]) for a, i, j in zip(starts, cuts[:-1], cuts[1:])]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, of each run only the first period."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
    return b" ".join([words[i] for i in kept])


def find(docs: DataFrame, text: str = "text", name: str = "periodic", least: int = LEAST) -> DataFrame:
    """All rows and columns of `docs`, and a struct `name`: n_words, runs, collapsed.

    Words are runs of characters other than ASCII white space, compared as they are. `runs` lists
    (start, length, period) of every maximal stretch with smallest period q and at least max(`least`, 2q) words, by start,
    then period; `collapsed` is the text with only the first period of each run, words joined by one space. A
    null or empty text has no words, no runs and an empty collapsed text. Repeated rows are treated alike; columns
    of `docs` keep their names, and `name` must be a new one. A long text is one piece of work, in n log n time.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(name, PERIODIC)])
    fields = pa.struct(
        [("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(f, pa.int64()) for f in RUN.names]))), ("collapsed", pa.string())]
    )
    work = fresh(docs, "searched_text")

    def run(batches):
        for batch in batches:
            for at, texts in text_steps(batch.column(batch.num_columns - 1)):
                split = [t.split() for t in texts]
                rows = []
                for words, runs in zip(split, runs_of(split, least)):
                    listed = [{"start": a, "length": e - a, "period": q} for a, e, q in runs.tolist()]
                    rows.append({"n_words": len(words), "runs": listed, "collapsed": collapse(words, runs).decode()})
                out = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*out.columns[:-1], pa.array(rows, fields)], names=[*out.schema.names[:-1], name]
                )

    return arrow_map(docs.withColumn(work, F.col(text)), run, schema)
