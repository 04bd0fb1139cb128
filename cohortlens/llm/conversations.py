"""Repair the structure of conversations at the least cost.

The roles of a repaired conversation spell (s?(ua)+)?: perhaps a system turn, then user and assistant in turn.
Each row is kept (0), given another role (2) or deleted (3, the only choice for blank and repeated rows); an
empty user or assistant turn may be inserted anywhere (2); a truncated row that stays costs 1 more. Among the cheapest
repairs the one with the ASCII-least letters (D, I, K, R) counts.

Cost and letters are one integer: the cost in the high digits, below it for every row two base-8 digits at a fixed place,
I and the row's letter if a turn is inserted before it, else its letter twice, and a last digit for an insertion
at the end, zero without one. Two letter sequences differ first where these digits differ first, and in the same
sense, so the least integer over the paths of a small graph (rows x four states) is the least cost and, of
those, the least letters. One insertion before a row is enough: two in one place bring the state back, or stand after a
system turn that is cheaper to delete; and one before a deletion comes later in ASCII than one behind it.

Paths over consecutive rows compose, so a conversation may lie in any number of tasks: rows without their texts
are sorted by range, each task finds the least integers between all states of its part, and the parts are joined.
Only the repaired text itself goes through one task a conversation, row by row, as its digest must.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortlens.llm.common import arrow_map
from cohortlens.session import join_on, stored

# Letters in ASCII order; their digits are 1 to 4, and 0 is the padding at the end.
LETTERS = "DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1
DIGIT_BITS = 3
ROW_BITS = 2 * DIGIT_BITS
# Nothing yet, after the system turn, after a user turn, after an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {
    EMPTY: {"s": SYSTEM, "u": USER},
    SYSTEM: {"u": USER},
    USER: {"a": ASSISTANT},
    ASSISTANT: {"u": USER},
}
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
# Rows of a block whose integers grow row by row; blocks are joined pairwise.
BLOCK_ROWS = 64

Paths = list[list[int | None]]


def _moves(initial: str, truncated: bool) -> list[list[tuple[int, int, int]]]:
    """From every state: (state, cost, digits) of all edits of a row that need not go."""
    out = []
    late = TRUNCATED_COST if truncated else 0
    for state in range(4):
        moves = [(state, DELETE_COST, DELETE << DIGIT_BITS | DELETE)]
        befores = [(state, 0, None)] + [
            (NEXT[state][r], INSERT_COST, INSERT) for r in NAMES if r in NEXT[state]
        ]
        for at, cost, inserted in befores:
            for role, to in NEXT[at].items():
                for letter, price in ((KEEP, KEEP_COST), (REROLE, REROLE_COST)):
                    if (role == initial) if letter == KEEP else (role in NAMES):
                        digits = (inserted or letter) << DIGIT_BITS | letter
                        moves.append((to, cost + price + late, digits))
        out.append(moves)
    return out


MOVES = {(i, late): _moves(i, late) for i in ("s", "u", "a", "") for late in (False, True)}


def _least(a: int | None, b: int) -> int:
    return b if a is None or b < a else a


class Part:
    """The least integers from each of `starts` to every state over rows added one after the other."""

    def __init__(self, starts: tuple[int, ...]) -> None:
        self.bits, self.rows = 0, 0
        self.paths: Paths = [[0 if s == t and s in starts else None for t in range(4)] for s in range(4)]

    def add(self, initial: str, truncated: bool) -> None:
        moves = MOVES[initial if initial in ("s", "u", "a") else "", truncated]
        bits = self.bits + ROW_BITS
        for s, row in enumerate(self.paths):
            new: list[int | None] = [None] * 4
            for at, weight in enumerate(row):
                if weight is not None:
                    for to, cost, digits in moves[at]:
                        new[to] = _least(new[to], (weight << ROW_BITS) + (cost << bits) + digits)
            self.paths[s] = new
        self.bits, self.rows = bits, self.rows + 1

    def delete(self, rows: int) -> None:
        """Rows that have to go: they leave every state as it is."""
        wide = ROW_BITS * rows
        digits = DELETE * (((1 << wide) - 1) // ((1 << DIGIT_BITS) - 1))
        bits = self.bits + wide
        for row in self.paths:
            for t, weight in enumerate(row):
                if weight is not None:
                    row[t] = (weight << wide) + (DELETE_COST * rows << bits) + digits
        self.bits, self.rows = bits, self.rows + rows


def joined(a: tuple[int, Paths], b: tuple[int, Paths]) -> tuple[int, Paths]:
    """Paths over the rows of one part and then the other."""
    (low, first), (wide, second) = a, b
    bits, mask = low + wide, (1 << wide) - 1
    out: Paths = [[None] * 4 for _ in range(4)]
    for s, row in enumerate(first):
        for at, weight in enumerate(row):
            if weight is not None:
                for t, more in enumerate(second[at]):
                    if more is not None:
                        sum_ = (weight << wide) + (more >> wide << bits) + (more & mask)
                        out[s][t] = _least(out[s][t], sum_)
    return bits, out


class Parts:
    """Consecutive rows; full blocks wait in a stack of ever smaller ones, so joining stays balanced."""

    def __init__(self, starts: tuple[int, ...]) -> None:
        self.open, self.full = Part(starts), []

    def room(self) -> Part:
        if self.open.rows >= BLOCK_ROWS:
            self._close()
            self.open = Part((EMPTY, SYSTEM, USER, ASSISTANT))
        return self.open

    def _close(self) -> None:
        part = (self.open.bits, self.open.paths)
        while self.full and self.full[-1][0] <= 2 * part[0]:
            part = joined(self.full.pop(), part)
        self.full.append(part)

    def total(self) -> tuple[int, Paths]:
        part = (self.open.bits, self.open.paths)
        for before in reversed(self.full):
            part = joined(before, part)
        return part


def finish(bits: int, paths: Paths) -> tuple[int, str]:
    """The least cost of a whole conversation, and its letters."""
    ends = [(EMPTY, 0, 0), (ASSISTANT, 0, 0), (USER, INSERT_COST, INSERT)]
    total = bits + DIGIT_BITS
    best = min(
        (paths[EMPTY][s] << DIGIT_BITS) + (cost << total) + digit
        for s, cost, digit in ends
        if paths[EMPTY][s] is not None
    )
    # Base-8 digits of the letters, the highest first, without the cost above them.
    digits = f"{best & ((1 << total) - 1):0{total // DIGIT_BITS}o}"
    audit = []
    for i in range(0, len(digits) - 1, 2):
        before, own = digits[i], digits[i + 1]
        if int(before) == INSERT:
            audit.append(LETTERS[INSERT - 1])
        audit.append(LETTERS[int(own) - 1])
    if int(digits[-1]) == INSERT:
        audit.append(LETTERS[INSERT - 1])
    return best >> total, "".join(audit)


def replay(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of every turn of the repaired conversation, from its rows in order."""
    state = EMPTY

    def given() -> str:
        nonlocal state
        role = "a" if state == USER else "u"
        state = NEXT[state][role]
        return NAMES[role]

    for letter in audit:
        if letter == "I":
            yield letter, given(), ""
            continue
        role, text = next(rows)
        if letter == "R":
            yield letter, given(), text
        elif letter == "K":
            state = NEXT[state][role[:1]]
            yield letter, role, text


SEGMENT = (
    "n_blank long, n_duplicate long, n_truncated long, n_illegal long, first string, last string,"
    " low string, high string, n_turns long, bits long, paths array<binary>"
)
FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PLAN = ("turn", "role", "digest")


def _number(value: int | None) -> str | None:
    return None if value is None else str(int(value))


class Segment:
    """The rows of one conversation that one task has, in order."""

    def __init__(self, starts: tuple[int, ...]) -> None:
        self.parts = Parts(starts)
        self.counts = [0, 0, 0, 0]
        self.first = self.last = self.low = self.high = None
        self.turns = 0

    def add(self, turn, initial: str, blank: bool, cut: bool, later: bool, n: int) -> None:
        """`n` equal rows; `later` ones have the role and text of an earlier turn."""
        fresh_row = not (blank or later)
        if self.last is not None and self.last + initial not in LEGAL:
            self.counts[3] += 1
        if n > 1 and initial * 2 not in LEGAL:
            self.counts[3] += n - 1
        if fresh_row:
            self.parts.room().add(initial, cut)
        self.counts[0] += n * blank
        self.counts[1] += (n - fresh_row) * (not blank)
        self.counts[2] += fresh_row and cut
        if n > fresh_row:
            self.parts.room().delete(n - fresh_row)
        if self.first is None:
            self.first = initial
        self.last = initial
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += self.high != turn
            self.high = turn

    def row(self) -> dict:
        bits, paths = self.parts.total()
        made = [None if w is None else w.to_bytes((w.bit_length() + 7) // 8, "big") for row in paths for w in row]
        names = ("n_blank", "n_duplicate", "n_truncated", "n_illegal")
        return {
            **dict(zip(names, self.counts)), "first": self.first, "last": self.last,
            "low": _number(self.low), "high": _number(self.high), "n_turns": self.turns, "bits": bits, "paths": made,
        }


def _segments(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for every conversation of a task. Its first one may have begun in the task before."""
    starts: tuple[int, ...] = (EMPTY, SYSTEM, USER, ASSISTANT)
    held, key = None, None
    for batch in batches:
        rows, done = batch.to_pylist(), []
        for r in rows:
            if held is None or r["conv"] != key[0]:
                if held is not None:
                    done.append({"conv": key[0], **dict(zip(_PLAN, key[1:])), **held.row()})
                    starts = (EMPTY,)
                held, key = Segment(starts), (r["conv"], r["turn"], r["role"], r["digest"])
            held.add(r["turn"], r["role"][:1], r["blank"], r["cut"], r["later"], r["n"])
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if held is not None:
        yield pa.RecordBatch.from_pylist([{"conv": key[0], **dict(zip(_PLAN, key[1:])), **held.row()}], schema)


def _merged(parts: Iterator[dict]) -> tuple[dict, str]:
    """Counts, cost and letters of a conversation from its parts in order."""
    out = {k: 0 for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    whole, last, low, high, turns = [], None, None, None, 0
    for p in parts:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            out[name] += p[f"n_{name}"]
        out["illegal"] += last is not None and last + p["first"] not in LEGAL
        last = p["last"]
        if p["low"] is not None:
            turns += p["n_turns"] - (high == p["low"])
            low, high = p["low"] if low is None else low, p["high"]
        made = [None if b is None else int.from_bytes(b, "big") for b in p["paths"]]
        part = (p["bits"], [made[i : i + 4] for i in range(0, 16, 4)])
        while whole and whole[-1][0] <= 2 * part[0]:
            part = joined(whole.pop(), part)
        whole.append(part)
    if not whole:
        return out, ""
    total = whole.pop()
    while whole:
        total = joined(whole.pop(), total)
    out["cost"], audit = finish(*total)
    if low is not None:
        out["gaps"] = int(high) - int(low) + 1 - turns
    return out, audit


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _texts(rows: Iterator[dict]) -> Iterator[tuple[str, str]]:
    for r in rows:
        for _ in range(r["n"]):
            yield r["role"], r["text"]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, dict, str, Iterator[tuple[str, str]]]]:
    """Conversation, its facts and letters, and its rows, which have to be read before the next one."""
    for conv, rows in groupby(_streamed(batches), lambda r: r["conv"]):
        following: list[dict] = []

        def parts(rows=rows, following=following):
            for r in rows:
                if r["kind"] == 2:
                    following.append(r)
                    return
                if r["kind"] == 1:
                    yield r["part"]

        facts, audit = _merged(parts())

        def texts(rows=rows, following=following):
            yield from following
            yield from rows

        yield conv, facts, audit, _texts(texts())


def _prepared(df: DataFrame, conv: str, turn: str, role: str, text: str, copies: Column | None) -> DataFrame:
    """One row per row, null roles and texts as one space, with what the plan needs instead of the text."""
    shown = df.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        (F.lit(1) if copies is None else copies).cast("long").alias("n"),
    )
    return shown.withColumns(
        {
            "digest": F.unhex(F.md5(F.col("text").cast("binary"))),
            "blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"),
            "cut": ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"),
        }
    )


def _laid_out(df: DataFrame, conv: str, turn: str, role: str, text: str, copies: Column | None) -> DataFrame:
    """Per conversation, in one task and in order: a head, its plan's parts, its rows."""
    rows = _prepared(df, conv, turn, role, text, copies)
    present = rows.where(F.col("n") > 0)
    units = stored(
        present.groupBy("conv", *_PLAN, "blank", "cut").agg(F.sum("n").alias("n")), "conversation-rows"
    )
    at = F.struct(F.col("turn").isNotNull().alias("k"), F.coalesce("turn", F.lit(0)).alias("t"))
    firsts = units.groupBy("conv", "role", "digest").agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_n"))
    # Only texts that a conversation has at several turns matter, and they are few or pre-aggregated.
    firsts = firsts.where(F.col("_n") > 1).drop("_n")
    units = join_on(units, firsts, ["conv", "role", "digest"], "left")
    units = units.withColumn("later", F.col("_first").isNotNull() & (F.col("_first") != at)).drop("_first")
    order = ["conv", *_PLAN]
    planned = units.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = T.StructType([units.schema[c] for c in order] + T.StructType.fromDDL(SEGMENT).fields)
    kinds = T.StructType([T.StructField(f.name, f.dataType) for f in kinds])
    arrow = to_arrow_schema(kinds)
    parts = arrow_map(planned, lambda batches: _segments(batches, arrow), kinds)
    empty = lambda name, kind: F.lit(None).cast(kind).alias(name)
    part_kind = T.StructType(kinds.fields[len(order) :])
    turn_kind = units.schema["turn"].dataType
    heads = df.select(F.col(conv).alias("conv")).distinct()
    layout = [
        heads.select("conv", F.lit(0).alias("kind"), empty("turn", turn_kind), empty("role", "string"),
                     empty("digest", "binary"), empty("text", "string"), empty("n", "long"), empty("part", part_kind)),
        parts.select("conv", F.lit(1).alias("kind"), *_PLAN, empty("text", "string"), empty("n", "long"),
                     F.struct(*[f.name for f in part_kind]).alias("part")),
        present.select("conv", F.lit(2).alias("kind"), *_PLAN, "text", "n", empty("part", part_kind)),
    ]
    every = layout[0].unionByName(layout[1]).unionByName(layout[2])
    return every.repartition("conv").sortWithinPartitions("conv", "kind", *_PLAN)


def repair(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    copies: Column | None = None,
) -> DataFrame:
    """One row per conversation: its faults, the cheapest repair and a digest of the repaired conversation.

    Rows stand in order of turn (nulls first); equal turns in order of role and the text's MD5. `copies` says how often a
    row counts (adjacent repetitions, 0: the row is gone; its conversation is listed all the same). Null roles
    and texts are one space; a null conversation is one like others; a role that is empty or begins with another letter
    than s, u, a cannot be kept. A row is blank, else duplicate (role and text of an earlier row), else truncated (no
    `.!?` at its end). Columns: the conversation, gaps (turn numbers missing between the lowest and the highest), blank, duplicate,
    truncated, illegal (neighbours whose roles may not follow each other), cost, audit (a letter per edit),
    repaired_sha256 (lines `role:text`). Without rows: zeros, empty letters, digest of the empty text. Other
    columns are not read. An empty table gives none.
    """
    schema = T.StructType([T.StructField(conv, df.schema[conv].dataType)] + T.StructType.fromDDL(FACTS).fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        done = []
        for key, facts, audit, rows in _conversations(batches):
            hash_, between = hashlib.sha256(), b""
            for _, r, t in replay(audit, rows):
                hash_.update(between + f"{r}:{t}".encode())
                between = b"\n"
            done.append({conv: key, **facts, "audit": audit, "repaired_sha256": hash_.hexdigest()})
            if len(done) == 1000:
                yield pa.RecordBatch.from_pylist(done, arrow)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist(done, arrow)

    return arrow_map(_laid_out(df, conv, turn, role, text, copies), run, schema)


def repaired(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    copies: Column | None = None,
) -> DataFrame:
    """The repaired conversations themselves: conversation, place (from 0), edit (K, R or I), role, text.

    Order, nulls and ties as in `repair`. A conversation of which nothing stays has no rows.
    """
    schema = T.StructType(
        [T.StructField(conv, df.schema[conv].dataType)]
        + T.StructType.fromDDL("place long, edit string, role string, text string").fields
    )
    arrow = to_arrow_schema(schema)

    def run(batches):
        done = []
        for key, _, audit, rows in _conversations(batches):
            for place, (letter, r, t) in enumerate(replay(audit, rows)):
                done.append({conv: key, "place": place, "edit": letter, "role": r, "text": t})
                if len(done) == 1000:
                    yield pa.RecordBatch.from_pylist(done, arrow)
                    done = []
        if done:
            yield pa.RecordBatch.from_pylist(done, arrow)

    return arrow_map(_laid_out(df, conv, turn, role, text, copies), run, schema)
