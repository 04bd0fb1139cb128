"""Best-fit-decreasing packing of token pieces into sequences.

Pieces of equal length are interchangeable, so the plan is made from the number of pieces of each
length (at most `size` numbers, however many documents there are): longest first, into the open bins
of the least sufficient room, which a segment tree over the capacities finds in logarithmic time.
Runs of equal placements are kept together. Each piece then finds its place from its rank among the
pieces of its length; ranks are counted in hash buckets, so no task holds a whole length.
"""

from __future__ import annotations

import json
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm.common import arrow_map, fresh, text_steps
from cohortlens.session import stored

SIZE = 2048
END_ID = 0
# Rows that one ranking task holds, about, and bytes of ids: all pieces may have one length.
RANK_ROWS = 500_000
RANK_BYTES = 32 << 20
# How a byte-level BPE vocabulary splits text before its merges (a fixed value of its format).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordIds:
    """Ids of texts as little-endian 32-bit numbers, by the vocabulary of a `tokenizers` file.

    A byte-level BPE file whose ids follow its merges is a table of ranks, which `tiktoken` encodes
    to the same ids in a third of the time. Other files, and texts that hold a special
    token, are encoded by `tokenizers` itself.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.fast = self._ranked(held, set(added)) if self._is_plain(held) else None

    @staticmethod
    def _is_plain(held: dict) -> bool:
        model, before = held["model"], held["pre_tokenizer"] or {}
        return (
            model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space") and held["normalizer"] is None
            and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
        )

    @staticmethod
    def _ranked(held: dict, added: set[int]) -> tiktoken.Encoding | None:
        vocabulary, byte_of = held["model"]["vocab"], _byte_of()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
        ids = [vocabulary["".join(m)] for m in pairs]
        if ids != sorted(ids):
            return None
        ranks = {bytes(byte_of[c] for c in w): i for w, i in vocabulary.items() if i not in added}
        return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.fast is None:
            return self._encode(texts)
        return [
            self._encode([t])[0] if any(s in t for s in self.special) else array("I", self.fast.encode_ordinary(t)).tobytes()
            for t in texts
        ]


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def cut_points(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, the first holds what is left over."""
    first = n % size or min(n, size)
    return [(0, first)] + [(a, size) for a in range(first, n, size)]


def token_pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32) of the pieces of every document.

    A document is the ids of its text (null: empty) and then END_ID, so none is without a piece.
    `ids` are little-endian unsigned 32-bit numbers.
    """

    def run(batches):
        encode = word_ids(tokenizer)
        for batch in batches:
            for start, texts in text_steps(batch.column(1)):
                row, piece, begin, length, ids = [], [], [], [], []
                for i, tokens in enumerate(encode([t.decode() for t in texts]), start):
                    tokens += END_ID.to_bytes(4, "little")
                    for k, (a, n) in enumerate(cut_points(len(tokens) // 4, size)):
                        row.append(i)
                        piece.append(k)
                        begin.append(a)
                        length.append(n)
                        ids.append(tokens[4 * a : 4 * (a + n)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(begin, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids", "ids_crc32"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return arrow_map(
        docs.select(F.col(doc_id).alias("doc_id"), text),
        run,
        f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, ids_crc32 bigint",
    )


class RoomTree:
    """A segment tree over the capacities 0..size: which hold open bins, and the least one from a wanted room on."""

    def __init__(self, size: int):
        self.base = 1 << (size + 1).bit_length()
        self.used = [0] * (2 * self.base)

    def set(self, room: int, is_open: bool) -> None:
        i = self.base + room
        self.used[i] = int(is_open)
        while i > 1:
            i //= 2
            self.used[i] = self.used[2 * i] | self.used[2 * i + 1]

    def least(self, room: int) -> int | None:
        """The least capacity of `room` or more with an open bin."""
        i = self.base + room
        if self.used[i]:
            return room
        while i > 1 and not (i % 2 == 0 and self.used[i + 1]):
            i //= 2
        if i <= 1:
            return None
        i += 1
        while i < self.base:
            i = 2 * i if self.used[2 * i] else 2 * i + 1
        return i - self.base


@dataclass
class Plan:
    """Runs of placements: pieces of `length` from rank `rank` on, `each` to a bin, from `bin` and `offset` on."""

    size: int
    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    bins: int = 0

    def add(self, *values: int) -> None:
        for name, v in zip(("length", "rank", "each", "bin", "offset"), values):
            getattr(self, name).append(v)


def best_fit(counts: dict[int, int], size: int = SIZE) -> Plan:
    """Best-fit decreasing over {length: number of pieces}: the bins that placing one by one gives.

    `open_bins` maps a room to runs (first bin, number of bins) that have it. Of bins with equal
    room the ones opened last are filled first.
    """
    plan, tree = Plan(size), RoomTree(size)
    open_bins: dict[int, list[tuple[int, int]]] = {}

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            runs = open_bins.setdefault(room, [])
            if not runs:
                tree.set(room, True)
            runs.append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.least(length)
            if room is None:
                room, first, n = size, plan.bins, -(-left // (size // length))
                plan.bins += n
            else:
                runs = open_bins[room]
                first, n = runs.pop()
                if not runs:
                    tree.set(room, False)
            each = room // length
            full = min(n, left // each)
            if full:
                plan.add(length, rank, each, first, size - room)
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            rest = n - full
            if rest and left and left < each:  # the last pieces share one more bin
                plan.add(length, rank, each, first + full, size - room)
                put(room - left * length, first + full, 1)
                rank, left, full, rest = rank + left, 0, full + 1, rest - 1
            put(room, first + full, rest)
    return plan


def place(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """`pieces` (doc_id, piece, start, length, ids_crc32, ...) with sequence_id and offset.

    Pieces of one length are ordered by hash bucket, doc_id, piece, start and checksum; pieces equal in all of
    these are interchangeable. `pieces` is read several times and should be a written table.
    """
    order = ["doc_id", "piece", "start", "ids_crc32"]
    bucket, rank = fresh(pieces, "bucket"), fresh(pieces, "rank")
    held = pieces.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
    id_bytes = 4 * held["tokens"] if "ids" in pieces.columns else 0
    n_buckets = max(1, -(-held["rows"] // RANK_ROWS), -(-id_bytes // RANK_BYTES))
    dealt = pieces.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(n_buckets)).cast("int"))
    counted = dealt.groupBy("length", bucket).agg(F.count(F.lit(1)).alias("n"))
    # At most `size` lengths: the number of pieces of each.
    totals = {int(r[0]): int(r[1]) for r in counted.groupBy("length").agg(F.sum("n")).collect()}
    plan = best_fit(totals, size)
    before = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("length", bucket).orderBy(*order))
    ranked = dealt.withColumn(rank, own - 1).join(starts, ["length", bucket]).withColumn(rank, F.col(rank) + F.col("first"))
    ranked = ranked.select(*pieces.columns, rank)
    # The runs of the plan in the order of (length, rank); their number depends on the lengths only.
    run_length = np.array(plan.length, np.int64)
    run_rank, run_each = np.array(plan.rank, np.int64), np.array(plan.each, np.int64)
    run_bin, run_offset = np.array(plan.bin, np.int64), np.array(plan.offset, np.int64)
    by = np.lexsort((run_rank, run_length))
    top = int(run_rank.max()) + 1 if len(by) else 1
    shared = pieces.sparkSession.sparkContext.broadcast(
        ((run_length * top + run_rank)[by], run_rank[by], run_each[by], run_bin[by], run_offset[by], top)
    )
    at_length = pieces.columns.index("length")

    def run(batches):
        for batch in batches:
            key, first, each, bins, offset, most = shared.value
            length = batch.column(at_length).to_numpy()
            own_rank = batch.column(batch.num_columns - 1).to_numpy()
            i = np.searchsorted(key, length * most + np.minimum(own_rank, most - 1), "right") - 1
            along = own_rank - first[i]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(bins[i] + along // each[i]),
                    pa.array(offset[i] + along % each[i] * length),
                ],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return arrow_map(ranked, run, f"{kinds}, sequence_id bigint, offset bigint")


def pack(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, with_ids: bool = True
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Every document is packed, repeated rows as often as they occur; an empty table gives no rows.
    """
    pieces = token_pieces(docs, tokenizer, doc_id, text, size)
    return place(stored(pieces if with_ids else pieces.drop("ids"), "pieces"), size)
