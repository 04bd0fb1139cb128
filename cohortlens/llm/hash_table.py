"""Sorted hash arrays in the shared folder: summed in Spark by key range, memory-mapped by the workers.

A table maps 64-bit keys to a few whole numbers. Its shards hold ranges of the key (its highest
bits); a shard is its sorted keys and one file of bytes for each column, with a list of the values of 255 or more.
Of a key only the lowest 48 bits are stored: the highest 16 or more follow from the shard and its list of buckets.
"""

from __future__ import annotations

import os
import urllib.parse
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm.common import U64, arrow_map
from cohortlens.session import shared_dir

# Entries that a task combines before it sends them on.
HELD = 2_000_000
# Bytes of text whose entries one shard holds, about.
SHARD_TEXT = 32 << 20


def mapped_dir(spark: SparkSession, name: str) -> str:
    """A new folder for mapped files. The shared folder must be a mounted one: workers map its files."""
    at = urllib.parse.urlparse(shared_dir(spark))
    if at.scheme not in ("", "file"):
        raise RuntimeError(f"memory-mapped tables need a mounted shared folder, not {at.scheme}:")
    path = f"{urllib.parse.unquote(at.path)}/{name}-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def shard_bits(text_bytes: int) -> int:
    """Bits of the shard number, so that a shard's share of the entries fits a task easily."""
    return max(0, int(text_bytes // SHARD_TEXT).bit_length())


def _planes(values: np.ndarray) -> bytes:
    """Compressed by byte planes: equal bytes of neighbouring numbers vanish."""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)


def _numbers(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as the steps from one to the next, whose high bytes are zero."""
    return _planes(np.diff(keys, prepend=U64(0)))


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data, U64), dtype=U64)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the order of the rows, and where in it each key begins."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    return keys[first], order, first


def _sums(column: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(column[order], first).astype(column.dtype, copy=False) if len(first) else column


def combine(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their rows of values; a column at a time, as values may be wide."""
    keys, order, first = _groups(keys)
    out = np.empty((len(keys), values.shape[1]), values.dtype)
    for j in range(values.shape[1]):
        out[:, j] = _sums(values[:, j], order, first)
    return keys, out


def _top_bits(rows: int, bits: int) -> int:
    """Bits after the shard's that number the buckets of a shard: about eight rows each, and 16 bits known at least."""
    return max(0, 16 - bits, (rows // 8).bit_length())


def _buckets(keys: np.ndarray, bits: int, top: int) -> np.ndarray:
    return ((keys << U64(bits)) >> U64(64 - top)).astype(np.int64) if top else np.zeros(len(keys), np.int64)


def _write(path: str, array: np.ndarray) -> None:
    """Written beside and renamed: a task that runs twice leaves one whole file."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, path)


def gather(
    texts: DataFrame, emit: Callable[[list[bytes]], Iterator[tuple[str, np.ndarray, np.ndarray]]],
    steps: Callable, folder: str, bits: int,
) -> DataFrame:
    """Sum what `emit` yields for lists of texts, (table, keys, values), and write it as tables in `folder`.

    Tasks combine equal keys before the shuffle; a key, however frequent, comes once from each
    combination. Returns per table and shard how often the first column is not zero, the sums of the first and the
    second column (zero without one), and how often the first is one, two, three and four; taking that result runs the
    work. Sums are rounded.
    """

    def send(name: str, parts: list) -> Iterator[pa.RecordBatch]:
        keys, order, first = _groups(np.concatenate([k for k, _ in parts]))
        kind = parts[0][1].dtype
        columns = [_sums(np.concatenate([v[:, j] for _, v in parts]), order, first) for j in range(parts[0][1].shape[1])]
        shard = (keys >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(keys) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            body = [_planes(c[a:b]) for c in columns]
            yield pa.RecordBatch.from_pydict(
                {"name": [name], "shard": pa.array([int(shard[a])]), "keys": [_pack(keys[a:b])],
                 "body": pa.array([body], pa.list_(pa.binary())),
                 "kind": [kind.str]}
            )

    def run(batches):
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for _, some in steps(batch.column(0)):
                for name, keys, values in emit(some):
                    held.setdefault(name, []).append(combine(keys, values))
                    sizes[name] = sizes.get(name, 0) + len(held[name][-1][0])
                    if sizes[name] > HELD:
                        yield from send(name, held.pop(name))
                        sizes[name] = 0
        for name, parts in held.items():
            yield from send(name, parts)

    def merge(table: pa.Table) -> pa.Table:
        name, shard = table.column("name")[0].as_py(), table.column("shard")[0].as_py()
        keys, order, first = _groups(np.concatenate([_unpack(k) for k in table.column("keys").to_pylist()]))
        bodies, kinds = table.column("body").to_pylist(), table.column("kind").to_pylist()
        stem = f"{folder}/{name}-{shard}"
        sums, ones = [], {}
        for j in range(len(bodies[0])):  # one column at a time in memory
            column = np.concatenate([_numbers(body[j], kind).astype(float) for body, kind in zip(bodies, kinds)])
            column = np.rint(_sums(column, order, first)).astype(np.int64)
            big = np.flatnonzero(column >= 255)
            _write(f"{stem}-{j}.npy", np.minimum(column, 255).astype(np.uint8))
            _write(f"{stem}-{j}-big.npy", np.stack([big, column[big]]))
            sums.append(int(column.sum()))
            if j == 0:
                ones = {"known": [int((column > 0).sum())], **{f"n{k}": [int((column == k).sum())] for k in (1, 2, 3, 4)}}
        top = _top_bits(len(keys), bits)
        _write(f"{stem}-low.npy", keys.astype(np.uint16))
        _write(f"{stem}-middle.npy", (keys >> U64(16)).astype(np.uint32))
        _write(f"{stem}-starts.npy", np.searchsorted(_buckets(keys, bits, top), np.arange((1 << top) + 1)).astype(np.uint32))
        row = {"name": [name], "shard": [shard], "known": ones["known"], "first": [sums[0]], "second": [sum(sums[1:2])]}
        return pa.table(row | {k: v for k, v in ones.items() if k != "known"})

    sent = arrow_map(texts, run, "name string, shard bigint, keys binary, body array<binary>, kind string")
    return sent.groupBy("name", "shard").applyInArrow(
        merge, "name string, shard bigint, known bigint, first bigint, second bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint"
    )


class Table:
    """Looks keys up in the mapped shards of a table; missing keys have zeros."""

    def __init__(self, folder: str, name: str, bits: int, columns: int):
        self.stem, self.bits, self.columns = f"{folder}/{name}", bits, columns
        self.shards: dict[int, tuple | None] = {}

    def _shard(self, i: int):
        if i not in self.shards:
            stem = f"{self.stem}-{i}"
            if os.path.exists(f"{stem}-starts.npy"):
                load = lambda p: np.load(p, mmap_mode="r")
                self.shards[i] = (
                    (load(f"{stem}-starts.npy"), load(f"{stem}-middle.npy"), load(f"{stem}-low.npy")),
                    [(load(f"{stem}-{j}.npy"), np.load(f"{stem}-{j}-big.npy")) for j in range(self.columns)],
                )
            else:
                self.shards[i] = None
        return self.shards[i]

    def _hits(self, held: tuple, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys the shard holds, and where: bisection in their buckets."""
        starts, middle, low = held
        value = lambda at: middle[at].astype(U64) << U64(16) | low[at]
        bucket, want = _buckets(asked, self.bits, (len(starts) - 1).bit_length() - 1), asked & U64((1 << 48) - 1)
        a, b = starts[bucket].astype(np.int64), starts[bucket + 1].astype(np.int64)
        end = b
        while (some := np.flatnonzero(a < b)).size:
            mid = (a[some] + b[some]) >> 1
            less = value(mid) < want[some]
            a, b = a.copy(), b.copy()
            a[some[less]], b[some[~less]] = mid[less] + 1, mid[~less]
        inside = np.flatnonzero(a < end)
        hit = inside[value(a[inside]) == want[inside]]
        return hit, a[hit]

    def get(self, keys: np.ndarray, *wanted: int) -> np.ndarray:
        """One row for each key: the numbers of the wanted columns (none named: of all)."""
        wanted = wanted or tuple(range(self.columns))
        asked, where = np.unique(keys, return_inverse=True)
        out = np.zeros((len(asked), len(wanted)), np.int64)
        number = (asked >> U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(asked), np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]])) if len(asked) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            shard = self._shard(int(number[a]))
            if shard is None:
                continue
            held, columns = shard
            hit, at = self._hits(held, asked[a:b])
            for j, (small, big) in enumerate(columns[c] for c in wanted):
                values = small[at].astype(np.int64)
                over = np.flatnonzero(values == 255)
                values[over] = big[1][np.searchsorted(big[0], at[over])]
                out[a + hit, j] = values
        return out[where]
