"""Benchmark decontamination: each shard of training text gets an FM-index that test phrases are searched in.

A phrase (window) is 10 consecutive words of a benchmark item; an item of fewer words is one window.
Words outside the benchmark's vocabulary are in no window. They part the text into runs, and the
index of a shard (some megabytes of text in a task) holds the runs that are as long as the shortest window. All
windows are searched backwards at once, occurrences located by sampled positions, and the covered
words merged into spans. Nothing is shuffled.

The benchmark is sent to the tasks in blocks of bounded size, all searched in the same stage.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cohortlens.llm.common import arrow_map, fresh, text_steps, words_of
from cohortlens.llm.fm_index import FmIndex

WINDOW = 10
# Characters of benchmark text in one block.
BLOCK_CHARS = 16 << 20
SHARD_BYTES = 8 << 20
# Words before they are put in lower case.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
REPORT = "n_words bigint, n_hit bigint, items array<string>, word_spans array<struct<start:bigint,end:bigint>>"


class _Known(dict):
    def __missing__(self, key):
        return 0


class Block:
    """The windows of some benchmark items, as numbers of their vocabulary."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int = WINDOW):
        self.known, self.names = _Known(), []
        windows: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            w = [self.known.setdefault(x, len(self.known) + 1) for x in words_of(text)]
            for i in range(max(1, len(w) - width + 1) if w else 0):
                windows.setdefault(tuple(w[i : i + width]), set()).add(len(self.names))
            self.names.append(name)
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.phrases = np.zeros((len(windows), width), np.int64)
        for i, w in enumerate(windows):
            self.phrases[i, : len(w)] = w
        self.items = list(windows.values())
        self.least = int(self.lengths.min()) if windows else 0

    def search(self, texts: list[bytes]) -> list[tuple[int, np.ndarray, set[int]]]:
        """(number of words, flags of the covered words or an empty array, items) of each text."""
        split = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in split], np.int64)
        clean = [(int(n), np.empty(0, bool), set()) for n in sizes]
        if not len(self.phrases) or not sizes.sum():
            return clean
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        ids = np.zeros(starts[-1], np.int64)
        find = self.known.__getitem__
        for w, a in zip(split, starts):
            ids[a : a + len(w)] = np.fromiter(map(find, w), np.int64, len(w))
        # Runs of known words; ids ends with a 0.
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ids != 0]).astype(np.int8)))
        first, last = edge[0::2], edge[1::2]
        keep = last - first >= self.least
        first, last = first[keep], last[keep]
        if not len(first):
            return clean
        length = last - first + 1  # with the 0 behind it
        at = np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        index = FmIndex(ids[at], len(self.known))
        low, high = index.search(self.phrases, self.lengths)
        counts = high - low
        window = np.repeat(np.arange(len(counts)), counts)
        if not len(window):
            return clean
        rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + low[window]
        place = at[index.locate(rows)]
        depth = np.zeros(len(ids) + 1, np.int64)
        np.add.at(depth, place, 1)
        np.add.at(depth, place + self.lengths[window], -1)
        hit = np.cumsum(depth[:-1]) > 0
        owner = np.searchsorted(starts, place, "right") - 1
        found = {}
        for doc, w in set(zip(owner.tolist(), window.tolist())):
            found.setdefault(doc, set()).update(self.items[w])
        return [
            (n, hit[starts[i] : starts[i] + n], found[i]) if i in found else row
            for i, row in enumerate(clean)
            for n in (row[0],)
        ]


def blocks(benchmark: DataFrame, item_id: str, text: str, width: int = WINDOW):
    """Blocks of items of about BLOCK_CHARS characters; the driver holds one block at a time."""
    held, size = [], 0
    some = benchmark.select(F.col(item_id).cast("string"), F.coalesce(F.col(text), F.lit("")))
    for name, body in some.toLocalIterator():
        if held and size + len(body) > BLOCK_CHARS:
            yield Block(held, width)
            held, size = [], 0
        held.append((name, body.encode()))
        size += len(body)
    yield Block(held, width)


def _spans(flags: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]]).astype(np.int8)))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[0::2], edge[1::2])]


def report(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = WINDOW, name: str = "leaks",
) -> DataFrame:
    """All rows and columns of `docs`, and a struct `name`: n_words, n_hit, items, word_spans.

    `n_hit` counts words inside any occurrence of a window, `items` lists the ids (as sorted strings) of the
    items whose windows occur, `word_spans` the merged runs of hit words, by word number, end
    exclusive. A null text has no words; an item without words has no window; a null id is not listed. An empty
    benchmark hits nothing. Columns of `docs` keep their names; `name` must be a new one.
    """
    schema = StructType([*docs.schema.fields, StructField(name, StructType.fromDDL(REPORT))])
    kind = pa.struct(
        [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
         ("word_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    )
    work = fresh(docs, "searched_text")
    spark = docs.sparkSession
    out, old = docs, None
    for block in blocks(benchmark, item_id, item_text, width):
        shared = spark.sparkContext.broadcast(block)  # of bounded size, see BLOCK_CHARS

        def run(batches, shared=shared, old=old):
            for batch in batches:
                b, rows = shared.value, []
                before = batch.column(old).to_pylist() if old is not None else None
                for start, texts in text_steps(batch.column(batch.num_columns - 1), SHARD_BYTES):
                    for i, (n, flags, found) in enumerate(b.search(texts), start):
                        items = {b.names[k] for k in found} - {None}
                        if before is not None and before[i]["n_hit"]:
                            flags = flags.copy() if len(flags) else np.zeros(n, bool)
                            for s in before[i]["word_spans"]:
                                flags[s["start"] : s["end"]] = True
                            items |= set(before[i]["items"])
                        rows.append(
                            {"n_words": n, "n_hit": int(flags.sum()), "items": sorted(items), "word_spans": _spans(flags)}
                        )
                n_docs = batch.num_columns - 1 - (old is not None)
                columns = [*batch.columns[:n_docs], pa.array(rows, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:n_docs], name])

        out = arrow_map(out.withColumn(work, F.col(text)), run, schema)
        old = len(docs.columns)
    return out


def cut(text: str, flags: np.ndarray) -> str:
    """The text without its flagged words and what lies between two of them; each cut leaves a line end."""
    words = [m.span() for m in WORD.finditer(text)]
    parts, at = [], 0
    for s in _spans(flags):
        parts.append(text[at : words[s["start"]][0]].rstrip())
        at = words[s["end"] - 1][1]
    return "\n".join(p for p in [*parts, text[at:].strip() if parts else text] if p)


def clean(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = WINDOW,
) -> DataFrame:
    """All rows and columns of `docs`, with every occurrence of a window cut out of `text`.

    All blocks are searched in the same text and their spans cut together. A text is searched again after a
    cut, until no block finds anything. Texts without an occurrence, null ones too, stay as they are; a
    text that is nothing else becomes empty.
    """
    at = docs.columns.index(text)
    shared = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks(benchmark, item_id, item_text, width)]

    def run(batches):
        for batch in batches:
            changed = {}
            for start, texts in text_steps(batch.column(at), SHARD_BYTES):
                todo = dict(enumerate(texts, start))
                while todo:
                    hits: dict[int, np.ndarray] = {}
                    for block in shared:
                        for i, (_, flags, _) in zip(todo, block.value.search(list(todo.values()))):
                            if len(flags):
                                hits[i] = hits[i] | flags if i in hits else flags
                    changed |= {i: cut(todo[i].decode(), flags) for i, flags in hits.items()}
                    todo = {i: changed[i].encode() for i in hits}
            if changed:
                values = batch.column(at).to_pylist()
                for i, t in changed.items():
                    values[i] = t
                batch = batch.set_column(at, text, pa.array(values, batch.column(at).type))
            yield batch

    return arrow_map(docs, run, docs.schema)
