"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, mapped by the workers that score.

There is one pass over the training texts for each order, the longest grams first. A pass looks up what the one
before stored, and its shuffle is deleted when it ends. Three tables of order 3 result, one for each length of gram:

- `count3`: how often the gram occurs;
- `left2` and `word`, six numbers of a gram: in how many different contexts to its left it occurs, how often, and as
  the context of longer grams the sum of their counts and how many of these are one, two, and three or more.

A gram that occurs c times adds 1/c at each occurrence, so sums over occurrences count different
grams without listing them. Keys are 64-bit hashes of words and of runs of words; a gram and the context of longer
grams have the same key, so all that is known of a run of words is dealt, sent and stored under one key.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from cohortlens.llm.common import GOLDEN, U64, arrow_map, fresh, hashes, mix, shuffles_dropped, text_steps, tokens_of
from cohortlens.llm.hash_table import Table, gather, mapped_dir, shard_bits

ORDER = 3
END, BEGIN = U64(0x243F6A8885A308D3), U64(0x13198A2E03707344)


class Grams:
    """Keys of all grams of some texts. Every text is its tokens and an end, after order - 1 begins."""

    def __init__(self, texts: list[bytes], order: int):
        split = [tokens_of(t) for t in texts]
        self.sizes = np.array([len(w) + 1 for w in split], np.int64)
        pad = order - 1
        starts = np.concatenate([[0], np.cumsum(self.sizes + pad)])
        words = np.full(starts[-1], BEGIN, U64)
        for w, a in zip(split, starts):
            words[a + pad : a + pad + len(w)] = hashes(w)
        words[starts[1:] - 1] = END
        row = np.repeat(starts[:-1] + pad - np.concatenate([[0], np.cumsum(self.sizes)[:-1]]), self.sizes)
        self.at = row + np.arange(self.sizes.sum())
        # How many tokens of its own text a gram that ends here can hold.
        self.reach = np.arange(self.sizes.sum()) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes) + 1
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])
        self._keys = [words]
        with np.errstate(over="ignore"):
            for m in range(1, order):
                longer = self._keys[-1].copy()
                longer[m:] = mix(self._keys[-1][m:] * GOLDEN + words[:-m])
                self._keys.append(longer)

    def keys(self, m: int) -> np.ndarray:
        """The gram of m tokens that ends at each token."""
        return self._keys[m - 1][self.at]

    def all_keys(self, m: int) -> np.ndarray:
        """The gram of m tokens that ends at each place, begins included: at `at` those of the tokens, at `at` - 1 the
        contexts of the grams of m + 1."""
        return self._keys[m - 1]


@dataclass
class Model:
    """Where the tables are, and the numbers that all texts share."""

    folder: str
    bits: int
    order: int
    tokens: int
    words: int
    mass: int
    discounts: dict[int, tuple[float, float, float]]
    left_over: float

    def tables(self) -> dict[int, Table]:
        """The table of the grams of each length."""
        return {m: Table(self.folder, _name(m, self.order), self.bits, 1 if m == self.order else 6) for m in range(1, self.order + 1)}


def _name(m: int, order: int) -> str:
    return f"count{m}" if m == order else f"left{m}" if m > 1 else "word"


def _discount(n: tuple[int, int, int, int]) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from the numbers of ones, twos, threes and fours."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return (0.5, 1.0, 1.5)
    y = n1 / (n1 + 2 * n2)
    values = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(v, 0.0), float(k)) for k, v in enumerate(values, 1))


def _taken(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(count, 3)]


def train(texts: DataFrame, text: str = "text", order: int = ORDER) -> Model:
    """Count the grams of all given texts (null: empty) and store the model's tables."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = texts.sparkSession
    only = texts.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = only.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder, bits = mapped_dir(spark, "ngrams"), shard_bits(size)

    def collected(emit) -> dict:
        with shuffles_dropped(spark):
            rows = gather(only, emit, text_steps, folder, bits).groupBy("name").agg(
                *[F.sum(c).alias(c) for c in ("known", "first", "second", "n1", "n2", "n3", "n4")]
            )
            return {r["name"]: r for r in rows.collect()}  # one row

    def longest(some):
        keys, n = np.unique(Grams(some, order).keys(order), return_counts=True)
        yield _name(order, order), keys, n.astype(np.uint32)[:, None]

    def shorter(m: int):
        opened: dict[int, Table] = {}  # by each task for itself

        def emit(some):
            opened.update({} if opened else Model(folder, bits, order, 0, 0, 0, {}, 0).tables())
            grams = Grams(some, order)
            longer = opened[m + 1].get(grams.keys(m + 1), 0, 0 if m + 1 == order else 1)
            own, share = longer[:, 0], 1 / np.maximum(longer[:, 1], 1)
            # One row for each place: as a gram that ends there, and as the context of the token that follows.
            keys = grams.all_keys(m)
            values = np.zeros((len(keys), 6))
            # A gram that holds a begin has nothing to its left; it keeps its count.
            values[grams.at, 0] = np.where(grams.reach < m, 1.0, share)
            values[grams.at, 1] = 1
            values[grams.at - 1, 2] = own * share
            for k in (1, 2, 3):
                values[grams.at - 1, 2 + k] = (np.minimum(own, 3) == k) * share
            used = values.any(axis=1)
            yield _name(m, order), keys[used], values[used]

        return emit

    stats = collected(longest)
    for m in range(order - 1, 0, -1):
        stats |= collected(shorter(m))
    discounts = {}
    for m in range(1, order + 1):
        r = stats.get(_name(m, order))
        discounts[m] = _discount(tuple(r[f"n{k}"] for k in (1, 2, 3, 4)) if r else (0, 0, 0, 0))
    word = stats.get("word")
    if word is None:
        return Model(folder, bits, order, 0, 0, 0, discounts, 1.0)
    n1, n2 = word["n1"], word["n2"]
    d1, d2, d3 = discounts[1]
    over = (d1 * n1 + d2 * n2 + d3 * (word["known"] - n1 - n2)) / word["first"]
    return Model(folder, bits, order, int(word["second"]), int(word["known"]), int(word["first"]), discounts, float(over))


def _log10(grams: Grams, model: Model, tables: dict[int, Table]) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each token, and each token's count in training."""
    shorter = {m: tables[m].get(grams.all_keys(m)) for m in range(1, model.order)}
    seen = shorter[1][grams.at, :2]
    p = np.full(len(seen), model.left_over / (model.words + 1))
    if model.mass:
        p += np.maximum(seen[:, 0] - _taken(seen[:, 0], model.discounts[1]), 0) / model.mass
    for m in range(2, model.order + 1):
        d = model.discounts[m]
        own = shorter[m][grams.at, 0] if m < model.order else tables[m].get(grams.keys(m))[:, 0]
        total, *kinds = shorter[m - 1][grams.at - 1, 2:].T
        known = total > 0
        safe = np.where(known, total, 1)
        rest = sum(k * x for k, x in zip(d, kinds)) / safe
        p = np.where(known, np.maximum(own - _taken(own, d), 0) / safe + rest * p, p)
    return np.log10(p), seen[:, 1]


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "lm") -> DataFrame:
    """All rows and columns of `docs`, and a struct `name`: n_tokens, n_known, train_tokens, base_score, score.

    `score` is the log10 probability of all tokens and the end; perplexity is 10 ** (-score /
    n_tokens). A null or empty text is its end alone. Repeated rows get equal scores. A model of no texts gives
    every token probability 1.
    """
    parts = [("n_tokens", LongType()), ("n_known", LongType()), ("train_tokens", LongType()),
             ("base_score", DoubleType()), ("score", DoubleType())]
    kind = StructType([StructField(n, t) for n, t in parts])
    schema = StructType([*docs.schema.fields, StructField(name, kind)])
    work = fresh(docs, "scored_text")

    def run(batches):
        tables = model.tables()
        for batch in batches:
            out = []
            for _, texts in text_steps(batch.column(batch.num_columns - 1)):
                grams = Grams(texts, model.order)
                logs, counts = _log10(grams, model, tables)
                base = np.log10((counts + 1) / (model.tokens + model.words + 1))
                first = grams.ends[:-1]
                sums = [np.add.reduceat(x, first) for x in ((counts > 0).astype(np.int64), base, logs)]
                out.append((grams.sizes, sums[0], np.full(len(texts), model.tokens), sums[1], sums[2]))
            columns = [np.concatenate(x) for x in zip(*out)] if out else [[] for _ in parts]
            arrays = [pa.array(c, pa.float64() if t == DoubleType() else pa.int64()) for c, (_, t) in zip(columns, parts)]
            struct = pa.StructArray.from_arrays(arrays, names=[n for n, _ in parts])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], struct], names=[*batch.schema.names[:-1], name])

    return arrow_map(docs.withColumn(work, F.col(text)), run, schema)
