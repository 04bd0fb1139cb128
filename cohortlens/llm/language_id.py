"""Language identification: nearest of several centroids per language, by cosine of TF-IDF n-gram vectors.

Terms are hashed byte n-grams (2 and 3 bytes) of the lower-case text whose other ASCII than letters is
a space. Document frequencies come from all training rows; the centroids of a language are the clusters
of spherical k-means over a bounded sample of its rows. Every fourth row of the sample is kept from the centroids and
says how far texts of the language may lie from them: a text farther from its nearest centroid than nearly all
of those is marked as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from cohortlens.llm.common import ASCII_LOWER, arrow_map, fresh, text_steps
from cohortlens.session import pin

BITS = 14
DIM = 1 << BITS
# Rows of each language, those of the smallest text hashes, that its centroids are made from.
SAMPLE_ROWS = 500
CENTROIDS = 4
# Share of a language's kept rows that may lie beyond its rejection distance; every KEPT_FROM-th row is kept.
BEYOND = 0.005
KEPT_FROM = 4
UNKNOWN = "und"
LETTERS = bytes(ASCII_LOWER[c] if chr(c).isalpha() and c < 128 or c > 127 else 32 for c in range(256))


def counts(text: bytes) -> np.ndarray:
    """How often each hashed n-gram occurs."""
    b = np.frombuffer(b" " + b" ".join(text.translate(LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    out = np.zeros(DIM, np.int64)
    with np.errstate(over="ignore"):
        two = b[:-1] * np.uint32(257) + b[1:]
        three = two[:-1] * np.uint32(257) + b[2:] + np.uint32(1 << 26)
        for code in (two, three):
            out += np.bincount((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=DIM)
    return out


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    names: list[str]
    limits: np.ndarray

    def vector(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(terms, values) of the text's vector of length 1; all values 0 if no term is known."""
        n = counts(text)
        terms = np.flatnonzero(n)
        values = (1 + np.log(n[terms])) * self.idf[terms]
        length = np.sqrt(values @ values)
        return terms, values / length if length else values

    def nearest(self, text: bytes) -> tuple[int, float]:
        """The nearest centroid and its cosine."""
        terms, values = self.vector(text)
        cosines = self.centroids[:, terms] @ values
        best = int(cosines.argmax())
        return best, float(min(max(cosines[best], 0.0), 1.0))


def clusters(x: np.ndarray, k: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of rows of length 1, started from rows far from each other; centroids and labels."""
    first = [int((x @ x.mean(axis=0)).argmax())]
    while len(first) < min(k, len(x)):
        first.append(int((x @ x[first].T).max(axis=1).argmin()))
    centre = x[first]
    for _ in range(rounds):
        label = (x @ centre.T).argmax(axis=1)
        sums = np.stack([x[label == c].sum(axis=0) if (label == c).any() else centre[c] for c in range(len(centre))])
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centre, (x @ centre.T).argmax(axis=1)


def _frequencies(batches):
    total = np.zeros(DIM, np.int64)
    rows = 0
    for batch in batches:
        for _, texts in text_steps(batch.column(0)):
            for t in texts:
                total += counts(t) > 0
                rows += 1
    terms = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"term": np.append(terms, -1), "n": np.append(total[terms], rows)})


def _sparse(batches):
    for batch in batches:
        for start, texts in text_steps(batch.column(1)):
            terms, values = [], []
            for t in texts:
                n = counts(t)
                at = np.flatnonzero(n)
                terms.append(at.astype(np.uint16).tobytes())
                values.append(n[at].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, len(texts)), pa.array(terms, pa.binary()), pa.array(values, pa.binary())],
                names=["lang", "terms", "counts"],
            )


def fit(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from rows with a language and a text with a letter; other rows are left out.

    A language with fewer than KEPT_FROM texts is measured against the rows that it was learned from.
    """
    some = rows.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")
    )
    found = arrow_map(some.select("text"), _frequencies, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    n, total = np.zeros(DIM), 0
    for term, value in found.collect():  # at most DIM + 1 rows
        if term < 0:
            total = value
        else:
            n[term] = value
    idf = np.log((1 + total) / (1 + n)) + 1
    # The texts of the smallest hashes of each language; equal texts count once.
    hashed = some.withColumn("at", F.xxhash64("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    edge = hashed.select("lang", "at").distinct().withColumn("rank", rank).where(F.col("rank") <= SAMPLE_ROWS)
    edge = edge.groupBy("lang").agg(F.max("at").alias("edge"))
    # One row for each language, size-checked and broadcast: texts are not dealt out by language.
    sample = hashed.join(pin(edge), "lang").where("at <= edge").dropDuplicates(["lang", "at"])
    model = Model(idf, np.zeros((0, DIM)), [], np.zeros(0))
    rows_of: dict[str, list] = {}
    vectors = arrow_map(sample.select("lang", "text"), _sparse, "lang string, terms binary, counts binary")
    for name, terms, values in vectors.coalesce(4).toLocalIterator():
        rows_of.setdefault(name, []).append((terms, values))
    centroids, limits = [], []
    for name in sorted(rows_of):
        own = sorted(rows_of.pop(name))
        x = np.zeros((len(own), DIM), np.float32)
        for i, (terms, values) in enumerate(own):
            at = np.frombuffer(terms, np.uint16).astype(np.int64)
            x[i, at] = (1 + np.log(np.frombuffer(values, np.uint32))) * idf[at]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        kept = np.arange(len(x)) % KEPT_FROM == KEPT_FROM - 1
        centre, _ = clusters(x[~kept], CENTROIDS)
        # A language of very few rows has only those that its centroids are made from.
        near = (x[kept] if kept.any() else x) @ centre.T
        limit = float(np.quantile(near.max(axis=1), BEYOND, method="lower"))
        for c in centre:
            centroids.append(c)
            limits.append(limit)
            model.names.append(name)
    model.centroids = np.array(centroids, np.float64).reshape(-1, DIM)
    model.limits = np.array(limits)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", name: str = "language") -> DataFrame:
    """All rows and columns of `docs`, and a struct `name`: lang_pred, score (cosine, 0 to 1), rejected.

    A text that is null or has no letter is `und` with score 0 and rejected; so is every text if the
    model knows no language. A rejected text with letters still names its nearest language.
    """
    kind = StructType(
        [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]
    )
    schema = StructType([*docs.schema.fields, StructField(name, kind)])
    work = fresh(docs, "scored_text")
    lettered = F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).otherwise(F.lit(""))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM numbers for each centroid

    def run(batches):
        for batch in batches:
            m, out = shared.value, []
            for _, texts in text_steps(batch.column(batch.num_columns - 1)):
                for t in texts:
                    if not t or not m.names:
                        out.append({"lang_pred": UNKNOWN, "score": 0.0, "rejected": True})
                        continue
                    best, cosine = m.nearest(t)
                    out.append({"lang_pred": m.names[best], "score": cosine, "rejected": cosine < m.limits[best]})
            fields = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(out, fields)], names=[*batch.schema.names[:-1], name]
            )

    return arrow_map(docs.withColumn(work, lettered), run, schema)
