"""Quality classifier: n-gram indicators scaled by class log-count ratios, then a linear hinge loss.

Indicators are hashed: byte trigrams of the raw text, runs of character classes, and runs of the
flag "this word repeats the one before". A text's vector holds, for each indicator it has, the log
ratio of that indicator's smoothed shares in the two classes, scaled to length 1. The linear model is fitted by
dual coordinate descent on the squared hinge loss; a logistic curve turns margins into scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cohortlens.llm.common import arrow_map, fresh, text_steps

# Indicators are hashed into three regions of these sizes.
GRAM_BITS, SHAPE_BITS, REPEAT_BITS = 17, 14, 8
DIM = (1 << GRAM_BITS) + (1 << SHAPE_BITS) + (1 << REPEAT_BITS)
# Labelled rows that the model is fitted on, at most per class; chosen by hash.
FIT_ROWS = 2000

# Classes of bytes: 0 white space, 1 lower case, 2 upper case, 3 digit, 4 beyond ASCII, then signs.
CLASSES = np.full(256, 8, np.uint32)
CLASSES[[9, 10, 11, 12, 13, 32]] = 0
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58], CLASSES[128:] = 1, 2, 3, 1
CLASSES[[ord(c) for c in ".,;:'\"()-"]] = 5
CLASSES[[ord(c) for c in "!?"]] = 6
CLASSES[[ord(c) for c in "|<>{}[]=/\\_"]] = 7


def _flag(mark: np.ndarray, x: np.ndarray, widths: range, base: int, bits: int, start: int) -> None:
    """Set the flags of all runs of the given widths; values are below `base`."""
    step = np.uint32(base)
    for w in widths:
        if len(x) >= w:
            n = len(x) - w + 1
            code = x[:n] + np.uint32(w)
            for j in range(1, w):
                code = code * step + x[j : j + n]
            mark[((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)) + np.uint32(start)] = True


def indicators(text: bytes, mark: np.ndarray) -> np.ndarray:
    """Numbers of the indicators that a text has; `mark` is an all-false scratch array of DIM flags."""
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        _flag(mark, b.astype(np.uint32), range(1, 4, 2), 257, GRAM_BITS, 0)
        kinds = CLASSES[b]
        kinds = kinds[np.concatenate([[True], kinds[1:] != kinds[:-1]])]
        _flag(mark, kinds, range(2, 6), 11, SHAPE_BITS, 1 << GRAM_BITS)
        words = text.split()
        same = np.fromiter(map(bytes.__eq__, words[1:], words), np.uint32, max(0, len(words) - 1))
        _flag(mark, same, range(1, 7), 3, REPEAT_BITS, (1 << GRAM_BITS) + (1 << SHAPE_BITS))
    found = np.flatnonzero(mark)
    mark[found] = False
    return found


@dataclass
class Model:
    """`weights` already hold the log-count ratios; `ratio2` their squares, for the length."""

    weights: np.ndarray
    ratio2: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        length = float(np.sqrt(self.ratio2[found].sum())) if len(found) else 0.0
        return float(self.weights[found].sum()) / length + self.bias if length else self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -60, 60))))


def dual_descent(
    rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int, cost: np.ndarray,
    epochs: int = 30, seed: int = 7, tolerance: float = 1e-3,
) -> np.ndarray:
    """Squared hinge loss with L2 penalty: minimise over one dual variable at a time.

    `rows` are (numbers, values) of sparse vectors; `cost` is each row's weight of the loss.
    """
    w, alpha = np.zeros(dim), np.zeros(len(rows))
    diagonal = 0.5 / cost
    squares = np.array([float(v @ v) for _, v in rows]) + diagonal
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            idx, v = rows[i]
            gradient = y[i] * float(w[idx] @ v) - 1 + diagonal[i] * alpha[i]
            projected = min(gradient, 0.0) if alpha[i] == 0 else gradient
            if projected:
                worst = max(worst, abs(projected))
                new = max(alpha[i] - gradient / squares[i], 0.0)
                w[idx] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
        if worst < tolerance:
            break
    return w


def logistic_curve(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(label 1) by margin: Newton steps on the log loss with a small penalty."""
    a, b, target = 1.0, 0.0, (y > 0).astype(float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -60, 60)))
        g = np.array([((p - target) * margin * weight).sum() + 1e-3 * a, ((p - target) * weight).sum() + 1e-3 * b])
        s = p * (1 - p) * weight
        h = np.array([[(s * margin**2).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 1e-6), float(b)


def fit_rows(found: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0, cost: float = 1.0) -> Model:
    """Fit on indicator lists. Without both classes every text gets the share of label 1 (0.5 if none)."""
    y = np.where(labels > 0, 1.0, -1.0)
    share = float((labels.sum() + 0.5) / (len(labels) + 1)) if len(labels) else 0.5
    if len(set(y)) < 2:
        return Model(np.zeros(DIM), np.zeros(DIM), 0.0, 1.0, float(np.log(share / (1 - share))))
    counts = {s: np.full(DIM, smooth) for s in (1.0, -1.0)}
    for idx, s in zip(found, y):
        counts[s][idx] += 1
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    rows = []
    for idx in found:
        v = ratio[idx]
        length = np.linalg.norm(v)
        v = np.append(v / length if length else v, 1.0).astype(np.float32)
        rows.append((np.append(idx, DIM).astype(np.int32), v))
    # Both classes weigh the same in the hinge loss; the curve below restores their real shares.
    weight = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    w = dual_descent(rows, y, DIM + 1, cost * weight)
    model = Model(w[:DIM] * ratio, ratio**2, float(w[DIM]), 1.0, 0.0)
    margins = np.array([model.margin(idx) for idx in found])
    model.slope, model.shift = logistic_curve(margins, y, np.ones(len(y)))
    return model


def fit(labelled: DataFrame, text: str = "text", label: str = "quality", most: int = FIT_ROWS) -> Model:
    """Fit on at most `most` labelled rows of each class, those with the smallest text hash.

    Rows with a null label are left out; a null text is an empty one. Equal texts with the same
    label count once, so that groups of copies do not fill the sample.
    """

    def features(batches):
        mark = np.zeros(DIM, bool)
        for batch in batches:
            for _, texts in text_steps(batch.column(0)):
                yield pa.RecordBatch.from_pydict(
                    {"found": [indicators(t, mark).astype(np.int32).tobytes() for t in texts]}
                )

    rows = labelled.where(F.col(label).isNotNull()).select(
        F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("int").alias("label")
    )
    keyed = rows.withColumn("at", F.xxhash64("text"))
    got = []
    for value in (0, 1):
        # The hashes that are small enough, then the texts: only ids are sorted.
        own = keyed.where(F.col("label") == value)
        edge = own.select("at").distinct().orderBy("at").limit(most).agg(F.max("at")).first()[0]
        if edge is None:
            continue
        sample = own.where(F.col("at") <= edge).dropDuplicates(["at"]).select("text")
        table = arrow_map(sample, features, "found binary").toArrow()
        got += [(value, np.frombuffer(x.as_py(), np.int32)) for x in table.column(0)]
    got.sort(key=lambda x: (x[0], len(x[1]), x[1].tobytes()))
    return fit_rows([x for _, x in got], np.array([v for v, _ in got], float))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of `docs` and the score of the whole text, 0 to 1, as a last column `name`.

    A null or empty text has no indicator and gets the model's score without evidence. Every row
    is returned once, repeated rows too; no column besides `text` is read by the model.
    """
    work = fresh(docs, "scored_text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: DIM weights

    def run(batches):
        mark = np.zeros(DIM, bool)
        for batch in batches:
            m = shared.value
            scores = [
                m.score(indicators(t, mark)) for _, texts in text_steps(batch.column(batch.num_columns - 1)) for t in texts
            ]
            columns = [*batch.columns[:-1], pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], name])

    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return arrow_map(docs.withColumn(work, F.col(text)), run, schema)
