"""Toxicity: gradient-boosted trees over dense features of the whole text, with isotonic calibration.

Features are rates: words of two lexicons (a fixed one and one learned from labels), their weight,
how near they are to a second person, capitals, punctuation, lengthened and disguised words. The
labelled sample is parted by text hash: the lexicon is learned on one half, the trees on a quarter, the
calibration on the last quarter, so that no part flatters the next one.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from cohortlens.llm.common import ASCII_LOWER, arrow_map, fresh, text_steps
from cohortlens.session import stored

# Labelled rows, at most, that the model is fitted on; those of the smallest text hashes.
FIT_ROWS = 20_000
# Learned lexicon: words at most; the share of toxic texts among those with a word is at least LEAST_SHARE,
# by the lower end of its 95 % confidence interval.
LEXICON_WORDS, LEAST_SHARE = 400, 0.5
TREES, DEPTH = 25, 3

# Common insults and second persons in four languages.
INSULTS = """
idiot idiots moron morons stupid dumb fool loser losers trash garbage scum pathetic worthless disgusting clown
jerk liar ugly filthy vermin parasite coward disgrace hate shut imbecile dimwit creep freak retard bastard
dumm dummkopf trottel arschloch abschaum widerlich feigling hässlich blöd
stupide imbécile crétin débile minable ordure dégoûtant abruti connard raclure
estúpido imbécil tonto basura asqueroso patético escoria inútil payaso cobarde
""".split()
SECOND_PERSON = """
you your yours yourself yourselves ur du dich dir dein deine deinen deiner euch euer eure
tu te toi ton ta tes vous votre vos usted ustedes tus ti contigo
""".split()

STRIP = string.punctuation.encode()
# A word that has digits or signs before or between its letters; each word is tried once, from its start.
DISGUISED = re.compile(
    rb"(?<![A-Za-z0-9@$])(?:[A-Za-z]++[0-9@$!*#+._-]++(?=[A-Za-z0-9])|[0-9@$]++(?=[A-Za-z]))[A-Za-z0-9@$!*#+._-]*+"
)
UNDISGUISE = [bytes.maketrans(b"01345@$!7", x) for x in (b"oieasasit", b"oleasasit")]
DROPPED = b"*#+.-_"
LONG_RUN = re.compile(rb"([A-Za-z!?])\1\1")
CAPITALS = bytes(range(65, 91))
LETTERS = bytes([*range(65, 91), *range(97, 123)])
SIGNS = b"!?.,;:*#$%&@"
FEATURES = [
    "fixed_rate", "learned_rate", "any_fixed", "any_learned", "weight_rate", "best_weight", "near_second_person",
    "second_person_rate", "capital_rate", "capital_words", "sign_rate", "shout_rate", "long_run_rate", "disguised_rate",
    "unmasked_rate", "log_words",
]
NEAR = 5


def features(text: bytes, lexicon: dict[bytes, float]) -> list[float]:
    """The numbers of FEATURES. `lexicon` has weights: of learned words above 0, of the fixed ones only, 0."""
    raw = text.split()
    words = [w.strip(STRIP) for w in text.decode().lower().encode().split()]
    n, size = max(len(words), 1), max(len(text), 1)
    hits = [i for i, w in enumerate(words) if w in lexicon]
    weights = [lexicon[words[i]] for i in hits]
    second = [i for i, w in enumerate(words) if w in _SECOND]
    near = 0
    if hits and second:
        at = np.searchsorted(second, hits)
        before = np.abs(np.array(hits) - np.array(second)[np.maximum(at - 1, 0)])
        after = np.abs(np.array(hits) - np.array(second)[np.minimum(at, len(second) - 1)])
        near = int((np.minimum(before, after) <= NEAR).sum())
    fixed = sum(words[i] in _INSULTS for i in hits)
    disguised = DISGUISED.findall(text)
    unmasked = sum(
        any(d.translate(ASCII_LOWER).rstrip(b"!").translate(t, DROPPED) in lexicon for t in UNDISGUISE) for d in disguised
    )
    letters = size - len(text.translate(None, LETTERS))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    signs = len(text) - len(text.translate(None, SIGNS))
    learned = [w for w in weights if w > 0]
    return [
        fixed / n, len(learned) / n, float(fixed > 0), float(bool(learned)), sum(weights) / n, max(weights, default=0.0),
        near / n, len(second) / n, capitals / max(letters, 1), sum(map(bytes.isupper, raw)) / n, signs / size,
        (text.count(b"!") + text.count(b"?")) / size, len(LONG_RUN.findall(text)) / n, len(disguised) / n, unmasked / n,
        float(np.log1p(len(words))),
    ]


_SECOND = frozenset(w.encode() for w in SECOND_PERSON)
_INSULTS = frozenset(w.encode() for w in INSULTS)


@dataclass
class Model:
    """Trees and the calibration's steps; without both classes only a constant score."""

    lexicon: dict[bytes, float]
    trees: GBTClassificationModel | None
    steps: list[tuple[float, float]]
    constant: float


def _sample(rows: DataFrame, text: str, label: str) -> DataFrame:
    """(text, label, part) of distinct labelled texts, at most FIT_ROWS; part is 0 to 3."""
    some = rows.where(F.col(label).isNotNull()).select(
        F.coalesce(F.col(text), F.lit("")).alias("text"), (F.col(label) > 0).cast("int").alias("label")
    ).withColumn("at", F.xxhash64("text"))
    edge = some.select("at").distinct().orderBy("at").limit(FIT_ROWS).agg(F.max("at")).first()[0]
    part = F.pmod(F.crc32(F.col("at").cast("string").cast("binary")), F.lit(4)).cast("int")
    kept = some.where(F.col("at") <= F.lit(edge)).dropDuplicates(["label", "at"])
    return stored(kept.select("text", "label", part.alias("part")), "labelled")


def _lexicon(sample: DataFrame) -> dict[bytes, float]:
    """The fixed words, and the words that are mostly in toxic texts, with that share."""
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "")
    word = F.explode(F.array_distinct(F.transform(F.split("text", r"\s+"), bare)))
    by_word = sample.select("label", word.alias("word")).where("word <> ''").groupBy("word").agg(
        F.sum("label").alias("a"), F.count(F.lit(1)).alias("n")
    )
    # Wilson's interval, z = 1.96.
    n, p, zz = F.col("n"), F.col("a") / F.col("n"), 1.96**2
    share = (p + zz / (2 * n) - 1.96 * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)
    best = by_word.withColumn("share", share).where(F.col("share") >= LEAST_SHARE)
    best = best.orderBy(F.desc("share"), "word").limit(LEXICON_WORDS)
    found = {w.encode(): 0.0 for w in INSULTS}
    return found | {r["word"].encode(): float(r["share"]) for r in best.select("word", "share").collect()}


def _with_features(docs: DataFrame, lexicon: dict[bytes, float], text: str, name: str) -> DataFrame:
    schema = StructType([*docs.schema.fields, StructField(name, ArrayType(DoubleType()))])
    work = fresh(docs, "scored_text")

    def run(batches):
        for batch in batches:
            rows = [
                features(t, lexicon) for _, texts in text_steps(batch.column(batch.num_columns - 1)) for t in texts
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], name]
            )

    return arrow_map(docs.withColumn(work, F.col(text)), run, schema)


def fit(rows: DataFrame, text: str = "text", label: str = "toxic", trees: int = TREES, depth: int = DEPTH) -> Model:
    """Fit on a bounded sample of labelled rows (see FIT_ROWS); rows with a null label are left out.

    Without both classes every text gets the share of toxic rows (0 without any).
    """
    sample = _sample(rows, text, label)
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return Model({}, None, [], float(share))
    lexicon = _lexicon(sample.where("part < 2"))
    known = stored(_with_features(sample, lexicon, "text", "numbers").select("label", "part", array_to_vector("numbers").alias("x")), "features").coalesce(4)
    learn, check = known.where("part = 2"), known.where("part = 3")
    if learn.select("label").distinct().count() < 2 or check.select("label").distinct().count() < 2:
        learn = check = known  # too few rows to part them
    booster = GBTClassifier(
        featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=11, minInstancesPerNode=5
    )
    model = booster.fit(learn)
    margins = model.transform(check).select(vector_to_array("rawPrediction")[1].alias("margin"), F.col("label").cast("double"))
    curve = IsotonicRegression(featuresCol="margin", labelCol="label").fit(margins)
    steps = list(zip(curve.boundaries.toArray().tolist(), curve.predictions.toArray().tolist()))
    return Model(lexicon, model, steps, float(share))


def calibrated(margin, steps: list[tuple[float, float]]):
    """The isotonic curve at a margin (a column): linear between steps, flat beyond them."""
    x, y = F.array(*[F.lit(a) for a, _ in steps]), F.array(*[F.lit(b) for _, b in steps])
    after = F.size(F.filter(x, lambda v: v <= margin))  # how many steps lie at or below
    last = len(steps)
    lo, hi = F.greatest(after, F.lit(1)), F.least(after + 1, F.lit(last))
    x0, x1, y0, y1 = F.get(x, lo - 1), F.get(x, hi - 1), F.get(y, lo - 1), F.get(y, hi - 1)
    between = F.when(x1 > x0, y0 + (y1 - y0) * (margin - x0) / (x1 - x0)).otherwise(y0)
    return F.when(after == 0, y[0]).when(after == last, y[last - 1]).otherwise(between)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of `docs` and the toxicity of the whole text, 0 to 1, as a last column `name`.

    A null text is scored as an empty one. Repeated rows get equal scores.
    """
    if model.trees is None:
        return docs.withColumn(name, F.lit(model.constant))
    numbers, vector = fresh(docs, "feature_numbers"), fresh(docs, "feature_vector")
    keep = [F.col(f"`{c}`") for c in docs.columns]
    outputs = {k: fresh(docs, f"gbt_{k}") for k in ("raw", "probability", "prediction")}
    model.trees.setFeaturesCol(vector).setRawPredictionCol(outputs["raw"]).setProbabilityCol(
        outputs["probability"]).setPredictionCol(outputs["prediction"])
    known = _with_features(docs, model.lexicon, text, numbers).withColumn(vector, array_to_vector(numbers))
    margin = vector_to_array(outputs["raw"])[1]
    return model.trees.transform(known).select(*keep, calibrated(margin, model.steps).alias(name))
