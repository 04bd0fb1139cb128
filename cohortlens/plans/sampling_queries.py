"""Exact-sample, split and fold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions.scalars import SPLIT_PRIME
from cohortlens.operators import sampling as S
from cohortlens.operators.training import training_sets as make_sets
from cohortlens.plans.analogs import (
    ID,
    LABEL,
    PERIOD,
    SCORED,
    key_sql,
    number_sql,
    order_months,
    scored,
    with_,
)
from cohortlens.plans.registry import ORACLES, query
from cohortlens.session import stored
from cohortlens.operators.ordering import small_buckets

_ORDER_42 = f"ORDER BY {key_sql('id', 42)}, id"


@query(
    "undersample",
    with_(
        SCORED,
        f"""SELECT id, cust, period, label FROM (
              SELECT *, row_number() OVER (PARTITION BY period, label {_ORDER_42}) AS rn,
                     count(*) OVER (PARTITION BY period, label) AS n
              FROM scored)
            WHERE label IS NULL OR label <> 'CONTINUA' OR rn <= round_even(n * 0.3, 0)""",
    ),
)
def undersample(spark, sf):
    rows = scored(spark, sf).select("id", ID, PERIOD, LABEL)
    return S.undersample(rows, "id", PERIOD, LABEL, 0.3, seed=42)


@query(
    "stratified_split",
    with_(
        SCORED,
        f"""SELECT id, label, CASE WHEN rn <= round_even(n * 0.3, 0) THEN 'public'
                                   ELSE 'private' END AS side
            FROM (SELECT id, label,
                         row_number() OVER (PARTITION BY label {_ORDER_42}) AS rn,
                         count(*) OVER (PARTITION BY label) AS n
                  FROM scored)""",
    ),
)
def stratified_split(spark, sf):
    rows = scored(spark, sf).select("id", LABEL)
    return S.stratified_split(rows, "id", LABEL, 0.3, seed=42)


@query(
    "kfold_assign",
    with_(
        SCORED,
        f"""SELECT id, label,
                   CAST(ntile(5) OVER (PARTITION BY label {_ORDER_42}) - 1 AS INTEGER) AS fold
            FROM scored""",
    ),
)
def kfold_assign(spark, sf):
    return S.kfold(scored(spark, sf).select("id", LABEL), "id", LABEL, 5, seed=42)


@query(
    "training_sets",
    with_(
        SCORED,
        f"""SELECT * FROM (
              SELECT id, period, label, score, score_b,
                     CASE label WHEN 'BAJA+2' THEN CAST(1.00002 AS DOUBLE)
                                WHEN 'BAJA+1' THEN CAST(1.00001 AS DOUBLE)
                                ELSE CAST(1 AS DOUBLE) END AS clase_peso,
                     CASE WHEN label = 'BAJA+2' THEN 1 ELSE 0 END AS clase_binaria1,
                     CASE WHEN label = 'CONTINUA' THEN 0 ELSE 1 END AS clase_binaria2,
                     unnest(CASE WHEN period = 200010 THEN ['train', 'test']
                                 WHEN period < 200010 THEN ['train'] ELSE ['test'] END) AS part
              FROM (SELECT *, row_number() OVER (PARTITION BY period, label {_ORDER_42}) AS rn,
                           count(*) OVER (PARTITION BY period, label) AS n
                    FROM scored)
              WHERE label IS NULL OR label <> 'CONTINUA' OR rn <= round_even(n * 0.4, 0))
            WHERE part = 'test' OR label IS NOT NULL""",
    ),
)
def training_sets(spark, sf):
    rows = scored(spark, sf).drop("gain", ID)
    months = order_months(spark, sf)
    sets = make_sets(
        rows,
        "id",
        PERIOD,
        LABEL,
        [m for m in months if m <= 200010],
        [m for m in months if m >= 200010],
        fraction=0.4,
        drop_unlabelled=True,
    )
    return sets.train.withColumn("part", F.lit("train")).unionByName(
        sets.test.withColumn("part", F.lit("test"))
    )


N_SPLITS = 50

SPLITS = (
    SCORED
    + f""",
orders_of_splits AS (
  SELECT split, CAST('0x' || substr(digest, 1, 13) AS BIGINT) % {SPLIT_PRIME - 1} + 1 AS a,
         CAST('0x' || substr(digest, 14, 13) AS BIGINT) % {SPLIT_PRIME} AS b
  FROM (SELECT split, md5('split-' || split || '-42') AS digest
        FROM (SELECT unnest(range(1, {N_SPLITS + 1})) AS split))
),
keyed AS (
  SELECT id, label, split, gain, score, score_b,
         ({number_sql("id", 42)} % {SPLIT_PRIME} * a + b) % {SPLIT_PRIME} AS k
  FROM scored, orders_of_splits
),
sided AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY split, label ORDER BY k, id)
                      <= round_even(count(*) OVER (PARTITION BY split, label) * 0.3, 0)
                 THEN 'public' ELSE 'private' END AS side
  FROM keyed
)"""
)


def board(spark, sf):
    """Gain of two score models on both sides of every split."""
    rows = stored(scored(spark, sf).select("id", LABEL, "gain", "score", "score_b"), "scored")
    masked = S.split_masks(rows, "id", LABEL, N_SPLITS)
    out = S.split_gains(masked, {"base": F.col("score") >= 0.25, "alt": F.col("score_b") >= 0.25}, "gain", N_SPLITS)
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c != "split"})


BOARD = (
    SPLITS
    + """,
board AS (
  SELECT split, """
    + ", ".join(
        f"round(CAST(sum(CASE WHEN {score} >= CAST(0.25 AS DOUBLE) AND side = '{side}' THEN gain"
        f" ELSE 0 END) AS DOUBLE) / CAST({share} AS DOUBLE), 4) AS {model}_{side}"
        for model, score in (("base", "score"), ("alt", "score_b"))
        for side, share in (("public", 0.3), ("private", 0.7))
    )
    + """
  FROM sided GROUP BY split
)"""
)


@query("repeated_splits", with_(BOARD, "SELECT CAST(split AS INTEGER) AS split, * EXCLUDE (split) FROM board"))
def repeated_splits(spark, sf):
    return board(spark, sf)


@query("undersample_buckets", ORACLES["undersample"])
def undersample_buckets(spark, sf):
    with small_buckets():
        return undersample(spark, sf)


@query("stratified_split_buckets", ORACLES["stratified_split"])
def stratified_split_buckets(spark, sf):
    with small_buckets():
        return stratified_split(spark, sf)


@query("kfold_assign_buckets", ORACLES["kfold_assign"])
def kfold_assign_buckets(spark, sf):
    with small_buckets():
        return kfold_assign(spark, sf)


@query("repeated_splits_buckets", ORACLES["repeated_splits"])
def repeated_splits_buckets(spark, sf):
    """The same from rows repeated by split."""
    with small_buckets():
        rows = scored(spark, sf).select("id", LABEL, "gain", "score", "score_b")
        sided = S.repeated_splits(rows, "id", LABEL, N_SPLITS)
        sums = {}
        for model, score in (("base", "score"), ("alt", "score_b")):
            for side, share in (("public", 0.3), ("private", 0.7)):
                hit = (F.col(score) >= 0.25) & (F.col("side") == side)
                total = F.sum(F.when(hit, F.col("gain")).otherwise(F.lit(0)))
                sums[f"{model}_{side}"] = F.round(total / share, 4)
        return sided.groupBy("split").agg(*[c.alias(n) for n, c in sums.items()])
