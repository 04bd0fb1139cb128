"""Customer snapshots made of the given tables, and the same as SQL.

Orders give the entity-by-month panel: one row per customer and month, with counts and amounts.
Amounts are summed as integer cents, so they are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.scalars import LEAVES_SECOND, row_gain, sample_number, yyyymm
from cohortlens.operators.panel import churn_label, in_months, observed_periods
from cohortlens.session import stored

ID, PERIOD, LABEL = "cust", "period", "label"
MEASURES = ["n_orders", "spend", "top_price", "n_filled", "n_urgent"]
TRAIN = [199601, 199602, 199603, 199604, 199605, 199606]
SCORE = [199707, 199708]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def panel(spark: SparkSession, sf_dir: str, months: list[int] | None = None) -> DataFrame:
    """Customer x month, with nulls where a count is zero, as card columns have them.

    With `months` only their orders are read: a range of the raw date reaches the scan.
    """
    orders = table(spark, sf_dir, "orders")
    if months:
        orders = in_months(orders, "o_orderdate", months)
    sums = orders.groupBy(F.col("o_custkey").alias(ID), yyyymm("o_orderdate").alias(PERIOD)).agg(
        F.count(F.lit(1)).cast("int").alias("n_orders"),
        F.sum(cents("o_totalprice")).alias("cents"),
        F.max("o_totalprice").alias("top_price"),
        F.sum((F.col("o_orderstatus") == "F").cast("int")).cast("int").alias("n_filled"),
        F.sum((F.col("o_orderpriority") == "1-URGENT").cast("int")).cast("int").alias("n_urgent"),
    )
    return sums.select(
        ID,
        PERIOD,
        "n_orders",
        (F.col("cents") / 100).alias("spend"),
        "top_price",
        F.nullif("n_filled", F.lit(0)).alias("n_filled"),
        F.nullif("n_urgent", F.lit(0)).alias("n_urgent"),
    )


def order_months(spark: SparkSession, sf_dir: str) -> list[int]:
    """The periods of the panel, read from one column of the orders."""
    return observed_periods(
        table(spark, sf_dir, "orders").select(yyyymm("o_orderdate").alias(PERIOD)), PERIOD
    )


def stored_panel(spark: SparkSession, sf_dir: str, months: list[int] | None = None) -> DataFrame:
    """The panel as a table, for operators that read it several times."""
    return stored(panel(spark, sf_dir, months), "panel")


PANEL = """
panel AS (
  SELECT o_custkey AS cust,
         CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS period,
         CAST(count(*) AS INTEGER) AS n_orders,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS spend,
         max(o_totalprice) AS top_price,
         nullif(CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS INTEGER), 0)
           AS n_filled,
         nullif(CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS INTEGER), 0)
           AS n_urgent
  FROM orders GROUP BY 1, 2
)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = order_months(spark, sf_dir)
    return churn_label(panel(spark, sf_dir), ID, PERIOD, LABEL, periods=months)


# the label by its definition: is the customer there in the next two observed months?
LABELLED = (
    PANEL
    + """,
months AS (
  SELECT period, lead(period, 1) OVER (ORDER BY period) AS next1,
         lead(period, 2) OVER (ORDER BY period) AS next2
  FROM (SELECT DISTINCT period FROM panel)
),
labelled AS (
  SELECT p.*, CASE WHEN next2 IS NULL THEN NULL
                   WHEN second.cust IS NOT NULL THEN 'CONTINUA'
                   WHEN first.cust IS NOT NULL THEN 'BAJA+2'
                   ELSE 'BAJA+1' END AS label
  FROM panel p JOIN months m ON m.period = p.period
  LEFT JOIN panel first ON first.cust = p.cust AND first.period = next1
  LEFT JOIN panel second ON second.cust = p.cust AND second.period = next2
)"""
)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled panel with one id per row, its gain and two deterministic scores with ties.

    Stored, since curves and samples read it several times.
    """
    rows = labelled(spark, sf_dir)
    rows = rows.select(
        (F.col(ID) * 1_000_000 + F.col(PERIOD)).alias("id"),
        ID,
        PERIOD,
        LABEL,
        row_gain(F.col(LABEL).eqNullSafe(LEAVES_SECOND)).alias("gain"),
        (F.floor(F.col("spend") / 5000) / 100).alias("score"),
        (F.floor(F.col("top_price") / 4000) / 100).alias("score_b"),
    )
    return stored(rows, "scored")


SCORED = (
    LABELLED
    + """,
scored AS (
  SELECT cust * 1000000 + period AS id, cust, period, label,
         CAST(CASE WHEN label = 'BAJA+2' THEN 273000 ELSE -7000 END AS BIGINT) AS gain,
         CAST(floor(spend / 5000) AS DOUBLE) / 100 AS score,
         CAST(floor(top_price / 4000) AS DOUBLE) / 100 AS score_b
  FROM labelled
)"""
)

TRIALS = 2
SEEDS = [17, 19]


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scored row for each of two trials and two seeds; the seed disturbs the score."""
    runs = F.explode(F.array(*[F.lit(s) for s in SEEDS]))
    rows = scored(spark, sf_dir).withColumn("seed", runs)
    rows = rows.withColumn("trial", F.explode(F.array(F.lit(1), F.lit(2))))
    base = F.when(F.col("trial") == 1, F.col("score")).otherwise(F.col("score_b"))
    shift = sample_number("id", F.col("seed")) % 7
    return rows.select(
        "id",
        "trial",
        "seed",
        LABEL,
        "gain",
        ((F.round(base * 100).cast("long") + shift) / 100).alias("pred"),
    )


def key_sql(id_expr: str, seed_expr: str) -> str:
    """The sampling order in SQL."""
    return f"md5(CAST({id_expr} AS VARCHAR) || '-' || CAST({seed_expr} AS VARCHAR))"


def number_sql(id_expr: str, seed_expr: str) -> str:
    """The leading hash digits as a number."""
    return f"CAST('0x' || substr({key_sql(id_expr, seed_expr)}, 1, 13) AS BIGINT)"


SEEDED = (
    SCORED
    + f""",
seeded AS (
  SELECT id, trial, seed, label, gain,
         CAST(CAST(round(CASE WHEN trial = 1 THEN score ELSE score_b END * 100) AS BIGINT)
              + {number_sql("id", "seed")} % 7 AS DOUBLE) / 100 AS pred
  FROM scored, (SELECT unnest([17, 19]) AS seed), (SELECT unnest([1, 2]) AS trial)
)"""
)


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"
