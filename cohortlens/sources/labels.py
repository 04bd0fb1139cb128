"""A labelled panel that is kept up month by month.

A month's label needs the two periods after it, so a new month decides the label of the second one before it and
leaves the older ones alone. Each arrival writes three months (itself and the two before) as a new version of those
partitions, whatever the length of the history; a manifest names the version of every month. A row enters the manifest
only when its data are written, so an arrival that broke off leaves the table as it was and can be repeated.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators.panel import churn_label, observed_periods

VERSION = "version"


def _manifest(spark: SparkSession, root: str, period: str) -> list[tuple]:
    """(period, version, number) of the newest version of every period, in order of periods."""
    try:
        rows = spark.read.parquet(f"{root}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    newest = F.max_by(F.struct(VERSION, "number"), F.struct("number", VERSION)).alias("n")
    found = rows.groupBy(period).agg(newest).orderBy(period)  # one row for a period of the calendar
    return [(r[0], r["n"][VERSION], r["n"]["number"]) for r in found.collect()]


def _write(rows: DataFrame, root: str, period: str, months: list[int], number: int) -> None:
    """A version of some months; it counts from the moment that its manifest rows are there."""
    spark, version = rows.sparkSession, uuid.uuid4().hex
    rows.hint("rebalance", F.col(period)).write.partitionBy(period).parquet(f"{root}/data/{VERSION}={version}")
    kind = T.StructType(
        [rows.schema[period], T.StructField(VERSION, T.StringType()), T.StructField("number", T.IntegerType())]
    )
    entries = spark.createDataFrame([(m, version, number) for m in months], kind)
    entries.coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def _read(spark: SparkSession, root: str, period: str, entries: list[tuple], schema: T.StructType | None = None) -> DataFrame:
    paths = [f"{root}/data/{VERSION}={v}/{period}={m}" for m, v, _ in entries]
    rows = spark.read.option("basePath", f"{root}/data").parquet(*paths).drop(VERSION)
    return rows if schema is None else rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def start(df: DataFrame, root: str, id_col: str, period: str, label: str = "label", calendar: bool = False) -> None:
    """Label a whole panel as the first version. Rows without a period are not kept: no month holds them."""
    rows = df.where(F.col(period).isNotNull())
    months = observed_periods(rows, period)
    _write(churn_label(rows, id_col, period, label, calendar, months), root, period, months, 0)


def add_month(df: DataFrame, root: str, id_col: str, period: str, label: str = "label", calendar: bool = False) -> list[int]:
    """Take in the rows of a new month, the latest so far; returns the months that were written.

    An earlier month, or one that is there already, changes the labels before it in other ways: label the whole
    panel again with `start` under another root. No rows: nothing is written.
    """
    spark = df.sparkSession
    rows = df.where(F.col(period).isNotNull())
    months = observed_periods(rows, period)
    if not months:
        return []
    known = _manifest(spark, root, period)
    if len(months) > 1 or known and months[0] <= known[-1][0]:
        raise ValueError(f"{months} is not one month behind {known[-1][0] if known else 'all others'}")
    before = known[-2:]
    if before:
        schema = T.StructType([f for f in rows.schema])
        rows = _read(spark, root, period, before, schema).unionByName(rows)
    touched = [m for m, _, _ in before] + months
    _write(churn_label(rows, id_col, period, label, calendar, touched), root, period, touched, 1 + max((n for *_, n in known), default=-1))
    return touched


def current(spark: SparkSession, root: str, period: str, months: list[int] | None = None) -> DataFrame:
    """The labelled panel, or some months of it: only the newest folders of those months are read."""
    entries = [e for e in _manifest(spark, root, period) if months is None or e[0] in months]
    if not entries:
        raise ValueError(f"{root} holds none of the months")
    return _read(spark, root, period, entries)
