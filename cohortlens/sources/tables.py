"""Snapshot tables: CSV intake, Parquet by period, versions, result files."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators.panel import months_in


def snapshot_schema(
    names: list[str], id_col: str, period: str, label: str | None = None
) -> T.StructType:
    """Types by naming rule: leading `m` or a card amount is a double, everything else an int.

    Card columns carry a brand prefix up to the first underscore.
    """

    def kind(name: str) -> T.DataType:
        if name == id_col:
            return T.LongType()
        if name == label:
            return T.StringType()
        if name == period:
            return T.IntegerType()
        bare = name.split("_", 1)[1] if name[:1].isupper() and "_" in name else name
        return T.DoubleType() if bare.startswith("m") else T.IntegerType()

    return T.StructType([T.StructField(n, kind(n)) for n in names])


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, partitions: int | None = None
) -> DataFrame:
    """Read plain or gzip CSV with a header.

    A gzip file is one task however large, so a big one should be repartitioned and written to
    Parquet once.
    """
    df = spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")
    return df.repartition(partitions) if partitions else df


def write_csv(df: DataFrame, path: str, partition_by: list[str] = (), gzip: bool = False) -> None:
    writer = df.write.mode("errorifexists").option("header", True)
    if gzip:
        writer = writer.option("compression", "gzip")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def new_version(root: str) -> str:
    return f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"


def write_snapshots(df: DataFrame, root: str, period: str) -> str:
    """Write a new version of the table, one folder per period, and return its path.

    A version is never written over, so a job may read the old one while it writes the new one.
    Rows are gathered by period, and adaptive execution splits a period that is too large for
    one task into several files.
    """
    path = new_version(root)
    df.hint("rebalance", F.col(period)).write.partitionBy(period).parquet(path)
    return path


def read_months(spark: SparkSession, path: str, period: str, months: list[int]) -> DataFrame:
    """Rows of some months; only their folders are read."""
    return months_in(spark.read.parquet(path), period, months)


def finished_runs(spark: SparkSession, path: str, keys: list[str], schema: str) -> DataFrame:
    """Keys of the runs already written; empty when nothing has been written."""
    try:
        return spark.read.parquet(path).select(*keys).distinct()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
