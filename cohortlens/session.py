"""Session settings, durable intermediate tables and size-checked small sides."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A pinned summary is shipped to every executor, so both its rows and its bytes are checked.
PIN_ROWS = 500_000
PIN_BYTES = 64 << 20


def local_session(cores: int | str = "*", app: str = "cohortlens") -> SparkSession:
    """A session for tests and benchmarks on one machine.

    The size limits keep all cores busy on tables of a few megabytes; a cluster keeps Spark's own.
    """
    n = 8 if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the cluster names it.

    Only a session on one machine may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if not current:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cohortlens-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """Write a frame below the shared folder and read it back, cutting its lineage.

    Use it for a frame that is costly (model scores) and read by several passes: later passes
    scan a columnar table, and losing an executor costs only the tasks that ran on it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin(df: DataFrame, row_bytes: int = 100) -> DataFrame:
    """Fix the content of a summary, so that every later pass sees the same values.

    A summary within the limits becomes a broadcast side. A larger one is stored in the shared
    folder and joined by a shuffle, where adaptive execution splits skewed keys. `row_bytes`
    is the expected row width, so that rows with long arrays are not fetched in large numbers.
    """
    most = max(1, min(PIN_ROWS, PIN_BYTES // row_bytes))
    table = df.limit(most + 1).toArrow()
    if table.num_rows <= most and table.nbytes <= PIN_BYTES:
        return F.broadcast(df.sparkSession.createDataFrame(table, schema=df.schema))
    return stored(df, "pinned")


def join_on(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls equal nulls; the keys are kept once."""
    names = {k: f"_other_{k}" for k in keys}
    other = other.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return df.join(other, same, how).drop(*names.values())


def attach(
    df: DataFrame, small: DataFrame, groups: list[str], row_bytes: int = 100
) -> DataFrame:
    """Add the columns of a small per-group summary to every row of its group.

    Without groups the summary is one row, and its values become constants of the plan; a row
    beyond the byte limit is joined instead. Null groups meet null groups; rows whose group is
    missing from the summary get nulls.
    """
    if groups:
        return join_on(df, pin(small, row_bytes), groups, "left")
    text = small.select(F.to_json(F.struct("*"))).first()[0]
    if len(text) > PIN_BYTES:
        return df.crossJoin(stored(small, "attached"))
    row = F.from_json(F.lit(text), small.schema)
    return df.withColumns({c: row[c] for c in small.columns})
