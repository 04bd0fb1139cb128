"""Cut-point tables and submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of a cut-point file and their names after reading it.
CUT_POINT = (
    "ganancia bigint, y_pred_lgm double, public double, private double, "
    "nro_envios bigint, public_cum double, private_cum double"
)
RENAMED = {"public_cum": "public_score_acumulado", "private_cum": "private_score_acumulado"}
FILE_PREFIX = "df_cut_point"

RUN = ["study", "trial", "seed", "month"]


def write_cut_points(df: DataFrame, path: str) -> None:
    """Append runs; each (study, trial, seed, month) has its own folder."""
    df.write.mode("append").partitionBy(*RUN).parquet(path)


def read_cut_points(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumnsRenamed(RENAMED)


def write_cut_point_files(
    df: DataFrame, folder: str, study: str, trial: str, seed: str, month: str
) -> None:
    """Write the curves of all runs in one job; the folder of each run is named like the run."""
    run = F.concat_ws("-", F.lit(FILE_PREFIX), F.lit(study), F.col(trial), F.col(seed), F.lit(month))
    named = df.withColumn("run", run).drop(trial, seed)
    named.write.mode("errorifexists").partitionBy("run").csv(folder, header=True)


def read_cut_point_files(spark: SparkSession, folder: str) -> DataFrame:
    """Read `df_cut_point-<study>-<trial>-<seed>-<month>` files or run folders of one folder.

    Model, trial and seed come from the name; all files are read in one job.
    """
    files = spark.read.csv(f"{folder}/*{FILE_PREFIX}-*", header=True, schema=CUT_POINT)
    name = F.regexp_extract("_metadata.file_path", rf"({FILE_PREFIX}-[^/]+)", 1)
    part = F.split(F.regexp_replace(name, r"\.csv$", ""), "-")
    return files.select(
        *files.columns,
        part.getItem(1).alias("model"),
        part.getItem(2).alias("trial"),
        part.getItem(3).alias("semilla"),
    ).withColumnsRenamed(RENAMED)


def write_submissions(df: DataFrame, path: str, keys: list[str]) -> None:
    """One folder of CSV files per key (trial, seed) and cut-off."""
    df.write.mode("errorifexists").partitionBy(*keys, "n_envios").csv(path, header=True)
