"""Rule tables that steer imputation, ranks and column dropping.

They have one row per column of a snapshot, so they are read to the driver when a plan is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.ranks import RANKS

# Headers of the three rule files.
DICTIONARY = (
    "var string, min string, max string, nunique bigint, nulls bigint, "
    "DESCRIPCION string, CASO_NULL string"
)
IMPUTATION = "varname string, varcname string, CASO_NULL string"
RANK_FLAGS = (
    "var string, min string, max string, nunique bigint, nulls bigint, DESCRIPCION string, "
    "ordinal string, percentil string, decil string, cuartil string"
)
DROP_LIST = "fname string"

MAX_RULES = 100_000


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, quote='"', escape='"')


def _rows(df: DataFrame) -> list:
    rows = df.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError("a rule table has one row per column; this one is far longer")
    return rows


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, DICTIONARY)


def sentinel_rules(rules: DataFrame, name: str = "varname") -> dict[str, float | None]:
    """Column name to sentinel; a rule without a number means: leave nulls alone."""
    value = F.col("CASO_NULL").try_cast("double")
    found = {r[0]: r[1] for r in _rows(rules.select(name, value))}
    if "varcname" in rules.columns:
        roots = {r[0]: r[1] for r in _rows(rules.select("varcname", value))}
        found = {**roots, **found}
    return found


def read_imputation(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, IMPUTATION)


def read_rank_flags(spark: SparkSession, path: str) -> dict[str, set[str]]:
    """Column name to the rank-family members switched on for it."""
    rows = _rows(_read(spark, path, RANK_FLAGS).select("var", *RANKS))
    return {r["var"]: {m for m in RANKS if r[m] == "T"} for r in rows}


def read_drop_list(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, DROP_LIST)
