"""The two null-safe helpers as SQL functions of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Names under which queries call the helpers.
SQL_FUNCTIONS = {
    "suma_sin_null": "coalesce(a, 0) + coalesce(b, 0)",
    "division_segura": "coalesce(a, 0) / nullif(b, 0)",
}


def register_sql_functions(spark: SparkSession) -> None:
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a DOUBLE, b DOUBLE) "
            f"RETURNS DOUBLE RETURN {body}"
        )
