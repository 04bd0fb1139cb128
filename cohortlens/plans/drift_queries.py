"""Drift and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import drift as D
from cohortlens.plans.analogs import ID, MEASURES, PANEL, PERIOD, stored_panel, table, with_
from cohortlens.functions.scalars import yyyymm
from cohortlens.plans.registry import ORACLES, query
from cohortlens.operators.ordering import small_buckets

_TRAIN = [199500 + m for m in range(1, 13)] + [199600 + m for m in range(1, 13)]
_SCORE = [199700 + m for m in range(1, 13)] + [199800 + m for m in range(1, 13)]


def _in(months: list[int]) -> str:
    return ", ".join(map(str, months))


def _psi_sql(long: str, buckets: int) -> str:
    """The index from a CTE `long` with (feature, period, value)."""
    at = f"(n - 1) * i // {buckets}"
    return f"""
    WITH {long},
    sorted AS (SELECT feature, list(value ORDER BY value) AS vs, count(*) AS n FROM long
               WHERE value IS NOT NULL AND period IN ({_in(_TRAIN)}) GROUP BY feature),
    points AS (SELECT feature, n, vs, unnest(range(0, {buckets + 1})) AS i FROM sorted),
    quant AS (SELECT DISTINCT feature,
                vs[{at} + 1] + (vs[least({at} + 1, n - 1) + 1] - vs[{at} + 1])
                  * (CAST((n - 1) * i % {buckets} AS DOUBLE) / {buckets}) AS e FROM points),
    edges AS (SELECT feature, e AS low, lead(e) OVER w AS high, row_number() OVER w AS b,
                     count(*) OVER (PARTITION BY feature) AS m
              FROM quant WINDOW w AS (PARTITION BY feature ORDER BY e)),
    sides AS (SELECT feature, value, CASE WHEN period IN ({_in(_TRAIN)}) THEN 1 ELSE 0 END AS t
              FROM long WHERE period IN ({_in(_TRAIN + _SCORE)})),
    sizes AS (SELECT feature,
                     sum(t) FILTER (value IS NOT NULL) AS te, sum(1 - t) FILTER (value IS NOT NULL) AS ta,
                     sum(t) FILTER (value IS NULL) AS ne, sum(1 - t) FILTER (value IS NULL) AS na
              FROM sides GROUP BY feature),
    bins AS (SELECT x.feature, x.b, sum(s.t) AS e, sum(1 - s.t) AS a
             FROM edges x LEFT JOIN sides s ON s.feature = x.feature AND s.value >= x.low
               AND (s.value < x.high OR (x.b = x.m - 1 AND s.value = x.high))
             WHERE x.high IS NOT NULL GROUP BY x.feature, x.b),
    shares AS (SELECT b.feature, CAST(coalesce(e, 0) AS DOUBLE) / te AS p,
                      CAST(coalesce(a, 0) AS DOUBLE) / ta AS q
               FROM bins b JOIN sizes z ON z.feature = b.feature),
    main AS (SELECT feature, sum(CASE WHEN p = 0 AND q = 0 THEN CAST('nan' AS DOUBLE)
                                      WHEN p = 0 OR q = 0 THEN CAST('inf' AS DOUBLE)
                                      ELSE (q - p) * ln(q / p) END) AS psi
             FROM shares GROUP BY feature),
    nulls AS (SELECT feature, CAST(ne AS DOUBLE) / (te + ne) AS p,
                     CAST(na AS DOUBLE) / (ta + na) AS q FROM sizes WHERE ne > 0 AND na > 0)
    SELECT z.feature, round(coalesce(m.psi, 0) + coalesce((k.q - k.p) * ln(k.q / k.p), 0), 6) AS psi
    FROM sizes z LEFT JOIN main m ON m.feature = z.feature LEFT JOIN nulls k ON k.feature = z.feature
    """


@query(
    "psi_feature",
    _psi_sql(
        """long AS (SELECT 'l_extendedprice' AS feature, l_extendedprice AS value,
             year(l_shipdate) * 100 + month(l_shipdate) AS period FROM lineitem)""",
        255,
    ),
)
def psi_feature(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_extendedprice", yyyymm("l_shipdate").alias(PERIOD)
    )
    out = D.psi(rows, ["l_extendedprice"], "l_orderkey", PERIOD, _TRAIN, _SCORE)
    return out.withColumn("psi", F.round("psi", 6))


@query(
    "psi_all",
    _psi_sql(
        PANEL.strip()
        + ", long AS ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, period, CAST({c} AS DOUBLE) AS value FROM panel"
            for c in MEASURES
        )
        + ")",
        20,
    ),
)
def psi_all(spark, sf):
    out = D.psi(stored_panel(spark, sf, _TRAIN + _SCORE), MEASURES, ID, PERIOD, _TRAIN, _SCORE, buckets=20)
    return out.withColumn("psi", F.round("psi", 6))


@query(
    "describe_numeric",
    with_(
        PANEL
        + ", long AS ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM panel" for c in MEASURES
        )
        + ")",
        """SELECT feature, count(value) AS "count", round(avg(value), 4) AS mean,
                  round(stddev_samp(value), 4) AS std, min(value) AS min,
                  round(quantile_cont(value, 0.25), 6) AS p25,
                  round(quantile_cont(value, 0.5), 6) AS p50,
                  round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max
           FROM long WHERE value IS NOT NULL GROUP BY feature""",
    ),
)
def describe_numeric(spark, sf):
    out = D.describe_numeric(stored_panel(spark, sf), MEASURES, ID)
    quartiles = {c: F.round(c, 6) for c in ("p25", "p50", "p75")}
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4), **quartiles})


_PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "paid"]


@query(
    "column_profile",
    "WITH lines AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice END AS paid"
    " FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,"
        f" count(DISTINCT {c}) AS nunique, count(*) - count({c}) AS nulls FROM lines"
        for c in _PROFILED
    ),
)
def column_profile(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn(
        "paid", F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice"))
    )
    return D.column_profile(lines, _PROFILED)


@query("psi_feature_buckets", ORACLES["psi_feature"])
def psi_feature_buckets(spark, sf):
    with small_buckets():
        return psi_feature(spark, sf)


@query("psi_all_buckets", ORACLES["psi_all"])
def psi_all_buckets(spark, sf):
    with small_buckets():
        return psi_all(spark, sf)


@query("describe_numeric_buckets", ORACLES["describe_numeric"])
def describe_numeric_buckets(spark, sf):
    with small_buckets():
        return describe_numeric(spark, sf)


_ALL_PROFILED = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                 "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "paid"]


@query(
    "column_profile_all_types",
    "WITH lines AS (SELECT * EXCLUDE (l_shipdate), CAST(l_shipdate AS DATE) AS l_shipdate,"
    " CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_shipmark END AS paid"
    " FROM (SELECT *, 9007199254740992 + l_orderkey AS l_shipmark FROM lineitem)) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max,"
        f" count(DISTINCT {c}) AS nunique, count(*) - count({c}) AS nulls FROM lines"
        for c in _ALL_PROFILED
    ),
)
def column_profile_all_types(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    lines = lines.withColumn("paid", F.when(F.col("l_returnflag") != "R", F.lit(2**53) + F.col("l_orderkey")))
    return D.column_profile(lines, _ALL_PROFILED)


@query("psi_report", ORACLES["psi_all"])
def psi_report(spark, sf):
    return D.psi_report(psi_all(spark, sf))
