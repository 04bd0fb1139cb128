"""Panel, label, lag and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions.selectors import select_columns
from cohortlens.operators import panel as P
from cohortlens.plans.analogs import (
    ID,
    LABEL,
    LABELLED,
    MEASURES,
    PANEL,
    PERIOD,
    SCORE,
    TRAIN,
    labelled,
    order_months,
    panel,
    with_,
)
from cohortlens.plans.registry import query


def _in(months: list[int]) -> str:
    return ", ".join(map(str, months))


@query("churn_label", with_(LABELLED, "SELECT cust, period, label FROM labelled"))
def churn_label(spark, sf):
    return labelled(spark, sf).select(ID, PERIOD, LABEL)


@query(
    "churn_label_counts",
    with_(
        LABELLED,
        """SELECT period, coalesce(label, 'none') AS label, count(*) AS n
           FROM labelled GROUP BY 1, 2""",
    ),
)
def churn_label_counts(spark, sf):
    rows = labelled(spark, sf)
    return rows.groupBy(PERIOD, F.coalesce(LABEL, F.lit("none")).alias(LABEL)).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "churn_label_calendar",
    """
    WITH monthly AS (SELECT DISTINCT o_custkey AS cust, year(o_orderdate) * 12 + month(o_orderdate) - 1
                  AS ix, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS period
                FROM orders),
    last AS (SELECT max(ix) AS top FROM monthly)
    SELECT a.cust, a.period,
           CASE WHEN a.ix + 2 > top THEN NULL
                WHEN EXISTS (SELECT 1 FROM monthly b WHERE b.cust = a.cust AND b.ix = a.ix + 2)
                  THEN 'CONTINUA'
                WHEN EXISTS (SELECT 1 FROM monthly b WHERE b.cust = a.cust AND b.ix = a.ix + 1)
                  THEN 'BAJA+2'
                ELSE 'BAJA+1' END AS label
    FROM monthly a, last
    """,
)
def churn_label_calendar(spark, sf):
    rows = panel(spark, sf).select(ID, PERIOD)
    return P.churn_label(
        rows, ID, PERIOD, LABEL, calendar=True, periods=order_months(spark, sf)
    )


@query(
    "dense_panel",
    with_(
        PANEL,
        "SELECT cust, period FROM (SELECT DISTINCT cust FROM panel),"
        " (SELECT DISTINCT period FROM panel)",
    ),
)
def dense_panel(spark, sf):
    return P.dense_panel(panel(spark, sf), ID, PERIOD, order_months(spark, sf))


@query(
    "panel_presence",
    with_(
        PANEL,
        """SELECT c.cust, m.period, CASE WHEN p.cust IS NULL THEN 0 ELSE 1 END AS present, p.spend
           FROM (SELECT DISTINCT cust FROM panel) c, (SELECT DISTINCT period FROM panel) m
           LEFT JOIN panel p ON p.cust = c.cust AND p.period = m.period""",
    ),
)
def panel_presence(spark, sf):
    rows = panel(spark, sf).select(ID, PERIOD, "spend")
    return P.panel_presence(rows, ID, PERIOD, periods=order_months(spark, sf))


@query("month_scan", with_(PANEL, f"SELECT * FROM panel WHERE period IN ({_in(TRAIN + SCORE)})"))
def month_scan(spark, sf):
    return panel(spark, sf, TRAIN + SCORE)


@query(
    "month_split",
    with_(
        PANEL,
        f"""SELECT 'train' AS part, cust, period, spend FROM panel WHERE period IN ({_in(TRAIN)})
            UNION ALL
            SELECT 'test', cust, period, spend FROM panel WHERE period IN ({_in(TRAIN[-1:] + SCORE)})""",
    ),
)
def month_split(spark, sf):
    rows = panel(spark, sf).select(ID, PERIOD, "spend")
    train, test = P.month_split(rows, PERIOD, TRAIN, TRAIN[-1:] + SCORE)
    return train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )


_LAGS = ", ".join(f"lag({c}, {k}) OVER w AS lag{k}_{c}" for k in (1, 2) for c in MEASURES)


@query(
    "lag_features",
    with_(
        PANEL,
        f"""SELECT cust, period, {_LAGS} FROM panel
            WINDOW w AS (PARTITION BY cust ORDER BY period)""",
    ),
)
def lag_features(spark, sf):
    rows = panel(spark, sf)
    cols = select_columns(rows, exclude=f"^({ID}|{PERIOD})$")
    return P.lag_features(rows, cols, ID, PERIOD)


@query(
    "lag_features_calendar",
    with_(
        PANEL,
        """SELECT a.cust, a.period, b.spend AS lag1_spend, c.spend AS lag2_spend
           FROM panel a
           LEFT JOIN panel b ON b.cust = a.cust
             AND b.period // 100 * 12 + b.period % 100 = a.period // 100 * 12 + a.period % 100 - 1
           LEFT JOIN panel c ON c.cust = a.cust
             AND c.period // 100 * 12 + c.period % 100 = a.period // 100 * 12 + a.period % 100 - 2
        """,
    ),
)
def lag_features_calendar(spark, sf):
    return P.lag_features(panel(spark, sf), ["spend"], ID, PERIOD, calendar=True)


_VARS = ", ".join(
    f"CAST({c} AS DOUBLE) / nullif(CAST(lag({c}, {k}) OVER w AS DOUBLE), 0) - 1"
    f" AS variacion{k}_{c}"
    for k in (1, 2)
    for c in MEASURES
)


@query(
    "variation",
    with_(
        PANEL,
        f"""SELECT cust, period, {_VARS} FROM panel
            WINDOW w AS (PARTITION BY cust ORDER BY period)""",
    ),
)
def variation(spark, sf):
    return P.variations(panel(spark, sf), MEASURES, ID, PERIOD)


@query(
    "lag_join",
    with_(
        LABELLED,
        """SELECT cust, period, label, spend, lag(spend, 1) OVER w AS lag1_spend,
                  lag(spend, 2) OVER w AS lag2_spend
           FROM labelled WINDOW w AS (PARTITION BY cust ORDER BY period)""",
    ),
)
def lag_join(spark, sf):
    rows = labelled(spark, sf).select(ID, PERIOD, LABEL, "spend")
    lags = P.lag_features(rows, ["spend"], ID, PERIOD, keep=[LABEL])
    return P.lag_join(rows, lags, ID, PERIOD, LABEL)


@query(
    "lag_join_match_label",
    with_(
        LABELLED,
        """SELECT * FROM (
             SELECT cust, period, label, spend, lag(spend, 1) OVER w AS lag1_spend,
                    lag(spend, 2) OVER w AS lag2_spend
             FROM labelled WINDOW w AS (PARTITION BY cust ORDER BY period))
           WHERE label IS NOT NULL""",
    ),
)
def lag_join_match_label(spark, sf):
    rows = labelled(spark, sf).select(ID, PERIOD, LABEL, "spend")
    lags = P.lag_features(rows, ["spend"], ID, PERIOD, keep=[LABEL])
    return P.lag_join(rows, lags, ID, PERIOD, LABEL, match_label=True)


@query(
    "duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS "count" FROM lineitem
       GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicate_keys(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    return P.duplicate_keys(rows, "l_orderkey", "l_linenumber")


# every third row of the panel twice: with the same key, other amounts
_REPEATED = (
    LABELLED
    + """,
repeated AS (
  SELECT cust, period, spend FROM panel
  UNION ALL SELECT cust, period, spend + 1 FROM panel WHERE (cust + period) % 3 = 0
)"""
)


def _repeated(spark, sf):
    rows = panel(spark, sf).select(ID, PERIOD, "spend")
    again = rows.where((F.col(ID) + F.col(PERIOD)) % 3 == 0).withColumn("spend", F.col("spend") + 1)
    return rows.unionByName(again)


@query(
    "churn_label_repeated_keys",
    with_(
        _REPEATED,
        """SELECT r.cust, r.period, round(r.spend, 2) AS spend, l.label
           FROM repeated r JOIN labelled l ON l.cust = r.cust AND l.period = r.period""",
    ),
)
def churn_label_repeated_keys(spark, sf):
    rows = P.churn_label(_repeated(spark, sf), ID, PERIOD, LABEL, periods=order_months(spark, sf))
    return rows.withColumn("spend", F.round("spend", 2))


@query(
    "one_row_per_key",
    with_(_REPEATED, "SELECT cust, period, round(max(spend), 2) AS spend FROM repeated GROUP BY 1, 2"),
)
def one_row_per_key(spark, sf):
    return P.one_row_per_key(_repeated(spark, sf), ID, PERIOD).withColumn("spend", F.round("spend", 2))
