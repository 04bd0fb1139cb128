"""Queries that go through files: intake, reload of curves, submissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators.profit import cutoff_submissions
from cohortlens.plans.analogs import (
    ID,
    LABEL,
    LABELLED,
    PANEL,
    PERIOD,
    SCORE,
    SCORED,
    TRAIN,
    order_months,
    panel,
    scored,
    stored_panel,
    table,
    with_,
)
from cohortlens.plans.profit_queries import CUT_POINTS, cut_points
from cohortlens.plans.registry import query
from cohortlens.session import scratch_path
from cohortlens.sources import curves as C
from cohortlens.sources import labels as L
from cohortlens.sources import tables as T


@query(
    "csv_roundtrip",
    "SELECT * FROM orders",
)
def csv_roundtrip(spark, sf):
    rows = table(spark, sf, "orders")
    path = scratch_path(spark, "csv")
    T.write_csv(rows, path, gzip=True)
    return T.read_csv(spark, path, rows.schema, partitions=8)


@query(
    "versioned_months",
    with_(
        PANEL,
        f"SELECT cust, period, n_orders, spend FROM panel"
        f" WHERE period IN ({', '.join(map(str, TRAIN + SCORE))})",
    ),
)
def versioned_months(spark, sf):
    rows = panel(spark, sf).select(ID, PERIOD, "n_orders", "spend")
    path = T.write_snapshots(rows, scratch_path(spark, "snapshots"), PERIOD)
    return T.read_months(spark, path, PERIOD, TRAIN + SCORE)


@query("label_upkeep", with_(LABELLED, "SELECT cust, period, label FROM labelled"))
def label_upkeep(spark, sf):
    """The label of a panel whose last three months arrived one by one."""
    rows, months = stored_panel(spark, sf), order_months(spark, sf)
    root = scratch_path(spark, "labelled")
    L.start(rows.where(~F.col(PERIOD).isin(months[-3:])), root, ID, PERIOD, LABEL)
    for month in months[-3:]:
        L.add_month(rows.where(F.col(PERIOD) == month), root, ID, PERIOD, LABEL)
    return L.current(spark, root, PERIOD).select(ID, PERIOD, LABEL)


@query(
    "cutpoint_reload",
    with_(
        CUT_POINTS,
        """SELECT 'exp' AS model, CAST(trial AS VARCHAR) AS trial, CAST(seed AS VARCHAR) AS semilla,
                  gain AS ganancia, pred AS y_pred_lgm, nro_envios,
                  public_cum AS public_score_acumulado, private_cum AS private_score_acumulado
           FROM cut_points""",
    ),
)
def cutpoint_reload(spark, sf):
    """Written as CSV named like the runs, and read in one job."""
    folder = scratch_path(spark, "cut-points")
    rows = cut_points(spark, sf).select(
        "trial",
        "seed",
        F.col("gain").alias("ganancia"),
        F.col("pred").alias("y_pred_lgm"),
        "public",
        "private",
        "nro_envios",
        "public_cum",
        "private_cum",
    )
    C.write_cut_point_files(rows, folder, "exp", "trial", "seed", "may")
    return C.read_cut_point_files(spark, folder).drop("public", "private")


@query(
    "submission_files",
    with_(
        SCORED,
        """SELECT n_envios, id, CASE WHEN rn <= n_envios THEN 1 ELSE 0 END AS "Predicted"
           FROM (SELECT id, row_number() OVER (ORDER BY score_b DESC, id) AS rn FROM scored),
                (SELECT unnest([1000, 2000, 100000000]) AS n_envios)""",
    ),
)
def submission_files(spark, sf):
    rows = cutoff_submissions(
        scored(spark, sf).select("id", "score_b"), "score_b", "id", [1000, 2000, 100_000_000]
    )
    path = scratch_path(spark, "submissions")
    C.write_submissions(rows.withColumn("seed", F.lit(17)), path, ["seed"])
    back = spark.read.csv(path, header=True, schema="id bigint, Predicted int, seed int, n_envios bigint")
    return back.drop("seed")
