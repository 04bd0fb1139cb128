"""Gain, curve and cut-off queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions.scalars import LEAVES_SECOND, row_gain as gain_of
from cohortlens.operators import profit as G
from cohortlens.operators.sampling import in_exact_sample, stratified_split
from cohortlens.plans.analogs import (
    ID,
    LABEL,
    LABELLED,
    PERIOD,
    SCORED,
    SEEDED,
    key_sql,
    labelled,
    scored,
    seeded,
    with_,
)
from cohortlens.plans.registry import ORACLES, query
from cohortlens.operators.ordering import small_buckets
from cohortlens.session import stored

CURVE = (
    SCORED
    + """,
curve AS (
  SELECT id, score, gain, row_number() OVER w - 1 AS nro_envios, row_number() OVER w AS n_sent,
         CAST(sum(gain) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gain_cum
  FROM scored WINDOW w AS (ORDER BY score DESC, id)
)"""
)


def curve(spark, sf, between=None):
    rows = scored(spark, sf).select("id", "score", "gain")
    return G.gain_curve(rows, "score", "id", "gain", between=between)


@query(
    "row_gain",
    with_(
        LABELLED,
        """SELECT cust, period, CAST(CASE WHEN label = 'BAJA+2' THEN 273000 ELSE -7000 END AS BIGINT)
             AS gain FROM labelled""",
    ),
)
def row_gain(spark, sf):
    rows = labelled(spark, sf)
    return rows.select(ID, PERIOD, gain_of(F.col(LABEL).eqNullSafe(LEAVES_SECOND)).alias("gain"))


@query("gain_curve", with_(CURVE, "SELECT * FROM curve"))
def gain_curve(spark, sf):
    return curve(spark, sf)


@query("gain_max", with_(CURVE, "SELECT max(gain_cum) AS gain_max FROM curve"))
def gain_max(spark, sf):
    return G.gain_max(scored(spark, sf), "score", "id", "gain")


@query(
    "best_cutoff",
    with_(
        CURVE,
        """SELECT gain_cum AS best_value, nro_envios AS best_pos FROM curve
           ORDER BY gain_cum DESC, nro_envios LIMIT 1""",
    ),
)
def best_cutoff(spark, sf):
    return G.best_contact(scored(spark, sf), "score", "id", "gain")


@query(
    "best_contact_by_label_buckets",
    with_(
        SCORED,
        """SELECT label, max(g) AS best_value, arg_min(p, -g * 1000000000 + p) AS best_pos
           FROM (SELECT label, CAST(sum(gain) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS g, row_number() OVER w - 1 AS p
                 FROM scored WINDOW w AS (PARTITION BY label ORDER BY score DESC, id)) GROUP BY label""",
    ),
)
def best_contact_by_label_buckets(spark, sf):
    """By group, null labels too, on tables cut again and again."""
    with small_buckets():
        return G.best_contact(scored(spark, sf), "score", "id", "gain", [LABEL])


@query(
    "curve_window",
    with_(CURVE, "SELECT * FROM curve WHERE nro_envios > 4000 AND nro_envios < 14000"),
)
def curve_window(spark, sf):
    return G.curve_window(curve(spark, sf, between=(4001, 14000)), 4000, 14000)


@query(
    "gain_at_threshold",
    with_(
        SCORED,
        """SELECT coalesce(label, 'none') AS label, CAST(sum(CASE WHEN score >= CAST(0.025 AS DOUBLE)
             THEN gain ELSE 0 END) AS DOUBLE) AS gain FROM scored GROUP BY 1""",
    ),
)
def gain_at_threshold(spark, sf):
    rows = scored(spark, sf).withColumn(LABEL, F.coalesce(LABEL, F.lit("none")))
    return G.gain_at_threshold(rows, "score", "gain", groups=[LABEL])


CUT_POINTS = (
    SEEDED
    + f""",
sided AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY trial, seed, label
                        ORDER BY {key_sql("id", "seed")}, id)
                      <= round_even(count(*) OVER (PARTITION BY trial, seed, label) * 0.3, 0)
                 THEN 'public' ELSE 'private' END AS side
  FROM seeded
),
cut_points AS (
  SELECT trial, seed, id, gain, pred, side, row_number() OVER w - 1 AS nro_envios,
         round(CAST(sum(CASE WHEN side = 'public' THEN gain ELSE 0 END)
           OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(0.3 AS DOUBLE), 4) AS public_cum,
         round(CAST(sum(CASE WHEN side = 'private' THEN gain ELSE 0 END)
           OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(0.7 AS DOUBLE), 4) AS private_cum
  FROM sided WINDOW w AS (PARTITION BY trial, seed ORDER BY pred DESC, id)
)"""
)


def sided_runs(spark, sf):
    """The rows of every trial and seed, each on its side, as a table."""
    rows = seeded(spark, sf)
    rows = in_exact_sample(rows, "id", ["trial", "seed", LABEL], 0.3, F.col("seed"), "_public")
    rows = rows.withColumn("side", F.when(F.col("_public"), F.lit("public")).otherwise("private"))
    return stored(rows.drop("_public", LABEL), "sided")


def cut_points(spark, sf, between=None, rows=None):
    """Public and private curves of every trial and seed; `rows` are those of `sided_runs`, if made before."""
    rows = sided_runs(spark, sf) if rows is None else rows
    out = G.public_private_curve(rows, "pred", "id", "gain", "side", ["trial", "seed"], between)
    return out.withColumns({c: F.round(c, 4) for c in ("public_cum", "private_cum")})


@query(
    "public_private_curve",
    with_(
        SCORED,
        f"""SELECT id, side, nro_envios, round(public / CAST(0.3 AS DOUBLE), 4) AS public_cum,
                   round(private / CAST(0.7 AS DOUBLE), 4) AS private_cum
            FROM (
              SELECT id, side, row_number() OVER w - 1 AS nro_envios,
                CAST(sum(CASE WHEN side = 'public' THEN gain ELSE 0 END)
                  OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS public,
                CAST(sum(CASE WHEN side = 'private' THEN gain ELSE 0 END)
                  OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS private
              FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label
                                ORDER BY {key_sql("id", 17)}, id)
                              <= round_even(count(*) OVER (PARTITION BY label) * 0.3, 0)
                            THEN 'public' ELSE 'private' END AS side FROM scored)
              WINDOW w AS (ORDER BY score DESC, id))""",
    ),
)
def public_private_curve(spark, sf):
    rows = scored(spark, sf).select("id", LABEL, "score", "gain")
    sided = stratified_split(rows, "id", LABEL, 0.3, seed=17)
    out = G.public_private_curve(sided, "score", "id", "gain", "side")
    return out.select(
        "id",
        "side",
        "nro_envios",
        F.round("public_cum", 4).alias("public_cum"),
        F.round("private_cum", 4).alias("private_cum"),
    )


@query(
    "best_cutoff_grid",
    with_(
        CUT_POINTS,
        """SELECT trial, seed, public_cum AS best_value, nro_envios AS best_pos
           FROM cut_points WHERE nro_envios BETWEEN 4000 AND 9000 AND (nro_envios - 4000) % 500 = 0
           QUALIFY row_number() OVER (PARTITION BY trial, seed ORDER BY public_cum DESC, nro_envios) = 1
        """,
    ),
)
def best_cutoff_grid(spark, sf):
    grid = G.on_grid(cut_points(spark, sf, between=(4000, 9001)), 4000, 500, 10)
    return G.best_cutoff(grid, "public_cum", ["trial", "seed"])


CUTOFFS = list(range(8000, 14000, 250))


@query(
    "cutoff_submissions",
    with_(
        SCORED,
        f"""SELECT n_envios, id, CASE WHEN rn <= n_envios THEN 1 ELSE 0 END AS "Predicted"
            FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rn FROM scored),
                 (SELECT unnest({CUTOFFS}) AS n_envios)""",
    ),
)
def cutoff_submissions(spark, sf):
    rows = scored(spark, sf).select("id", "score")
    return G.cutoff_submissions(rows, "score", "id", CUTOFFS)


@query("gain_curve_buckets", ORACLES["gain_curve"])
def gain_curve_buckets(spark, sf):
    with small_buckets():
        return gain_curve(spark, sf)


@query("public_private_curve_buckets", ORACLES["public_private_curve"])
def public_private_curve_buckets(spark, sf):
    with small_buckets():
        return public_private_curve(spark, sf)


@query("curve_window_buckets", ORACLES["curve_window"])
def curve_window_buckets(spark, sf):
    with small_buckets():
        return curve_window(spark, sf)


@query("cutoff_submissions_buckets", ORACLES["cutoff_submissions"])
def cutoff_submissions_buckets(spark, sf):
    with small_buckets():
        return cutoff_submissions(spark, sf)


@query("best_cutoff_grid_buckets", ORACLES["best_cutoff_grid"])
def best_cutoff_grid_buckets(spark, sf):
    with small_buckets():
        return best_cutoff_grid(spark, sf)


# customers with text ids, and rows of no month
_TEXT_ID = "printf('customer-%015d', id)"


def _text_id():
    return F.format_string("customer-%015d", "id").alias("id")


@query(
    "gain_curve_text_id",
    with_(
        SCORED,
        f"""SELECT id, score, gain, row_number() OVER w - 1 AS nro_envios, row_number() OVER w AS n_sent,
                   CAST(sum(gain) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gain_cum
            FROM (SELECT {_TEXT_ID} AS id, score, gain FROM scored)
            WINDOW w AS (ORDER BY score DESC, id)""",
    ),
)
def gain_curve_text_id(spark, sf):
    rows = scored(spark, sf).select(_text_id(), "score", "gain")
    return G.gain_curve(rows, "score", "id", "gain")


_NULL_GROUP = "nullif(period // 100, 1996)"


def _null_group():
    year = F.floor(F.col(PERIOD) / 100).cast("int")
    return F.when(year != 1996, year).alias("year")


@query(
    "gain_curve_null_group",
    with_(
        SCORED,
        f"""SELECT year, id, score, gain, row_number() OVER w - 1 AS nro_envios,
                   row_number() OVER w AS n_sent,
                   CAST(sum(gain) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gain_cum
            FROM (SELECT {_NULL_GROUP} AS year, id, score, gain FROM scored)
            WINDOW w AS (PARTITION BY year ORDER BY score DESC, id)""",
    ),
)
def gain_curve_null_group(spark, sf):
    rows = scored(spark, sf).select(_null_group(), "id", "score", "gain")
    return G.gain_curve(rows, "score", "id", "gain", ["year"])


@query(
    "cutoff_submissions_null_group",
    with_(
        SCORED,
        f"""SELECT year, n_envios, id, CASE WHEN rn <= n_envios THEN 1 ELSE 0 END AS "Predicted"
            FROM (SELECT year, id, row_number() OVER (PARTITION BY year ORDER BY score DESC, id) AS rn
                  FROM (SELECT {_NULL_GROUP} AS year, {_TEXT_ID} AS id, score FROM scored)),
                 (SELECT unnest([0, 250, 1000]) AS n_envios)""",
    ),
)
def cutoff_submissions_null_group(spark, sf):
    rows = scored(spark, sf).select(_null_group(), _text_id(), "score")
    return G.cutoff_submissions(rows, "score", "id", [0, 250, 1000], ["year"])
