"""Experiment-comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import evaluate as E
from cohortlens.plans.analogs import LABEL, SCORED, SEEDS, scored, table, with_
from cohortlens.plans.profit_queries import CUT_POINTS, cut_points, sided_runs
from cohortlens.plans.registry import ORACLES, query
from cohortlens.operators.ordering import small_buckets
from cohortlens.plans.sampling_queries import BOARD, board
from cohortlens.session import stored


@query(
    "seed_mean_curve",
    with_(
        CUT_POINTS,
        """SELECT trial, nro_envios, round(avg(public_cum), 2) AS public_cum_mean,
                  round(avg(private_cum), 2) AS private_cum_mean
           FROM cut_points WHERE nro_envios > 4000 AND nro_envios < 20000 GROUP BY 1, 2""",
    ),
)
def seed_mean_curve(spark, sf):
    curves = cut_points(spark, sf, between=(4001, 20000))
    out = E.seed_mean_curve(curves, ["public_cum", "private_cum"], ["trial"])
    return out.withColumns({c: F.round(c, 2) for c in ("public_cum_mean", "private_cum_mean")})


@query(
    "seed_band",
    with_(
        CUT_POINTS,
        """SELECT trial, nro_envios, round(m, 2) AS mean, round(s, 2) AS std,
                  round(m - s, 2) AS low, round(m + s, 2) AS high
           FROM (SELECT trial, nro_envios, avg(private_cum) AS m, stddev_samp(private_cum) AS s
                 FROM cut_points GROUP BY 1, 2)""",
    ),
)
def seed_band(spark, sf):
    rows = sided_runs(spark, sf)
    out = E.seed_band(cut_points(spark, sf, rows=rows), "private_cum", ["trial"], rows=rows.count())
    return out.withColumns({c: F.round(c, 2) for c in ("mean", "std", "low", "high")})


@query(
    "seed_band_whole_curve",
    with_(
        CUT_POINTS
        + """,
means AS (SELECT trial, nro_envios, avg(private_cum) AS m FROM cut_points GROUP BY 1, 2),
width AS (SELECT trial, stddev_samp(m) AS s FROM means GROUP BY 1)""",
        """SELECT m.trial, nro_envios, round(m, 2) AS mean, round(s, 1) AS std,
                  round(m - s, 1) AS low, round(m + s, 1) AS high
           FROM means m JOIN width w ON w.trial = m.trial""",
    ),
)
def seed_band_whole_curve(spark, sf):
    rows = sided_runs(spark, sf)
    curves = cut_points(spark, sf, rows=rows)
    out = E.seed_band(curves, "private_cum", ["trial"], whole_curve=True, rows=rows.count())
    digits = {"mean": 2, "std": 1, "low": 1, "high": 1}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


# importances of five models: a part name with its lag prefix is a feature
_IMPORTANCE = """
importances AS (
  SELECT CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'lag1_' ELSE 'lag2_' END
           || replace(p_name, ' ', '_') || '_' || lower(p_type) || '_' || p_size % 10 AS fname,
         p_partkey // 3 % 5 AS model, sum(CASE WHEN p_size < 10 THEN 0 ELSE p_size END) AS importance
  FROM part GROUP BY 1, 2
),
means AS (SELECT fname, CAST(sum(importance) AS DOUBLE) / count(*) AS importance
          FROM importances GROUP BY 1)"""


def _importances(spark, sf):
    prefix = (
        F.when(F.col("p_partkey") % 3 == 0, F.lit(""))
        .when(F.col("p_partkey") % 3 == 1, F.lit("lag1_"))
        .otherwise(F.lit("lag2_"))
    )
    name = F.concat(
        prefix,
        F.replace("p_name", F.lit(" "), F.lit("_")),
        F.lit("_"),
        F.lower("p_type"),
        F.lit("_"),
        (F.col("p_size") % 10).cast("string"),
    )
    return (
        table(spark, sf, "part")
        .groupBy(name.alias("fname"), (F.floor(F.col("p_partkey") / 3) % 5).alias("model"))
        .agg(F.sum(F.when(F.col("p_size") < 10, 0).otherwise(F.col("p_size"))).alias("importance"))
    )


def _means(spark, sf):
    return E.importance_mean(_importances(spark, sf), "fname", "importance")


@query("importance_mean", with_(_IMPORTANCE, "SELECT fname, round(importance, 6) AS importance FROM means"))
def importance_mean(spark, sf):
    return _means(spark, sf).select("fname", F.round("importance", 6).alias("importance"))


@query(
    "importance_log",
    with_(
        _IMPORTANCE,
        """SELECT fname, round(ln(1 + importance), 6) AS log_importance FROM means
           WHERE ln(1 + importance) < 3""",
    ),
)
def importance_log(spark, sf):
    low = E.below_log_importance(_means(spark, sf), 3.0)
    return low.select("fname", F.round("log_importance", 6).alias("log_importance"))


@query(
    "root_feature",
    with_(
        _IMPORTANCE,
        """SELECT regexp_replace(fname, '^(lag1_|lag2_)', '') AS root,
                  round(sum(importance), 6) AS importance, count(*) AS n_features
           FROM means GROUP BY 1""",
    ),
)
def root_feature(spark, sf):
    out = E.importance_by_root(_means(spark, sf))
    return out.withColumn("importance", F.round("importance", 6))


@query(
    "bottom_features",
    with_(_IMPORTANCE, "SELECT fname FROM means ORDER BY importance, fname DESC LIMIT 100"),
)
def bottom_features(spark, sf):
    return E.bottom_features(_means(spark, sf), "fname", 100)


@query(
    "top_features",
    with_(
        _IMPORTANCE,
        """SELECT fname, round(importance, 6) AS importance FROM means WHERE importance > 0
           ORDER BY means.importance DESC, fname LIMIT 50""",
    ),
)
def top_features(spark, sf):
    out = E.top_features(_means(spark, sf), "fname", 50)
    return out.select("fname", F.round("importance", 6).alias("importance"))


# trials: one per supplier, scored by the lines it delivered
_TRIALS = """
trials AS (
  SELECT l_suppkey AS number, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS value,
         CASE WHEN l_suppkey % 7 = 3 THEN 'FAIL' ELSE 'COMPLETE' END AS state
  FROM lineitem GROUP BY l_suppkey
)"""


def _trials(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("number")).agg(
        (F.sum(F.col("l_quantity").cast("long")) / F.count(F.lit(1))).alias("value"),
        F.first(F.when(F.col("l_suppkey") % 7 == 3, "FAIL").otherwise("COMPLETE")).alias("state"),
    )


@query(
    "top_trials",
    with_(
        _TRIALS,
        """SELECT number, round(value, 9) AS value, state FROM trials WHERE state = 'COMPLETE'
           ORDER BY trials.value DESC, number LIMIT 10""",
    ),
)
def top_trials(spark, sf):
    return E.top_trials(_trials(spark, sf), 10).withColumn("value", F.round("value", 9))


_RUN_MONTHS = [202105, 202106]


@query(
    "pending_runs",
    with_(
        _TRIALS,
        """SELECT 'exp' AS study, number AS trial, seed, month
           FROM trials, (SELECT unnest([17, 19, 18, 20]) AS seed),
                (SELECT unnest([202105, 202106]) AS month)
           WHERE NOT EXISTS (SELECT 1 FROM part
             WHERE p_partkey % 100 = number AND p_size % 4 + 17 = seed
               AND 202105 + p_partkey % 2 = month)""",
    ),
)
def pending_runs(spark, sf):
    trials = _trials(spark, sf)
    plan = E.plan_runs(trials, "number", SEEDS, _RUN_MONTHS, "exp")
    done = table(spark, sf, "part").select(
        F.lit("exp").alias("study"),
        (F.col("p_partkey") % 100).alias("trial"),
        (F.col("p_size") % 4 + 17).alias("seed"),
        (F.lit(202105) + F.col("p_partkey") % 2).cast("int").alias("month"),
    )
    return E.pending_runs(plan, done, ["study", "trial", "seed", "month"])


_GAINS = ["base_public", "base_private", "alt_public", "alt_private"]
_LONG = (
    BOARD
    + ", long AS ("
    + " UNION ALL ".join(
        f"SELECT CAST(split AS INTEGER) AS split, '{g.split('_')[0]}' AS modelo,"
        f" '{g.split('_')[1]}' AS tipo, {g} AS ganancia FROM board"
        for g in _GAINS
    )
    + ")"
)
_WINNERS = (
    BOARD
    + """,
winners AS (
  SELECT CAST(split AS INTEGER) AS split,
         CASE WHEN base_public >= alt_public THEN 'base_public' ELSE 'alt_public' END AS best_public,
         CASE WHEN base_private >= alt_private THEN 'base_private' ELSE 'alt_private' END
           AS best_private
  FROM board
)"""
)


def _winners(spark, sf):
    return E.leaderboard_winner(
        board(spark, sf), "split", ["base_public", "alt_public"], ["base_private", "alt_private"]
    )


@query("leaderboard_long", with_(_LONG, "SELECT * FROM long"))
def leaderboard_long(spark, sf):
    return E.leaderboard_long(board(spark, sf), "split", _GAINS)


@query("leaderboard_winner", with_(_WINNERS, "SELECT * FROM winners"))
def leaderboard_winner(spark, sf):
    return _winners(spark, sf)


@query(
    "winner_crosstab",
    with_(
        _WINNERS,
        """SELECT best_public, count(*) FILTER (best_private = 'base_private') AS base_private,
                  count(*) FILTER (best_private = 'alt_private') AS alt_private
           FROM winners GROUP BY 1""",
    ),
)
def winner_crosstab(spark, sf):
    values = ["base_private", "alt_private"]
    return E.crosstab(_winners(spark, sf), "best_public", "best_private", values)


@query(
    "gain_histogram",
    with_(
        _LONG,
        """SELECT modelo, tipo, CAST(CASE WHEN ganancia < -2e9 THEN 0 WHEN ganancia >= 2e9 THEN 41
             ELSE floor((ganancia + 2e9) / 1e8) + 1 END AS INTEGER) AS bin, count(*) AS n
           FROM long GROUP BY 1, 2, 3""",
    ),
)
def gain_histogram(spark, sf):
    long = E.leaderboard_long(board(spark, sf), "split", _GAINS)
    return E.gain_histogram(long, "ganancia", ["modelo", "tipo"], -2e9, 2e9, 40)


def _p_sql(z: str) -> str:
    """The two-sided tail of the normal distribution, by the same fit of the error function."""
    t = f"(1 / (1 + abs({z}) / sqrt(2) / 2))"
    power = f"CAST({E.ERFC[-1]} AS DOUBLE)"
    for c in reversed(E.ERFC[:-1]):
        power = f"({c} + {t} * {power})"
    return f"{t} * exp(-({z}) * ({z}) / 2 + {power})"


@query(
    "wilcoxon_stat",
    with_(
        SCORED
        + """,
diffs AS (SELECT coalesce(label, 'none') AS label, round(score - score_b, 6) AS d FROM scored),
ranked AS (
  SELECT label, d, rank() OVER (PARTITION BY label ORDER BY abs(d))
           + (count(*) OVER (PARTITION BY label, abs(d)) - 1) / 2 AS r,
         CAST(count(*) OVER (PARTITION BY label, abs(d)) AS DOUBLE) AS t
  FROM diffs WHERE d <> 0
),
tests AS (
  SELECT label, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus,
         coalesce(sum(r) FILTER (d < 0), 0) AS w_minus, sum(t * t - 1) AS ties
  FROM ranked GROUP BY label
)""",
        """SELECT label, n, w_plus, w_minus, least(w_plus, w_minus) AS statistic,
                  round(z, 6) AS z, round(""" + _p_sql("z") + """, 6) AS p_value
           FROM (SELECT *, (least(w_plus, w_minus) - CAST(n AS DOUBLE) * (n + 1) / 4)
                   / sqrt((CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM tests)""",
    ),
)
def wilcoxon_stat(spark, sf):
    rows = scored(spark, sf).withColumn(LABEL, F.coalesce(LABEL, F.lit("none")))
    out = E.wilcoxon(rows, "score", "score_b", [LABEL], method="approx")
    return out.withColumns({c: F.round(c, 6) for c in ("z", "p_value")})


@query("wilcoxon_stat_buckets", ORACLES["wilcoxon_stat"])
def wilcoxon_stat_buckets(spark, sf):
    with small_buckets():
        return wilcoxon_stat(spark, sf)


# two experiments: the second one has the other trial's scores; curves meet position by position
_PAIRS = (
    CUT_POINTS
    + """,
pairs AS (
  SELECT a.trial, a.seed, round(a.private_cum - b.private_cum, 6) AS d
  FROM cut_points a JOIN cut_points b
    ON b.trial = 3 - a.trial AND b.seed = a.seed AND b.nro_envios = a.nro_envios
  WHERE a.nro_envios BETWEEN 200 AND 1199
),
ranked AS (
  SELECT trial, seed, d, rank() OVER (PARTITION BY trial, seed ORDER BY abs(d))
           + (count(*) OVER (PARTITION BY trial, seed, abs(d)) - 1) / 2 AS r,
         CAST(count(*) OVER (PARTITION BY trial, seed, abs(d)) AS DOUBLE) AS t
  FROM pairs WHERE d <> 0
),
tests AS (
  SELECT trial, seed, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus,
         coalesce(sum(r) FILTER (d < 0), 0) AS w_minus, sum(t * t - 1) AS ties
  FROM ranked GROUP BY trial, seed
)"""
)


@query(
    "wilcoxon_experiments",
    with_(
        _PAIRS,
        """SELECT trial, seed, n, w_plus, w_minus, least(w_plus, w_minus) AS statistic, round(z, 6) AS z,
                  round(""" + _p_sql("z") + """, 6) AS p_value
           FROM (SELECT *, (least(w_plus, w_minus) - CAST(n AS DOUBLE) * (n + 1) / 4)
                   / sqrt((CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM tests)""",
    ),
)
def wilcoxon_experiments(spark, sf):
    first = stored(cut_points(spark, sf, between=(200, 1200)), "curves")
    second = first.withColumn("trial", 3 - F.col("trial"))
    pairs = E.paired_runs(first, second, ["trial", "seed", "nro_envios"], "private_cum")
    out = E.wilcoxon(pairs, "first", "second", ["trial", "seed"], method="approx")
    return out.withColumns({c: F.round(c, 6) for c in ("z", "p_value")})


@query(
    "wilcoxon_exact",
    "WITH RECURSIVE " + (SCORED.split("WITH ", 1)[1] if SCORED.strip().upper().startswith("WITH") else SCORED).strip()
    + """,
diffs AS (SELECT id // 1000000 AS cust, round(score - score_b, 6) AS d FROM scored),
ranked AS (
  SELECT cust, d, rank() OVER (PARTITION BY cust ORDER BY abs(d))
           + (count(*) OVER (PARTITION BY cust, abs(d)) - 1) / 2 AS r,
         CAST(count(*) OVER (PARTITION BY cust, abs(d)) AS DOUBLE) AS t
  FROM diffs WHERE d <> 0
),
tests AS (
  SELECT cust, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus,
         coalesce(sum(r) FILTER (d < 0), 0) AS w_minus, sum(t * t - 1) AS ties
  FROM ranked GROUP BY cust
),
law(n, w, c) AS (
  SELECT 0, 0, CAST(1 AS DOUBLE)
  UNION ALL
  SELECT n, w, sum(c) FROM (
    SELECT n + 1 AS n, w + k * (n + 1) AS w, c FROM law, (SELECT unnest([0, 1]) AS k) WHERE n < 50
  ) GROUP BY n, w
),
chance AS (SELECT n, w, least(1, 2 * sum(c) OVER (PARTITION BY n ORDER BY w) / pow(2, n)) AS p FROM law)
SELECT s.cust, s.n, w_plus, w_minus, least(w_plus, w_minus) AS statistic, round(z, 6) AS z,
       round(CASE WHEN ties = 0 AND s.n <= 50 THEN p ELSE """ + _p_sql("z") + """ END, 6) AS p_value
FROM (SELECT *, (least(w_plus, w_minus) - CAST(n AS DOUBLE) * (n + 1) / 4)
        / sqrt((CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM tests) s
LEFT JOIN chance ON chance.n = s.n AND chance.w = least(w_plus, w_minus)""",
)
def wilcoxon_exact(spark, sf):
    """One test for every customer's months: few pairs, so the exact law counts."""
    rows = scored(spark, sf).withColumn("cust", F.floor(F.col("id") / 1000000))
    out = E.wilcoxon(rows, "score", "score_b", ["cust"])
    return out.withColumns({c: F.round(c, 6) for c in ("z", "p_value")})
