"""The bucketed order must equal plain windows, whatever the distribution."""

import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.operators import ordering as O


def skewed(spark, n=4000):
    """A third of all rows share one value, a third of the groups' rows one group; some nulls."""
    x = F.col("id")
    return spark.range(n).select(
        x.alias("id"),
        F.when(x % 3 == 0, F.lit(7.0))
        .when(x % 11 == 0, F.lit(None))
        .otherwise(F.pmod(F.hash(x), F.lit(500)) / 10)
        .alias("v"),
        F.when(x % 5 < 2, F.lit("big")).otherwise(F.concat(F.lit("g"), (x % 7))).alias("g"),
        (x % 13 - 5).alias("amount"),
    )


def check_running(df, groups, **kw):
    out = O.running(
        df, F.col("v"), F.col("id"), groups, {"s": F.col("amount")}, rank="rk", total="n", **kw
    )
    part = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    rows = part.orderBy(F.col("v").asc_nulls_last(), "id")
    want = df.select(
        "id",
        (F.row_number().over(rows) - 1).alias("position"),
        F.sum("amount").over(rows.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
        F.rank().over(part.orderBy(F.col("v").asc_nulls_last())).alias("rk"),
        F.count("*").over(part).alias("n"),
    )
    cols = ["id", "position", "s", "rk", "n"]
    got = sorted(map(tuple, out.select(cols).collect()))
    assert got == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_running_equals_window(spark, groups):
    check_running(skewed(spark), groups)


def test_running_without_broadcast_sides(spark, tiny_pins):
    check_running(skewed(spark, 1500), ["g"])


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_one_cut_of_default_size_gives_the_same(spark, groups):
    O._SIZES.set(None)
    check_running(skewed(spark), groups)


@pytest.mark.parametrize("groups", [[], ["g"]])
@pytest.mark.parametrize("tie", ["text", "binary", "date"])
def test_any_orderable_tie_and_null_groups(spark, groups, tie):
    made = {
        "text": F.concat(F.lit("customer-"), F.lpad(F.col("id"), 8, "0")),
        "binary": F.encode(F.lpad(F.col("id"), 8, "0"), "utf-8"),
        "date": F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")),
    }[tie]
    df = skewed(spark, 2500).withColumn("g", F.when(F.col("g") != "g3", F.col("g"))).withColumn("id", made)
    check_running(df, groups)
    at = lambda n: F.array(F.lit(0).cast("long"), F.floor(n / 2), n - 1)
    got = O.keys_at(df, F.col("v"), F.col("id"), at, groups)
    part = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    rows = df.withColumn("p", F.row_number().over(part.orderBy(F.col("v").asc_nulls_last(), "id")) - 1)
    rows = rows.withColumn("n", F.count("*").over(part))
    want = rows.where("p = 0 or p = floor(n / 2) or p = n - 1").select(*groups, "n", "p", "v", "id")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_one_value_in_all_rows_is_cut_by_the_tie(spark):
    df = spark.range(3000).select("id", F.lit(1.0).alias("v"), F.lit("a").alias("g"), F.lit(1).alias("amount"))
    check_running(df, ["g"])
    _, buckets, sizes = O.bucketed(df, F.col("v"), F.col("id"))
    assert sizes.agg(F.max("_n")).first()[0] <= 500 and len(buckets) > 1


def test_running_keeps_only_wanted_positions(spark):
    df = skewed(spark)
    out = O.running(df, -F.col("v"), F.col("id"), between=(100, 250))
    assert sorted(r[0] for r in out.select("position").collect()) == list(range(100, 250))
    full = O.running(df, -F.col("v"), F.col("id")).where("position >= 100 and position < 250")
    assert sorted(r[0] for r in out.select("id").collect()) == sorted(
        r[0] for r in full.select("id").collect()
    )


def test_descending_nulls_last_and_ties_by_id(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.9), (4, 0.5)], "id long, v double")
    out = O.running(df, -F.col("v"), F.col("id"))
    assert [r["id"] for r in out.orderBy("position").collect()] == [3, 1, 4, 2]


@pytest.fixture(autouse=True)
def fine_buckets(monkeypatch):
    """Many buckets on small tables."""
    monkeypatch.setattr(O, "BUCKET_ROWS", 1)


def test_small_groups_get_few_buckets(spark, monkeypatch):
    monkeypatch.setattr(O, "BUCKET_ROWS", 64)
    O._SIZES.set((9, 4000))
    df = skewed(spark, 4000)
    check_running(df, ["g"])
    sizes = O.bucketed(df, F.col("v"), F.col("id"), ["g"])[2].groupBy("g").agg(
        F.count("*").alias("n"), F.sum("_n").alias("rows")
    )
    assert all(r["n"] < r["rows"] / 10 for r in sizes.where("rows > 300").collect())


def test_no_bucket_is_larger_than_asked(spark):
    df = skewed(spark, 20000)
    with O.small_buckets(6, 700):
        sizes = O.bucketed(df, F.col("v"), F.col("id"))[2]
    assert sizes.agg(F.max("_n")).first()[0] <= 700


def test_only_buckets_with_wanted_positions_are_joined(spark):
    df = skewed(spark)
    out = O.keys_at(df, F.col("v"), F.col("id"), lambda n: F.array(n - 1, F.lit(0).cast("long")), ["g"])
    rows = Window.partitionBy("g").orderBy(F.col("v").asc_nulls_last(), "id")
    want = df.withColumn("p", F.row_number().over(rows) - 1).withColumn(
        "n", F.count("*").over(Window.partitionBy("g"))
    )
    want = want.where("p = 0 or p = n - 1").select("g", "n", "p", "v", "id")
    key = lambda r: (r[0], r[2])
    assert sorted(map(tuple, out.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_digits_of_a_hash_narrow_down_to_the_same_keys(spark):
    from cohortlens.functions import sample_key

    df = spark.range(3000).select("id", (F.col("id") % 3).alias("g"), sample_key("id", 5).alias("k"))
    at = lambda n: F.array(F.lit(0).cast("long"), F.floor(n / 3), n - 1)
    digits = [F.substring("k", 1, 1), F.substring("k", 2, 1)]
    out = O.keys_at(df, F.col("k"), F.col("id"), at, ["g"], digits=digits)
    want = []
    for g in range(3):
        ids = [r["id"] for r in df.where(F.col("g") == g).orderBy("k", "id").collect()]
        want += [(g, p, ids[p]) for p in (0, 333, 999)]
    assert sorted((r["g"], r["_position"], r["_tie"]) for r in out.collect()) == sorted(want)


def test_place_in_equals_lower_bound(spark):
    df = spark.createDataFrame([(x, [1.0, 2.0, 2.0, 5.0]) for x in (0.0, 1.0, 1.5, 2.0, 4.9, 5.0, 6.0)], "x double, a array<double>")
    out = O.lower_bound(df, "a", "x", "lo", 4).select("lo", O.place_in(F.col("a"), F.col("x"), 4).alias("p"))
    assert all(r["lo"] == r["p"] for r in out.collect())


def test_lower_bound(spark):
    df = spark.createDataFrame(
        [(x, [1.0, 2.0, 2.0, 5.0]) for x in (0.0, 1.0, 1.5, 2.0, 4.9, 5.0, 6.0)],
        "x double, a array<double>",
    )
    df = O.lower_bound(df, "a", "x", "lo", 4)
    df = O.lower_bound(df, "a", "x", "hi", 4, inclusive=True)
    got = [(r["lo"], r["hi"]) for r in df.orderBy("x").collect()]
    assert got == [(0, 0), (0, 1), (1, 1), (1, 3), (3, 3), (3, 4), (4, 4)]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.integers(-3, 3))),
        min_size=1,
        max_size=40,
    )
)
def test_running_on_any_rows(spark, rows):
    data = [(i, g, None if v is None else float(v), i) for i, (g, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, g string, v double, amount long")
    check_running(df, ["g"])


def test_few_cuts_reach_the_asked_size(spark):
    """All rows wanted: the limits of later cuts follow the largest bucket, so their number does not grow with the rows."""
    df = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.hash("id")).alias("v"))
    with O.small_buckets(2, 30):
        _, buckets, sizes = O.bucketed(df, F.col("v"), F.col("id"))
    assert sizes.agg(F.max("_n")).first()[0] <= 30 and len(buckets) <= 4


def test_only_wanted_buckets_are_cut_again(spark):
    df = spark.range(40_000).select("id", F.pmod(F.hash("id"), F.lit(10_000)).cast("double").alias("v"))
    first = lambda n: F.array(F.lit(0).cast("long"))
    made = []
    with O.small_buckets(3, 50):
        plain = O.bucketed
        try:
            O.bucketed = lambda *a, **k: made.append(plain(*a, **k)) or made[-1]
            row = O.keys_at(df, F.col("v"), F.col("id"), first).first()
        finally:
            O.bucketed = plain
    assert (row["_value"], row["_tie"]) == tuple(df.orderBy("v", "id").select("v", "id").first())
    _, _, sizes = made[0]
    assert sizes.agg(F.sum("_n")).first()[0] == 40_000
    assert sizes.count() < 300 and sizes.where("_n <= 50").count() > 1


def test_one_value_needs_no_cut_for_its_quantiles(spark):
    df = spark.range(5000).select("id", F.lit(1.0).alias("v"))
    at = lambda n: F.array(F.lit(0).cast("long"), n - 1)
    with O.small_buckets(3, 50):
        _, buckets, _ = O.bucketed(df, F.col("v"), F.col("id"), values_only=True)
        got = O.keys_at(df, F.col("v"), F.col("id"), at, values_only=True).collect()
    assert len(buckets) == 1 and sorted((r["_position"], r["_value"]) for r in got) == [(0, 1.0), (4999, 1.0)]


def test_one_further_cut_reaches_any_size(spark, monkeypatch):
    """Also of rows that are equal in value and tie, which limits cannot cut; values lie across tasks and batches."""
    monkeypatch.setattr(O, "RANGE_ROWS", 700)
    df = skewed(spark, 6000)
    with O.small_buckets(1, 5):
        _, buckets, sizes = O.bucketed(df.withColumn("id", F.lit(1)), F.col("v"), F.col("id"))
        assert sizes.agg(F.max("_n"), F.sum("_n")).first()[:] == (5, 6000) and len(buckets) == 2
        check_running(df, ["g"])


def test_tasks_that_find_places_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(O, "TASK_ROWS", 500)
    df = skewed(spark, 6000)
    check_running(df, ["g"])
    out = O.running(df, F.col("v"), F.col("id"), ["g"])
    assert out.rdd.getNumPartitions() == 12


def test_few_large_buckets_are_dealt_to_tasks_by_their_rows(spark, monkeypatch):
    """By hash some tasks would hold several buckets and others none."""
    monkeypatch.setattr(O, "TASK_ROWS", 500)
    df = skewed(spark, 6000)
    with O.small_buckets(3, 300):
        _, buckets, sizes = O.bucketed(df, F.col("v"), F.col("id"), ["g"])
        largest = sizes.agg(F.max("_n")).first()[0]
        out = O.running(df, F.col("v"), F.col("id"), ["g"])
        check_running(df, ["g"])
    held = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(held) == 6000 and largest <= 300 and max(held) <= 500 + largest


def test_many_wanted_positions_are_found_by_search(spark):
    """Time follows the buckets, not buckets times positions; positions may come in any order and repeat."""
    array, lo, hi = F.col("a"), F.col("lo"), F.col("hi")
    few = spark.createDataFrame([(x, x + n) for x in range(9) for n in range(5)], "lo long, hi long")
    few = few.withColumn("a", F.array_sort(F.array(*[F.lit(x).cast("long") for x in (7, 1, 3, 3, 4, 1)])))
    for r in few.withColumn("got", O.between_limits(array, lo, hi)).collect():
        assert (r["got"] or []) == [x for x in (1, 1, 3, 3, 4, 7) if r["lo"] <= x < r["hi"]]

    def taken(found):
        start = time.perf_counter()
        df = spark.range(20_000).select(F.col("id").alias("lo"), (F.col("id") + 1).alias("hi"))
        df = df.join(F.broadcast(spark.sql("SELECT sequence(0L, 40000L, 4L) AS a")))
        assert df.select(F.sum(F.size(found))).first()[0] == 5000
        return time.perf_counter() - start

    found = F.coalesce(O.between_limits(array, lo, hi), F.array().cast("array<bigint>"))
    taken(found)
    assert taken(found) * 2 < taken(F.filter(array, lambda p: (p >= lo) & (p < hi)))

    at = lambda n: F.reverse(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(10)))
    df = spark.range(2000).select("id", F.hash("id").alias("v"))
    with O.small_buckets(3, 20):
        got = O.keys_at(df, F.col("v"), F.col("id"), at).collect()
    ordered = [r["id"] for r in df.orderBy("v", "id").select("id").collect()]
    assert sorted((r["_position"], r["_tie"]) for r in got) == [(p, ordered[p]) for p in range(0, 2000, 10)]
