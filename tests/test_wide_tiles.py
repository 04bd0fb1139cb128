"""Tiles of many columns against one sort per column."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import ordering, ranks
from cohortlens.plans import feature_queries


def plain_tiles(rows, column, tiles):
    """{(period, id): tile} of one column; nulls last, ties by id."""
    out = {}
    for period in {r["period"] for r in rows}:
        own = sorted((r for r in rows if r["period"] == period), key=lambda r: (r[column] is None, r[column] or 0, r["id"]))
        n = len(own)
        for i, r in enumerate(own):
            small, wide = divmod(n, tiles)
            edge = wide * (small + 1)
            out[period, r["id"]] = i // (small + 1) + 1 if i < edge else wide + (i - edge) // small + 1
    return out


@pytest.mark.parametrize("bits, split_rows, searched", [(5, 500, True), (3, 20, True), (4, 10_000, False)])
def test_tiles_of_many_columns(spark, monkeypatch, bits, split_rows, searched):
    """Cut by limits, cut again by long rows, and tile ends that are too many to be sent."""
    if not searched:
        monkeypatch.setattr(ranks, "END_ROWS", 3)
    rng = random.Random(bits)
    rows = [
        {"period": p, "id": f"c{i:04d}", "a": rng.choice([None, 0.0, 1.0, rng.random()]), "b": float(rng.randint(0, 3)), "c": None,
         "kept": i}
        for p in (1, 2, None) for i in range(150 if p == 1 else 7)
    ]
    df = spark.createDataFrame(rows, "period int, id string, a double, b double, c double, kept int").repartition(3)
    with ordering.small_buckets(bits, split_rows):
        out = ranks.ntile_features(df, ["a", "b", "c"], "id", "period", tiles=10)
        assert out.columns == ["period", "id", "kept", "ntile_a", "ntile_b", "ntile_c"]
        got = out.collect()
    assert len(got) == len(rows)
    for column in "abc":
        want = plain_tiles(rows, column, 10)
        assert {(r["period"], r["id"]): r[f"ntile_{column}"] for r in got} == want, column


def test_number_ids_and_no_rows(spark):
    df = spark.range(1000).select(
        (F.col("id") % 2).alias("period"), "id", (F.col("id") * 7919 % 13).alias("a"), (-F.col("id")).cast("double").alias("b")
    )
    out = ranks.ntile_features(df, ["a", "b"], "id", "period", tiles=200, replace=False).collect()
    rows = [r.asDict() for r in df.collect()]
    for column in "ab":
        assert {(r["period"], r["id"]): r[f"ntile_{column}"] for r in out} == plain_tiles(rows, column, 200)
    assert ranks.ntile_features(df.limit(0), ["a", "b"], "id", "period").collect() == []


def shares_of_wanted_rows(limits, values, tiles):
    """For each column of a period the share of its rows that lie in buckets with a tile's end."""
    out = []
    for cut, x in zip(limits, values):
        x = np.sort(x)
        at = np.searchsorted(cut, x)
        bucket = 2 * at + (np.append(cut, np.nan)[at] == x)
        i = np.arange(1, tiles)
        ends = i * (len(x) // tiles) + np.minimum(i, len(x) % tiles) - 1
        out.append(np.isin(bucket, bucket[ends]).mean())
    return out


def test_few_rows_lie_where_a_tile_may_end(spark, monkeypatch):
    """Rows with ids that numpy orders, enough to have limits: NaN behind numbers, nulls last, -0.0 equal to 0.0."""
    ordering._SIZES.set(None)
    found, limits_of = [], ranks._column_limits
    monkeypatch.setattr(ranks, "_column_limits", lambda *args: found.append(limits_of(*args)) or found[0])
    rng = random.Random(7)
    rows = [
        {"period": p, "id": i * 7919 % 30_011, "a": rng.random(), "b": float(rng.randint(0, 2000)),
         "c": rng.choice([None, float("nan"), -0.0, 0.0, 1.0, rng.random()]), "d": float(rng.randint(0, 3))}
        for i, p in enumerate([1] * 20_000 + [None] * 1_500 + [2] * 30)
    ]
    df = spark.createDataFrame(rows, "period int, id long, a double, b double, c double, d double").repartition(2).sortWithinPartitions("period")
    got = ranks.ntile_features(df, list("abcd"), "id", "period", tiles=50).collect()
    for column in "abcd":
        nan = {r["id"] for r in rows if r[column] is not None and math.isnan(r[column])}
        key = lambda r: (r[column] is None, r["id"] in nan, 0 if r["id"] in nan else r[column] or 0)  # noqa: B023, E731
        number = {k: float(i) for i, k in enumerate(sorted({key(r) for r in rows}))}
        want = plain_tiles([{**r, column: number[key(r)]} for r in rows], column, 50)
        assert {(r["period"], r["id"]): r[f"ntile_{column}"] for r in got} == want, column
    values = [np.array([r[c] for r in rows if r["period"] == 1]) for c in "ab"]
    assert max(shares_of_wanted_rows(found[0][1], values, 50)) < 0.3


def test_the_wide_query_stores_no_wide_table(spark, monkeypatch):
    stored, widths = feature_queries.stored, []
    monkeypatch.setattr(feature_queries, "stored", lambda df, name="stored": widths.append(len(df.columns)) or stored(df, name))
    feature_queries.ntile_features_wide(spark, "/root/testdata/sf0.001")
    assert widths == [4]
