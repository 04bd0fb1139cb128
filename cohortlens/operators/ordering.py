"""Ordering a whole table, or huge groups of it, without sending a group to one task.

A window without partitions, or partitioned by a month, runs in as many tasks as there are
months. Here each group is cut into buckets whose order follows the sort key, at every size:

1. approximate quantiles of the value give the bucket limits (one partial aggregate);
2. row counts and sums per bucket give every bucket its starting position (partial aggregate);
3. wanted buckets with too many rows are cut again, all in one sort by ranges of the whole key: its tasks follow the rows, not
   the groups, and cut their sorted rows into pieces of the asked size, so one cut does, whatever the values or the size;
4. only rows of the same bucket are sorted together.

The limits decide how even the buckets are, never the result; their number follows the rows that
were counted. The sort key is (value ascending with nulls last, tie); tie must be unique
inside a value and may have any type that can be ordered. Null groups are groups like others.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.session import attach, join_on, pin, stored

VALUE, TIE = "_value", "_tie"
# Limits of one cut, as a power of two: of a whole table, and of each group.
BITS, GROUP_BITS = 10, 7
# Fewer rows than this are not worth a bucket of their own; more than this are cut again.
BUCKET_ROWS, SPLIT_ROWS = 64, 4_000_000
# Rows that one task sorts when buckets are cut again, and when the rows of buckets get their places.
RANGE_ROWS, TASK_ROWS = 250_000, 1_000_000
# More buckets a task than this are dealt evenly by hash; fewer are dealt to tasks by their rows.
TASK_BUCKETS = 64

_SIZES: ContextVar[tuple[int, int] | None] = ContextVar("sizes", default=None)


@contextmanager
def small_buckets(bits: int = 3, split_rows: int = 100):
    """Plans made inside cut coarsely and then again and again, as those of very large tables do."""
    token = _SIZES.set((bits, split_rows))
    try:
        yield
    finally:
        _SIZES.reset(token)


def lower_bound(
    df: DataFrame, array: str, key: str, out: str, size: int, inclusive: bool = False
) -> DataFrame:
    """Add the number of elements of a sorted array column that come before the key column.

    A binary search, one projection per step, so it stays generated code. `size` is an upper
    limit of the array length; `inclusive` also counts elements equal to the key.
    """
    df = df.withColumn(out, F.lit(0))
    step = 1 << max(size.bit_length() - 1, 0)
    before = "<=" if inclusive else "<"
    while step:
        probe = f"get(`{array}`, `{out}` + {step - 1}) {before} `{key}`"
        df = df.withColumn(out, F.expr(f"`{out}` + if({probe}, {step}, 0)"))
        step >>= 1
    return df


def place_in(array: Column, key: Column, size: int) -> Column:
    """The number of elements of a sorted array before a key, as one expression.

    `size` is an upper limit of the array length. For many columns in one projection: the plan grows with
    the columns only, not with the steps of the search.
    """
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(size.bit_length()))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: at + F.when(F.get(array, at + step - 1) < key, step).otherwise(0),
    )


def _first_from(array: Column, key: Column) -> Column:
    """The number of elements of a sorted array before a key, as `place_in`, for arrays of any length."""
    top = F.floor(F.log2(F.greatest(F.size(array), F.lit(1)))).cast("int")
    steps = F.transform(F.sequence(top, F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(2), i).cast("int"))
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(array, at + step - 1) < key, step).otherwise(0))


def between_limits(array: Column, low: Column, high: Column) -> Column:
    """The elements low <= e < high of a sorted array, found by binary searches; null if there are none."""
    first = _first_from(array, low)
    return F.when(F.get(array, first) < high, F.slice(array, first + 1, _first_from(array, high) - first))


def _limits(df: DataFrame, column: str, groups: list[str], count: int) -> DataFrame:
    """Up to count - 1 limits of a column by group, in order and at least BUCKET_ROWS apart, as `_limits`.

    Numbers and times have approximate quantiles, with a rank error below a quarter of a bucket; other types those of
    a sample by hash, eight values for a limit. A small group keeps only every second limit, every fourth ...
    """
    kind = df.schema[column].dataType
    if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        probs = F.expr("array(" + ", ".join(f"{i / count!r}D" for i in range(1, count)) + ")")
        found = df.groupBy(*groups).agg(
            F.percentile_approx(column, probs, 4 * count).alias("_limits"),
            F.count(F.lit(1)).alias("_rows"),
        )
        spare = F.ceil(F.log2(F.lit(float(count * BUCKET_ROWS)) / F.greatest("_rows", F.lit(1))))
        step = F.pow(F.lit(2), F.greatest(spare, F.lit(0))).cast("int")
        kept = F.filter("_limits", lambda _, i: (i + 1) % step == 0)
        return found.select(*groups, kept.alias("_limits"))
    # The window keeps its first rows in each task before they are shuffled.
    by_hash = _window(groups).orderBy(F.xxhash64(column))
    some = df.where(F.col(column).isNotNull()).select(*groups, column)
    some = some.withColumn("_at", F.row_number().over(by_hash)).where(F.col("_at") <= 8 * count)
    sample = some.groupBy(*groups).agg(F.array_sort(F.collect_list(column)).alias("_sample"))
    n = F.least(F.floor(F.size("_sample") / 8), F.lit(count)).cast("int") - 1
    pick = lambda i: F.get("_sample", F.floor(i * F.size("_sample") / (n + 1)).cast("int"))
    picked = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), pick))
    none = F.array().cast(T.ArrayType(kind))
    return sample.select(*groups, F.coalesce(picked, none).alias("_limits"))


def _cut(df: DataFrame, limits: DataFrame, column: str, groups: list[str], count: int, out: str) -> DataFrame:
    """Add the bucket of a column between its group's limits; 0 for groups without limits.

    Rows on a limit have a bucket of their own, nulls the last one.
    """
    df = attach(df, limits, groups, row_bytes=16 * count)
    df = lower_bound(df, "_limits", column, "_p", count - 1)
    on_limit = F.coalesce(F.get(F.col("_limits"), F.col("_p")) == F.col(column), F.lit(False))
    bucket = F.when(F.col("_limits").isNull(), 0).when(F.col(column).isNull(), 2 * count)
    return df.withColumn(out, bucket.otherwise(F.col("_p") * 2 + on_limit.cast("int"))).drop("_limits", "_p")


def _cut_again(df: DataFrame, keys: list[str], rows: int, split_rows: int, out: str) -> DataFrame:
    """Add the piece of a row among the rows with its keys, in key order: pieces have at most `split_rows` rows.

    The rows are sorted once by ranges of the whole key, about RANGE_ROWS in a task. A value lies in one piece whole, or else
    alone in its pieces: so do those that a task or a batch begins or ends with, as more of them may lie outside.
    """
    order = [*keys, F.col(VALUE).asc_nulls_last(), F.col(TIE)]
    tasks = max(1, -(-rows // RANGE_ROWS))
    ranges = df.withColumn("_same", F.xxhash64(VALUE)).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    few = max(1, split_rows // 5)
    step = max(1, split_rows - few)

    def pieces(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            same = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
            size = np.diff(np.concatenate([first, [n]]))
            alone = size > few
            alone[0] = alone[-1] = True
            # Rows of one value: a piece for each split_rows of them, or together with those that begin in the same step.
            start, alone = np.repeat(first, size), np.repeat(alone, size)
            part = np.where(alone, (np.arange(n) - start) // split_rows, 0)
            value = (start[1:] != start[:-1]) & (alone[1:] | alone[:-1])
            new = value | (part[1:] != part[:-1]) | (start[1:] // step != start[:-1] // step)
            piece = number + np.concatenate([[0], np.cumsum(new)])
            number = int(piece[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(piece)], names=names)

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType())])
    names = schema.names
    return ranges.mapInArrow(pieces, schema)


def bucketed(
    df: DataFrame,
    value: Column,
    tie: Column,
    groups: list[str] = (),
    bits: int | None = None,
    sums: dict[str, Column] | None = None,
    wanted: Callable[[DataFrame, list[str]], DataFrame] | None = None,
    values_only: bool = False,
) -> tuple[DataFrame, list[str], DataFrame]:
    """The sort key and the bucket of every row; the bucket columns; the size of each bucket.

    Sizes are groups, bucket columns, `_n`, the extremes `_low` and `_high` of the value, and a
    `_sum_<name>` for each of `sums`. `wanted` keeps of the sizes those whose rows will be sorted; only they are
    cut again, and once a bucket is cut again only their rows are returned. With `values_only` buckets of one value
    are not cut: their rows need no order. Rows are stored before and after a further cut, so no cut is made twice.
    """
    groups = list(groups)
    forced = _SIZES.get()
    split_rows = forced[1] if forced else SPLIT_ROWS
    count = 1 << (forced[0] if forced else bits or (GROUP_BITS if groups else BITS))
    df = df.withColumns({VALUE: value, TIE: tie})
    df = _cut(df, _limits(df, VALUE, groups, count), VALUE, groups, count, "_b0")
    buckets = ["_b0"]
    totals = [F.sum(c).alias(f"_sum_{n}") for n, c in (sums or {}).items()]

    def measured(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*groups, *buckets).agg(
            F.count(F.lit(1)).alias("_n"), F.min(VALUE).alias("_low"), F.max(VALUE).alias("_high"), *totals
        )

    sizes = pin(measured(df))
    kept = wanted(sizes, buckets) if wanted else sizes
    is_large = F.col("_n") > split_rows
    if values_only:
        is_large &= ~F.col("_low").eqNullSafe(F.col("_high"))
    found = kept.groupBy(is_large.alias("_large")).agg(F.sum("_n")).collect()  # two rows at most
    found = {r[0]: r[1] for r in found}
    if True not in found:
        return df, buckets, sizes
    keys = [*groups, "_b0"]
    kept = pin(kept.select(*keys, is_large.alias("_large")))
    rows = stored(join_on(df, kept, keys), "cut")
    large = rows.where("_large").drop("_large")
    cut = _cut_again(large, keys, found[True], split_rows, "_b1")
    whole = rows.where("NOT _large").drop("_large").withColumn("_b1", F.lit(0).cast("long"))
    df = stored(cut.unionByName(whole) if False in found else cut, "cut")
    settled = join_on(sizes, kept.drop("_large"), keys, "left_anti").withColumn("_b1", F.lit(0).cast("long"))
    buckets.append("_b1")
    sizes = measured(df)
    return df, buckets, pin(sizes.unionByName(settled) if wanted else sizes)


def _window(groups: list[str]):
    return Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))


def _before(groups: list[str], order: list[str]):
    """Window over the buckets of a group that come earlier; its size is the bucket count."""
    return _window(groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def running(
    df: DataFrame,
    value: Column,
    tie: Column,
    groups: list[str] = (),
    sums: dict[str, Column] | None = None,
    bits: int | None = None,
    position: str = "position",
    rank: str | None = None,
    total: str | None = None,
    between: tuple[int, int] | None = None,
) -> DataFrame:
    """Position and running sums in key order, by group.

    Adds `position` (0-based), for each entry of `sums` its running sum, on request `rank`
    (1-based, equal values share the lowest) and the group's row count `total`.
    `between=(a, b)` keeps positions a <= p < b; buckets outside are never shuffled.
    """
    groups, sums = list(groups), dict(sums or {})
    columns = df.columns

    def inside_limits(sizes, buckets):
        starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(_before(groups, buckets)), F.lit(0)))
        return starts.where((F.col("_start") < between[1]) & (F.col("_start") + F.col("_n") > between[0]))

    wanted = inside_limits if between is not None else None
    df, buckets, sizes = bucketed(df, value, tie, groups, bits, sums, wanted)
    before = _before(groups, buckets)
    starts = sizes.select(
        *groups,
        *buckets,
        "_n",
        "_low",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(_window(groups)).alias("_total"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_start_{n}") for n in sums],
    )
    if rank:
        # A value cut into several buckets ranks from the first of them: they hold that value alone.
        first = F.min("_start").over(Window.partitionBy(*groups, "_low"))
        starts = starts.withColumn("_rank_start", first)
    if between is not None:
        starts = starts.where(
            (F.col("_start") < between[1]) & (F.col("_start") + F.col("_n") > between[0])
        )
    starts = pin(starts.drop("_low"))
    rows, many = starts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))).first()
    # As many tasks as the rows need: a shuffle of so many bytes may hold very many narrow rows.
    tasks = -(-rows // TASK_ROWS)
    place = [*groups, *buckets]
    if tasks > 1 and many <= tasks * TASK_BUCKETS:
        # A task has at most the rows of its last bucket beyond TASK_ROWS.
        ahead = F.coalesce(F.sum("_n").over(_before([], place)), F.lit(0))
        starts = pin(starts.withColumn("_task", F.floor(ahead / TASK_ROWS).cast("int")))
        df = join_on(df, starts.drop("_n"), place).repartitionById(tasks, F.col("_task"))
        place = ["_task", *place]
    else:
        df = join_on(df, starts.drop("_n"), place)
        if tasks > 1:
            df = df.repartition(tasks, *place)

    own = Window.partitionBy(*place)
    inside = own.orderBy(F.col(VALUE).asc_nulls_last(), TIE)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {position: F.col("_start") + F.row_number().over(inside) - 1}
    for n, c in sums.items():
        added[n] = F.col(f"_start_{n}") + F.sum(c).over(upto)
    if rank:
        # In a bucket of one value all rank alike; in others a value lies in its bucket whole.
        alike = F.rank().over(own.orderBy(F.col(VALUE).asc_nulls_last()))
        added[rank] = F.when(alike == 1, F.col("_rank_start")).otherwise(F.col("_start")) + alike
    if total:
        added[total] = F.col("_total")
    df = df.withColumns(added)
    if between is not None:
        df = df.where((F.col(position) >= between[0]) & (F.col(position) < between[1]))
    return df.select(*[c for c in columns if c not in added], *added)


def peak_buckets(
    df: DataFrame, value: Column, tie: Column, gain: Column, groups: list[str] = (), bits: int | None = None
) -> tuple[DataFrame, list[str], DataFrame]:
    """As `bucketed`, but of the sizes only buckets in which a running sum of `gain` may peak.

    A bucket's running sums reach at most its start plus its positive gains. One that cannot reach the best sum at
    the end of any bucket holds no peak. Adds `_start` (rows before) and `_before` (gain before).
    """
    groups = list(groups)
    up = F.greatest(gain, F.lit(0).cast("long"))

    def may_peak(sizes, buckets):
        before = _before(groups, buckets)
        total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
        added = F.coalesce("_sum_gain", F.lit(0))
        sizes = sizes.withColumns({"_start": total("_n"), "_before": total("_sum_gain")})
        best = F.max(F.col("_before") + added).over(_window(groups))
        reach = F.col("_before") + F.coalesce("_sum_up", F.lit(0))
        return sizes.withColumns({"_best": best, "_reach": reach}).where(F.col("_reach") >= F.col("_best"))

    df, buckets, sizes = bucketed(df, value, tie, groups, bits, {"gain": gain, "up": up}, may_peak)
    return df, buckets, may_peak(sizes, buckets).select(*groups, *buckets, "_n", "_start", "_before")


def peak(
    df: DataFrame, value: Column, tie: Column, gain: Column, groups: list[str] = (), bits: int | None = None
) -> DataFrame:
    """Highest running sum of `gain` in key order and its first 0-based position, as `_peak` and `_at`, by group.

    Only rows of buckets that may hold the peak are shuffled and sorted; the others are counted and summed. Null
    gains add nothing. Without rows there is no peak: no row by group, one row of nulls without groups.
    """
    groups = list(groups)
    df, buckets, sizes = peak_buckets(df.select(*groups, gain.alias("_gain"), value.alias("_by"), tie.alias("_id")),
                                      F.col("_by"), F.col("_id"), F.col("_gain"), groups, bits)
    rows = df.select(*groups, *buckets, VALUE, TIE, F.coalesce("_gain", F.lit(0)).alias("_gain"))
    rows = join_on(rows, pin(sizes.drop("_n")), [*groups, *buckets])
    inside = Window.partitionBy(*groups, *buckets).orderBy(F.col(VALUE).asc_nulls_last(), TIE)
    rows = rows.withColumns(
        {
            "_sum": F.col("_before") + F.sum("_gain").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "_place": F.col("_start") + F.row_number().over(inside) - 1,
        }
    )
    top = F.max(F.struct(F.col("_sum").alias("v"), (-F.col("_place")).alias("p")))
    found = rows.groupBy(*groups).agg(top.alias("_top"))
    return found.select(*groups, F.col("_top.v").alias("_peak"), (-F.col("_top.p")).alias("_at"))


def keys_at(
    df: DataFrame,
    value: Column,
    tie: Column,
    positions: Callable[[Column], Column],
    groups: list[str] = (),
    bits: int | None = None,
    digits: list[Column] = (),
    values_only: bool = False,
) -> DataFrame:
    """The sort keys that stand at given positions of each group.

    `positions` maps the group's row count to an array of 0-based positions. Only rows of
    buckets that hold a wanted position are shuffled and sorted.

    A value that is evenly spread by construction, such as a hash, brings its own buckets as
    `digits`: its leading digits, then the following ones. Each step counts the rows per digit
    inside the buckets still wanted, so the counts stay few and the last buckets tiny.
    With `values_only` the tie is not wanted, and a bucket of equal values needs no rows at all.
    Returns groups, `_total`, `_position`, `_value`, `_tie`.
    """
    groups = list(groups)
    first = None

    def with_positions(sizes: DataFrame) -> DataFrame:
        """The rows and the wanted positions of each group, worked out once for a group and not for each of its buckets."""
        per_group = sizes.groupBy(*groups).agg(F.sum("_n").alias("_total"))
        return attach(sizes, per_group.withColumn("_wanted", F.array_sort(positions(F.col("_total")))), groups)

    def inside(sizes: DataFrame) -> DataFrame:
        """Of every bucket the wanted positions that it holds; buckets without any are left out."""
        here = between_limits(F.col("_wanted"), F.col("_start"), F.col("_start") + F.col("_n"))
        return sizes.withColumn("_wanted", here).where(F.col("_wanted").isNotNull())

    if digits:
        steps = [[f"_d{i}"] for i in range(len(digits))]
        df = df.withColumns({VALUE: value, TIE: tie})
        df = df.withColumns({f"_d{i}": d for i, d in enumerate(digits)})
    else:

        def holds_wanted(sizes, buckets):
            start = F.coalesce(F.sum("_n").over(_before(groups, buckets)), F.lit(0))
            return inside(with_positions(sizes.withColumn("_start", start)))

        df = df.select(*groups, value.alias("_by"), tie.alias("_id"))
        df, buckets, first = bucketed(
            df, F.col("_by"), F.col("_id"), groups, bits, None, holds_wanted, values_only
        )
        steps = [buckets]
        first = first if values_only else first.drop("_low", "_high")
    df = df.select(*groups, VALUE, TIE, *[c for step in steps for c in step])

    wanted, parents = None, groups
    for step in steps:
        if first is None:
            counted = df if wanted is None else join_on(df, wanted.select(*parents), parents)
            sizes = counted.groupBy(*parents, *step).agg(F.count(F.lit(1)).alias("_n"))
        else:
            sizes = first
        start = F.coalesce(F.sum("_n").over(_before(parents, step)), F.lit(0))
        if wanted is None:
            sizes = with_positions(sizes.withColumn("_start", start))
        else:
            sizes = join_on(sizes.withColumn("_offset", start), wanted, parents)
            sizes = sizes.withColumn("_start", F.col("_start") + F.col("_offset")).drop("_offset")
        wanted, parents = pin(inside(sizes).drop("_n")), [*parents, *step]

    known = None
    if values_only:
        same = F.col("_low").eqNullSafe(F.col("_high"))
        known = wanted.where(same).select(
            *groups,
            "_total",
            F.explode("_wanted").alias("_position"),
            F.col("_low").alias(VALUE),
            F.lit(None).cast(df.schema[TIE].dataType).alias(TIE),
        )
        wanted = wanted.where(~same).drop("_low", "_high")
    rows = join_on(df, wanted.select(*parents, "_start"), parents)
    sorted_ = Window.partitionBy(*parents).orderBy(F.col(VALUE).asc_nulls_last(), F.col(TIE))
    rows = rows.withColumn("_position", F.col("_start") + F.row_number().over(sorted_) - 1)
    spots = pin(wanted.select(*groups, "_total", F.explode("_wanted").alias("_position")))
    rows = join_on(rows, spots, [*groups, "_position"]).select(*groups, "_total", "_position", VALUE, TIE)
    return rows.unionByName(known) if known is not None else rows


def sort_key(value: Column, tie: Column) -> Column:
    """The sort key as a struct: structs compare field by field, and nulls go last."""
    return F.struct(value.isNull().alias("m"), value.alias("v"), tie.alias("t"))
