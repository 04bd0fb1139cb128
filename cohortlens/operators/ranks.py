"""Tiles and ranks inside a period."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cohortlens.operators import ordering
from cohortlens.operators.ordering import GROUP_BITS, keys_at, place_in, running, sort_key
from cohortlens.session import PIN_BYTES, join_on, pin, stored

# The four members of the rank family and their tile counts.
RANKS = ("ordinal", "percentil", "decil", "cuartil")
TILES = {"decil": 10, "cuartil": 4}
# Columns whose tile ends are sent to the tasks together.
TILE_COLUMNS = 25
# Bucket limits are taken for periods of so many rows. Limits of all periods and columns are sent to the tasks together, so
# their bytes are bounded.
LIMIT_ROWS, LIMIT_BYTES = 4096, 32 << 20
# Rows of wanted buckets that one task sorts together, and that are dealt to one task of the shuffle.
BLOCK_ROWS, TASK_ROWS = 1 << 20, 1 << 22
# Tile ends that are sent to the tasks, if they have PIN_BYTES at most.
END_ROWS = 3_000_000
# Rows that a task looks at together, and values of all columns in them.
CHUNK_ROWS, CHUNK_VALUES = 1 << 16, 1 << 23
# Rows of a period in such a chunk from which their tiles are found from the sorted rows, not from rows and tile ends sorted together.
SORTED_ROWS = 1024


def tile_of(position: Column, total: Column, tiles: int) -> Column:
    """ntile of a 0-based position: the first `total % tiles` tiles hold one row more."""
    small = F.floor(total / tiles)
    wide = total % tiles
    edge = wide * (small + 1)
    in_wide = F.floor(position / (small + 1)) + 1
    in_small = F.when(small > 0, wide + F.floor(F.try_divide(position - edge, small)) + 1)
    return F.when(position < edge, in_wide).otherwise(in_small).cast("int")


def tile_ends(total: Column, tiles: int) -> Column:
    """Positions of the last row of every tile but the last."""
    steps = F.sequence(F.lit(1), F.lit(tiles - 1))
    small, wide = F.floor(total / tiles), total % tiles
    ends = F.transform(steps, lambda i: i * small + F.least(i.cast("long"), wide) - 1)
    return F.array_distinct(ends)


def long_form(df: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    """One row per row and column, as (feature, value)."""
    doubles = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    return doubles.unpivot(keep, cols, "feature", "value")


def _packed(df: DataFrame, first: list[Column], cols: list[str]) -> DataFrame:
    """The columns `first` and all of `cols` as one array of doubles, which goes to Python far faster than many columns do.

    The last column has no use but its lambda: that keeps the projection out of the code of a whole stage, where it would be
    one method, too long to be compiled.
    """
    values = F.array(*[F.col(c).cast("double") for c in cols]).alias("_values")
    return df.select(*first, values, F.exists(F.array(first[0].isNull()), lambda x: x).alias("_lambda"))


def _tools(width: int, tiles: int):
    """Functions of the tasks. Made here, so that they are sent to the tasks whole, without this module."""
    most = max(1, min(CHUNK_ROWS, CHUNK_VALUES // max(1, width)))

    def matrix(lists):
        """Values and nulls (None without any), a row for each row; nulls are NaN."""
        flat = pa.concat_arrays([x.flatten() for x in lists])
        null = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, width) if flat.null_count else None
        return flat.to_numpy(zero_copy_only=False).reshape(-1, width), null

    def chunks(batches):
        """Batches held together until they have `most` rows or a little more."""
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= most:
                yield held
                held, size = [], 0
        if held:
            yield held

    def periods(column, x, null):
        """(period, its rows, values and nulls with a row for each column); -0.0 is 0.0."""
        codes = column.dictionary_encode(null_encoding="encode")
        keys, code = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        edges = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(keys)))])
        for k, key in enumerate(keys):
            own = order[edges[k] : edges[k + 1]]
            if own[-1] - own[0] + 1 == len(own):
                own = slice(own[0], own[-1] + 1)  # neighbours need no copy
            yield key, own, np.add(x[own].T, 0.0, order="C"), None if null is None else null[own].T

    def taken(array, own):
        return array[own] if isinstance(own, slice) else array.take(pa.array(own))

    def by_period(batches):
        """(period, ids, values and nulls with a row for each column) of batches of period, id and values."""
        for held in chunks(batches):
            ids = pa.concat_arrays([b.column(1) for b in held])
            for key, own, x, null in periods(pa.concat_arrays([b.column(0) for b in held]), *matrix([b.column(2) for b in held])):
                yield key, taken(ids, own), x, null

    def in_order(x, null):
        """The order of a column's rows, NaN behind all numbers and nulls last, and how many are not null."""
        order = np.argsort(x)
        if null is None or not null.any():
            return order, len(x)
        numbers = len(x) - int(np.isnan(x).sum())
        tail = order[numbers:]
        last = null[tail]
        return np.concatenate([order[:numbers], tail[~last], tail[last]]), len(x) - int(last.sum())

    def bucket_edges(x, n, cut):
        """Where the buckets of sorted rows, of which n are not null, begin and end; rows on a limit have their own, nulls the last."""
        if cut is None:
            return np.array([0, len(x)])
        at = np.stack([np.searchsorted(x[:n], cut, side) for side in ("left", "right")], axis=1)
        return np.concatenate([[0], at.ravel(), [n, len(x)]])

    def positions(total):
        """Positions of the last row of every tile but the last, as `tile_ends`."""
        i = np.arange(1, tiles)
        ends = i * (total // tiles) + np.minimum(i, total % tiles) - 1
        return np.unique(ends[ends >= 0])

    def lists(arrays, kind):
        """Arrays as one array of lists."""
        offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
        arrays = [a if isinstance(a, pa.Array) else pa.array(a, kind) for a in arrays]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(arrays) if arrays else pa.array([], kind))

    return SimpleNamespace(
        chunks=chunks, matrix=matrix, periods=periods, taken=taken, by_period=by_period, in_order=in_order, bucket_edges=bucket_edges,
        positions=positions, lists=lists,
    )


def _column_limits(rows: DataFrame, cols: list[str], counts: dict, tiles: int) -> dict:
    """{period: arrays of bucket limits, one for each column}, from one pass over the packed rows.

    Limits decide balance, never the result: each tile's end is to lie between two limits that are close to each other.
    Of every chunk of rows a task hands on evenly spaced values of each period and column with the number of rows they
    stand for, so it holds one chunk at a time, however many periods and columns there are. The spacing grows with the root of
    a period's rows, so that neither these values nor the rows between the limits are many.
    """
    forced = ordering._SIZES.get()
    most = LIMIT_BYTES // (8 * len(cols) * max(1, len(counts)))
    if not counts or not forced and (max(counts.values()) < LIMIT_ROWS or most < 2):
        return {}
    apart = {key: 1 if forced else max(1, int((n / (10 * tiles)) ** 0.5)) for key, n in counts.items()}
    key_type = rows.schema[0].dataType
    kind = to_arrow_type(key_type)
    schema = T.StructType(
        [T.StructField("key", key_type), T.StructField("column", T.IntegerType()),
         T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("rows", T.DoubleType())]
    )
    tools = _tools(len(cols), tiles)

    def spaced(batches):
        for key, _, values, null in tools.by_period(batches):
            column, some, stand = [], [], []
            for c, x in enumerate(values):
                x = np.sort(x if null is None else x[~null[c]])
                if len(x):
                    k = -(-len(x) // apart[key])
                    column.append(c)
                    some.append(x[((np.arange(k) + 0.5) * len(x) / k).astype(np.int64)])
                    stand.append(len(x) / k)
            yield pa.RecordBatch.from_pydict(
                {"key": pa.array([key] * len(column), kind), "column": pa.array(column, pa.int32()),
                 "values": tools.lists(some, pa.float64()), "rows": pa.array(stand, pa.float64())}
            )

    def merged(chunks: pa.Table) -> pa.Table:
        key, values = chunks.column("key")[0].as_py(), chunks.column("values").combine_chunks()
        x, each = values.flatten().to_numpy(), chunks.column("rows").to_numpy()
        rows = np.repeat(each, values.value_lengths().to_numpy())
        order = np.argsort(x, kind="stable")
        x, rows = x[order], rows[order]
        upto = np.cumsum(rows)
        if forced:
            at = np.searchsorted(upto, upto[-1] * np.arange(1, 1 << forced[0]) / (1 << forced[0]))
            at = np.minimum(at, len(x) - 1)
        else:
            # A value's rank is known up to half the spacing in each chunk: three standard deviations of their sum.
            error = 3 * np.sqrt((each**2).sum() / 12) + 1
            rank, ends = upto - rows / 2, tools.positions(counts[key]) + 0.5
            ends = ends[ends < upto[-1]]
            at = np.concatenate([np.searchsorted(rank, ends - error, "right") - 1, np.searchsorted(rank, ends + error)])
            at = at[(at >= 0) & (at < len(x))]
        limits = np.unique(x[at])
        limits = limits[~np.isnan(limits)]
        limits = limits[:: max(1, -(-len(limits) // most))]
        return pa.table(
            {"key": chunks.column("key")[:1], "column": chunks.column("column")[:1],
             "limits": pa.array([limits], pa.list_(pa.float64()))}
        )

    found = T.StructType([schema[0], schema[1], T.StructField("limits", schema[2].dataType)])
    found = rows.mapInArrow(spaced, schema).groupBy("key", "column").applyInArrow(merged, found).toArrow()  # LIMIT_BYTES at most
    out = {key: [np.empty(0)] * len(cols) for key in counts}
    limits = found.column("limits").combine_chunks()
    for i, (key, column) in enumerate(zip(found.column("key").to_pylist(), found.column("column").to_pylist())):
        out[key][column] = limits[i].values.to_numpy()
    return out


def wide_tile_keys(df: DataFrame, cols: list[str], id_col: str, period: str, tiles: int) -> DataFrame | None:
    """The sort keys that end the tiles of every period and column, as `keys_at` of the long form gives them.

    Wide rows are cut into buckets column by column inside the tasks: one pass counts them, a second one hands on the
    values and ids of buckets that hold a tile's end, as arrays and not as rows. Only these are shuffled and sorted. None if a
    bucket that is wanted has more rows than a task should sort: it has to be cut again, by `keys_at`. Rows in order of
    the period, if only in part, are cheaper: a task sorts its rows of a period and column together.
    """
    context = df.sparkSession.sparkContext
    rows = _packed(df, [F.col(period), F.col(id_col)], cols)
    counts = {r[0]: r[1] for r in df.groupBy(period).agg(F.count(F.lit(1))).toLocalIterator()}  # one for a period
    limits = context.broadcast(_column_limits(rows, cols, counts, tiles))
    tools = _tools(len(cols), tiles)

    def count(batches, limits=limits):
        sums = {}
        for key, _, values, null in tools.by_period(batches):
            for c, x in enumerate(values):
                own = None if null is None else null[c]
                n = len(x) if own is None else len(x) - int(own.sum())
                x = np.sort(x) if n == len(x) else np.concatenate([np.sort(x[~own]), x[own]])
                n = np.diff(tools.bucket_edges(x, n, limits.value[key][c]))
                sums[key, c] = sums[key, c] + n if (key, c) in sums else n
        for (key, c), n in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"key": pa.array([key], kind), "column": pa.array([c], pa.int32()), "n": pa.array([n], pa.list_(pa.int64()))}
            )

    def holders(counted: pa.Table) -> pa.Table:
        """The buckets that hold a tile's end, with the position of their first row and their rows."""
        n = counted.column("n").combine_chunks().flatten().to_numpy().reshape(counted.num_rows, -1).sum(axis=0)
        ends = np.cumsum(n)
        some = np.unique(np.searchsorted(ends, tools.positions(int(ends[-1])), "right"))
        return pa.table(
            {"key": counted.column("key")[:1], "column": counted.column("column")[:1],
             **{k: pa.array([v], pa.list_(pa.int64())) for k, v in (("bucket", some), ("start", (ends - n)[some]), ("n", n[some]))}}
        )

    key_type, id_type = rows.schema[0].dataType, rows.schema[1].dataType
    kind, id_kind = to_arrow_type(key_type), to_arrow_type(id_type)
    fields = [T.StructField("key", key_type), T.StructField("column", T.IntegerType())]
    forced = ordering._SIZES.get()
    split_rows = forced[1] if forced else ordering.SPLIT_ROWS
    wanted: dict = {}
    if limits.value:
        whole = T.ArrayType(T.LongType())
        counted = rows.mapInArrow(count, T.StructType([*fields, T.StructField("n", whole)])).groupBy("key", "column")
        found = T.StructType([*fields, *[T.StructField(c, whole) for c in ("bucket", "start", "n")]])
        found = counted.applyInArrow(holders, found).toArrow()  # as many numbers as tile ends, or limits
        bucket, start, size = (found.column(i).combine_chunks() for i in (2, 3, 4))
        if len(size.flatten()) and pc.max(size.flatten()).as_py() > split_rows:
            return None
        for i, own in enumerate(zip(found.column(0).to_pylist(), found.column(1).to_pylist())):
            if len(bucket[i].values):
                wanted[own] = tuple(a[i].values.to_numpy() for a in (bucket, start, size))
    else:
        # Without limits every period and column is one bucket.
        if max(counts.values(), default=0) > split_rows:
            return None
        wanted = {(key, c): tuple(np.array([v]) for v in (0, 0, n)) for key, n in counts.items() for c in range(len(cols))}
    # Neighbouring buckets go to one task together, as one block.
    wanted = {own: (b, start, n, (np.cumsum(n) - n) // BLOCK_ROWS) for own, (b, start, n) in wanted.items()}
    handed_rows = sum(int(n.sum()) for _, _, n, _ in wanted.values())
    shared = context.broadcast(wanted)
    totals = context.broadcast(counts)

    def hand_on(batches, shared=shared, limits=limits):
        out, size = {"key": [], "column": [], "block": [], "values": [], "ids": []}, 0

        def made():
            return pa.RecordBatch.from_pydict(
                {"key": pa.array(out["key"], kind), "column": pa.array(out["column"], pa.int32()),
                 "block": pa.array(out["block"], pa.int32()), "values": tools.lists(out["values"], pa.float64()),
                 "ids": tools.lists(out["ids"], id_kind)}
            )

        for key, ids, values, null in tools.by_period(batches):
            for c, x in enumerate(values):
                some = shared.value.get((key, c))
                if some is None:
                    continue
                own = None if null is None else null[c]
                order, n = tools.in_order(x, own)
                edges = tools.bucket_edges(x[order], n, limits.value[key][c] if limits.value else None)
                for block in range(int(some[3][-1]) + 1):
                    held = np.zeros(len(edges) - 1, bool)
                    held[some[0][some[3] == block]] = True
                    part = order[np.repeat(held, np.diff(edges))]
                    if len(part):
                        out["key"].append(key)
                        out["column"].append(c)
                        out["block"].append(block)
                        out["values"].append(pa.array(x[part], mask=None if own is None else own[part]))
                        out["ids"].append(ids.take(pa.array(part)))
                        size += len(part)
                if size >= 1 << 18:
                    yield made()
                    out, size = {k: [] for k in out}, 0
        if out["key"]:
            yield made()

    def pick(batches, shared=shared, totals=totals):
        def found(key, column, block, values, ids):
            v, i = pa.concat_arrays(values), pa.concat_arrays(ids)
            if plain_id and not i.null_count:
                order = np.lexsort((i.to_numpy(), v.to_numpy(zero_copy_only=False), v.is_null().to_numpy(zero_copy_only=False)))
            else:
                order = pc.sort_indices(pa.table({"v": v, "i": i}), [("v", "ascending"), ("i", "ascending")]).to_numpy()
            _, start, size, own = shared.value[key, column]
            start, size = start[own == block], size[own == block]
            total = totals.value[key]
            places = tools.positions(total)
            at = np.searchsorted(start, places, "right") - 1
            inside = (at >= 0) & (places < start[at] + size[at])
            places, at = places[inside], at[inside]
            # The rows of a block are those of its buckets, one after the other.
            row = pa.array(order[(np.cumsum(size) - size)[at] + places - start[at]])
            n = len(places)
            return pa.RecordBatch.from_pydict(
                {"key": pa.array([key] * n, kind), "column": pa.array([column] * n, pa.int32()),
                 "total": pa.array([total] * n, pa.int64()), "position": pa.array(places, pa.int64()),
                 "value": v.take(row), "tie": i.take(row)}
            )

        now, values, ids = None, [], []
        for batch in batches:
            key, column, block = (batch.column(i).to_pylist() for i in range(3))
            for r in range(batch.num_rows):
                here = (key[r], column[r], block[r])
                if here != now:
                    if now is not None:
                        yield found(*now, values, ids)
                    now, values, ids = here, [], []
                values.append(batch.column(3)[r].values)
                ids.append(batch.column(4)[r].values)
        if now is not None:
            yield found(*now, values, ids)

    plain_id = _plain(id_type)
    arrays = [T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("ids", T.ArrayType(id_type))]
    handed = rows.mapInArrow(hand_on, T.StructType([*fields, T.StructField("block", T.IntegerType()), *arrays]))
    grouped = ["key", "column", "block"]
    tasks = -(-handed_rows // TASK_ROWS)
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        handed = handed.repartition(tasks, *grouped)
    else:
        handed = handed.repartition(*grouped)
    ends = T.StructType(
        [*fields, T.StructField("total", T.LongType()), T.StructField("position", T.LongType()),
         T.StructField("value", T.DoubleType()), T.StructField("tie", id_type)]
    )
    names = F.array(*[F.lit(c) for c in cols])
    return handed.sortWithinPartitions(*grouped).mapInArrow(pick, ends).select(
        F.col("key").alias(period), F.get(names, F.col("column")).alias("feature"),
        F.col("total").alias("_total"), F.col("position").alias("_position"),
        F.col("value").alias("_value"), F.col("tie").alias("_tie"),
    )


def _plain(kind: T.DataType) -> bool:
    """Whether numpy orders an id of this type as Spark does."""
    return isinstance(kind, T.NumericType) and not isinstance(kind, T.DecimalType)


def _tiles_by_search(
    df: DataFrame, kept: list[str], cols: list[str], id_col: str, period: str, ends: pa.Table, prefix: str
) -> DataFrame:
    """Kept columns and the tile of every column: one more than the tile ends before the row's own (value, id).

    `ends` has a checked size and is sent to every task; the wide rows are not shuffled.
    """
    codes = ends.column(period).combine_chunks().dictionary_encode(null_encoding="encode")
    keys, code = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
    number = pc.index_in(ends.column("feature").combine_chunks(), pa.array(cols)).to_numpy(zero_copy_only=False)
    order = np.lexsort((ends.column("_position").to_numpy(), number, code))
    values, ties = (ends.column(c).combine_chunks().take(pa.array(order)) for c in ("_value", "_tie"))
    code, number = code[order], number[order]
    first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (number[1:] != number[:-1])])[: len(code)])
    of = {
        (keys[code[a]], int(number[a])): (int(a), int(b - a)) for a, b in zip(first, np.concatenate([first[1:], [len(code)]]))
    }
    # Both arrays once and whole: a pickled slice would carry all of its parent.
    shared = df.sparkSession.sparkContext.broadcast((of, values, ties))
    rows = _packed(df, [F.col(period).alias("_tile_period"), F.col(id_col).alias("_tile_id"), *[F.col(c) for c in kept]], cols)
    made_here = [T.StructField(f"{prefix}{c}", T.IntegerType()) for c in cols]
    schema = T.StructType([*df.select(*kept).schema.fields, *made_here])
    tools, plain_id, sorted_rows = _tools(len(cols), 1), _plain(df.schema[id_col].dataType), SORTED_ROWS

    def before(x, ids, ends_x, ends_ids):
        """How many of the ends come before each row; nulls come last."""
        v, i = pa.concat_arrays([x, ends_x]), pa.concat_arrays([ids, ends_ids])
        flag = np.repeat([0, 1], [len(x), len(ends_x)])
        if plain_id and not i.null_count:
            numbers = v.to_numpy(zero_copy_only=False) + 0.0
            order = np.lexsort((flag, i.to_numpy(zero_copy_only=False), numbers, v.is_null().to_numpy(zero_copy_only=False)))
        else:
            sorted_ = pa.table({"v": v, "i": i, "f": pa.array(flag)})
            order = pc.sort_indices(sorted_, [(c, "ascending") for c in "vif"]).to_numpy()
        count = np.cumsum(flag[order])
        out = np.empty(len(order), np.int32)
        out[order] = count
        return out[: len(x)]

    def before_sorted(x, null, ids, ends_x, ends_ids):
        """The same for many rows and ids that numpy can order: only rows with the value of an end look at their ids."""
        order, n = tools.in_order(x, null)
        numbers = len(ends_x) - ends_x.null_count
        u, first, size = np.unique(ends_x.slice(0, numbers).to_numpy() + 0.0, return_index=True, return_counts=True)
        low, high = (np.searchsorted(x[order[:n]], u, side) for side in ("left", "right"))
        step = np.zeros(len(x) + 1, np.int32)
        np.add.at(step, high, size.astype(np.int32))
        count = np.cumsum(step[:-1], dtype=np.int32)
        many = [(low[j], high[j], first[j], size[j]) for j in np.flatnonzero((low < high) & (size > 4))]
        for a, b, start, k in [*many, (n, len(x), numbers, ends_x.null_count)]:
            count[a:b] += np.searchsorted(ends_ids[start : start + k], ids[order[a:b]]).astype(np.int32)
        # Values with few ends, all together: the k-th end of each.
        few = np.flatnonzero((low < high) & (size <= 4))
        rows = high[few] - low[few]
        at = np.arange(rows.sum()) + np.repeat(low[few] - np.cumsum(rows) + rows, rows)
        own = ids[order[at]]
        more = np.zeros(len(at), np.int32)
        for k in range(size[few].max(initial=0)):
            more += np.repeat(size[few] > k, rows) & (np.repeat(ends_ids[np.minimum(first[few] + k, len(ends_ids) - 1)], rows) < own)
        count[at] += more
        out = np.empty(len(x), np.int32)
        out[order] = count
        return out

    def assign(batches):
        for held in tools.chunks(batches):
            column = [pa.concat_arrays([b.column(i) for b in held]) for i in range(len(kept) + 2)]
            ids, (places, values, ties) = column[1], shared.value
            made = np.ones((len(cols), len(ids)), np.int32)
            for key, own, x, null in tools.periods(column[0], *tools.matrix([b.column(len(kept) + 2) for b in held])):
                own_ids = tools.taken(ids, own)
                by_sort = plain_id and not ids.null_count and len(own_ids) >= sorted_rows
                numbers = own_ids.to_numpy() if by_sort else None
                for c in range(len(cols)):
                    if (key, c) not in places:
                        continue
                    some = None if null is None else null[c]
                    ends, end_ids = (e.slice(*places[key, c]) for e in (values, ties))
                    if by_sort and not end_ids.null_count:
                        made[c, own] += before_sorted(x[c], some, numbers, ends, end_ids.to_numpy())
                    else:
                        made[c, own] += before(pa.array(x[c], mask=some), own_ids, ends, end_ids)
            yield pa.RecordBatch.from_arrays([*column[2:], *[pa.array(m) for m in made]], names=schema.names)

    return rows.mapInArrow(assign, schema)


def ntile_features(
    df: DataFrame,
    cols: list[str],
    id_col: str,
    period: str,
    tiles: int = 200,
    prefix: str = "ntile_",
    replace: bool = True,
    bits: int | None = None,
) -> DataFrame:
    """Add the tile of every column inside its period; ties by id, nulls last.

    The sort keys that end the tiles are found for all columns together (`wide_tile_keys`), then
    every wide row finds its tiles by binary search. The wide rows are neither shuffled nor
    sorted. With `replace` the ranked columns themselves are dropped.
    """
    key = sort_key(F.col("_value"), F.col("_tie"))
    cuts = wide_tile_keys(df, cols, id_col, period, tiles)
    if cuts is None:
        # several buckets per tile: rows of buckets without a tile end need no sorting
        finer = bits or max(GROUP_BITS, (2 * tiles).bit_length())
        cuts = keys_at(
            long_form(df, cols, [id_col, period]),
            F.col("value"), F.col(id_col), lambda n: tile_ends(n, tiles), [period, "feature"], finer,
        )
    cuts = stored(cuts, "tile_ends")
    kept = [c for c in df.columns if not (replace and c in cols)]
    table = cuts.limit(END_ROWS + 1).drop("_total").toArrow()
    if table.num_rows <= END_ROWS and table.nbytes <= PIN_BYTES:
        return _tiles_by_search(df, kept, cols, id_col, period, table, prefix)
    out = df
    for start in range(0, len(cols), TILE_COLUMNS):
        some = cols[start : start + TILE_COLUMNS]
        per_period = cuts.where(F.col("feature").isin(some)).groupBy(period).agg(
            *[
                F.array_sort(F.collect_list(F.when(F.col("feature") == c, key))).alias(f"_cut{start + i}")
                for i, c in enumerate(some)
            ]
        )
        out = join_on(out, pin(per_period, row_bytes=32 * tiles * len(some)), [period], "left")
    own = {c: sort_key(F.col(c).cast("double"), F.col(id_col)) for c in cols}
    return out.select(
        *kept,
        *[
            (place_in(F.col(f"_cut{i}"), own[c], tiles - 1) + 1).alias(f"{prefix}{c}")
            for i, c in enumerate(cols)
        ],
    )


def rank_family(
    df: DataFrame,
    flags: dict[str, set[str]],
    id_col: str,
    period: str,
    bits: int | None = None,
) -> DataFrame:
    """Ordinal rank, percent rank, decile and quartile of the flagged columns in each period.

    `flags` maps a column to the members it needs, as in the rank-rule table. Returns the keys
    and `<member>_<column>`. All columns are ranked in one pass over their long form.
    """
    cols = [c for c, members in flags.items() if members]
    ranked = running(
        long_form(df, cols, [id_col, period]),
        F.col("value"),
        F.col(id_col),
        [period, "feature"],
        bits=bits,
        position="_at",
        rank="_rank",
        total="_size",
    )
    made = {
        "ordinal": F.col("_rank").cast("double"),
        "percentil": F.coalesce(
            F.try_divide(F.col("_rank") - 1, F.col("_size") - 1), F.lit(0.0)
        ),
        **{m: tile_of(F.col("_at"), F.col("_size"), k).cast("double") for m, k in TILES.items()},
    }
    wide = ranked.groupBy(id_col, period).agg(
        *[
            F.max(F.when(F.col("feature") == c, made[m])).alias(f"{m}_{c}")
            for c in cols
            for m in RANKS
            if m in flags[c]
        ]
    )
    return wide
