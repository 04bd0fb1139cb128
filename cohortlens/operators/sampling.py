"""Exact, reproducible samples.

A row's sample key is a hash of its id and the seed; a sample of k rows of a group is the k
smallest keys. The key at position k-1 is found first, then every row is compared with it, so
the rows themselves are not shuffled and the order of rows or partitions never matters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cohortlens.functions.scalars import (
    SPLIT_BITS,
    SPLIT_PRIME,
    STAYS,
    sample_key,
    sample_number,
    split_key,
    split_numbers,
)
from cohortlens.operators.ordering import keys_at, lower_bound, sort_key
from cohortlens.operators.ranks import tile_ends
from cohortlens.session import attach, join_on, pin

# Splits in one word of a mask, leading bits of a key that are counted, and the most classes of a label.
WORD_BITS, MASK_DIGIT_BITS, MASK_LABELS = 62, 12, 1000


def _strata(df: DataFrame, groups: list[str]) -> dict[str, Column]:
    """Group columns without nulls; rows without a label are a group of their own."""
    out = {}
    for i, g in enumerate(groups):
        field, c = df.schema[g], F.col(g)
        if field.nullable:
            plain = isinstance(field.dataType, T.NumericType)
            kind = field.dataType if plain else T.StringType()
            out[f"_none{i}"] = c.isNull()
            c = F.coalesce(c.cast(kind), F.lit(0).cast(kind))
        out[f"_group{i}"] = c
    return out


def _hex_digits(key: str) -> list[Column]:
    """256 buckets by the leading digits of a hash, then 4096 inside the wanted ones."""
    return [F.substring(key, 1, 2), F.substring(key, 3, 3)]


def _flag_smallest(
    df: DataFrame,
    key: str,
    digits: list[Column],
    id_col: str,
    groups: list[str],
    fraction: float,
    flag: str,
) -> DataFrame:
    """Flag the round-half-even(fraction * n) smallest keys of every group."""
    strata = _strata(df, groups)
    rows = df.withColumns(strata)
    keys = keys_at(
        rows,
        F.col(key),
        F.col(id_col),
        lambda n: F.array((F.bround(n * F.lit(fraction), 0) - 1).cast("long")),
        list(strata),
        digits=digits,
    )
    last = keys.select(*strata, sort_key(F.col("_value"), F.col("_tie")).alias("_last"))
    own = sort_key(F.col(key), F.col(id_col))
    return (
        attach(rows, last, list(strata))
        .withColumn(flag, F.coalesce(own <= F.col("_last"), F.lit(False)))
        .select(*df.columns, flag)
    )


def in_exact_sample(
    df: DataFrame,
    id_col: str,
    groups: list[str],
    fraction: float,
    seed: int | Column,
    flag: str = "sampled",
) -> DataFrame:
    """Flag exactly round-half-even(fraction * n) rows of every group."""
    rows = df.withColumn("_key", sample_key(id_col, seed))
    out = _flag_smallest(rows, "_key", _hex_digits("_key"), id_col, groups, fraction, flag)
    return out.drop("_key")


def undersample(
    df: DataFrame,
    id_col: str,
    period: str,
    label: str,
    fraction: float,
    seed: int = 42,
    majority: str = STAYS,
) -> DataFrame:
    """Keep a fraction of the majority class of every period and all other rows."""
    if fraction >= 1:
        return df
    major = F.col(label).eqNullSafe(majority)
    marked = df.withColumn("_major", major.cast("int"))
    marked = in_exact_sample(marked, id_col, [period, "_major"], fraction, seed, "_kept")
    return marked.where((F.col("_major") == 0) | F.col("_kept")).drop("_major", "_kept")


def stratified_split(
    df: DataFrame,
    id_col: str,
    label: str,
    public_share: float = 0.3,
    seed: int = 42,
    side: str = "side",
) -> DataFrame:
    """Split the rows of each label into a public and a private side."""
    out = in_exact_sample(df, id_col, [label], public_share, seed, "_public")
    return out.withColumn(
        side, F.when(F.col("_public"), F.lit("public")).otherwise(F.lit("private"))
    ).drop("_public")


def repeated_splits(
    df: DataFrame,
    id_col: str,
    label: str,
    splits: int,
    public_share: float = 0.3,
    seed: int = 42,
) -> DataFrame:
    """Every row once per split number, with its side in that split.

    A row is hashed once; each split orders that hash anew, by two numbers hashed from the split.
    """
    rows = df.withColumn("_hash", sample_number(id_col, seed))
    orders = [
        F.struct(F.lit(i).alias("split"), *[F.lit(x).alias(n) for n, x in zip("ab", split_numbers(i, seed))])
        for i in range(1, splits + 1)
    ]
    many = rows.withColumn("_order", F.explode(F.array(*orders))).withColumn("split", F.col("_order.split"))
    many = many.withColumn("_key", split_key(F.col("_hash"), F.col("_order.a"), F.col("_order.b")))
    many = many.drop("_order")
    low = SPLIT_BITS - 8
    digits = [F.shiftright("_key", low), F.shiftright("_key", low - 12) % 4096]
    out = _flag_smallest(many, "_key", digits, id_col, ["split", label], public_share, "_public")
    return out.withColumn(
        "side", F.when(F.col("_public"), F.lit("public")).otherwise(F.lit("private"))
    ).drop("_public", "_key", "_hash")


def split_masks(
    df: DataFrame,
    id_col: str,
    label: str,
    splits: int,
    public_share: float = 0.3,
    seed: int = 42,
    mask: str = "public_splits",
) -> DataFrame:
    """Every row once, with the splits in whose public side it lies as bits: the sides of `repeated_splits`.

    `mask` is an array of words of 62 bits; split i has bit (i - 1) % 62 of word (i - 1) // 62. The last public key
    of every split and label is found without repeating a row: tasks count the leading digits of all their
    keys in arrays, and hand on only keys with the digits of a wanted position, one in some thousands.
    `label` holds classes: at most MASK_LABELS of them.
    """
    kind, id_kind = df.schema[label].dataType, df.schema[id_col].dataType
    numbers = np.array([split_numbers(i, seed) for i in range(1, splits + 1)], np.int64).reshape(-1, 2)
    rows = df.select(label, id_col, F.coalesce(sample_number(id_col, seed), F.lit(0)).alias("_hash"))
    sizes = rows.groupBy(label).agg(F.bround(F.count(F.lit(1)) * F.lit(public_share), 0).cast("long").alias("n"))
    public = {r[0]: r[1] for r in sizes.limit(MASK_LABELS + 1).collect()}
    if len(public) > MASK_LABELS:
        raise ValueError(f"{label} has more than {MASK_LABELS} values")
    # Some 64 keys have the same digits, or more where the digits are all counted ones.
    most = max(public.values(), default=0) / max(public_share, 1e-9)
    digits = min(MASK_DIGIT_BITS, max(4, int(most / 64).bit_length()))
    prime, shift, words = SPLIT_PRIME, SPLIT_BITS - digits, -(-splits // WORD_BITS)
    arrow, id_arrow = to_arrow_type(kind), to_arrow_type(id_kind)

    def parts(batch):
        """(label, its rows, their keys of every split)."""
        codes = batch.column(0).dictionary_encode(null_encoding="encode")
        found, code = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
        hashes = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False) % prime
        for i, name in enumerate(found):
            own = np.flatnonzero(code == i)
            yield name, own, (hashes[own, None] * numbers[:, 0] + numbers[:, 1]) % prime

    def count(batches):
        sums = {}
        for batch in batches:
            for name, _, keys in parts(batch):
                n = sums.setdefault(name, np.zeros((splits, 1 << digits), np.int64))
                for s in range(splits):
                    n[s] += np.bincount(keys[:, s] >> shift, minlength=n.shape[1])
        for name, n in sums.items():
            for s in range(splits):
                some = np.flatnonzero(n[s])
                yield pa.RecordBatch.from_pydict(
                    {"label": pa.array([name], arrow), "split": pa.array([s], pa.int32()),
                     "digit": pa.array([some], pa.list_(pa.int32())), "n": pa.array([n[s][some]], pa.list_(pa.int64()))}
                )

    fields = [T.StructField("label", kind), T.StructField("split", T.IntegerType())]
    lists = [T.StructField("digit", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.LongType()))]
    counts = rows.mapInArrow(count, T.StructType([*fields, *lists]))
    counts = counts.select("label", "split", F.explode(F.arrays_zip("digit", "n")).alias("c"))
    counts = counts.groupBy("label", "split", "c.digit").agg(F.sum("c.n").alias("n"))
    counts = counts.groupBy("label", "split").agg(F.array_sort(F.collect_list(F.struct("digit", "n"))).alias("c"))
    wanted = {}
    found = counts.select("label", "split", "c.digit", "c.n").toArrow()  # 2^MASK_DIGIT_BITS numbers for a label and split
    for i, name in enumerate(found.column("label").to_pylist()):
        split, digit, n = (found.column(c)[i] for c in ("split", "digit", "n"))
        ends = np.cumsum(n.values.to_numpy())
        last = public[name] - 1
        if last >= 0:
            at = int(np.searchsorted(ends, last, "right"))
            wanted[name, split.as_py()] = (digit.values[at].as_py(), int(last - (ends[at - 1] if at else 0)))
    context = df.sparkSession.sparkContext
    near = context.broadcast(wanted)

    def hand_on(batches):
        for batch in batches:
            ids, labels, at, found, owners = batch.column(1), [], [], [], []
            for name, own, keys in parts(batch):
                for s in range(splits):
                    here = near.value.get((name, s))
                    if here is not None:
                        some = np.flatnonzero(keys[:, s] >> shift == here[0])
                        labels += [name] * len(some)
                        at += [s] * len(some)
                        found.append(keys[some, s])
                        owners.append(own[some])
            if labels:
                yield pa.RecordBatch.from_pydict(
                    {"label": pa.array(labels, arrow), "split": pa.array(at, pa.int32()),
                     "key": pa.array(np.concatenate(found)), "id": ids.take(pa.array(np.concatenate(owners)))}
                )

    long = rows.mapInArrow(hand_on, T.StructType([*fields, T.StructField("key", T.LongType()), T.StructField("id", id_kind)]))
    place = F.row_number().over(Window.partitionBy("label", "split").orderBy("key", "id")) - 1
    where = [(name, s, i) for (name, s), (_, i) in wanted.items()]
    places = df.sparkSession.createDataFrame(where, T.StructType([*fields, T.StructField("place", T.IntegerType())]))
    long = join_on(long.withColumn("_at", place), F.broadcast(places), ["label", "split"]).where(F.col("_at") == F.col("place"))
    last = {(r["label"], r["split"]): (r["key"], r["id"]) for r in long.collect()}  # one for a label and split
    ends = context.broadcast(last)
    kept = df.columns

    def marked(batches):
        for batch in batches:
            columns = batch.columns
            tail = pa.RecordBatch.from_arrays(columns[-3:], names=["label", "id", "hash"])
            bits = np.zeros((batch.num_rows, words), np.int64)
            for name, own, keys in parts(tail):
                ids = columns[-2].take(pa.array(own))
                for s in range(splits):
                    end = ends.value.get((name, s))
                    if end is None:
                        continue
                    low = keys[:, s] < end[0]
                    same = np.flatnonzero(keys[:, s] == end[0])
                    if len(same):
                        tied = pc.less_equal(ids.take(pa.array(same)), pa.scalar(end[1], id_arrow))
                        low[same] = tied.fill_null(True).to_numpy(zero_copy_only=False)
                    bits[own, s // WORD_BITS] |= low.astype(np.int64) << (s % WORD_BITS)
            made = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * words), pa.array(bits.ravel()))
            yield pa.RecordBatch.from_arrays([*columns[:-3], made], names=[*kept, mask])

    hashed = F.coalesce(sample_number(id_col, seed), F.lit(0)).alias("_hash")
    whole = df.select(*df.columns, F.col(label).alias("_label"), F.col(id_col).alias("_id"), hashed)
    return whole.mapInArrow(marked, T.StructType([*df.schema.fields, T.StructField(mask, T.ArrayType(T.LongType()))]))


def split_gains(
    masked: DataFrame, hits: dict[str, Column], gain: str, splits: int, public_share: float = 0.3, mask: str = "public_splits"
) -> DataFrame:
    """Gain of every model on both sides of every split, scaled by the side's share, from one pass over the rows.

    `hits` says for each model which rows it contacts. Columns: split, then <model>_public and <model>_private.
    """
    names = [f"_won{m}" for m in range(len(hits))]
    none = F.lit(0).cast("long")
    won = [F.coalesce(F.when(hit, F.col(gain)), none).alias(n) for n, hit in zip(names, hits.values())]
    rows = masked.select(*won, mask)
    kinds = [rows.schema[n].dataType for n in names]
    schema = T.StructType(
        [T.StructField("split", T.IntegerType())] + [T.StructField(f"{n}{k}", t) for n, t in zip(names, kinds) for k in ("_in", "")]
    )

    def add(batches):
        """The sums of one task: on the public side of every split, and of all rows."""
        inside, whole = [0] * len(names), [0] * len(names)
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(len(names)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            bits = np.stack([words[:, s // WORD_BITS] >> (s % WORD_BITS) & 1 for s in range(splits)])
            for m in range(len(names)):
                x = batch.column(m).to_numpy(zero_copy_only=False)
                inside[m], whole[m] = inside[m] + bits @ x, whole[m] + x.sum()
        columns = [pa.array(np.arange(1, splits + 1), pa.int32())]
        for m in range(len(names)):
            columns += [pa.array(np.broadcast_to(v, splits), arrow[m]) for v in (inside[m], whole[m])]
        yield pa.RecordBatch.from_arrays(columns, names=fields)

    arrow, fields = [to_arrow_type(t) for t in kinds], schema.names
    sums = rows.mapInArrow(add, schema).groupBy("split").agg(*[F.sum(c).alias(c) for c in fields[1:]])
    every = masked.sparkSession.range(1, splits + 1).select(F.col("id").cast("int").alias("split"))
    sums = every.join(F.broadcast(sums), "split", "left").na.fill(0)  # a row for each split
    sides = []
    for n, name in zip(names, hits):
        sides.append((F.col(f"{n}_in") / public_share).alias(f"{name}_public"))
        sides.append(((F.col(n) - F.col(f"{n}_in")) / (1 - public_share)).alias(f"{name}_private"))
    return sums.select("split", *sides)


def kfold(
    df: DataFrame,
    id_col: str,
    label: str,
    folds: int = 5,
    seed: int = 42,
    fold: str = "fold",
) -> DataFrame:
    """Stratified fold numbers: each label's rows, in sample-key order, cut into equal parts."""
    rows = df.withColumns(
        {"_key": sample_key(id_col, seed), **_strata(df, [label])}
    )
    strata = list(_strata(df, [label]))
    cuts = keys_at(
        rows,
        F.col("_key"),
        F.col(id_col),
        lambda n: tile_ends(n, folds),
        strata,
        digits=_hex_digits("_key"),
    )
    ends = cuts.groupBy(*strata).agg(
        F.array_sort(F.collect_list(sort_key(F.col("_value"), F.col("_tie")))).alias("_ends")
    )
    rows = join_on(rows, pin(ends), strata, "left")
    rows = rows.withColumn("_own", sort_key(F.col("_key"), F.col(id_col)))
    rows = lower_bound(rows, "_ends", "_own", fold, folds - 1)
    return rows.select(*df.columns, fold)
