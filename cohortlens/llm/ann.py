"""Nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

Vectors get one more component, sqrt(largest norm^2 - own norm^2), after which the largest inner product is the
smallest distance. The tree is made from a bounded sample; every row goes down to a leaf. A query
opens nodes from a priority queue, the centroid of largest inner product first, and so orders the leaves. How
many leaves are visited is widened on a sample of queries until their recall against brute force reaches the
target. Leaves are searched in blocks of rows and of queries, so that no task holds a whole leaf.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import U64, arrow_map, mix
from cohortlens.session import stored

BRANCHES = 8
# Rows of a leaf, about, as long as the sample allows; bytes and rows of the sample, at most.
LEAF_ROWS, SAMPLE_ROWS, SAMPLE_BYTES = 256, 20_000, 64 << 20
# Rows (of neighbouring leaves, or a part of one large leaf) and queries that meet in one task.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 8192
CALIBRATION_QUERIES, TARGET = 256, 0.96


@dataclass
class Tree:
    """Nodes by number; `children` is empty for a leaf, `leaf` its number."""

    centre: np.ndarray
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each (extended) row: the nearest centroid, level by level."""
        at = np.zeros(len(x), np.int64)
        moving = np.arange(len(x))
        while len(moving):
            following = []
            for node in np.unique(at[moving]):
                rows, below = moving[at[moving] == node], self.children[node]
                if below:
                    c = self.centre[below]
                    at[rows] = np.array(below)[((c**2).sum(axis=1) - 2 * x[rows] @ c.T).argmin(axis=1)]
                    following.append(rows)
            moving = np.concatenate(following) if following else np.empty(0, np.int64)
        return np.array(self.leaf)[at]

    def order(self, q: np.ndarray, most: int) -> list[int]:
        """The first `most` leaves of a query, best bin first. Ties go to the smaller node."""
        near = self.centre[:, : len(q)] @ q
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            node = heapq.heappop(queue)[1]
            if self.children[node]:
                for c in self.children[node]:
                    heapq.heappush(queue, (-near[c], c))
            else:
                out.append(self.leaf[node])
        return out


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    centre = np.unique(x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)], axis=0)
    for _ in range(rounds):
        label = ((centre**2).sum(axis=1) - 2 * x @ centre.T).argmin(axis=1)
        centre = np.stack([x[label == c].mean(axis=0) if (label == c).any() else centre[c] for c in range(len(centre))])
    return centre


def build(sample: np.ndarray, leaf_rows: int) -> Tree:
    """A tree over sample rows; nodes of up to `leaf_rows` rows, or of equal rows, are leaves."""
    centres, tree = [sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])], Tree(np.empty(0))
    tree.children, tree.leaf = [[]], [-1]
    todo = [(0, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        label = None
        if len(rows) > leaf_rows:
            centre = _kmeans(sample[rows], BRANCHES, node)
            label = ((centre**2).sum(axis=1) - 2 * sample[rows] @ centre.T).argmin(axis=1)
        if label is None or len(np.unique(label)) < 2:
            tree.leaf[node] = tree.leaves
            tree.leaves += 1
            continue
        for c in np.unique(label):
            tree.children[node].append(len(centres))
            todo.append((len(centres), rows[label == c]))
            centres.append(centre[c])
            tree.children.append([])
            tree.leaf.append(-1)
    tree.centre = np.array(centres)
    return tree


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v) of the vectors that take part: with an id, not null or zero, finite, of the commonest length."""
    v = F.col(embedding).cast("array<double>")
    good = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists(v, lambda x: x != 0)
    some = vectors.where(good).select(F.col(vec_id).alias("id"), v.alias("v"))
    sizes = some.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return some.where(F.size("v") == (sizes["n"] if sizes else 0))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _extended(x: np.ndarray, largest: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(largest - (x**2).sum(axis=1), 0))])


def best(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int, allowed=None):
    """(query, id, score) of the k best rows of each query in a block, ties to smaller ids.

    `allowed`, if given, holds a flag for each query and row. A matrix product chooses, with room for
    rounding; scores are then summed the same way for each pair, so that equal vectors have equal scores. Two sums
    of a product of d terms differ by less than 2 (d + 2) eps |q||c|, however much the terms cancel.
    """
    out = []
    room = 2 * (c.shape[1] + 2) * np.finfo(float).eps * np.linalg.norm(c, axis=1) if len(c) else np.empty(0)
    length = np.linalg.norm(q, axis=1) if len(q) else np.empty(0)
    for a in range(0, len(q), 256):
        product = q[a : a + 256] @ c.T
        for i, row in enumerate(product, a):
            open_rows = c_id != q_id[i]
            other = np.flatnonzero(open_rows if allowed is None else open_rows & allowed(i))
            if len(other) > k:
                near, unsure = row[other], room[other] * length[i]
                edge = np.partition(near - unsure, len(near) - k)[len(near) - k]
                other = other[near + unsure >= edge]
            score = (c[other] * q[i]).sum(axis=1)
            top = np.lexsort((c_id[other], -score))[:k]
            out.append((np.full(len(top), q_id[i]), c_id[other][top], score[top]))
    empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return tuple(np.concatenate(x) for x in zip(*(out or [empty])))


def shards(sizes: dict[int, int], leaves: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each leaf, and how many blocks each shard has.

    Neighbouring leaves share a shard of up to `most` rows; a larger leaf is a shard of several blocks.
    """
    shard, blocks, held = np.zeros(leaves, np.int64), [1], 0
    for leaf in range(leaves):
        n = sizes.get(leaf, 0)
        if held and held + n > most:
            blocks.append(1)
            held = 0
        shard[leaf] = len(blocks) - 1
        held += n
        blocks[-1] = max(1, -(-held // most))
    return shard, np.array(blocks)


TOP = "query_id bigint, vec_id bigint, score double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def brute_force(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of a bounded set of queries against all rows; both are (id, v)."""
    held = queries.toArrow()
    q_id, q = held.column("id").to_numpy(), _matrix(held.column("v"))
    shared = rows.sparkSession.sparkContext.broadcast((q_id, q))

    def run(batches):
        for batch in batches:
            if batch.num_rows and len(shared.value[0]):
                found = best(*shared.value, batch.column(0).to_numpy(), _matrix(batch.column(1)), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    return _ranked(arrow_map(rows.select("id", "v"), run, TOP), k)


def search(
    vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
    target: float = TARGET, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, its own id left out.

    `is_query` is a condition on the column `id`. Equal scores go by the smaller id. Rows with
    the id of the query never answer it; an id on several rows is several candidates. Vectors that are
    null, zero, not finite, of an uncommon length or without an id take no part. With fewer
    candidates than k all are returned; without vectors there are no rows.
    """
    spark = vectors.sparkSession
    rows = valid(vectors, vec_id, embedding).withColumn("id", F.col("id").cast("bigint"))
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"),
        F.max(F.size("v")).alias("dim"),
    ).first()
    n, dim = facts["n"], facts["dim"] or 0
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(1, dim))))
    hashed = F.xxhash64("id", "v")
    sample = rows.orderBy(hashed).limit(most).select("v").toArrow().column(0)
    x = _extended(_matrix(sample), facts["norm"] or 0.0)
    # Leaves of about `leaf_rows` rows, but of 16 sample rows at least.
    tree = build(x, max(16, len(x) * leaf_rows // max(1, n)))
    shared = spark.sparkContext.broadcast((tree, facts["norm"] or 0.0))

    def to_leaf(batches):
        for batch in batches:
            t, largest = shared.value
            if batch.num_rows:
                leaf = t.assign(_extended(_matrix(batch.column(1)), largest))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["id", "v", "leaf"])

    placed = stored(arrow_map(rows.select("id", "v"), to_leaf, "id bigint, v array<double>, leaf bigint"), "leaves")
    queries = placed.where(is_query).select("id", "v")
    n_queries = queries.count()
    width = _calibrated(queries, placed, tree, k, target)

    # One number for each leaf, of which there are at most as many as sample rows.
    sizes = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}
    shard, blocks = shards(sizes, tree.leaves, BLOCK_ROWS)
    # Queries that come to a shard, at most, are cut into parts.
    parts = max(1, -(-n_queries // BLOCK_QUERIES))
    layout = spark.sparkContext.broadcast((shard, blocks))

    def visits(batches):
        for batch in batches:
            t, (of, n) = shared.value[0], layout.value
            row, where, block, open_leaves = [], [], [], []
            for i, q in enumerate(_matrix(batch.column(1))):
                own = np.array(sorted(t.order(q, width)), np.int64)
                for s in np.unique(of[own]):
                    for j in range(n[s]):
                        row.append(i)
                        where.append(s)
                        block.append(j)
                        open_leaves.append(own[of[own] == s])
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(where, pa.int64()),
                 pa.array(block, pa.int64()), pa.array(open_leaves, pa.list_(pa.int64()))],
                names=["id", "v", "shard", "block", "leaves"],
            )

    def held_in(batches):
        for batch in batches:
            of, n = layout.value
            leaf, ids = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            where = of[leaf]
            spread = (mix(ids.astype(U64)) % U64(1 << 31)).astype(np.int64) % n[where]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(where), pa.array(spread)], names=["id", "v", "leaf", "shard", "block"]
            )

    asked = arrow_map(queries, visits, "id bigint, v array<double>, shard bigint, block bigint, leaves array<bigint>")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    held = arrow_map(
        placed.select("id", "v", "leaf"), held_in, "id bigint, v array<double>, leaf bigint, shard bigint, block bigint"
    ).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if left.num_rows and right.num_rows:
            names, leaf = np.unique(right.column("leaf").to_numpy(), return_inverse=True)
            open_leaves = left.column("leaves").to_pylist()
            found = best(
                left.column("id").to_numpy(), _matrix(left.column("v")),
                right.column("id").to_numpy(), _matrix(right.column("v")), k,
                lambda i: np.isin(names, open_leaves[i])[leaf],
            )
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found)))

    by = ["shard", "block", "part"]
    met = asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(meet, TOP)
    return _ranked(met, k).select("query_id", "rank", "vec_id", "score")


def _calibrated(queries: DataFrame, placed: DataFrame, tree: Tree, k: int, target: float) -> int:
    """Leaves to visit: widened until a sample of queries finds `target` of its true neighbours."""
    sample = stored(queries.orderBy(F.xxhash64("id", "v")).limit(CALIBRATION_QUERIES), "calibration")
    held = sample.toArrow()
    first = {}
    for i, q in zip(held.column("id").to_pylist(), _matrix(held.column("v"))):
        first[i] = {leaf: at for at, leaf in enumerate(tree.order(q, tree.leaves))}
    truth = brute_force(sample, placed.select("id", "v"), k)
    leaves = truth.join(placed.select(F.col("id").alias("vec_id"), "leaf"), "vec_id")
    leaves = leaves.select("query_id", "rank", "leaf").distinct().collect()  # a leaf for each of the k, if ids are unique
    needed = np.array([first[r["query_id"]][r["leaf"]] for r in leaves])
    width = 1
    while width < tree.leaves and len(needed) and (needed < width).mean() < target:
        width += 1
    return width
