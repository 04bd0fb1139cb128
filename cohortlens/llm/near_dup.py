"""Near duplicates by DartMinHash: weighted signatures from hashed darts, banded, then checked exactly.

Every element of a weighted set owns a region of width `weight`. Hashed darts fall into the regions
at rate 1 per unit of width and rank, each with one of k coordinates; the dart of least rank in a
coordinate is the set's sample there. Two sets agree in a coordinate with the probability of their
weighted Jaccard similarity. Darts are thrown only up to a rank of (k ln k + 4k) / total weight, so
a long text costs no more darts than a short one; coordinates that stay empty get a second throw.

Similarity is the Jaccard index of the sets of five-word shingles (weight 1 each), 0.8 or more.
With k = 96 in 24 bands of 4, a pair at 0.8 shares no band with probability 3e-6.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import GOLDEN, U64, arrow_map, fresh, hashes, mix, shingles, ship, text_steps, words_of
from cohortlens.llm.components import components
from cohortlens.session import stored

COORDINATES, BAND = 96, 4
SHINGLE, SIMILAR = 5, 0.8
# Pairs whose signatures agree in a smaller share are not similar: 0.6 is 4.9 deviations below 0.8.
AGREE = 0.6
# Members of larger buckets get finer signatures, of which 0.71 is 5.1 deviations below 0.8.
LARGE_BUCKET, FINE, FINE_AGREE = 48, 512, 0.71
# Members of a large bucket that one task compares with as many others.
BLOCK = 1024
# Size of the filter by which tasks skip texts that are in no pair: 16 MB, however many there are.
FILTER_BITS = 27
# Bytes of text whose shingles are held together, and darts that are thrown at once, about: a throw holds some ten numbers for
# each, and a worker keeps what its largest throw took.
STEP, DARTS = 1 << 20, 1 << 18
TO_UNIT = 2.0**-53


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U64(11)).astype(np.float64) + 0.5) * TO_UNIT


def darts(
    elements: np.ndarray, weights: np.ndarray, limits: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, coordinate, rank, name) of the darts of each weighted element up to its rank limit.

    Regions are cut at weights 1, 2, 4, ...: a dart of a cell depends on the element and the cell
    alone, and counts if its height is below the weight, so sets with other weights share it.
    """
    owner, low = np.arange(len(elements)), np.zeros(len(elements))
    width = np.ones(len(elements))
    out = []
    with np.errstate(over="ignore"):
        cell = 0
        while len(owner):
            seed = mix(elements[owner] ^ mix(np.full(1, cell + 1, U64) * GOLDEN))
            at, who, step = np.zeros(len(owner)), np.arange(len(owner)), 0
            while len(who):
                name = mix(seed[who] + U64(step + 1) * GOLDEN)
                at = at - np.log(_uniform(name)) / width[who]
                live = at <= limits[owner[who]]
                who, at, name = who[live], at[live], name[live]
                height = low[who] + width[who] * _uniform(mix(name ^ U64(0x5851F42D4C957F2D)))
                inside = height <= weights[owner[who]]
                spot = mix(name ^ U64(0x14057B7EF767814F)) % U64(k)
                out.append((owner[who][inside], spot[inside].astype(np.int64), at[inside], name[inside]))
                step += 1
            more = weights[owner] > low + width
            owner = owner[more]
            low, cell = (low + width)[more], cell + 1
            width = np.where(low >= 1, low, 1.0)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(4)) if out else (np.empty(0, int),) * 4


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = COORDINATES) -> np.ndarray:
    """One row of k 32-bit samples for each (elements, weights); an empty set gets a row of zeros."""
    out = np.zeros((len(sets), k), np.uint32)
    todo = np.array([i for i, (e, w) in enumerate(sets) if len(e) and float(w.sum()) > 0], int)
    # Sets of like size together: the throws of a part go on as long as its smallest set needs.
    todo = todo[np.argsort([len(sets[i][0]) for i in todo], kind="stable")]
    reach = math.log(k) + 4
    while len(todo):
        some, left = max(1, int(DARTS / (k * reach))), []
        for start in range(0, len(todo), some):
            part = todo[start : start + some]
            elements = np.concatenate([sets[i][0] for i in part])
            weights = np.concatenate([sets[i][1] for i in part])
            counts = np.array([len(sets[i][0]) for i in part])
            row = np.repeat(np.arange(len(part)), counts)
            total = np.array([sets[i][1].sum() for i in part])
            owner, spot, rank, name = darts(elements, weights, (k * reach / total)[row], k)
            place = row[owner] * k + spot
            order = np.argsort(-rank, kind="stable")  # the least rank is written last and stays
            found, hit = np.zeros(len(part) * k, np.uint32), np.zeros(len(part) * k, bool)
            found[place[order]] = (name[order] >> U64(32)).astype(np.uint32)
            hit[place] = True
            full = hit.reshape(-1, k).all(axis=1)
            out[part[full]] = found.reshape(-1, k)[full]
            left.append(part[~full])
        todo, reach = np.concatenate(left), reach * 2
    return out


def band_keys(signature: np.ndarray, band: int = BAND) -> np.ndarray:
    """One 64-bit key for each band of each row; the band's number is part of the key."""
    n, k = signature.shape
    parts = signature.reshape(n, k // band, band).astype(U64)
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(mix(np.arange(1, k // band + 1).astype(U64) * GOLDEN), parts.shape[:2]).copy()
        for j in range(band):
            keys = mix(keys ^ (parts[:, :, j] + U64(j + 1) * GOLDEN))
    return keys


def text_shingles(text: bytes) -> np.ndarray:
    return shingles(hashes(words_of(text)), SHINGLE)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def _signed(texts: DataFrame) -> DataFrame:
    """(key, bands, signature) of each text (key, text); texts without words have no row."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            for start, some in text_steps(batch.column(1), STEP):
                sets = [text_shingles(t) for t in some]
                at = [i for i, s in enumerate(sets) if len(s)]
                signed = signatures([(sets[i], np.ones(len(sets[i]))) for i in at])
                bands = band_keys(signed).astype(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": keys.take(pa.array([start + i for i in at], pa.int64())),
                        "bands": pa.array(list(bands), pa.list_(pa.int64())),
                        "signature": pa.array([r.tobytes() for r in signed], pa.binary()),
                    }
                )

    return arrow_map(texts.select("key", "text"), run, "key binary, bands array<bigint>, signature binary")


def _wanted(texts: DataFrame, pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """(node, text) of the texts in `pairs`, once each, without a shuffle of all texts.

    A bit for each wanted key, in a filter of fixed size, keeps nearly all others in their tasks.
    """
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    keys = stored(signed.select("key", "node").join(nodes, "node"), "wanted")
    place = F.shiftrightunsigned(F.xxhash64("key"), 64 - FILTER_BITS)
    part_bits = min(19, FILTER_BITS)

    def unite(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << part_bits, np.uint8)
        bits[table.column("place").to_numpy() & ((1 << part_bits) - 1)] = 1
        return pa.table({"part": table.column("part")[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    ship(texts.sparkSession)
    marks = keys.select(place.alias("place")).distinct().withColumn("part", F.shiftright("place", part_bits))
    made = marks.groupBy("part").applyInArrow(unite, "part bigint, bits binary")
    bits = np.zeros((1 << (FILTER_BITS - part_bits), 1 << (part_bits - 3)), np.uint8)
    for row in made.toArrow().to_pylist():  # 16 MB at most
        bits[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(bits.tobytes())

    def keep(batches):
        held = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            at = batch.column(2).to_numpy()
            on = (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            yield batch.select([0, 1]).filter(pa.array(on))

    near = arrow_map(texts.select("key", "text", place), keep, "key binary, text string")
    return stored(near.dropDuplicates(["key"]).join(keys, "key").select("node", "text"), "texts")


def _agreeing(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree in a share of AGREE or more."""

    def run(batches):
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, COORDINATES) for c in (2, 3)
            )
            yield batch.select([0, 1]).filter(pa.array((a == b).mean(axis=1) >= AGREE))

    one = signed.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    two = signed.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    return arrow_map(pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb"), run, "a bigint, b bigint")


def _similar(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pairs (a, b) whose texts are similar by the exact Jaccard index."""

    def run(batches):
        kept = {}
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a not in kept:  # pairs of one text mostly follow each other
                    kept = {a: text_shingles(ta.as_py().encode())}
                keep.append(similarity(kept[a], text_shingles(tb.as_py().encode())) >= SIMILAR)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = wanted.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    two = wanted.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    return arrow_map(pairs.join(one, "b").join(two, "a").select("a", "b", "ta", "tb"), run, "a bigint, b bigint")


def _finely_agreeing(members: DataFrame, texts: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (a, b) of large buckets (h, node, root, n) in different components whose finer signatures agree.

    A bucket is cut into blocks of about BLOCK members, and any two blocks meet in one task. Only
    agreeing pairs leave it, each from the first band that both texts share.
    """
    nodes = members.select(F.col("node").alias("a"), F.col("node").alias("b")).distinct()

    def sign(batches):
        for batch in batches:
            for start, some in text_steps(batch.column(1), STEP):
                sets = [text_shingles(t) for t in some]
                fine = signatures([(s, np.ones(len(s))) for s in sets], FINE).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(some)), pa.array([r.tobytes() for r in fine], pa.binary())],
                    names=["node", "fine"],
                )

    fine = stored(arrow_map(_wanted(texts, nodes, signed), sign, "node bigint, fine binary"), "fine")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    dealt = members.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1))
    )
    dealt = dealt.select(
        "h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root"
    )
    rows = dealt.join(fine, "node").join(signed.select("node", "bands"), "node")

    def compare(table: pa.Table) -> pa.Table:
        h, i, j = (table.column(c)[0].as_py() for c in ("h", "i", "j"))
        own, node, root = (table.column(c).to_numpy() for c in ("own", "node", "root"))
        bands = np.array(table.column("bands").to_pylist(), np.int64).reshape(len(node), -1)
        signs = np.frombuffer(b"".join(table.column("fine").to_pylist()), np.uint16).reshape(len(node), -1)
        a, b = [], []
        second = np.flatnonzero(own == j)
        for x in np.flatnonzero(own == i):
            y = second[(root[second] != root[x]) & ((node[second] > node[x]) if i == j else True)]
            y = y[(signs[y] == signs[x]).mean(axis=1) >= FINE_AGREE]
            shared = bands[y] == bands[x]
            y = y[bands[x][shared.argmax(axis=1)] == h] if len(y) else y
            a.append(np.minimum(node[x], node[y]))
            b.append(np.maximum(node[x], node[y]))
        empty = [np.empty(0, np.int64)]
        return pa.table({"a": np.concatenate(a or empty), "b": np.concatenate(b or empty)})

    return rows.groupBy("h", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def text_classes(texts: DataFrame) -> DataFrame:
    """(key, root) of texts (key, text) that are near duplicates of texts with other keys; root names the class.

    1. In each bucket of a band all members are compared with the most central one, the member whose
       buckets are largest. Copies of one original mostly link to it.
    2. Buckets whose members are then in several components get their pairs between components
       compared: all of them in buckets of up to LARGE_BUCKET members, by finer signatures in
       larger ones. Members of one component need no further link.
    """
    signed = _signed(texts).dropDuplicates(["key"]).withColumn("node", F.monotonically_increasing_id())
    signed = stored(signed, "signed")  # numbered once, in the written table
    rows = signed.select("node", F.explode("bands").alias("h"))
    sizes = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bucketed = stored(rows.join(sizes, "h"), "bucketed")
    weight = bucketed.groupBy("node").agg(F.sum("n").alias("weight"))
    centre = bucketed.join(weight, "node").groupBy("h").agg(F.max(F.struct("weight", "node"))["node"].alias("c"))
    stars = bucketed.join(centre, "h").where("node <> c").select(
        F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")
    ).distinct()
    checked = stored(_agreeing(stars, signed), "stars")
    links = stored(_similar(checked, _wanted(texts, checked, signed)), "links")
    root = stored(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "roots")

    placed = bucketed.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
    mixed = stored(placed.join(mixed, "h"), "mixed")
    small = mixed.where(F.col("n") <= LARGE_BUCKET)
    one = small.select("h", F.col("node").alias("a"), F.col("root").alias("ra"))
    two = small.select("h", F.col("node").alias("b"), F.col("root").alias("rb"))
    rest = _agreeing(one.join(two, "h").where("a < b and ra <> rb").select("a", "b").distinct(), signed)
    large = _finely_agreeing(mixed.where(F.col("n") > LARGE_BUCKET), texts, signed)
    rest = stored(rest.unionByName(large).distinct().join(checked, ["a", "b"], "left_anti"), "rest")
    more = stored(_similar(rest, _wanted(texts, rest, signed)), "links")
    if more.isEmpty():
        return signed.select("key", "node").join(root, "node").select("key", "root")
    # Roots of the first round are joined by the links of the second.
    first = root.select(F.col("node").alias("u"), F.col("root").alias("v"))
    found = components(first.unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    return signed.select("key", "node").join(found, "node").select("key", "root")


def _classed(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str, DataFrame]:
    """`docs` with a key of each text, that column's name, and (key, class_id, copies of the class id)."""
    key = fresh(docs, "text_key")
    keyed = docs.withColumn(key, F.unhex(F.md5(F.col(text).cast("binary"))))
    rows = keyed.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(doc_id).alias("id")
    )
    lowest = F.min(F.struct(F.col("id").isNull().alias("none"), "id"))["id"]
    # Ids are counted first, so that a class holds one row for each id.
    ids = rows.groupBy("key", "id").agg(F.count(F.lit(1)).alias("n"))
    roots = text_classes(rows.select("key", "text"))
    # A text outside all classes is a class by its own key.
    named = F.when(F.col("root").isNull(), F.col("key")).otherwise(F.col("root").cast("string").cast("binary"))
    placed = stored(ids.join(roots, "key", "left").withColumn("root", named), "placed")
    least = placed.groupBy("root").agg(lowest.alias("class_id"))
    return keyed, key, placed.join(least, "root").select("key", "root", "class_id", "id", "n")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "class_id") -> DataFrame:
    """All rows and columns of `docs`, and the class of each row in `name`: its smallest id.

    Equal texts are always one class (empty ones too). Texts without words are compared only as
    equal texts; a null text is a class of its own, named by its own id. Null ids count only if the
    class has no other. Repeated rows stay rows. Columns of `docs` keep their names and values.
    """
    keyed, key, classes = _classed(docs, doc_id, text)
    group = fresh(keyed, "group_id")
    found = classes.select(F.col("key").alias(key), F.col("class_id").alias(group)).distinct()
    return keyed.join(found, key, "left").withColumn(
        name, F.when(F.col(key).isNull(), F.col(doc_id)).otherwise(F.col(group))
    ).drop(key, group)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of near duplicates, the one with the smallest id; all columns.

    Rows with a null text all stay. If several rows of a class share the smallest id, the one with
    the smallest text key stays, and of equal texts any one row.
    """
    keyed, key, classes = _classed(docs, doc_id, text)
    winners = classes.where(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(
        F.min(F.struct("key", "id", "n")).alias("w")
    ).select(F.col("w.key").alias(key), F.col("w.id").alias("w_id"), F.col("w.n").alias("w_n"))
    one, many = (fresh(keyed, n) for n in ("winner_id", "winner_rows"))
    kept = keyed.join(winners.withColumnsRenamed({"w_id": one, "w_n": many}), key)
    kept = kept.where(F.col(doc_id).eqNullSafe(F.col(one)))
    single = kept.where(F.col(many) == 1)
    repeated = kept.where(F.col(many) > 1).dropDuplicates([key])
    return single.unionByName(repeated).drop(key, one, many).unionByName(docs.where(F.col(text).isNull()))
