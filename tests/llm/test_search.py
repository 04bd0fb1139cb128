"""Tree search, the pipeline and the registered queries."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import ann, decontaminate, near_dup, queries
from tests.check_oracles import compare, connect

SF = "/root/testdata/sf0.001"


def plain_search(rows, k, ask):
    """{query: [(rank, id, score)]} by comparing all rows."""
    good = [(i, v) for i, v in rows if i is not None and v and len(v) == 3 and all(
        x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if ask(q):
            found = sorted((-float((np.array(v) * np.array(w)).sum()), i) for i, w in good if i != q)[:k]
            out[q] = [(n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return out


def test_search_of_all_leaves_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 4)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-4, 5, 3)]) for i in range(150)]
    rows += [(200 + i, [1.0, 2.0, 2.0]) for i in range(60)]
    rows += [(300, None), (301, [0.0, 0.0, 0.0]), (302, [1.0, None, 2.0]), (303, [1.0, float("nan"), 0.0]),
             (304, [float("inf"), 1.0, 1.0]), (305, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (306, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, leaf int")
    got = ann.search(df, F.col("id") % 5 == 0, k=7, target=1.0, leaf_rows=20).collect()
    want = plain_search(rows, 7, lambda q: q % 5 == 0)
    mine = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        mine.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    # The width is calibrated on all queries here, so nothing is missed.
    assert mine == want


def test_search_of_few_or_no_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    assert ann.search(spark.createDataFrame([], kind), F.col("id") % 2 == 0).count() == 0
    two = spark.createDataFrame([(2, [1.0, 0.0]), (3, [0.5, 0.0])], kind)
    assert [tuple(r) for r in ann.search(two, F.col("id") % 2 == 0).collect()] == [(2, 1, 3, 0.5)]
    one = spark.createDataFrame([(2, [1.0, 0.0])], kind)
    assert ann.search(one, F.col("id") % 2 == 0).count() == 0


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, x = table.vec_id.to_numpy(), np.array(table.embedding.tolist(), np.float64)
    hit = total = 0
    for q, found in queries.op8_kmeans_tree_search(spark, sf).toPandas().groupby("query_id"):
        score = x @ x[ids == q][0]
        best = ids[np.lexsort((ids, -score))]
        hit += len(set(best[best != q][:20]) & set(found.vec_id))
        total += 20
        assert sorted(found["rank"]) == list(range(1, 21))
    assert hit / total >= 0.9


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.withColumn("quality_score", F.lit("kept")).withColumn("text_key", F.lit(1))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    frames = [extra]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frames.append(stage(spark, frames[-1], SF).cache())
        assert frames[-1].columns == extra.columns, name
    _, good, single, cut, masked = frames
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = good.select("doc_id").join(labels, "doc_id")
    assert kept.where("quality = 0").count() == 0
    assert good.join(labels, "doc_id").where("quality = 1").count() == labels.where("quality = 1").count()
    classes = near_dup.near_duplicates(good).select("class_id").distinct().count()
    assert single.count() == classes
    assert decontaminate.report(cut, bench).where("leaks.n_hit > 0").count() == 0
    assert cut.count() == single.count() == masked.count()
    changed = cut.join(single.withColumnRenamed("text", "before"), "doc_id").where("text <> before")
    assert changed.count() == decontaminate.report(single, bench).where("leaks.n_hit > 0").count() > 0
    assert masked.where(F.col("n_chars") != F.char_length("text")).count() == 0
    assert masked.where(F.col("text").rlike(r"[a-z0-9]@[a-z0-9]+\.[a-z]")).count() == 0
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == masked.count()
    assert packed.where(F.octet_length("ids") != F.col("length") * 4).count() == 0


def test_pipeline_stages_on_odd_tables(spark):
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    long_text = " ".join(f"plain words of a long text {i}" for i in range(20_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c", None, "s", 5),
            (5, long_text, "en", "s", len(long_text)), (5, long_text, "en", "s", len(long_text))]
    for docs in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "packing" or out.columns == docs.columns
            docs = out.cache()
            docs.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF) is None


def test_registered():
    from __spark_entry__ import queries as registered

    names = registered()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_large_components_that_cancel():
    """The matrix product rounds otherwise than the scores: no neighbour falls out before it is scored."""
    rng = np.random.default_rng(1)
    for _ in range(40):
        c = rng.normal(size=(400, 32)) * 1e12
        c[:, 16:] = -c[:, :16] + rng.normal(size=(400, 16))
        q = np.concatenate([np.ones((3, 16)), np.ones((3, 16))], axis=1) * 1e3
        ids = np.arange(400)
        got = ann.best(np.array([1000, 1001, 1002]), q, ids, c, 20)
        score = (c * q[0]).sum(axis=1)
        want = np.lexsort((ids, -score))[:20]
        assert got[1][:20].tolist() == want.tolist() and got[2][:20].tolist() == score[want].tolist()
