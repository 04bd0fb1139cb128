"""Language model, quality, toxicity and language identification against plain versions."""

import collections
import math
import os
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import hash_table, language_id, ngram_lm, quality, queries, toxicity
from cohortlens.llm.common import CLEAN_CONF, shuffles_dropped, text_steps

SF = "/root/testdata/sf0.001"


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + ["</s>"]


class PlainKneserNey:
    """Interpolated modified Kneser-Ney by dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        raw = [None] + [collections.Counter() for _ in range(order)]
        for t in texts:
            w = ["<s>"] * (order - 1) + tokens(t)
            for i in range(order - 1, len(w)):
                for m in range(1, order + 1):
                    raw[m][tuple(w[i - m + 1 : i + 1])] += 1
        self.words, self.total = raw[1], sum(raw[1].values())
        self.adjusted = [None] * (order + 1)
        self.adjusted[order] = raw[order]
        for m in range(order - 1, 0, -1):
            left = collections.Counter(g[1:] for g in raw[m + 1])
            self.adjusted[m] = {g: raw[m][g] if g[0] == "<s>" else left[g] for g in raw[m]}
        self.discounts, self.contexts = [None], [None]
        for m in range(1, order + 1):
            n = [sum(v == k for v in self.adjusted[m].values()) for k in (1, 2, 3, 4)]
            self.discounts.append(ngram_lm._discount(n))
            kinds = collections.defaultdict(lambda: [0, 0, 0, 0])
            for g, v in self.adjusted[m].items():
                kinds[g[:-1]][0] += v
                kinds[g[:-1]][min(v, 3)] += 1
            self.contexts.append(kinds)

    def probability(self, history, word):
        p = 1 / (len(self.words) + 1)
        for m in range(1, self.order + 1):
            u = tuple(history[len(history) - m + 1 :])
            if u in self.contexts[m]:
                total, *kinds = self.contexts[m][u]
                d, a = self.discounts[m], self.adjusted[m].get((*u, word), 0)
                rest = sum(x * y for x, y in zip(d, kinds)) / total
                p = max(a - (0, *d)[min(a, 3)], 0) / total + rest * p
        return p

    def row(self, text):
        w = tokens(text)
        history, score = ["<s>"] * (self.order - 1), 0.0
        for x in w:
            score += math.log10(self.probability(history, x))
            history = [*history, x][-(self.order - 1) :]
        base = sum(math.log10((self.words[(x,)] + 1) / (self.total + len(self.words) + 1)) for x in w)
        return len(w), sum(self.words[(x,)] > 0 for x in w), self.total, base, score


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney_equals_plain_version(spark, order):
    texts = ["a b a c", "A b d", "b a b a", "", None, "a b a c", "x", "d d d d c é É"] * 2 + ["a q r s"]
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(texts)], "id long, text string, lm_x double")
    train = docs.where("id < 14")
    model = ngram_lm.train(train, order=order)
    plain = PlainKneserNey(texts[:14], order)
    for r in ngram_lm.score(docs, model).collect():
        assert tuple(r.lm) == pytest.approx(plain.row(r.text), rel=1e-9)
        assert r.lm_x == 1.5


def test_op1_query_trains_middle_orders(spark, monkeypatch):
    seen, train = [], ngram_lm.train
    monkeypatch.setattr(ngram_lm, "train", lambda *a, **k: seen.append(train(*a, **k)) or seen[-1])
    assert queries.op1_kneser_ney_scores(spark, SF).count()
    assert seen[0].order >= 3 and any(f.startswith("left2") for f in os.listdir(seen[0].folder))


@pytest.mark.parametrize("bits", [0, 3, 18])
def test_tables_keep_whole_keys(spark, bits):
    rng = np.random.default_rng(bits)
    keys = np.unique(np.concatenate([rng.integers(0, 2**64, 300, np.uint64), np.array([0, 1, 2**16, 2**48 - 1, 2**48, 2**64 - 1], np.uint64)]))
    if bits > 3:
        keys = np.unique(keys >> np.uint64(60))
    values = rng.integers(1, 600, len(keys))
    folder = hash_table.mapped_dir(spark, "test")
    emit = lambda some: [("t", keys, values[:, None])]
    hash_table.gather(spark.createDataFrame([("x",)], "t string"), emit, text_steps, folder, bits).collect()
    found = hash_table.Table(folder, "t", bits, 1)
    assert (found.get(keys)[:, 0] == values).all()
    near = np.concatenate([keys ^ np.uint64(1 << k) for k in (0, 15, 16, 47, 48, 63)])
    near = near[~np.isin(near, keys)]
    assert not found.get(near).any()


def test_shuffles_of_a_pass_are_deleted(spark):
    def files():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}

    before, kept = files(), spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert len(kept.collect()) == 7 and files() - before
    before = files()
    with shuffles_dropped(spark):
        assert len(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()) == 7
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(CLEAN_CONF) == "false"


def test_kneser_ney_of_no_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    model = ngram_lm.train(docs.where("id > 5"))
    got = {r.id: tuple(r.lm) for r in ngram_lm.score(docs, model).collect()}
    assert got == {1: (3, 0, 0, 0.0, 0.0), 2: (1, 0, 0, 0.0, 0.0)}
    with pytest.raises(ValueError):
        ngram_lm.train(docs, order=1)


def test_op1_query_against_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in docs}
    plain = PlainKneserNey([r.text for r in docs if not held[r.doc_id]], ngram_lm.ORDER)
    texts = {r.doc_id: r.text for r in docs}
    rows = queries.op1_kneser_ney_scores(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain.row(texts[r.doc_id])
        assert r.held_out == held[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == pytest.approx(want, rel=1e-9)


def edge_docs(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "!!! ???"), (6, "word " * 60_000), (7, "été x 😀")]
    return spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], "doc_id long, text string, score double, words string")


def test_quality_separates_and_handles_edges(spark):
    good = [f"this is a plain line number {i} of some text" for i in range(60)]
    bad = [f"BUY!! NOW!! {i}!! CHEAP!! $$$ *** ###" for i in range(60)]
    rows = [(t, 1) for t in good] + [(t, 0) for t in bad] + [("ignored", None), (None, 1)]
    model = quality.fit(spark.createDataFrame(rows, "text string, quality int"))
    test = spark.createDataFrame([("one more plain line of a text",), ("SALE!! TODAY!! $$$ ***",)], "text string")
    scores = [r.score for r in quality.score(test, model).collect()]
    assert scores[0] > 0.5 > scores[1]
    out = quality.score(edge_docs(spark), model, name="quality_score")
    assert out.columns == ["doc_id", "text", "score", "words", "quality_score"]
    got = out.collect()
    assert len(got) == 7 and all(0 <= r.quality_score <= 1 for r in got)
    assert got[0].quality_score == got[1].quality_score and got[2].quality_score == got[3].quality_score


def test_quality_without_both_classes(spark):
    empty = spark.createDataFrame([], "text string, quality int")
    docs = spark.createDataFrame([("a b",)], "text string")
    assert quality.score(docs, quality.fit(empty)).first().score == pytest.approx(0.5)
    ones = spark.createDataFrame([("a", 1), ("b", 1)], "text string, quality int")
    assert quality.score(docs, quality.fit(ones)).first().score > 0.5


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 5))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=40) > 0, 1.0, -1.0)
    rows = [(np.arange(5), r) for r in x]
    w = quality.dual_descent(rows, y, 5, np.full(40, 1.0), epochs=2000, tolerance=1e-10)
    loss = lambda v: 0.5 * v @ v + (np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
    slope = [(loss(w + 1e-6 * e) - loss(w - 1e-6 * e)) / 2e-6 for e in np.eye(5)]
    assert np.abs(slope).max() < 1e-4


@pytest.mark.parametrize("name, sf, least", [("op3_quality_nbsvm", "sf0.01", 0.97), ("op10_language_centroids", "sf0.01", 0.97)])
def test_held_out_accuracy(spark, name, sf, least):
    base = f"/root/testdata/{sf}"
    rows = queries.QUERIES[name](spark, base).where("held_out").toPandas()
    if name.startswith("op3"):
        truth = spark.read.parquet(f"{base}/labels.parquet").select("doc_id", F.col("quality").alias("truth")).toPandas()
        both = rows.merge(truth, on="doc_id")
        right = both.predicted == both.truth
    else:
        truth = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", F.col("lang").alias("truth")).toPandas()
        both = rows.merge(truth, on="doc_id")
        right = both.lang_pred == both.truth
    assert len(both) > 50 and right.mean() >= least


def test_toxicity_held_out(spark):
    base = "/root/testdata/sf0.1"
    rows = queries.op9_toxicity_gbt(spark, base).toPandas()
    assert len(rows) == 10_000 and rows.score.between(0, 1).all()
    both = rows[rows.held_out].merge(spark.read.parquet(f"{base}/labels.parquet").toPandas(), on="doc_id")
    assert both[both.toxic == 1].predicted.mean() >= 0.85
    assert both[both.toxic == 0].predicted.mean() <= 0.02


def test_toxicity_features_and_edges(spark):
    lexicon = {b"idiot": 0.9, b"clown": 0.0}
    named = dict(zip(toxicity.FEATURES, toxicity.features(b"You absolute IDIOT!!! clown 1d10t", lexicon)))
    assert named["any_fixed"] == 1 and named["any_learned"] == 1 and named["near_second_person"] == 0.4
    assert named["disguised_rate"] == 0.2 and named["unmasked_rate"] == 0.2 and named["capital_words"] == 0.2
    assert len(toxicity.features(b"", lexicon)) == len(toxicity.FEATURES)
    constant = toxicity.fit(spark.createDataFrame([("a", 0), ("b", 0), ("c", None)], "text string, toxic int"))
    assert {r.tox for r in toxicity.score(edge_docs(spark), constant, name="tox").collect()} == {0.0}
    none = toxicity.fit(spark.createDataFrame([], "text string, toxic int"))
    assert none.constant == 0.0
    rows = [(f"you are an idiot {i}", 1) for i in range(40)] + [(f"a calm day number {i}", 0) for i in range(80)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    got = toxicity.score(edge_docs(spark), model, name="tox").collect()
    assert len(got) == 7 and all(0 <= r.tox <= 1 for r in got)
    test = spark.createDataFrame([("what an idiot",), ("a calm night",)], "text string")
    scores = [r.score for r in toxicity.score(test, model).collect()]
    assert scores[0] > 0.5 > scores[1]


def test_isotonic_curve_column(spark):
    steps = [(-1.0, 0.1), (0.0, 0.1), (1.0, 0.9)]
    df = spark.createDataFrame([(m,) for m in (-5.0, -1.0, -0.5, 0.0, 0.5, 1.0, 9.0)], "m double")
    got = [r[0] for r in df.select(toxicity.calibrated(F.col("m"), steps)).collect()]
    assert got == pytest.approx([0.1, 0.1, 0.1, 0.1, 0.5, 0.9, 0.9])
    assert df.select(toxicity.calibrated(F.col("m"), [(0.0, 0.3)])).distinct().collect()[0][0] == 0.3


def test_language_edges(spark):
    rows = [(f"the cat and the dog number {i} of the house", "en") for i in range(12)]
    rows += [(f"der hund und die katze nummer {i} das haus", "de") for i in range(12)]
    rows += [("12 34", "xx"), (None, "fr"), ("und der hund", None)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted(set(model.names)) == ["de", "en"]
    docs = edge_docs(spark).unionByName(
        spark.createDataFrame([(9, "die katze und der hund", 0.0, "y")], "doc_id long, text string, score double, words string")
    )
    got = [(r.doc_id, r.language.lang_pred, r.language.score) for r in language_id.predict(docs, model).collect()]
    assert got[0][1:] == ("und", 0.0) and got[1][1:] == ("und", 0.0) and got[4][1:] == ("und", 0.0)
    assert got[7][1] == "de" and all(0 <= s <= 1 for _, _, s in got)
    none = language_id.fit(spark.createDataFrame([], "text string, lang string"))
    assert {r.language.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}


def test_texts_of_an_unlearned_language_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.where(F.length("text") >= 200)
    for unknown in ("fr", "de"):
        learned = docs.where((F.col("lang") != unknown) & ~queries.held_out("doc_id", 3, 1))
        model = language_id.fit(learned)
        tried = language_id.predict(docs.where(queries.held_out("doc_id", 3, 1) | (F.col("lang") == unknown)), model).collect()
        rejected = {own: [r.language.rejected for r in tried if (r.lang == unknown) == own] for own in (True, False)}
        assert np.mean(rejected[True]) > 0.9 and np.mean(rejected[False]) < 0.06, (unknown, {k: np.mean(v) for k, v in rejected.items()})
