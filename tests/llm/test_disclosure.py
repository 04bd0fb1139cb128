"""Disclosing terms against a plain version, and texts with very many matches."""

import collections
import math
import random
import time

import regex
from pyspark.sql import functions as F

from cohortlens.llm import pii
from tests.llm.test_texts import plain_spans


def plain_blanked(text):
    chars = list(text)
    for a, _, b, _ in plain_spans(text):
        chars[a:b] = " " * (b - a)
    return "".join(chars)


def mentions(text):
    return [(m.start(), m.end(), m.group().lower()) for m in regex.finditer(r"(?<!\p{L})\p{L}{3,}(?!\p{L})", plain_blanked(text))]


def entities(text):
    value = lambda k, v: v.lower() if k in ("email", "ip") else regex.sub("[^0-9]", "", v)
    return {(k, value(k, text[a:b])) for a, _, b, k in plain_spans(text)}


def plain_disclosing(texts):
    """Spans (start, end, kind) of every text, by counting all pairs."""
    copies = collections.Counter(texts)
    n_term, k_term, n_of, k_of, n_both, k_both = (collections.Counter() for _ in range(6))
    for text, n in copies.items():
        words, own = {w for *_, w in mentions(text)}, entities(text)
        for counter, keys, by in ((n_term, words, n), (k_term, words, 1), (n_of, own, n), (k_of, own, 1)):
            counter.update(dict.fromkeys(keys, by))
        for e in own:
            n_both.update({(e, w): n for w in words})
            k_both.update({(e, w): 1 for w in words})
    total, kinds = len(texts), len(copies)
    pick = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    general, removed = collections.defaultdict(set), collections.defaultdict(set)
    for (e, w), both in n_both.items():
        k, t, o = k_both[e, w], k_term[w], k_of[e]
        ratio = (o - k) * (t - k) / ((k + 1) * (kinds - o - t + k + 1))
        chance = pick(t, k) + pick(kinds - t, o - k) - pick(kinds, o) - math.log(1 - ratio) if ratio < 1 else 0
        if chance + math.log(len(n_term)) > math.log(pii.CHANCE) or n_of[e] == total:
            continue
        disclosure = math.log2(total * both / (n_term[w] * n_of[e])) / math.log2(total / n_of[e])
        if disclosure >= pii.GENERALISE:
            (removed if disclosure >= pii.REMOVE else general)[e].add(w)
    out = {}
    for text in copies:
        gone = set().union(*(removed[e] for e in entities(text)))
        some = set().union(*(general[e] for e in entities(text)))
        base = [(a, b, k) for a, _, b, k in plain_spans(text)]
        out[text] = sorted(base + [(a, b, "remove" if w in gone else "generalise") for a, b, w in mentions(text) if w in gone | some])
    return out


def plain_masked(text, spans):
    at, out = 0, ""
    for a, b, k in spans:
        if a >= at:
            out += text[at:a] + pii.LABELS[k]
        at = max(at, b)
    return out + text[at:]


def test_disclosing_terms_equal_all_pairs(spark):
    rng = random.Random(11)
    common = [f"{a}{b}" for a in ("lor", "mip", "sun", "dol", "tek") for b in ("ane", "ivo", "uda", "eki")]
    rows = []
    for who in range(12):
        mail, own = f"p{who}@mail.org", [f"Name{'abcdefghijkl'[who]}", f"street{'abcdefghijkl'[who]}", f"firm{'abc'[who % 3]}"]
        for _ in range(rng.randrange(1, 9)):
            words = [rng.choice(common) for _ in range(12)] + [w for w in own for _ in range(rng.randrange(3))]
            words += [mail] + rng.choice([[], ["10.0.0.7"], ["+43 1 5861234567"]])
            rng.shuffle(words)
            rows += [" ".join(words)] * rng.choice([1, 1, 2])
    rows += [" ".join(rng.choice(common) for _ in range(15)) for _ in range(150)] + [""]
    want = plain_disclosing(rows)
    assert {k for spans in want.values() for *_, k in spans} >= {"email", "remove", "generalise"}
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in pii.find(docs).collect():
        assert sorted((s.start, s.end, s.kind) for s in r.personal.spans) == want[rows[r.doc_id]], rows[r.doc_id]
    for r in pii.sanitise(docs).collect():
        assert r.text == plain_masked(rows[r.doc_id], want[rows[r.doc_id]])


def test_blocks_and_overlaps_equal_plain_versions(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 3)
    rng = random.Random(12)
    parts = ["a", "b1@x.y", ".", "+", " ", "255", "1.2.3.4", "é", "😀", "4111111111111111", "+1 (234) 567-8901", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").withColumn("b", pii.base_spans(F.col("text")))
    got = df.select("i", "b", pii.blanked(F.col("text"), F.col("b")).alias("blank"), pii.masked(F.col("text"), F.col("b")).alias("masked"))
    for r in got.collect():
        spans = plain_spans(texts[r.i])
        assert [(s.start, s.rank, s.end, s.kind) for s in r.b] == spans
        assert r.blank == plain_blanked(texts[r.i])
        assert r.masked == plain_masked(texts[r.i], [(a, b, k) for a, _, b, k in spans])


def test_a_text_of_very_many_addresses(spark):
    n = 20_000
    text = " ".join(f"u{i}@h{i % 977}.org" for i in range(n))
    docs = spark.createDataFrame([(1, text), (2, "plain words only")], "doc_id long, text string")
    begun = time.time()
    rows = {r.doc_id: r for r in pii.find(docs).select("doc_id", F.size("personal.base").alias("n"), F.get("personal.base", F.lit(n - 1))["end"].alias("end")).collect()}
    assert rows[1].n == n and rows[1].end == len(text) and rows[2].n == 0
    assert {r.doc_id: r.text for r in pii.sanitise(docs).collect()}[1] == " ".join(["[EMAIL]"] * n)
    assert time.time() - begun < 120
