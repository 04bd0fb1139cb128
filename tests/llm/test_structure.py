"""Conversation repair, periodic runs and robust quality rules against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import conversations, periodic_runs, queries, robust_rules
from cohortlens.llm.conversations import ASSISTANT, EMPTY, SYSTEM, USER, Parts, finish, joined
from tests.check_oracles import compare, connect

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ANY = (EMPTY, SYSTEM, USER, ASSISTANT)


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_periodic_runs"])
def test_same_rows_as_sql(spark, name):
    assert compare(spark, connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF) is None


# Conversations


def all_repairs(rows, inserts=3):
    """(cost, letters) by trying every sequence of edits; rows are (initial, must go, truncated)."""
    best = [(3 * len(rows), "D" * len(rows))]

    def go(i, roles, cost, audit, added):
        if cost > best[0][0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best[0] = min(best[0], (cost, audit))
        if added < inserts:
            for r in "ua":
                go(i, roles + r, cost + 2, audit + "I", added + 1)
        if i < len(rows):
            initial, gone, late = rows[i]
            go(i + 1, roles, cost + 3, audit + "D", 0)
            if not gone:
                go(i + 1, roles + (initial or "?"), cost + late, audit + "K", 0)
                for r in "ua":
                    go(i + 1, roles + r, cost + 2 + late, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best[0]


def test_least_integers_equal_all_repairs():
    rng = random.Random(1)
    for _ in range(300):
        rows = [(rng.choice(["s", "u", "a", "x", ""]), rng.random() < 0.25, rng.random() < 0.3) for _ in range(rng.randint(0, 5))]
        done, part = [], Parts((EMPTY,))
        for initial, gone, late in rows:
            if rng.random() < 0.3:
                done.append(part.total())
                part = Parts(ANY)
            if gone:
                part.room().delete(1)
            else:
                part.room().add(initial, late)
        whole = part.total() if not done else done[0]
        for more in [*done[1:], part.total()] if done else []:
            whole = joined(whole, more)
        assert finish(*whole) == all_repairs(rows), rows


def test_long_conversation_in_blocks_equals_one_block(monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice("suax"), rng.random() < 0.2) for _ in range(1500)]

    def solved():
        parts = Parts((EMPTY,))
        for initial, late in rows:
            parts.room().add(initial, late)
            if late:
                parts.room().delete(2)
        return finish(*parts.total())

    small = solved()
    monkeypatch.setattr(conversations, "BLOCK_ROWS", 10**9)
    assert solved() == small


def plain_repair(rows):
    """Facts of one conversation, from (turn, role, text) with repetitions written out."""
    rows = sorted(
        ((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()),
    )
    seen, faults = set(), []
    for _, r, x in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", x)[-1:]
        faults.append("blank" if not last else "duplicate" if (r, x) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((r, x))
    cost, audit = all_repairs([(r[:1], f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(rows, faults)])
    turns = [t for t, _, _ in rows if t is not None]
    lines, at, state = [], iter(rows), ""
    for letter in audit:
        role, text = (None, "") if letter == "I" else next(at)[1:]
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if state == "u" else "user"
        state = role[:1]
        lines.append(f"{role}:{text}")
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def test_conversations_with_nulls_ties_and_repetitions(spark):
    rng = random.Random(3)
    texts = [None, "", " \t", "Yes.", "No!", "open", "Yes. ", "é?", "x" * 5000]
    rows = [
        (rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 0, 1, 2, 5]), rng.choice([None, "", "user", "assistant", "system", "tool"]),
         rng.choice(texts))
        for _ in range(30)
    ]
    kept = [r for r in rows if len([x for x in rows if x[0] == r[0]]) <= 9 or rng.random() < 0.7]
    by_conv = collections.defaultdict(list)
    for c, *rest in kept:
        by_conv[c].append(rest)
    gone = [(9, 1, "user", "Gone.", "k", 0), (9, 2, "assistant", "Gone.", "k", 0)]
    data = [(*r, "k", 1) for r in kept] + gone
    df = spark.createDataFrame(data, "conv_id long, turn int, role string, text string, conv string, n int").repartition(4)
    got = {r.conv_id: r.asDict() for r in conversations.repair(df, copies=F.col("n")).collect()}
    assert set(got) == set(by_conv) | {9}
    empty = hashlib.sha256(b"").hexdigest()
    assert got.pop(9) == {"conv_id": 9, **plain_repair([]), "audit": "", "repaired_sha256": empty}
    for c, facts in got.items():
        assert facts == {"conv_id": c, **plain_repair(by_conv[c])}, c
    rows_out = conversations.repaired(df, copies=F.col("n")).collect()
    again = collections.defaultdict(dict)
    for r in rows_out:
        again[r.conv_id][r.place] = f"{r.role}:{r.text}"
    for c, facts in got.items():
        body = "\n".join(again[c][i] for i in range(len(again[c])))
        assert hashlib.sha256(body.encode()).hexdigest() == facts["repaired_sha256"]
    assert conversations.repair(df.limit(0)).collect() == []


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["user", "assistant", "tool"]), rng.choice(["Yes.", f"No {i}", f"So {i}!"])) for i in range(3000)]
    df = spark.createDataFrame([(7, *r) for r in rows], "conv_id long, turn long, role string, text string").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = conversations.repair(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    parts = Parts((EMPTY,))
    seen = set()
    for _, r, t in rows:
        if (r, t) in seen:
            parts.room().delete(1)
        else:
            parts.room().add(r[0], not t.endswith((".", "!")))
        seen.add((r, t))
    cost, audit = finish(*parts.total())
    assert [(r.cost, r.audit, r.gaps) for r in many] == [(cost, audit, 0)]
    assert many[0].illegal == sum(a[1][0] + b[1][0] not in ("ua", "au") for a, b in zip(rows, rows[1:]))


# Periodic runs


def all_runs(words, least=12):
    """{(start, end): smallest period} by comparing the words at every distance."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(2 * q, least):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, e, q) for (a, e), q in out.items())


def looping(rng):
    words = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 3)):
        if words:
            a, p = rng.randrange(len(words)), rng.randint(1, 9)
            words[a:a] = words[a : a + p] * rng.randint(2, 6)
    return words


def test_caught_squares_equal_all_distances():
    rng = random.Random(5)
    lists = [looping(rng) for _ in range(600)]
    for least in (1, 12):
        found = periodic_runs.runs_of([[b"%d" % w for w in words] for words in lists], least)
        for words, runs in zip(lists, found):
            assert [tuple(r) for r in runs.tolist()] == all_runs(words, least), words
    for words in lists[:200]:  # in pieces, word by word
        catcher, i = periodic_runs.SquareCatcher(), 0
        while i < len(words):
            n = rng.choice([1, 1, 1, 3, 7])
            catcher.append(np.array(words[i : i + n]))
            i += n
        assert [tuple(r) for r in catcher.runs(1).tolist()] == all_runs(words, 1), words


def test_equal_sums_do_not_count(monkeypatch):
    """With sums that say every window is equal, the words still decide."""
    monkeypatch.setattr(periodic_runs.SquareCatcher, "_hash", lambda self, at, length: np.zeros(len(at), np.uint64))
    words = [b"%d" % (i % 5) for i in range(30)] + [b"x%d" % i for i in range(40)]
    for a, e, q in periodic_runs.runs_of([words])[0].tolist():
        assert words[a : e - q] == words[a + q : e]


def test_runs_of_texts(spark):
    loop = "one two three " * 10
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, loop), (4, loop), (5, "w " * 12), (6, "w " * 11), (None, "a b " * 9 + "c"),
        (7, "É é " * 8), (8, "x" * 300_000 + " " + "long tail " * 30_000), (9, "A a " * 6),
    ]
    df = spark.createDataFrame([(i, t, "kept", i) for i, t in rows], "doc_id long, text string, runs string, n_words long")
    out = periodic_runs.find(df)
    assert out.columns == ["doc_id", "text", "runs", "n_words", "periodic"]
    got = out.collect()
    assert len(got) == len(rows) and {r.runs for r in got} == {"kept"}
    for r in got:
        words = WORD.findall(r.text or "")
        listed = [(s.start, s.length, s.period) for s in r.periodic.runs]
        assert r.periodic.n_words == len(words)
        if len(words) < 1000:
            want = all_runs(words)
            assert listed == [(a, e - a, q) for a, e, q in want]
            gone = {i for a, e, q in want for i in range(a + q, e)}
            assert r.periodic.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
        else:
            assert listed == [(1, 60_000, 2)]
    assert periodic_runs.find(df.limit(0)).collect() == []


# Quality rules


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = collections.defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    hit = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    symbols = "#*$%&|<>"
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in symbols for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "n_lines": len(lines),
        "n_capitals": sum("A" <= c <= "Z" for c in text),
        "n_signs": sum(33 <= ord(c) < 127 and not c.isalnum() and c not in symbols for c in text),
    }


def test_counts_equal_plain(spark):
    texts = [
        None, "", " ", "one", "a b", "a b c a b c", "x\n x\nx\n\n \nx", "#*$%&|<> É　é ! ?", "a a a a", "\x0b\x0c\r\n",
        "é" * 9, "same line\nsame line\nSame line", "word " * 20_000, "1 2 3 4 1 2 3 5 2 3 4",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("mine"))
    out = robust_rules.measure(df)
    assert out.columns == ["doc_id", "text", "n_words", "statistics"]
    for r in out.collect():
        assert r.statistics.asDict() == plain_counts(r.text), r.text
    whole = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for r in robust_rules.measure(whole).collect():
        assert r.statistics.asDict() == plain_counts(r.text), r.doc_id


def plain_concentration(x):
    """The same least-scatter subset of one group by numpy: all rows in the nearest classes that hold the share."""
    best = None
    for start in (0, 1):
        if start == 0:
            centre = x.mean(axis=0)
            spread = (x - centre).T @ (x - centre) / len(x)
        else:
            grid = np.floor(x * robust_rules.GRID) / robust_rules.GRID
            middle = lambda v: np.sort(v, axis=0)[int(np.ceil(len(v) / 2)) - 1]
            centre = middle(grid)
            spread = np.diag(np.square(1.4826 * middle(np.abs(grid - centre))))
        least = np.diag(np.square(list(robust_rules.SCALES.values())))
        state = None
        for _ in range(robust_rules.STEPS):
            inverse = np.linalg.inv(spread + least)
            d = np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)
            low, high = 2.0**robust_rules.LOW, float(robust_rules.HIGH)
            at = np.floor(np.minimum(np.log2(np.maximum(d, low)), high) * robust_rules.CLASSES)
            order = np.sort(at)
            near = at <= order[int(np.ceil(robust_rules.SUBSET * len(x))) - 1]
            centre = x[near].mean(axis=0)
            spread = robust_rules.CONSISTENCY * ((x[near] - centre).T @ (x[near] - centre) / near.sum())
            size = np.linalg.slogdet(spread + least)[1]
            state = (size, start, centre, np.linalg.inv(spread + least))
        best = state if best is None or state[:2] < best[:2] else best
    return best[2], best[3]


def measured_rows(spark, groups):
    """Texts of varied words by (lang, source); a few are junk."""
    rng, rows = random.Random(6), []
    for (lang, source), n in groups.items():
        for i in range(n):
            words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(50, 90))]
            text = " ".join(words).capitalize() + "."
            if i % 12 == 5:
                text = text.upper().replace(" ", "!! ") if i % 24 == 5 else text.replace(" ", "### ")
            rows.append((len(rows), text, lang, source))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_fit_equals_plain_concentration(spark):
    least = robust_rules.FEWEST
    docs = measured_rows(spark, {("en", "web"): least + 40, ("en", "tiny"): 9, (None, None): least, ("fr", "a"): 5})
    measured = robust_rules.measure(docs)
    model = {(r["_level"], r["_lang"], r["_source"]): r for r in robust_rules.fit(measured).collect()}
    # Large groups; the language with a small group; everything, for a language that is small itself.
    assert set(model) == {(1, "en", "web"), (1, None, None), (2, "en", None), (3, None, None)}
    x = measured.select("doc_id", "lang", "source", *[c.alias(f"x{i}") for i, c in enumerate(robust_rules.coordinates())]).toPandas()
    vectors = x[[f"x{i}" for i in range(robust_rules.DIMS)]].to_numpy()
    wanted = {
        (1, "en", "web"): (x.lang == "en") & (x.source == "web"), (1, None, None): x.lang.isna(),
        (2, "en", None): x.lang == "en", (3, None, None): x.lang.isna() | x.lang.notna(),
    }
    distance = np.full(len(x), np.nan)
    for key in sorted(wanted, key=lambda k: -k[0]):
        centre, inverse = plain_concentration(vectors[wanted[key].to_numpy()])
        assert model[key]["rows"] == wanted[key].sum()
        np.testing.assert_allclose(model[key]["centre"], centre, rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(model[key]["precision"], [inverse[i, j] for i, j in robust_rules.PAIRS], rtol=1e-7, atol=1e-7)
        own = wanted[key].to_numpy()
        distance[own] = np.einsum("ij,jk,ik->i", vectors - centre, inverse, vectors - centre)[own]
    got = robust_rules.judge(measured, robust_rules.fit(measured)).toPandas().set_index("doc_id")
    for i, d in zip(x.doc_id, distance):
        rules = got.loc[i, "rules"]
        assert rules["distance"] == pytest.approx(d, rel=1e-6, abs=1e-9)
        assert rules["kept"] == (not rules["base_failed"] and d <= robust_rules.CUTOFF)
    junk = got.text.str.contains("!!|###").to_numpy()
    kept = np.array([r["kept"] for r in got.rules])
    assert not kept[junk].any() and kept[~junk].mean() > 0.97


def test_rules_of_small_and_odd_tables(spark):
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "few words", "en", None), (4, "again and " * 60, "en", "a"), (5, "w " * 50, "en", "a")]
    rows += [(6, " ".join(f"word{i}" for i in range(60)), None, "a")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({"centre": F.lit(1), "_level": F.lit(2), "_fit": F.lit(3)})
    measured = robust_rules.measure(docs)
    model = robust_rules.fit(measured)
    assert model.collect() == []
    out = robust_rules.judge(measured, model)
    assert out.columns == [*docs.columns, "statistics", "rules"]
    got = {r.doc_id: r.rules for r in out.collect()}
    assert [got[i].base_failed for i in range(1, 7)] == [True, True, True, True, True, False]
    assert [got[i].kept for i in range(1, 7)] == [False, False, False, False, False, True]
    assert all(r.distance is None and r.level is None for r in got.values())
    nothing = measured.limit(0)
    assert robust_rules.judge(nothing, robust_rules.fit(nothing)).collect() == []


def test_robust_rules_of_documents(spark):
    got = queries.op13_robust_quality_rules(spark, SF).toPandas().set_index("doc_id")
    texts = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id").text
    assert len(got) == len(texts)
    for i, t in texts.items():
        want, r = plain_counts(t), got.loc[i]
        assert all(r[k] == want[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").join(got, how="inner")
    judged = labels[~labels.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.98
    assert labels[labels.quality == 0].kept.mean() < 0.2


def test_loops_are_planted_as_stated(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    changed = 0
    for r, t in zip(queries.looped_documents(docs).orderBy("doc_id").collect(), docs.orderBy("doc_id").collect()):
        h, words = zlib.crc32(str(t.doc_id).encode()), WORD.findall(t.text or "")
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        assert WORD.findall(r.text or "") == words
    assert changed > 5
