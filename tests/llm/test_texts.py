"""Near duplicates, packing, decontamination, personal data and web pages against brute force."""

import bisect
import collections
import hashlib
import math
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import components, decontaminate, fm_index, html_tree, near_dup, packing, pii, queries, wrappers

SF = "/root/testdata/sf0.001"


def plain_classes(texts):
    """{id: smallest id} by comparing all pairs that share a shingle."""
    sets = {i: near_dup.text_shingles(t.encode()) for i, t in texts.items() if t is not None}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if texts[a] == texts[b] or near_dup.similarity(sets[a], sets[b]) >= 0.8:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def family(seed, n, words=80, most=6):
    """Copies of one text with some words changed; pairs lie on both sides of the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n - 1):
        copy = list(base)
        for _ in range(rng.randrange(most)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_near_duplicates_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "LARGE_BUCKET", 6)
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    texts = family(1, 40) + family(2, 25, 40, 4) + [f"lonely text number {i} {i * 7} {i * 11} of its own" for i in range(20)]
    texts += [None, None, "", "", "...", "...", "!!", "one two", "One, two!", "one two three four five"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, root long")
    out = near_dup.near_duplicates(docs)
    assert out.columns == ["doc_id", "text", "root", "class_id"]
    got = {r.doc_id: r.class_id for r in out.collect()}
    assert got == plain_classes(dict(rows))


def test_finer_signatures_hardly_miss_a_similar_pair():
    below = [k for k in range(near_dup.FINE) if k / near_dup.FINE < near_dup.FINE_AGREE]
    missed = sum(math.comb(near_dup.FINE, k) * 0.8**k * 0.2 ** (near_dup.FINE - k) for k in below)
    assert missed < 3e-6  # as rare as a pair at 0.8 that no band holds


def test_keep_one_row_of_each_class(spark):
    base = family(5, 6, 60, 2)
    rows = [(7, base[0], "a"), (3, base[1], "b"), (3, base[1], "b"), (None, base[2], "c"), (9, None, "d"), (9, None, "d"),
            (4, "alone here with five words", "e"), (None, "no id at all for this one", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key string")
    got = near_dup.keep_one(docs)
    assert got.columns == docs.columns
    kept = collections.Counter(r.doc_id for r in got.collect())
    assert kept == {3: 1, 9: 2, 4: 1, None: 1}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.keep_one(empty).count() == 0 and near_dup.near_duplicates(empty).count() == 0


def test_darts_of_many_texts_are_thrown_in_bounded_parts():
    rng = np.random.default_rng(5)
    sets = [(rng.integers(1, 1 << 62, n).astype(np.uint64), np.ones(n)) for n in [3, 60, 200, 40] * 100 + [0, 1]]
    tracemalloc.start()
    found = near_dup.signatures(sets, near_dup.FINE)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 << 20
    some = [0, 1, 2, 250, 400, 401]
    assert (found[some] == np.concatenate([near_dup.signatures([sets[i]], near_dup.FINE) for i in some])).all()


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(40):
        x = rng.integers(1, 2**63, 60).astype(np.uint64)
        a, b = rng.integers(0, 9, 60) / 2, rng.integers(0, 9, 60) / 2
        s = near_dup.signatures([(x, a), (x, b)], 128)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07
    assert not near_dup.signatures([(x[:0], a[:0])]).any()


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    # A node that is only its own neighbour may be left out: it is alone anyway.
    assert {k: got.get(k, k) for k in parent} == {k: find(k) for k in parent}


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    for _ in range(30):
        s = rng.integers(0, 5, rng.integers(1, 300))
        s[-1] = 0
        index = fm_index.FmIndex(s, 4)
        phrases = [tuple(rng.integers(1, 5, rng.integers(1, 6)).tolist()) for _ in range(20)]
        padded = np.zeros((20, 6), np.int64)
        for i, p in enumerate(phrases):
            padded[i, : len(p)] = p
        low, high = index.search(padded, np.array([len(p) for p in phrases]))
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(len(s) - len(p) + 1) if tuple(s[i : i + len(p)]) == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_report(text, items):
    w = plain_words(text)
    hit, found = set(), set()
    for name, item in items:
        x = plain_words(item)
        n = min(10, len(x))
        for i in range(len(x) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == x[i : i + n]:
                    hit.update(range(j, j + n))
                    found |= {name} - {None}
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination_equals_plain_search(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    rng = random.Random(4)
    items = [(str(i), " ".join(rng.choice("abcd") for _ in range(n))) for i, n in enumerate([12, 15, 10, 3, 30])]
    items += [("empty", ""), (None, "q r s t"), ("same", items[0][1]), ("none", None), ("é", "été Été x")]
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(30)]
    texts += [None, "", "..", "Q. r, S-t!", f"start {items[1][1].upper()} end", "été été X", "a " * 3000]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for r in decontaminate.report(docs, bench).collect():
        assert (r.leaks.n_words, r.leaks.n_hit, r.leaks["items"]) == plain_report(r.text, items), r.text
        assert sum(s.end - s.start for s in r.leaks.word_spans) == r.leaks.n_hit and r.n_hit == 5
    for r in decontaminate.clean(docs, bench).collect():
        assert plain_report(r.text, items)[1] == 0
        before = texts[r.doc_id]
        assert r.text == before or plain_report(before, items)[1] > 0
    none = bench.where("false")
    assert all(r.leaks.n_hit == 0 for r in decontaminate.report(docs, none).collect())
    assert decontaminate.report(docs.where("false"), bench).count() == 0


def test_cuts_do_not_depend_on_blocks(spark, monkeypatch):
    a, b = [" ".join(f"{c}{i}" for i in range(10)) for c in "ab"]
    c = " ".join([*a.split()[5:], *(f"c{i}" for i in range(5))])
    texts = [f"x {a[:14]} {b} {a[15:]} y", f"x {a} c0 c1 c2 c3 c4 y", f"x {b[:14]} {a} {b[15:]} y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([("a", a), ("b", b), ("c", c)], "item_id string, text string").coalesce(1)
    for block in (1 << 20, 20):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
        assert [r.text for r in decontaminate.clean(docs, bench).orderBy("doc_id").collect()] == ["x\ny"] * 3


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
            fine = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(d) <= 19 and sum(v - 9 if v > 9 else v for v in twice) % 10 == 0,
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if fine:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(5)
    parts = ["a", "b1", "@", ".", "+", "-", " ", "(", ")", "255", "4", "12", "é", "_", "%", "\n", "😀", "4111111111111111",
             "1.2.3.4", "x@y.z", "\u0001", "999.1.1.1", "0001.02.3.4"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += [None, "", "1" * 4000, "a" * 4000 + "@b.c", " ".join(["12"] * 9000), "a@b.c_d@e.f.g@h.i"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = df.select("i", pii.base_spans(F.coalesce("text", F.lit(""))).alias("b")).collect()
    for r in got:
        assert [(s.start, s.rank, s.end, s.kind) for s in r.b] == plain_spans(texts[r.i]), texts[r.i]


def test_terms_that_disclose_are_found_and_masked(spark):
    filler = "and then some other words of the long day went by without any sign of him"
    rows = [f"Case {i} {filler}: write to Zorbatron at anna@mail.org about the {w} plan" for i, w in enumerate(["red", "blue", "green", "grey"])]
    rows += [f"{filler} and the plan number {i} about the case, write to {i}" for i in range(200)]
    rows += [None, "", rows[0], "anna@mail.org"]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(rows)], "doc_id long, text string, key string")
    found = {r.doc_id: [(s.kind, rows[r.doc_id][s.start : s.end]) for s in r.personal.spans] for r in pii.find(docs).collect()}
    assert len(found) == len(rows)
    for i in range(4):
        assert ("email", "anna@mail.org") in found[i] and ("remove", "Zorbatron") in found[i]
        assert not any(t in ("the", "write", "about") for _, t in found[i])
    assert found[204] == [] and found[205] == [] and found[207] == [("email", "anna@mail.org")]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "Zorbatron" not in clean[0] and "[EMAIL]" in clean[0] and clean[10] == rows[10] and clean[204] is None
    assert pii.find(docs.where("false")).count() == 0 and pii.sanitise(docs.where("false")).count() == 0


def test_terms_far_from_their_entity_are_found_everywhere(spark):
    rng = random.Random(8)
    common = [f"{a}{b}" for a in ("lor", "mip", "sun", "dol") for b in ("ane", "ivo", "uda", "eki", "oro")]
    words = lambda n: " ".join(rng.choice(common) for _ in range(n))
    rows = [f"Quillfeather, {words(60)} Quillfeather {words(60)} anna@mail.org" for _ in range(3)]
    rows += [f"Once{'abc'[i]} {words(90)} only{'abc'[i]}@mail.org" for i in range(3)]
    rows += [words(100) for _ in range(300)] + ["solitary@mail.org onceonly"] * 5 + [rows[0]]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: [(s.kind, rows[r.doc_id][s.start : s.end]) for s in r.personal.spans] for r in pii.find(docs).collect()}
    for i in (0, 1, 2, len(rows) - 1):
        assert found[i] == [("remove", "Quillfeather")] * 2 + [("email", "anna@mail.org")]
    # A single text, however often copied, is no evidence.
    assert all([k for k, _ in found[i]] == ["email"] for i in [3, 4, 5, *range(306, 311)])
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "Quillfeather" not in clean[0] and clean[1].endswith("[EMAIL]") and "onceonly" in clean[306]


def plain_best_fit(lengths, size):
    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, n)
        room = rooms.pop(i) if i < len(rooms) else size
        bins += room == size
        bisect.insort(rooms, room - n)
    return bins


def test_plan_equals_placing_one_by_one():
    rng = random.Random(1)
    for _ in range(150):
        size = rng.choice([7, 20, 50, 100])
        lengths = [rng.randint(1, size) for _ in range(rng.randrange(150))]
        plan = packing.best_fit(collections.Counter(lengths), size)
        assert plan.bins == plain_best_fit(lengths, size)


def check_packing(rows, docs, size, encode):
    used = collections.defaultdict(list)
    by_doc = collections.defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    for i, text in docs.items():
        ids = encode(text or "") + [packing.END_ID]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
        assert all(r.length == size for r in pieces[1:]) and sum(r.length for r in pieces) == len(ids)
        for r in pieces:
            import zlib

            data = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert zlib.crc32(data) == r.ids_crc32
    return len(used)


def test_packing_round_trip(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 7)
    path = queries.tokenizer_file()
    tokenizer = packing.word_ids(path).tokenizer
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab cé\n\t!1😀") for _ in range(rng.randrange(120))) for _ in range(60)]
    texts += [None, "", "x", "x", "word " * 500, "<|endoftext|> here", "a  b \n c　 d"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, bucket long")
    rows = packing.pack(docs, path, size=64).collect()
    n = check_packing(rows, dict(enumerate(texts)), 64, encode)
    assert n == plain_best_fit([r.length for r in rows], 64)
    assert packing.pack(docs.where("false"), path).count() == 0


def test_op4_query_round_trip(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokenizer = packing.word_ids(queries.tokenizer_file()).tokenizer
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    check_packing(queries.op4_best_fit_packing(spark, SF).collect(), docs, 2048, encode)


PAGE = """<!DOCTYPE html><html><head><title>T {n}</title><style>p{{}}</style><script>if (a < b) "</p>"</script></head><body>
<header class="top">Site header {n}</header><nav><ul><li><a href=x>menu {n}</a></li><li><a href=y>more</a></li></ul></nav>
<div class="cookie-notice">We use cookies {n}</div>{main}<aside>Read &amp; see {n}</aside>
<form><label>Mail</label><input name=a></form><!-- hidden {n} --><footer>&copy; {n}</footer></body></html>"""


def test_main_text_of_pages(spark):
    bodies = {
        1: "<article><h1>Title  one</h1><p>First <b>para</b>graph &lt;x&gt;<p>Second<br>line<ul><li>a<li>b</ul></article>",
        2: "<article><h1>Two</h1><p>Only&nbsp;one</p><p></p><div class='ad'>Buy!</div><section class=comments><p>Nice!</p></section></article>",
        3: "<div><div class=teaser><a href=z>Link list here</a></div><div><p>Long text of the page without an article element.</p><p>More of it.</p></div></div>",
        4: "<main><h2>H</h2><p>A</p><h2>H</h2><p>B</p><h2>H</h2><p>C</p></main>",
    }
    want = {
        1: "Title one\nFirst paragraph <x>\nSecond line\na\nb",
        2: "Two\nOnly one",
        3: "Long text of the page without an article element.\nMore of it.",
        4: "H\nA\nH\nB\nH\nC",
    }
    rows = [(i, f"https://h{i}.example.com/{i}", PAGE.format(n=i, main=b), "x") for i, b in bodies.items()]
    rows += [(5, "https://h1.example.com/5", PAGE.format(n=5, main="<article><p>Same host</p><table><tr><td>c1<td>c2</table></article>"), "x"),
             (6, None, None, "x"), (7, "nonsense", "", "x"), (8, "nonsense", "plain words only", "x"),
             (8, "nonsense", "plain words only", "x"), (9, "https://h9.example.com", "<nav>menu</nav>", "x"),
             (10, "https://h10.example.com", "<article><p>" + "long word " * 20_000 + "</article>", "x")]
    want |= {5: "Same host\nc1\nc2", 6: "", 7: "", 8: "plain words only", 9: "", 10: ("long word " * 20_000).strip()}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    out = wrappers.extract(pages)
    assert out.columns == ["page_id", "url", "html", "host", "main_text"]
    got = out.collect()
    assert len(got) == len(rows)
    assert {r.page_id: r.main_text for r in got} == want
    assert wrappers.extract(pages.where("false")).count() == 0


@pytest.mark.parametrize("url", ["https://mixed.example.com/x", "no host"])
def test_templates_of_one_host_do_not_disturb_each_other(spark, url):
    rows, want = [], {}
    for i in range(12):
        text = f"First words of page {i}, a long one.", f"Last words of page {i}, as long as that."
        inner = "".join(f"<p>{t}</p>" for t in text)
        bodies = [f"<article>{inner}</article>", f"<main>{inner}</main>", f"<div class=content>{inner}</div>",
                  f"<article class=card><a href=z>Teaser {i}</a></article><main>{inner}</main>"]
        # Most of the host's text is in articles.
        body = bodies[i % 4] if i % 4 else bodies[0].replace("</article>", f"<p>{'and so on ' * 50}{i}</p></article>")
        rows.append((i, url, PAGE.format(n=i, main=body)))
        want[i] = "\n".join(text if i % 4 else (*text, f"{'and so on ' * 50}{i}"))
    out = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.main_text for r in out.collect()} == want


def test_many_shapes_of_one_host(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "GROUP", 3)
    rng = random.Random(6)
    rows, want = [], {}
    for i in range(40):
        kinds = [rng.choice(["p", "h2", "ul", "blockquote"]) for _ in range(rng.randrange(1, 9))]
        texts = [f"{k} text {i} {j}" for j, k in enumerate(kinds)]
        body = "".join(f"<{k}><li>{t}</li></{k}>" if k == "ul" else f"<{k}>{t}</{k}>" for k, t in zip(kinds, texts))
        rows.append((i, "http://one.example.org/x", PAGE.format(n=i, main=f"<article>{body}</article>")))
        want[i] = "\n".join(texts)
    got = {r.page_id: r.main_text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_wrapper_expression():
    pages = ["<ul><li>a<li>b</ul><p>x</p>", "<ul><li>c</ul><h1>t</h1><p>x</p>"]
    a, b = (wrappers.tree(html_tree.parse(p)) for p in pages)
    assert wrappers.expression(wrappers.merge(a, b)).replace(wrappers._leaf("x", 0).text, "x") == (
        "<ul> <li> text </>+ </> <h1> '" + wrappers._leaf("t", 0).text + "' </>? <p> 'x' </>"
    )


def test_op5_query_on_given_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    import html as entities

    for r in queries.op5_html_wrappers(spark, SF).collect():
        body = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = [entities.unescape(re.sub("<[^>]+>", "", b)) for b in re.split("</?p>|</?h1>|<br>", body)]
        want = "\n".join(" ".join(b.split()) for b in blocks if b.split())
        assert r.text == want and r.n_chars == len(want)


def test_op7_query_against_plain_patterns(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op7_pii_disclosure(spark, SF).collect():
        want = plain_spans(docs[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        counts = collections.Counter(k for *_, k in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in BASE)
        assert set(text.split(",")) <= set(r.spans.split(","))
