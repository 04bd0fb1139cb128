"""Main text of random templates, deep pages and long pages."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import html_tree, wrappers

CLASSES = ["", "", "", ' class="intro"', ' class="related-work"', ' id="discussion"', ' class="menu-du-jour"', ' class="c1 x"']
# What a page has around and inside its article that is no main text.
JUNK = [
    '<nav><a href="/">home page of the site</a></nav>', '<div class="share"><a href="/s">share this text</a></div>',
    '<aside>an aside of the page with some words</aside>', '<div class="comments"><p>a comment that a reader has written here</p></div>',
    '<form><label>your name</label><input></form>',
]


def blocks(rng, depth, kept):
    """HTML of a few blocks, nested to `depth`; their texts go to `kept`."""
    out = []
    for _ in range(rng.randint(1, 5)):
        if rng.random() < 0.12:
            out.append(rng.choice(JUNK))
        if depth and rng.random() < 0.45:
            tag = rng.choice(["section", "div", "blockquote", "ul"])
            inner = blocks(rng, depth - 1, kept)
            out.append(f"<{tag}{rng.choice(CLASSES)}>{inner}</{tag}>")
        else:
            tag = rng.choice(["p", "p", "p", "h2", "h3", "pre"])
            text = " ".join(rng.choice(["word", "text", "river", "stone", "cloud"]) + str(rng.randrange(10**6)) for _ in range(rng.randint(8, 25)))
            kept.append(text)
            out.append(f"<{tag}{rng.choice(CLASSES)}>{text}</{tag}>")
    return "".join(out)


@pytest.mark.parametrize("seed, root", [(1, "article"), (2, "article"), (3, "main"), (4, "article")])
def test_every_block_of_random_articles(spark, seed, root):
    rng, rows, want = random.Random(seed), [], {}
    for host in range(40):
        for page in range(rng.randint(1, 6)):
            kept = []
            body = blocks(rng, 3, kept)
            html = f"<html><body><nav><a href='/'>menu of the site</a></nav><{root}>{body}</{root}><footer>all rights reserved</footer></body></html>"
            rows.append((len(rows), f"http://h{host}.example/{page}", html))
            want[len(rows) - 1] = "\n".join(kept)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    got = {r.page_id: r.main_text for r in wrappers.extract(df).collect()}
    wrong = [i for i in want if got[i] != want[i]]
    assert not wrong, (len(wrong), got[wrong[0]], want[wrong[0]])


def test_deep_and_long_pages(spark):
    deep = "<article><p>first block of the text</p>" + "<div>" * 20_000 + "<p>deepest block of the text</p>" + "</div>" * 20_000
    deep += "<p>last block of the text</p></article><footer>the end</footer>"
    unclosed = "<article>" + "".join(f"<div>block number {i} of them" for i in range(2_000)) + "</article><footer>the end</footer>"
    rng = random.Random(5)
    tags = [rng.choice(["p", "h2", "pre", "h3"]) for _ in range(20_000)]
    long = ["".join(f"<{t}>block {i} of a long page {k}</{t}>" for i, t in enumerate(tags[k:])) for k in (0, 7)]
    rows = [(1, "http://a.example/1", deep), (2, "http://a.example/2", "<article><p>good page of the host</p></article>"),
            (3, "http://b.example/1", unclosed), (4, "http://c.example/1", f"<article>{long[0]}</article>"),
            (5, "http://c.example/2", f"<article>{long[1]}</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    start = time.time()
    got = {r.page_id: r.main_text for r in wrappers.extract(df).collect()}
    assert got[1] == "first block of the text\ndeepest block of the text\nlast block of the text"
    assert got[2] == "good page of the host"
    assert got[3] == "\n".join(f"block number {i} of them" for i in range(2_000))
    for page, k in ((4, 0), (5, 7)):
        assert got[page] == "\n".join(f"block {i} of a long page {k}" for i in range(20_000 - k))
    assert time.time() - start < 120


def test_words_inside_an_article(spark):
    def page(i, *parts):
        return f"<body><article><p>long text of article number {i} with many different words {i * 7}</p>{''.join(parts)}</article></body>"

    related = '<div class="related"><a href="/1">another article of this site</a><a href="/2">and one more of them</a></div>'
    rows = [
        (i, "http://r.example/", page(i, related, f'<section id="discussion"><p>here the results of study {i} are discussed at some length, {i * 11} times</p></section>'))
        for i in range(6)
    ]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in got:
        i = r.page_id
        assert r.main_text.split("\n") == [
            f"long text of article number {i} with many different words {i * 7}",
            f"here the results of study {i} are discussed at some length, {i * 11} times",
        ]


def test_deeper_tags_close_what_they_opened():
    n = html_tree.DEEPEST + 50
    page = "<main>" + "<div>" * n + "in" + "</div>" * n + "<p>out</p></main><p>after</p>"
    root = html_tree.parse(page)
    assert [x.tag for x in root.items] == ["main", "p"] and root.items[0].items[-1].tag == "p"


def test_long_lists_are_aligned_as_short_ones(monkeypatch):
    """Both ways through the table give the same pairs, ties included, so the length of a list decides nothing."""
    import random

    from cohortlens.llm import wrappers as W

    rng = random.Random(3)
    for k in range(300):
        a, b = ([W.Node(rng.choice("abcde"[: 1 + k % 5])) for _ in range(rng.randrange(1, 60))] for _ in "ab")
        table = W._pairs(a, b)
        with monkeypatch.context() as m:
            m.setattr(W, "CELLS", 0)
            assert W._pairs(a, b) == table
    # An odd item in front does not cost the rest of a long list.
    a = [W.Node(f"x{i}") for i in range(1500)]
    b = [W.Node("x40"), *a]
    assert sum(i is not None and j is not None for i, j in W._pairs(a, b)) == 1500


def test_items_of_long_pages_find_their_places_as_those_of_short_ones(monkeypatch):
    """Both ways give the same positions, ties included, whatever is kept and made again."""
    import random

    from cohortlens.llm import wrappers as W

    rng = random.Random(11)
    for k in range(600):
        letters, names, repeated, back = "abcdefgh"[: 1 + k % 8], [], [], {}
        for _ in range(rng.randrange(0, 20)):
            size = rng.choice([1, 1, 2, 3, 5])
            group = size > 1 or rng.random() < 0.2
            back |= {len(names) + i: len(names) for i in range(size) if group}
            names += [rng.choice(letters) for _ in range(size)]
            repeated += [group or rng.random() < 0.3] * size
        kinds = [rng.choice(letters + "z") for _ in range(rng.randrange(0, 50))]
        places = W._follow(kinds, names, repeated, back)
        with monkeypatch.context() as m:
            m.setattr(W, "CELLS", -1)
            m.setattr(W, "HELD", rng.choice([1, 30, 1 << 22]), raising=False)
            assert W._follow(kinds, names, repeated, back) == places
    # The item behind a repeated group has a place of its own, which the nearest place, in the group, would not give it.
    names = ["a", "b", "a", *[f"x{i}" for i in range(1500)]]
    assert W._follow(names, names, [True, True] + [False] * 1501, {0: 0, 1: 0}) == list(range(1503))
