"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of one host.

A page is a tree of block elements and text slots. Within a page, neighbours of the same kind fold
into a repeated group. Trees of one host are aligned one after the other: elements of the same kind
merge, others become optional, neighbours that turn out to be alike become a repeated group,
and texts that differ become slots. Trees that are equal but for their texts are counted in Spark first, so only
distinct ones are aligned, in groups of bounded size, level by level, until each host has one wrapper.

Each page is matched to its host's wrapper; a block that has no place there is judged by its own names or else goes the way
of its parent. The slots that a page meets say which are main text: those in articles if
the page has some, else those in main, else those in the element with most of the host's unlinked text; never those
in menus, headers, footers, sidebars, notices, adverts, forms and comments. Inside an article some words of class and id
refuse an element only where the host's statistics agree. So templates of one host do not disturb
each other.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortlens.llm.common import arrow_map, fresh, ship
from cohortlens.llm.html_tree import Element, parse
from cohortlens.session import pin, stored

# Distinct trees that one task aligns.
GROUP = 64
# Longest period of a repeated group of neighbours.
PERIOD = 4
# Share of an element's text that must be below it for the main text to lie there.
DEEPER = 0.7
PAGE_BYTES = 4 << 20

# Elements, and words of class, id or role, of what is not main text.
NOT_MAIN_TAGS = {"nav", "footer", "aside", "form", "button", "select", "fieldset", "dialog", "menu", "head", "label", "hidden"}
NOT_MAIN = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promos promotion cookie cookies "
    "consent gdpr notice notices alert popup modal overlay menu menus nav navbar navigation navi breadcrumb breadcrumbs sidebar "
    "side aside footer foot masthead topbar comment comments commentlist disqus reply replies respond discussion share sharing "
    "social related recommended recommendations newsletter subscribe subscription signup login search pagination pager widget "
    "widgets toolbar skip hidden complementary contentinfo disclaimer".split()
)

# Of these, words that an article's own parts are named with, too: inside an article they count only where the host's
# statistics agree (mostly links, mostly the same on all pages, or short).
DOUBTFUL = set(
    "related recommended recommendations discussion menu menus side skip search complementary respond disclaimer".split()
)
SHORT = 40
# Cells of a table that matches two lists; of larger ones some rows are kept only, and the others are made again. Numbers of
# the places of items that are held at once then.
CELLS = 1 << 20
HELD = 1 << 22


class Node:
    """A wrapper's element (or repeated group, name "+"), or a slot (name "#"); lists for JSON."""

    __slots__ = ("name", "kids", "rep", "opt", "text", "stats", "main")

    def __init__(self, name, kids=(), rep=False, opt=False, text=None, stats=None, main=False):
        self.name, self.kids, self.rep, self.opt = name, list(kids), rep, opt
        self.text, self.stats, self.main = text, stats, main

    def pack(self):
        return [self.name, [k.pack() for k in self.kids], int(self.rep), int(self.opt), self.text, self.stats, int(self.main)]

    @staticmethod
    def unpack(x) -> Node:
        return Node(x[0], [Node.unpack(k) for k in x[1]], bool(x[2]), bool(x[3]), x[4], x[5], bool(x[6]))


def _leaf(text: str, links: int) -> Node:
    mark = xxhash.xxh3_64_hexdigest(text.encode("utf-8", "replace"))
    return Node("#", text=mark, stats=[1, len(text), min(links, len(text))])


def tree(element: Element) -> Node:
    """The element with neighbours folded; texts are slots with a hash and [texts, characters, linked characters]."""
    kids = [_leaf(*x) if isinstance(x, tuple) else tree(x) for x in element.items]
    return Node(element.name, fold(kids))


def merge(a: Node, b: Node) -> Node:
    """Two nodes of the same name as one."""
    out = Node(a.name, rep=a.rep or b.rep, opt=a.opt or b.opt)
    if a.name == "#":
        out.text = a.text if a.text == b.text else None
        out.stats = [x + y for x, y in zip(a.stats, b.stats)]
        return out
    out.kids = align(a.kids, b.kids)
    return out


def fold(kids: list[Node]) -> list[Node]:
    """Repeats of one to PERIOD neighbours become one repeated node."""
    for period in range(1, PERIOD + 1):
        out: list[Node] = []
        for kid in kids:
            out.append(kid)
            while len(out) >= 2 * period and all(
                out[-1 - i].name == out[-1 - i - period].name for i in range(period)
            ) and (period == 1 or not any(x.name == "+" for x in out[-2 * period :])):
                last, out = out[-period:], out[:-period]
                again = [merge(x, y) for x, y in zip(out[-period:], last)]
                if period == 1:
                    again[0].rep = True
                    out[-1:] = again
                else:
                    out[-period:] = [Node("+", again, rep=True)]
            if period > 1 and len(out) > period and out[-period - 1].name == "+" and [x.name for x in out[-period:]] == [
                x.name for x in out[-period - 1].kids
            ]:
                group, last = out[-period - 1], out[-period:]
                group.kids = [merge(x, y) for x, y in zip(group.kids, last)]
                out = out[:-period]
        kids = out
    return kids


def _pairs(a: list[Node], b: list[Node]) -> list[tuple[int | None, int | None]]:
    """A longest common subsequence of names, as index pairs in order; None where the other side has none."""
    n, m = len(a), len(b)
    if n * m > CELLS:
        return _long_pairs([x.name for x in a], [x.name for x in b])
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i].name == b[j].name else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i].name == b[j].name:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def _long_pairs(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """The same subsequence of two long lists, without the whole table of their lengths.

    Rows are made from the last to the first; some are kept, and the rows between two of them are made again when the way
    through the table gets there. Neighbours in a row differ by one at most, so a row is kept as bits.
    """
    n, m = len(a), len(b)
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(k, len(number)) for k in names], np.int32) for names in (a, b))
    step = isqrt(n) + 1

    def row(i: int, below: np.ndarray) -> np.ndarray:
        out = np.zeros(m + 1, np.int32)
        reach = np.where(y == x[i], below[1:] + 1, below[:-1])
        out[:-1] = np.maximum.accumulate(reach[::-1])[::-1]
        return out

    kept, at = {}, np.zeros(m + 1, np.int32)
    for i in range(n - 1, -1, -1):
        at = row(i, at)
        if i % step == 0:
            kept[i] = np.packbits(at[:-1] != at[1:])

    def between(low: int) -> list[np.ndarray]:
        """For the rows from a kept one up to the next: where leaving out an item of `a` is as good as one of `b`."""
        high = min(low + step, n)
        at = np.zeros(m + 1, np.int32)
        if high < n:
            at[:-1] = np.cumsum(np.unpackbits(kept[high], count=m)[::-1], dtype=np.int32)[::-1]
        out = []
        for i in range(high - 1, low - 1, -1):
            below, at = at, row(i, at)
            out.append(np.packbits(below[:-1] >= at[1:]))
        return out[::-1]

    out, i, j, low, rows = [], 0, 0, -1, []
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
            continue
        if i < n and j < m and i - i % step != low:
            low = i - i % step
            rows = between(low)
        if j == m or i < n and rows[i - low][j >> 3] >> (7 - (j & 7)) & 1:
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """One list that matches both; what only one has is optional, and neighbours alike fold."""
    out = []
    for i, j in _pairs(a, b):
        if i is not None and j is not None:
            out.append(merge(a[i], b[j]))
        else:
            node = a[i] if j is None else b[j]
            node.opt = True
            out.append(node)
    return fold(out)


def expression(node: Node) -> str:
    """The wrapper as a regular expression over tags and texts, for people."""
    if node.name == "#":
        return "text" if node.text is None else f"'{node.text}'"
    inner = " ".join(expression(k) for k in node.kids)
    body = f"({inner})" if node.name == "+" else f"<{node.name}> {inner} </>" if node.name else inner
    return body + ("+" if node.rep and not node.opt else "*" if node.rep else "?" if node.opt else "")


def _words(name: str) -> set[str]:
    parts = name.split(".")
    return {parts[0]} if len(parts) == 1 else {parts[0]} | {w for p in parts[1:] for w in re.split(r"[-_=]", p)}


@lru_cache(maxsize=100_000)
def _refusal(name: str) -> str:
    """Whether an element of this name is no main text: "yes", "doubtful" (by a word of DOUBTFUL alone) or ""."""
    parts = name.split(".")
    words = (_words(".".join(["", *parts[1:]])) if len(parts) > 1 else set()) & NOT_MAIN
    if parts[0] in NOT_MAIN_TAGS or words - DOUBTFUL:
        return "yes"
    return "doubtful" if words else ""


def _tag(node: Node) -> str:
    return node.name.split(".")[0]


def _is_main(node: Node) -> bool:
    return _tag(node) == "main" or "role=main" in node.name.split(".")


class Part:
    """A wrapper's node with those of its kids that count: all of them, or those that a page meets."""

    __slots__ = ("node", "kids", "weight")

    def __init__(self, node: Node, kids: list[Part]):
        self.node, self.kids, self.weight = node, kids, 0

    @staticmethod
    def whole(node: Node) -> Part:
        return Part(node, [Part.whole(k) for k in node.kids])

    def refused(self, inside: bool) -> bool:
        how = _refusal(self.node.name)
        if how != "doubtful" or not inside:
            return bool(how)
        slots = _weighed(self, False)
        texts, chars, links = (sum(s.node.stats[i] for s in slots) for i in range(3))
        same = sum(s.node.stats[1] for s in slots if s.node.text is not None and s.node.stats[0] > 1)
        return 2 * links >= chars or 2 * same >= chars or chars < SHORT * texts

    def weigh(self, inside: bool = False) -> int:
        """Unlinked characters of a node that are not refused; `inside` an article or main, a header counts."""
        if self.node.name == "#":
            _, chars, links = self.node.stats
            self.weight = chars - links if links * 2 < chars else 0
        else:
            within = inside or _tag(self.node) in ("article", "main")
            total = sum(k.weigh(within) for k in self.kids)
            self.weight = 0 if self.refused(inside) or _tag(self.node) == "header" and not inside else total
        return self.weight

    def every(self, wanted, inside: bool = False) -> list[tuple[Part, bool]]:
        if self.node.name == "#" or self.node.name and self.refused(inside):
            return []
        if wanted(self.node):
            return [(self, inside)]
        within = inside or _tag(self.node) in ("article", "main")
        return [x for k in self.kids for x in k.every(wanted, within)]

    def densest(self) -> tuple[Part, bool]:
        """Down to the element that still holds most of the text."""
        at, inside = self, False
        while True:
            below = [(k.weight, i) for i, k in enumerate(at.kids) if k.node.name != "#"]
            if not below or max(below)[0] < DEEPER * at.weight or not at.weight:
                return at, inside
            inside = inside or _tag(at.node) in ("article", "main")
            at = at.kids[max(below)[1]]

    def slots(self, inside: bool, top: bool = False) -> list[Node]:
        if self.node.name == "#":
            return [self.node]
        if not top and self.refused(inside) or _tag(self.node) == "header" and not inside:
            return []
        within = inside or _tag(self.node) in ("article", "main")
        return [x for k in self.kids for x in k.slots(within)]


def _below(roots: list[tuple[Part, bool]], wrapper: Part) -> list[Node]:
    return [x for part, inside in roots for x in part.slots(inside, part is wrapper)]


def choose(wrapper: Node) -> Node:
    """Mark the slots of the element with most of the host's text."""
    whole = Part.whole(wrapper)
    whole.weigh()
    for slot in _below([whole.densest()], whole):
        slot.main = True
    return wrapper


def chosen(met: Part) -> list[Node]:
    """The main slots among those that a page meets."""
    met.weigh()
    levels = [met.every(lambda n: _tag(n) == "article"), met.every(_is_main)]
    for roots in levels:
        if any(part.weight for part, _ in roots):
            return _below(roots, met)
    marked = sum(s.weight for s in _weighed(met) if s.node.main)
    if met.weight and marked < DEEPER * met.weight:  # another template than most of the host's text
        return _below([met.densest()], met)
    if not met.weight:
        for roots in levels:
            if roots:
                return _below(roots, met)
    return [s.node for s in _weighed(met, False) if s.node.main]


def _weighed(part: Part, some: bool = True) -> list[Part]:
    """The slots below a part; with `some` only below nodes that have weight."""
    if part.node.name == "#":
        return [part]
    return [x for k in part.kids if k.weight or not some for x in _weighed(k, some)]


def _leaves(node: Node) -> list[Node]:
    return [node] if node.name == "#" else [x for k in node.kids for x in _leaves(k)]


def main_text(page: Element, wrapper: Node) -> list[str]:
    """The page's texts in main slots, in page order."""
    met: list[tuple[str, Node]] = []
    parts: dict[int, Part] = {id(wrapper): Part(wrapper, [])}

    def part(node: Node, above: Part) -> Part:
        if id(node) not in parts:
            parts[id(node)] = Part(node, [])
            above.kids.append(parts[id(node)])
        return parts[id(node)]

    def stray(item, above: Part, main: bool) -> None:
        """An item that the wrapper has no place for: judged by its own names, else as its parent is."""
        if isinstance(item, tuple):
            node = Node("#", stats=[1, len(item[0]), min(item[1], len(item[0]))], main=main)
            above.kids.append(Part(node, []))
            met.append((item[0], node))
        else:
            here = Part(Node(item.name), [])
            above.kids.append(here)
            for kid in item.items:
                stray(kid, here, main)

    def walk(items: list, kids: list[Node], own: Part) -> None:
        # A repeated group is matched as often as it occurs: its kinds follow each other in any number.
        flat = []
        for k in kids:
            flat += [(x, True, k) for x in k.kids] if k.name == "+" else [(k, k.rep, None)]
        names = [x.name for x, _, _ in flat]
        main = None
        starts = {}
        at = 0
        for k in kids:
            size = len(k.kids) if k.name == "+" else 1
            if k.name == "+":
                starts |= {at + i: at for i in range(size)}
            at += size
        for item, i in zip(items, _follow([_kind(x) for x in items], names, [r for _, r, _ in flat], starts)):
            if i is None:
                main = any(s.main for k in kids for s in _leaves(k)) if main is None else main
                stray(item, own, main)
                continue
            node, _, group = flat[i]
            here = part(node, part(group, own) if group else own)
            if isinstance(item, tuple):
                met.append((item[0], node))
            else:
                walk(item.items, node.kids, here)

    walk(page.items, wrapper.kids, parts[id(wrapper)])
    main = set(map(id, chosen(parts[id(wrapper)])))
    return [text for text, node in met if id(node) in main]


def _kind(item) -> str:
    return "#" if isinstance(item, tuple) else item.name


def _follow(kinds: list[str], names: list[str], repeated: list[bool], back: dict[int, int]) -> list[int | None]:
    """The wrapper position of each item: forward, staying on repeated ones, back to a group's start.

    The furthest reach with the fewest skipped positions is kept for each end position.
    """
    if len(kinds) * len(names) > CELLS:
        return _long_follow(kinds, names, repeated, back)
    places: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        places.setdefault(name, []).append(i)

    def again(at: int, kind: str) -> list[int]:
        """Positions of the kind that may follow without a skip: a repeated one itself, earlier ones of its group."""
        out = [at] if at >= 0 and repeated[at] and names[at] == kind else []
        if at in back:
            out += [i for i in range(back[at], at) if names[i] == kind and back.get(i) == back[at]]
        return out

    # State: position of the last matched item -> (skipped, chain of positions).
    states: dict[int, tuple[int, tuple]] = {-1: (0, ())}
    for kind in kinds:
        following: dict[int, tuple[int, tuple]] = {}
        before = sorted(states)
        # The cheapest state before each place: what it skipped, less its position.
        best, k = None, 0
        for i in places.get(kind, []):
            while k < len(before) and before[k] < i:
                skipped, chain = states[before[k]]
                if best is None or skipped - before[k] < best[0]:
                    best = (skipped - before[k], chain)
                k += 1
            if best is not None:
                following[i] = (best[0] + i - 1, (best[1], i))
        for at in before:
            skipped, chain = states[at]
            for i in again(at, kind):
                if i not in following or skipped < following[i][0]:
                    following[i] = (skipped, (chain, i))
        if following:
            states = following
        else:  # behind an item that was matched further on; it stays unmatched
            states = {at: (skipped, (chain, None)) for at, (skipped, chain) in states.items()}
    chain = min(states.items(), key=lambda x: (x[1][0], x[0]))[1][1]
    out: list[int | None] = []
    while chain:
        chain, i = chain
        out.append(i)
    return out[::-1]


def _long_follow(kinds: list[str], names: list[str], repeated: list[bool], back: dict[int, int]) -> list[int | None]:
    """The same positions for many items or a long wrapper, without a chain for each end position.

    States are arrays of positions, in order, and of what they skipped. Some are kept; those between two of them are made again,
    with the state that each came from, when the way back from the best end gets there.
    """
    n, m = len(kinds), len(names)
    start = np.array([back.get(i, i) for i in range(m)], np.int64)
    stop = np.searchsorted(start, start, "right")
    stays = np.array(repeated, bool)
    of: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        of.setdefault(name, []).append(i)
    places = {name: np.array(x, np.int64) for name, x in of.items()}

    def after(kind: str, at: np.ndarray, skipped: np.ndarray):
        """The states behind one more item and the state each came from; None if no state has a place for it."""
        to = places.get(kind)
        if to is None:
            return None
        # Forward: the cheapest state before each place, the first one of equals.
        less = skipped - at
        low = np.minimum.accumulate(less)
        first = np.maximum.accumulate(np.where(np.append(True, less[1:] < low[:-1]), np.arange(len(at)), 0))
        k = np.searchsorted(at, to) - 1
        found = k >= 0
        source = first[k]
        cost = low[k] + to - 1
        # Without a skip: from the place itself if it is repeated, from later ones of its group; the first one of the cheapest.
        k = np.searchsorted(at, to + ~stays[to])
        again = k < np.searchsorted(at, stop[to])
        if again.any():
            # Backwards, where each group starts anew as its numbers are below all of the groups behind it.
            group = np.cumsum(np.append(0, start[at[1:]] != start[at[:-1]])) if at[0] >= 0 else np.zeros(len(at), np.int64)
            number = (skipped - skipped.min() + group * (np.ptp(skipped) + 1))[::-1]
            low = np.minimum.accumulate(number)
            last = np.maximum.accumulate(np.where(np.append(True, number[1:] <= low[:-1]), np.arange(len(at)), 0))
            best = (len(at) - 1 - last)[::-1][np.minimum(k, len(at) - 1)]
            better = again & (~found | (skipped[best] < cost))
            source, cost, found = np.where(better, best, source), np.where(better, skipped[best], cost), found | again
        if not found.any():
            return None
        return to[found], cost[found], source[found]

    begin = (np.array([-1], np.int64), np.zeros(1, np.int64))
    step = max(isqrt(n) + 1, HELD // max(map(len, places.values()), default=1))
    kept, states = {0: begin}, begin
    for j in range((n - 1) // step * step):
        states = (after(kinds[j], *states) or states)[:2]
        if (j + 1) % step == 0:
            kept[j + 1] = states
    out: list[int | None] = [None] * n
    end = None
    for low in sorted(kept, reverse=True):
        states, made = kept[low], []
        for j in range(low, min(low + step, n)):
            new = after(kinds[j], *states)
            made.append(None if new is None else (new[0].astype(np.int32), new[2].astype(np.int32)))
            states = states if new is None else new[:2]
        if end is None:
            end = int(np.argmin(states[1]))
        for j in range(low + len(made) - 1, low - 1, -1):
            if made[j - low] is not None:
                at, source = made[j - low]
                out[j], end = int(at[end]), int(source[end])
    return out


def _shape(node: Node, slots: list[Node]) -> list:
    """The tree without texts and counts, which go to `slots` in order."""
    if node.name == "#":
        slots.append(node)
        return ["#", [], int(node.rep), int(node.opt)]
    return [node.name, [_shape(k, slots) for k in node.kids], int(node.rep), int(node.opt)]


def _from_shape(x: list, slots: list[dict]) -> Node:
    if x[0] == "#":
        s = slots.pop(0)
        text = s["lo"] if s["lo"] == s["hi"] and s["constant"] else None
        return Node("#", rep=bool(x[2]), opt=bool(x[3]), text=text, stats=[s["texts"], s["chars"], s["links"]])
    return Node(x[0], [_from_shape(k, slots) for k in x[1]], bool(x[2]), bool(x[3]))


def _host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def infer(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper) of every host: the wrapper of all its pages, as JSON with the slots of its densest element marked."""

    def shapes(batches):
        for batch in batches:
            hosts, found, counts = [], [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                slots: list[Node] = []
                found.append(json.dumps(_shape(tree(parse(page.as_py() or "")), slots), separators=(",", ":")))
                hosts.append(host)
                counts.append(
                    [{"text": s.text or "", "constant": s.text is not None, "texts": s.stats[0], "chars": s.stats[1], "links": s.stats[2]}
                     for s in slots]
                )
            kind = pa.list_(pa.struct([("text", pa.string()), ("constant", pa.bool_()), ("texts", pa.int64()),
                                       ("chars", pa.int64()), ("links", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(found, pa.string()), pa.array(counts, kind)], names=["host", "shape", "slots"]
            )

    schema = "host string, shape string, slots array<struct<text:string,constant:boolean,texts:bigint,chars:bigint,links:bigint>>"
    parsed = arrow_map(pages.select(_host(url).alias("host"), html), shapes, schema)
    # Pages that differ in their texts alone are added up slot by slot; a page without slots counts, too.
    summed = parsed.select("host", "shape", F.posexplode_outer("slots").alias("pos", "s")).groupBy("host", "shape", "pos").agg(
        F.min("s.text").alias("lo"), F.max("s.text").alias("hi"), F.min("s.constant").alias("constant"),
        F.sum("s.texts").alias("texts"), F.sum("s.chars").alias("chars"), F.sum("s.links").alias("links"),
    )
    distinct = summed.groupBy("host", "shape").agg(F.array_sort(F.collect_list(F.struct("pos", "lo", "hi", "constant", "texts", "chars", "links"))).alias("slots"))

    def start(batches):
        for batch in batches:
            out = [
                json.dumps(_from_shape(json.loads(shape), [s for s in slots if s["pos"] is not None]).pack(), separators=(",", ":"))
                for shape, slots in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["host", "wrapper"])

    def unite(table: pa.Table) -> pa.Table:
        some = sorted(table.column("wrapper").to_pylist(), key=lambda w: (len(w), w))
        united = Node.unpack(json.loads(some[0]))
        for w in some[1:]:
            united = merge(united, Node.unpack(json.loads(w)))
        return pa.table({"host": table.column("host")[:1], "wrapper": [json.dumps(united.pack(), separators=(",", ":"))]})

    ship(pages.sparkSession)
    level = stored(arrow_map(distinct, start, "host string, wrapper string"), "wrappers")
    while True:
        sizes = level.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 1
        if most == 1:
            break
        # A host's wrappers are dealt to groups of about GROUP; a host of one group gets its single wrapper.
        groups = F.ceil(F.col("n") / F.lit(GROUP)).cast("int")
        dealt = level.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("wrapper"), groups).cast("int"))
        level = stored(dealt.groupBy("host", "part").applyInArrow(unite, "host string, wrapper string"), "wrappers")

    def decide(batches):
        for batch in batches:
            out = [json.dumps(choose(Node.unpack(json.loads(w))).pack(), separators=(",", ":")) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["host", "wrapper"])

    return arrow_map(level, decide, "host string, wrapper string")


@lru_cache(maxsize=512)
def _loaded(wrapper: str) -> Node:
    return Node.unpack(json.loads(wrapper))


def extract(pages: DataFrame, url: str = "url", html: str = "html", name: str = "main_text") -> DataFrame:
    """All rows and columns of `pages` and the main text of each in a last column `name`.

    Blocks are in page order, joined by a line end; white space within one is a single space. A
    null or empty page, or one without main text, has an empty text. Pages whose url names no host
    share one wrapper. Repeated rows stay rows.
    """
    wrappers = stored(infer(pages, url, html), "wrappers")
    host, own, work = fresh(pages, "page_host"), fresh(pages, "host_wrapper"), fresh(pages, "page_html")
    small = pin(wrappers.withColumnsRenamed({"host": host, "wrapper": own}), 2000)
    keep = [F.col(f"`{c}`") for c in pages.columns]
    joined = pages.withColumn(host, _host(url)).join(small, host, "left").select(*keep, F.col(html).alias(work), own)
    schema = StructType([*pages.schema.fields, StructField(name, StringType())])

    def run(batches):
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
                page, wrapper = page.as_py(), wrapper.as_py()
                texts.append("\n".join(main_text(parse(page), _loaded(wrapper))) if page and wrapper else "")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(texts, pa.string())], names=[*batch.schema.names[:-2], name]
            )

    return arrow_map(joined, run, schema)
