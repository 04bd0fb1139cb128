"""HTML as a tree of block elements with text slots, from any sequence of tags."""

from __future__ import annotations

import html
import re

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"  # a comment, to the end if it is not closed
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
# Fixed values of the format: elements whose content is no text, elements without an end tag, elements inside a line.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "object", "title"}
VOID = {"area", "base", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "br"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var".split()
)
# Which open elements a start tag ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "tbody": {"thead", "tr", "td", "th"}, "body": {"head"}}
SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "nav", "aside", "header", "footer", "form", "body"}

# Elements nested deeper count as parts of the element at this level: their texts stay blocks of their own.
DEEPEST = 150


class Element:
    """`name` is the tag with its class, id and role; `items` are elements and texts (str, characters in links)."""

    __slots__ = ("tag", "name", "items")

    def __init__(self, tag: str, name: str):
        self.tag, self.name, self.items = tag, name, []


def _name(tag: str, attributes: str) -> str:
    found = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    words = sorted({re.sub(r"\d+", "0", w.lower()) for k in ("class", "id") for w in found.get(k, "").split()})
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""))
    role = found.get("role", "").strip().lower()
    return ".".join([tag, *words, *([f"role={role}"] if role else []), *(["hidden"] if hidden else [])])


def parse(page: str) -> Element:
    """The tree of a page. Tags inside a line are dropped, `br` counts as white space, empty elements are left out."""
    root = Element("", "")
    stack, parts, links, in_link = [root], [], 0, False
    deep: list[str] = []  # tags of open elements below DEEPEST

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            stack[-1].items.append((text, links))
        parts.clear()
        links = 0

    def close(at: int) -> None:
        flush()
        while len(stack) > at:
            done = stack.pop()
            if done.items:
                stack[-1].items.append(done)

    def say(text: str) -> None:
        nonlocal links
        if text:
            text = html.unescape(text)
            parts.append(text)
            if in_link:
                links += len(text.strip())

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[1] is None:
            continue
        tag, end = m[1].lower(), page[m.start() + 1] == "/"
        if tag == "a":
            in_link = not end
        if tag == "br":
            parts.append(" ")
        if tag in INLINE or tag == "br":
            if not end and tag != "br" and "hidden" in (name := _name(tag, m[2])) and name.endswith(".hidden"):
                closing = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = closing.end() if closing else at
                in_link = False
            continue
        if tag in RAW and not end:
            flush()
            if not m[2].rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                closing = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = closing.end() if closing else len(page) if tag in ("script", "style") else at
            continue
        if tag in VOID or tag in RAW:
            flush()
            continue
        in_link = False
        if deep and end:
            flush()
            if tag == deep[-1]:
                deep.pop()
                continue
            if tag in SCOPE and tag not in deep and any(e.tag == tag for e in stack):
                deep.clear()
            else:
                if tag in deep:
                    del deep[len(deep) - 1 - deep[::-1].index(tag) :]
                continue
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag == "p" and stack[i].tag in SCOPE:
                    break
            flush()
            continue
        flush()
        if len(stack) > DEEPEST:
            if deep and deep[-1] in ENDS.get(tag, set()) | {"p"}:
                deep.pop()
            deep.append(tag)
            continue
        ends = ENDS.get(tag, set()) | {"p"}
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ends:
                close(i)
                break
            if stack[i].tag in SCOPE and stack[i].tag not in ends:
                break
        if tag == "body" and any(e.tag == "body" for e in stack):
            continue
        stack.append(Element(tag, _name(tag, m[2])))
        deep.clear()
    close(1)
    return root
