"""Main text of web pages by maximum-scoring subsequence, with weights learned from labelled pages."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_labels import Page, labelled_pages

#: Elements whose content is no text of the page at all.
RAW = {"script", "style", "noscript", "template", "svg", "textarea", "iframe", "object", "head", "title"}
BLOCKS = {
    "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th",
    "caption", "blockquote", "pre", "section", "article", "main", "header", "footer", "aside", "nav", "form", "fieldset", "figure", "figcaption",
    "hr", "address", "details", "summary", "body", "html", "center",
}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Elements that hold blocks: a region is widened to one of these, not to a paragraph or a phrase.
HOLDERS = {"article", "main", "div", "section", "td", "body", "html", "center", "blockquote"}
#: Log-odds below which an element is furniture.
FURNITURE = -2.0
#: Open elements that a start tag ends when their own end tag is missing.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What no missing end tag is looked for beyond.
_WALLS = {"ul", "ol", "dl", "table", "article", "main", "body", "html", "section", "div", "aside", "blockquote"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


@cache
def _shut(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


def features(tag: str, attrs: str) -> list[str]:
    """What an element shows of its kind: its tag (apart for elements with and without names) and the words of its class, id and role."""
    names: dict[str, None] = {}
    for found in _NAMES.finditer(attrs):
        value = _CAMEL.sub(r"\1 \2", found[1] or found[2] or found[3] or "")
        names |= dict.fromkeys(f"name:{w}" for w in _PART.findall(value.lower()))
    return [f"tag:{tag}" if names else f"bare:{tag}", *names, *(["hidden"] if attrs and _HIDDEN.search(attrs) else [])]


@dataclass
class Node:
    """An element of a page, of which the page itself is the first."""

    tag: str
    up: int
    features: list[str] = field(default_factory=list)


def parse(html: str) -> tuple[list[Node], list[tuple[str, str, int]]]:
    """Elements, and the events ``text, raw text, element`` and ``tag, name (with / if it closes), element`` in page order.

    Missing end tags of paragraphs, list items, cells and whatever an outer end tag closes are supplied.
    """
    nodes, out, now = [Node("", -1)], [], 0
    at, end = 0, len(html)

    def close(to: int) -> None:
        nonlocal now
        while now != to:
            out.append(("tag", "/" + nodes[now].tag, now))
            now = nodes[now].up

    while at < end:
        found = _TOKEN.search(html, at)
        stop = found.start() if found else end
        if stop > at:
            out.append(("text", html[at:stop], now))
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            up = now
            while up > 0 and nodes[up].tag != tag:
                up = nodes[up].up
            if up > 0:
                close(nodes[up].up)
            elif tag in BLOCKS:
                out.append(("tag", "/" + tag, now))
            continue
        if tag in RAW:
            shut = None if found[3].rstrip().endswith("/") and tag not in ("script", "style") else _shut(tag).search(html, at)
            if shut:
                at = shut.end()
            elif tag in ("script", "style"):
                at = end
            continue
        if tag in BLOCKS:  # a block ends an open paragraph
            up = now
            while up > 0 and nodes[up].tag not in _WALLS and nodes[up].tag != "p":
                up = nodes[up].up
            if nodes[up].tag == "p":
                close(nodes[up].up)
        if tag in _ENDS:
            up = now
            while up > 0 and nodes[up].tag not in _WALLS and nodes[up].tag not in _ENDS[tag]:
                up = nodes[up].up
            if nodes[up].tag in _ENDS[tag]:
                close(nodes[up].up)
        if tag in VOID or found[3].rstrip().endswith("/") and tag == "math":
            out.append(("tag", tag, now))
            continue
        nodes.append(Node(tag, now, features(tag, found[3])))
        now = len(nodes) - 1
        out.append(("tag", tag, now))
    close(0)
    return nodes, out


@dataclass
class Weights:
    """``tokens``: score of a word (``word``, ``word:link``, above zero) and of a tag (below zero); ``kinds``: log-odds of the
    features of elements that hold main text against those of elements that hold none of it."""

    tokens: dict[str, float]
    kinds: dict[str, float]

    def of_element(self, node: Node) -> float:
        return sum(self.kinds.get(f, 0.0) for f in node.features)


def _links(nodes: list[Node]) -> list[bool]:
    out: list[bool] = []
    for n in nodes:
        out.append(n.up >= 0 and (out[n.up] or n.tag == "a"))
    return out


def learn_weights(pages: Iterable[Page] | None = None, smooth: float = 0.5, rare: float = 0.1) -> Weights:
    """Weights from labelled pages: log-odds of tokens inside against outside main text, and of element features.

    The signs are the method's: words score above zero (0.05 at least) and tags below it (-0.05 at most), so only words
    can pay for the markup between them. An element counts as main if main words are in it, as furniture if it is the
    outermost one that holds words but no main ones, and else not at all; elements of equal features count once.
    """
    inside: dict[str, float] = defaultdict(float)
    outside: dict[str, float] = defaultdict(float)
    good_kinds: set[tuple[str, ...]] = set()
    bad_kinds: set[tuple[str, ...]] = set()
    for page in labelled_pages() if pages is None else pages:
        nodes, seen = parse("".join(f"\x00{int(good)}{piece}" for piece, good in page))
        link, good = _links(nodes), False
        words = [[0, 0] for _ in nodes]
        for kind, value, node in seen:
            if kind == "tag":
                (inside if good else outside)[f"tag:{value.lstrip('/')}"] += 1
                continue
            for part in re.split(r"(\x00[01])", value):
                if part.startswith("\x00"):
                    good = part[1] == "1"
                    continue
                n = len(part.split())
                (inside if good else outside)["word:link" if link[node] else "word"] += n
                while node >= 0 and n:
                    words[node][good] += n
                    node = nodes[node].up
        for node, (bad, well) in zip(nodes, words, strict=True):
            if node.tag in ("", "html", "body") or not bad + well or not well and nodes[node.up].tag not in ("", "html", "body") and not words[node.up][1]:
                continue
            (good_kinds if well else bad_kinds).add(tuple(node.features))
    n_in, n_out = sum(inside.values()) or 1, sum(outside.values()) or 1
    odds = {c: log((inside[c] + smooth) / n_in) - log((outside[c] + smooth) / n_out) for c in [*inside, *outside]}
    tokens = {c: max(0.05, x) if c.startswith("word") else min(-0.05, x) for c, x in odds.items()}
    good_of, bad_of = (Counter(f for fs in kinds for f in fs) for kinds in (good_kinds, bad_kinds))
    kinds = {f: log(good_of[f] + rare) - log(bad_of[f] + rare) for f in [*good_of, *bad_of]}
    return Weights(tokens, kinds)


_DEFAULT = learn_weights()


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last-plus-one index of the maximum-scoring contiguous run; ``(0, 0)`` if no score is positive."""
    best, span, run, begin = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if run <= 0:
            run, begin = 0.0, k
        run += s
        if run > best:
            best, span = run, (begin, k + 1)
    return span


def main_text(html: str | None, weights: Weights | None = None) -> str:
    """Main text of one page; blocks joined by an empty line. Null, empty and text-free pages give ''.

    Elements whose features speak for furniture are left out, and their words score nothing. The best region of what is
    left is widened, so that no list or heading at its ends is lost, to the element it lies in: the outermost ``article``
    around it, else the outermost element around it whose features speak for main text, else the least element that holds
    blocks; on a page without any but its body the region grows over neighbouring text that is not in links.
    """
    if not html:
        return ""
    w = weights or _DEFAULT
    nodes, seen = parse(html)
    link = _links(nodes)
    odds = [w.of_element(n) for n in nodes]
    off = [False]
    for n, x in zip(nodes[1:], odds[1:], strict=True):
        off.append(off[n.up] or (x < FURNITURE and n.tag not in ("html", "body")))
    scores = []
    for kind, value, node in seen:
        if kind == "text":
            scores.append(0.0 if off[node] else w.tokens.get("word:link" if link[node] else "word", 0.05) * len(value.split()))
        else:
            scores.append(w.tokens.get(f"tag:{value.lstrip('/')}", -0.3))
    begin, end = best_region(scores)
    if begin == end:
        return ""
    above: list[int] | None = None  # elements around all words of the region, the innermost first
    for (kind, value, node), s in zip(seen[begin:end], scores[begin:end], strict=True):
        if kind == "text" and s > 0:
            own, up = set(), node
            if above is not None and node == above[0]:
                continue
            while up > 0:
                own.add(up)
                up = nodes[up].up
            if above is None:
                above, up = [], node
                while up > 0:
                    above.append(up)
                    up = nodes[up].up
                above.append(0)
            else:
                above = [x for x in above if x in own or x == 0]
    above = above or [0]
    articles = [x for x in above if nodes[x].tag == "article"]
    good = [x for x in above if odds[x] > 0.5 and nodes[x].tag in HOLDERS and nodes[x].tag not in ("body", "html")]
    plain = [x for x in above if nodes[x].tag in HOLDERS]
    holder = articles[-1] if articles else good[-1] if good else plain[0] if plain else 0
    if nodes[holder].tag in ("", "html", "body"):
        while begin and not (seen[begin - 1][0] == "text" and seen[begin - 1][1].strip() and (link[seen[begin - 1][2]] or off[seen[begin - 1][2]])):
            begin -= 1
        while end < len(seen) and not (seen[end][0] == "text" and seen[end][1].strip() and (link[seen[end][2]] or off[seen[end][2]])):
            end += 1
        chosen = seen[begin:end]
    else:
        inside = [False] * len(nodes)
        for k in range(holder, len(nodes)):
            inside[k] = k == holder or (nodes[k].up >= 0 and inside[nodes[k].up])
        chosen = [e for e in seen if inside[e[2]]]
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(now)).split())
        if text:
            blocks.append(text)
        now.clear()

    for kind, value, node in chosen:
        if kind == "text":
            if not off[node]:
                now.append(value)
        elif value.lstrip("/") in BLOCKS:
            flush()
        elif value == "br" and not off[node]:
            now.append(" ")
    flush()
    return "\n\n".join(blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row; one pass, no shuffle.

    Null or empty html, and pages without main text, give ''. Pages of any length are parsed whole, in time that grows with
    them. Ids and urls pass through, nulls included; repeated rows
    each appear; an empty table gives an empty result; other columns are ignored.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(each, "page_id long, url string, text string, n_chars long")
