"""Operator 2: main text of pages by a site style tree.

The DOMs of a host's pages are merged: elements with the same path of tags and class names are one style node. Each style node has
a presentation importance, the entropy of the child styles seen below it, and a content importance, the entropy of the texts seen
below it; both are 1 where pages differ and 0 where all are alike. A branch of low importance is removed from each page.

Entropy is asked first. What it leaves isn't all article: an advert with a new text on each page looks important, and a host's only
page tells nothing. So among the branches that it doesn't remove, those go whose tag or class names a role that is no article, and an
article's own elements without class or id, the paragraphs that a host may repeat, aren't removed at all.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtflow.llm.shared import map_arrow, stored

#: Entropy decides a style node that this many pages have with different texts as a whole, as copies of one page prove nothing.
SUPPORT = 2
#: With this many pages it decides without that proof.
MANY_PAGES = 8
#: Composite importance below which a branch goes, as a share of the content importance of the host's whole pages: where pages are
#: copies of each other, what they repeat isn't a sign of a template.
LEAST_IMPORTANCE = 0.2
#: Weight of the presentation; the content has the rest.
PRESENTATION = 0.3
#: The style node of a host's whole pages.
ROOT = 0
#: Removed style nodes of all hosts are broadcast up to this many bytes, and joined by host beyond.
BROADCAST_BYTES = 8 << 20

# HTML's element kinds and the names that state a role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg annotation annotation-xml object canvas audio video textarea title head select".split())
#: Of those, the ones that hold the rest of the page where their end tag is missing.
TO_THE_END = frozenset("script style textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
NOISE_TAGS = frozenset("nav aside footer form button fieldset input dialog menu".split())
NOISE_NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar sidebars aside ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored "
    "promo promotion promoted cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup share sharing social related recommended "
    "recommendations comment comments commentlist discussion disqus replies respond widget widgets form login search pagination pager toolbar skip disclaimer".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
HEADER_NAMES = frozenset("header masthead banner topbar".split())
ARTICLE_NAMES = frozenset("article articlebody".split())
COMMENT_NAMES = frozenset("comment comments commentlist discussion disqus replies respond".split())

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
#: The end of each raw element; a head ends with the body's start too, when its end tag is missing.
_ENDS = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)[^>]*(?:>|\Z)" if x != "head" else r"(?=</head(?:[\s/>]|\Z)|<body(?:[\s/>]|\Z))", re.A | re.I) for x in RAW}
_UNREAD = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\Z)", re.A | re.I | re.S)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element(NamedTuple):
    tag: str
    style: int
    role: int
    article: bool
    noise: str
    #: its own names say that it is noise
    own: bool
    #: the innermost style node around its text that may be removed, as a place in Page.nodes; -1 for none
    node: int
    #: texts, and texts of noise, before it
    before: tuple[int, int]


class Branch:
    """What a page has below one style node, as hashes; noise: whether its role says that it is noise."""

    __slots__ = ("children", "text", "noise")

    def __init__(self, noise: bool):
        self.children = self.text = 0
        self.noise = noise


class Sequence:
    """Hashes of stretches of a list that only grows, each in constant time."""

    __slots__ = ("sums", "powers")

    def __init__(self) -> None:
        self.sums, self.powers = [0], [1]

    def add(self, x: int) -> None:
        self.sums.append((self.sums[-1] * _FACTOR + x + 1) % _PRIME)
        self.powers.append(self.powers[-1] * _FACTOR % _PRIME)

    def between(self, a: int, b: int) -> int:
        return (self.sums[b] - self.sums[a] * self.powers[b - a]) % _PRIME

    def __len__(self) -> int:
        return len(self.sums) - 1


_PRIME, _FACTOR = (1 << 61) - 1, 0x9E3779B97F4A7C15 % ((1 << 61) - 1)


def _digest(x: str) -> int:
    return int.from_bytes(blake2b(x.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


@lru_cache(1 << 15)
def _described(tag: str, raw: str) -> tuple[str, str, frozenset[str], bool]:
    """A start tag's label, stated role, names, and whether it is an article."""
    a = {m[1].lower(): html.unescape(m[2].strip("\"'")) for m in _ATTRIBUTE.finditer(raw)} if raw.strip() else {}
    stated = a.get("role", "").lower()
    label = " ".join([tag, *sorted(re.sub(r"\d+", "#", f"{a.get('class', '')} {a.get('id', '')}").split())])
    names = frozenset(x.lower() for k in ("class", "id") for x in _WORDS.findall(a.get(k, "")))
    article = tag in ("article", "main") or stated in ("article", "main") or "articlebody" in a.get("itemprop", "").lower() or bool(names & ARTICLE_NAMES and names & {"body", "content", "text"})
    return label, stated, names, article


@lru_cache(1 << 15)
def _style(parent: int, label: str) -> int:
    return _digest(f"{parent}>{label}")


def tags(source: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, tag, attributes, whether an end tag) of each tag; comments, declarations and the like have the tag ''.

    A tag ends at the first > outside of quotes or, without one, at the first >. Each character is looked at a bounded number of times:
    failed is where a search outside of quotes has been that found none to the end, so that a later search stops there.
    """
    at, failed, last = 0, set(), source.rfind(">")
    while True:
        start = source.find("<", at)
        if start < 0:
            return
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = len(source) if end < 0 else end + 3
            at = (yield start, at, "", "", False) or at
            continue
        if last < start:  # no tag ends any more
            at = len(source) if source.find("<!--", start) < 0 else source.find("<!--", start)
            continue
        if source.startswith(("<!", "<?"), start):
            at = source.find(">", start) + 1
            at = (yield start, at, "", "", False) or at
            continue
        m = _NAME.match(source, start)
        if not m:
            at = start + 1
            continue
        i, path = m.end(), []
        while (stop := _STOP.search(source, i)) and stop[0] != ">":
            i = source.find(stop[0], stop.end()) + 1
            if not i or i in failed:
                stop = None
                break
            path.append(i)
        if stop is None:
            failed.update(path)
            end = source.find(">", m.end())
        else:
            end = stop.start()
        if end < 0:
            at = start + 1
            continue
        at = end + 1
        at = (yield start, at, m[1].lower(), source[m.end() : end], source[start + 1] == "/") or at


class Page:
    """A parsed page: its text in pieces, each with the style nodes it lies in."""

    def __init__(self, source: str | None):
        #: (text, the innermost style node around it that may be removed)
        self.pieces: list[tuple[str, int]] = []
        #: (style, the node around it)
        self.nodes: list[tuple[int, int]] = []
        #: by style node; ROOT stands for the whole page
        self.branches: dict[int, Branch] = {ROOT: Branch(False)}
        self._source = source or ""
        #: by tag: whether as many end as start
        self._even: dict[str, bool] = {}
        self._texts, self._noise = Sequence(), Sequence()
        self._stack = [Element("", 0, 0, False, "", False, -1, (0, 0))]
        #: places in the stack: by tag, of elements that aren't inline, of articles
        self._open: dict[str, list[int]] = {}
        self._blocks: list[int] = []
        self._articles: list[int] = []
        self._styles: list[int] = []
        self._parse(self._source)

    def _pop(self, to: int) -> None:
        """Ends the open elements from a place in the stack on."""
        while len(self._stack) > to:
            e = self._stack.pop()
            self._open[e.tag].pop()
            if e.tag not in INLINE:
                self._blocks.pop()
            if e.tag in ("article", "main"):
                self._articles.pop()
            if e.role:
                self._styles.pop()
                b = self.branches[e.style]
                seen = self._noise.between(e.before[1], len(self._noise)) if b.noise else self._texts.between(e.before[0], len(self._texts))
                b.text = (b.text * _FACTOR + seen + 1) % _PRIME

    def _parse(self, source: str) -> None:
        stack, endless, at = self._stack, set(), 0
        found = tags(source)
        item = next(found, None)
        while item is not None:
            start, end, tag, raw, closing = item
            self._put(source[at:start])
            at, skip = end, None
            if tag:
                if tag not in INLINE:
                    self.pieces.append((" ", -1))
                if closing:
                    places = self._open.get(tag)
                    if places and not (self._articles and self._articles[-1] > places[-1] and tag in ("p", "li", "b", "a", "i", "span")):
                        self._pop(places[-1])
                elif tag in RAW:
                    if (not raw.endswith("/") or tag in TO_THE_END) and tag not in endless:
                        close = _ENDS[tag].search(source, at)
                        if close:
                            at = skip = close.end()
                        elif tag in TO_THE_END:
                            at = skip = len(source)
                        else:  # what follows is read as if the tag weren't there
                            endless.add(tag)
                else:
                    closes = ("p",) if tag in ENDS_PARAGRAPH else SIBLINGS.get(tag, ())
                    if self._blocks and stack[self._blocks[-1]].tag in closes:
                        self._pop(self._blocks[-1])
                    if tag not in VOID:
                        self._start(tag, raw)
            try:
                item = found.send(skip) if skip is not None else next(found)
            except StopIteration:
                item = None
        self._put(source[at:])
        self._pop(1)
        self.branches[ROOT].text = self._texts.between(0, len(self._texts))

    def _closed(self, tag: str) -> bool:
        """Whether elements of this kind are properly closed: the page has as many of their end tags as of their start tags."""
        if tag not in self._even:
            plain = _UNREAD.sub("", self._source)
            starts, ends = (len(re.findall(rf"<{x}{re.escape(tag)}(?=[\s/>])", plain, re.A | re.I)) for x in ("", "/"))
            self._even[tag] = starts == ends
        return self._even[tag]

    def _start(self, tag: str, raw: str) -> None:
        """role 0: no style node of its own; 1: entropy alone decides; 2: its names say that it is noise, below which nothing needs a decision."""
        parent = self._stack[-1]
        label, stated, names, is_article = _described(tag, raw) if len(raw) < 400 else _described.__wrapped__(tag, raw)
        style = _style(parent.style, label)
        noise, article, node, own = parent.noise, parent.article, parent.node, False
        if is_article and not names & COMMENT_NAMES and (not noise or noise == "open" and not any(e.own and e.noise and self._closed(e.tag) for e in self._stack)):
            # an advert or menu before the article that was never closed doesn't hold the article
            noise, article, node = "", True, -1 if noise else node
        elif names & COMMENT_NAMES or tag in ("aside", "footer") or stated in ("complementary", "contentinfo"):
            noise, own = "closed", True
        elif tag in NOISE_TAGS or stated in NOISE_ROLES or names & NOISE_NAMES or (not article and (tag == "header" or names & HEADER_NAMES)):
            noise, own = noise or "open", True
        if noise:
            role = 0 if parent.noise == noise else 2
        else:
            role = int(not is_article and tag not in ("html", "body") and (bool(names) if article else tag not in INLINE))
        if self._styles:
            b = self.branches[self._styles[-1]]
            b.children = (b.children * _FACTOR + (style & 0xFFFF) + 1) % _PRIME
        if role:
            self._styles.append(style)
            self.branches.setdefault(style, Branch(role == 2))
            self.nodes.append((style, node))
            node = len(self.nodes) - 1
        at = len(self._stack)
        self._open.setdefault(tag, []).append(at)
        if tag not in INLINE:
            self._blocks.append(at)
        if tag in ("article", "main"):
            self._articles.append(at)
        self._stack.append(Element(tag, style, role, article, noise, own, node, (len(self._texts), len(self._noise))))

    def _put(self, text: str) -> None:
        if text:
            top = self._stack[-1]
            self.pieces.append((text, top.node))
            if not text.isspace():
                (self._noise if top.noise else self._texts).add(_digest(text.strip()))

    def main_text(self, removed: frozenset[int] | set[int]) -> str:
        """All text without the removed branches."""
        gone: list[bool] = []
        for style, above in self.nodes:
            gone.append(style in removed or above >= 0 and gone[above])
        # references are decoded in each stretch of text, so that none is made up of two stretches
        return " ".join("".join(html.unescape(t) if "&" in t else t for t, node in self.pieces if node < 0 or not gone[node]).split())


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", url or "")
    return m[1].lower() if m else ""


def style_nodes(pages: DataFrame) -> DataFrame:
    """host, style, kind (0 presentation, 1 content), value, named and n: what a host's pages have below each style node.

    named: on some of these pages its names say that it is noise. Null or empty html has the whole page's node alone; a null URL has the host ''; repeated pages count each time; an empty
    table gives no rows.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter = Counter()
        for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            host = host_of(url)
            for style, b in Page(source).branches.items():
                counts[host, style, 0, b.children, b.noise] += 1
                counts[host, style, 1, b.text, b.noise] += 1
        rows = [(*k, n) for k, n in counts.items()]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["host", "style", "kind", "value", "named", "n"])

    seen = map_arrow(pages.select(pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html")), each, "host string, style long, kind int, value long, named boolean, n long")
    # summed by value first, so that one host with most pages is spread over tasks
    return seen.groupBy("host", "style", "kind", "value").agg(F.max("named").alias("named"), F.sum("n").alias("n"))


def judged(nodes: DataFrame) -> DataFrame:
    """host, style, m (its pages), importance and by of each style node: 'entropy' or 'names' say that it goes, null that it stays.

    Entropy says so below LEAST_IMPORTANCE, where enough pages show the node; names are asked where it doesn't. nodes is read twice.
    """
    entropy = (
        nodes.groupBy("host", "style", "kind")
        .agg(F.sum("n").alias("m"), F.count(F.lit(1)).alias("values"), F.max("named").alias("named"), F.sum(F.col("n") * F.log2("n")).alias("s"))
        .withColumn("importance", F.when(F.col("m") > 1, (F.log2("m") - F.col("s") / F.col("m")) / F.log2("m")).otherwise(1.0))
    )
    both = entropy.groupBy("host", "style").agg(
        F.max("m").alias("m"), F.max("named").alias("named"), F.sum(F.col("importance") * F.when(F.col("kind") == 0, PRESENTATION).otherwise(1 - PRESENTATION)).alias("importance")
    )
    whole = entropy.filter((F.col("style") == ROOT) & (F.col("kind") == 1)).select("host", F.col("importance").alias("whole"), (F.col("m") - F.col("values")).alias("copies"))
    both = both.filter(F.col("style") != ROOT).join(whole, "host")
    # of m pages at least m - copies differ as a whole
    supported = (F.col("m") - F.col("copies") >= SUPPORT) | (F.col("m") >= MANY_PAGES)
    by = F.when(supported & (F.col("importance") < LEAST_IMPORTANCE * F.col("whole")), "entropy").when(F.col("named"), "names")
    return both.select("host", "style", "m", "importance", by.alias("by"))


def unimportant(nodes: DataFrame) -> DataFrame:
    """host and the array removed of its style nodes that go; a host without such nodes has no row."""
    return judged(nodes).filter(F.col("by").isNotNull()).groupBy("host").agg(F.sort_array(F.collect_set("style")).alias("removed"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null or empty html gives an empty text; a null URL has the host ''; repeated pages are handled alike; an empty table gives no
    rows; other columns are not read. White space is what Unicode calls so. All of the body that isn't noise is the text, in an
    article element or not. A header inside an article is part of it. An article inside properly closed noise is noise.
    """
    slim = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    # pages are parsed once for the tree, and again for their texts, as parsed pages are larger than pages
    low = stored(unimportant(stored(style_nodes(slim), "style_nodes", compact=True)), "removed", compact=True)
    size = low.agg(F.coalesce(F.sum(F.size("removed") * 8 + F.octet_length("host") + 32), F.lit(0)).alias("b")).first()["b"]
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1))
    if not size:
        joined = slim.withColumn("removed", F.lit(None).cast("array<long>"))
    else:  # many pages to one row: a host with most pages is split by the skew join
        joined = slim.withColumn("host", host).join(F.broadcast(low) if size <= BROADCAST_BYTES else low, "host", "left").drop("host")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        removed = [frozenset(x or ()) for x in batch.column("removed").to_pylist()]
        texts = [Page(h).main_text(r) for h, r in zip(batch.column("html").to_pylist(), removed, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(joined, each, "page_id long, url string, text string, n_chars long")
