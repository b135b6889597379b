"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative, with weights learned from labelled
pages: a word's weight is its log odds of standing in the content, a tag's is the lower the more it stands outside or
at the content's edge. Words that stand in a marked element score by the mark instead: marks are the element's own kind
(`<nav>`, `<footer>`, `<form>`), its role and the words of its class and id, and a mark's weight is the log odds that words
under it are content, from the same labelled pages. One linear scan finds the contiguous region with the largest sum.

Edges: a region of which a quarter of the words or more stand in article or main elements, and over half of these in one,
ends with that one (what follows it are comments and the like); else it grows to the ends of the innermost element around it while that holds prose, and takes a heading right before it. In the region,
elements whose marks score below zero are left out, unless by class, id, role or being a form they are or hold the
page's largest article or main element, by words, or, on a page without any, more than half of its words: such an element
is a wrapper, not a part; so is one of any kind if the page's only articles stand in such ones. What is not shown (hidden, aria-hidden, display: none) and raw elements (scripts, styles) never
count.

Labelled pages are the built-in templates of `labelled_pages` and at most TRAIN_PAGES pages of the table, in the order
of a hash of page_id, whose markup has exactly one article or main element: what it holds is the content.

Text: character references are decoded, white space within a block becomes one space, blocks are joined in page order
by two line feeds. Line breaks (br) and inline elements do not end a block.

Defined results: null html is an empty page, with an empty text; a page without content words gives an empty text;
tags that are never closed end with their parents; unclosed comments, scripts and tags run to the end of the page;
rows that repeat each keep a row; an empty table gives an empty result; only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import in_arrow

TRAIN_PAGES = 400
#: Bounds of what is learned: words stay positive, tags negative.
LEAST_WORD, LEAST_TAG, MOST_TAG = 0.2, -6.0, -0.02

_TAG = r"""</?[A-Za-z][^\s/>]*(?:"[^"]*"|'[^']*'|[^>])*+(?:>|\Z)"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|{_TAG}", re.DOTALL)
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
HIDDEN = re.compile(r"\shidden(?=[\s>/])")

RAW = frozenset(["script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
#: Elements whose kind is a mark.
KINDS = frozenset(["head", "nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "svg", "canvas", "audio", "video", "datalist"])
#: Elements that no class, id or role marks: what they hold is the page.
WHOLE = frozenset(["html", "body", "main"])
BLOCKS = frozenset(
    [
        *("address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form"),
        *("h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"),
    ]
)
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: An open element of the key ends where one of the values begins.
ENDS = {"p": BLOCKS - {"body", "html", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


def _words(text: str) -> int:
    return len(text.split())


class Page:
    """Events (tag or empty, text, element): tags as `p` or `/p`, texts undecoded, an end tag in the innermost open element.

    Of each element, numbered in page order, 0 the page: its name, parent, kind mark, soft marks, own words, whether it
    is hidden, and the events from `first` to before `last`.
    """

    def __init__(self, page: str):
        self.events: list[tuple[str, str, int]] = []
        self.names, self.parents, self.kinds, self.soft, self.own, self.hidden, self.first, self.last = [""], [0], [""], [()], [0], [False], [0], [0]
        self._parse(page)
        n = len(self.events)
        self.last = [z if z >= 0 else n for z in self.last]
        self.last[0] = n

    def _marks(self, name: str, tag: str, open_names: Counter) -> None:
        kind = f"<{name}>" if name in KINDS and name != "form" or name == "header" and not (open_names["article"] or open_names["main"]) else ""
        soft: list[str] = ["<form>"] if name == "form" else []
        hidden = False
        if name not in WHOLE and ("=" in tag or "hidden" in tag):
            for key, value in ATTRIBUTE.findall(tag):
                key, value = key.lower(), value.strip("\"'")
                if key in ("class", "id"):
                    soft += _SPLIT.split(_CAMEL.sub("-", value).lower())
                elif key == "role":
                    soft.append(f"role={value.lower()}")
                elif key == "aria-hidden" and value.lower() == "true" or key == "style" and UNSEEN.search(value):
                    hidden = True
            hidden = hidden or bool(HIDDEN.search(tag))
        self.kinds.append(kind)
        self.soft.append(tuple(filter(None, soft)))
        self.hidden.append(hidden)

    def _parse(self, page: str) -> None:
        events, at, n = self.events, 0, len(page)
        stack: list[int] = [0]
        block_at: list[int] = []  # the places in the stack of open block elements
        open_names: Counter = Counter()

        def close() -> None:
            e = stack.pop()
            self.last[e] = len(events)
            open_names[self.names[e]] -= 1
            if block_at and block_at[-1] == len(stack):
                block_at.pop()

        while at < n:
            m = TOKEN.search(page, at)
            start = m.start() if m else n
            if start > at:
                text = page[at:start]
                self.own[stack[-1]] += _words(text)
                events.append(("", text, stack[-1]))
            if not m:
                return
            at = m.end()
            tag = m.group()
            if tag[1] in "!?":
                continue
            name = NAME.match(tag).group(1).lower()
            if tag[1] == "/":
                if open_names[name] > 0:
                    events.append(("/" + name, "", stack[-1]))
                    while self.names[stack[-1]] != name:
                        close()
                    close()
                continue
            while name in ENDS.get(self.names[stack[-1]], ()):
                close()
            if name in BLOCKS and block_at and self.names[stack[block_at[-1]]] == "p":  # its inline elements were never closed
                for _ in range(len(stack) - block_at[-1]):
                    close()
            if name in VOID or tag.endswith("/>") and name in ("svg", "path"):
                events.append((name, "", stack[-1]))
                continue
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = end.end() if end else n
                continue
            e = len(self.names)
            self._marks(name, tag, open_names)
            self.names.append(name)
            self.parents.append(stack[-1])
            self.own.append(0)
            self.first.append(len(events))
            self.last.append(-1)
            if name in BLOCKS:
                block_at.append(len(stack))
            stack.append(e)
            open_names[name] += 1
            events.append((name, "", e))

    def totals(self, counted: list[bool] | None = None) -> list[int]:
        """The words in each element and what it holds, of counted elements."""
        words = [w if counted is None or counted[e] else 0 for e, w in enumerate(self.own)]
        for e in range(len(words) - 1, 0, -1):
            words[self.parents[e]] += words[e]
        return words

    def _largest(self, words: list[int]) -> set[int]:
        """The article or main element with the most words and all around it."""
        bodies = [e for e in range(1, len(words)) if self.names[e] in ("article", "main") and words[e]]
        out, e = set(), max(bodies, key=lambda e: words[e], default=0)
        while e:
            out.add(e)
            e = self.parents[e]
        return out

    def levels(self, marks: dict[str, float]) -> list[float]:
        """Of each element 0.0 if it is content by its marks, else the weight of a word in it."""
        n = len(self.names)
        own = [LEAST_TAG if h else marks.get(k, 0.0) if k else 0.0 for h, k in zip(self.hidden, self.kinds, strict=True)]
        soft = [min(0.0, min(marks.get(x, 0.0) for x in s)) if s else 0.0 for s in self.soft]
        kept: set[int] = set()
        if any(soft) or any(own):
            hard = self._down(own)
            words = self.totals([h == 0 for h in hard])
            kept = self._largest(words)
            if not kept:  # a menu, say, that was never closed may hold the article
                unseen = self._down([LEAST_TAG if h or k == "<head>" else 0.0 for h, k in zip(self.hidden, self.kinds, strict=True)])
                kept = self._largest(self.totals([u == 0 for u in unseen]))
                own = [0.0 if e in kept else w for e, w in enumerate(own)]
            if not kept:
                kept = {e for e in range(1, n) if 2 * words[e] > words[0]}
        return self._down([min(w, 0.0 if e in kept else soft[e]) for e, w in enumerate(own)])

    def _down(self, own: list[float]) -> list[float]:
        """The least of an element's own and all around it."""
        out = [0.0] * len(own)
        for e in range(1, len(own)):
            out[e] = min(out[self.parents[e]], own[e])
        return out

    def bodies(self) -> list[int]:
        """Of each element the innermost article or main element around it, itself included; 0 if there is none."""
        out = [0] * len(self.names)
        for e in range(1, len(out)):
            out[e] = e if self.names[e] in ("article", "main") else out[self.parents[e]]
        return out


class Weights:
    """Of a word, of each tag and of each mark; unknown tags weigh as much as the mean, within an article or main element
    nearly nothing; unknown marks nothing."""

    def __init__(self, word: float, tags: dict[str, float], marks: dict[str, float]):
        self.word, self.tags, self.marks = word, tags, marks
        self.other = sum(tags.values()) / len(tags) if tags else -1.0

    def of(self, tag: str) -> float:
        got = self.tags.get(tag)
        return got if got is not None else MOST_TAG if tag[0] == "+" else self.other

    @classmethod
    def learn(cls, labelled: list[tuple[Page, int]]) -> Weights:
        """labelled: pages with the number of the element that holds the content."""
        marks = mark_odds(*mark_counts(labelled))
        inside, outside = tag_counts(labelled, marks)
        return cls.of_counts(inside, outside, marks)

    @classmethod
    def of_counts(cls, inside: Counter, outside: Counter, marks: dict[str, float]) -> Weights:
        kinds = {*inside, *outside, ""}
        n_in, n_out = sum(inside.values()) + len(kinds), sum(outside.values()) + len(kinds)
        odds = {k: math.log((inside[k] + 1) / n_in) - math.log((outside[k] + 1) / n_out) for k in kinds}
        word = max(LEAST_WORD, min(1.0, odds.pop("")))
        return cls(word, {k: max(LEAST_TAG, min(MOST_TAG, v)) for k, v in odds.items()}, marks)

    def with_other(self, other: Weights) -> Weights:
        """The mean of two, so that one table's layout does not hide all others; tags of one only as they are."""
        both = {*self.tags, *other.tags}
        tags = {k: (self.tags.get(k, other.tags.get(k)) + other.tags.get(k, self.tags.get(k))) / 2 for k in both}
        return Weights((self.word + other.word) / 2, tags, other.marks | self.marks)


def mark_counts(labelled: list[tuple[Page, int]]) -> tuple[Counter, Counter]:
    """The words under each mark, within the content and without. Elements around the content mark nothing."""
    inside, outside = Counter(), Counter()
    for page, body in labelled:
        words = page.totals()
        around, e = {body}, body
        while e:
            e = page.parents[e]
            around.add(e)
        in_body = [False] * len(page.names)
        for e in range(1, len(page.names)):
            in_body[e] = page.parents[e] == body or in_body[page.parents[e]]
            if e not in around:
                for x in {*page.soft[e], *([page.kinds[e]] if page.kinds[e] else [])}:
                    (inside if in_body[e] else outside)[x] += words[e]
    return inside, outside


def mark_odds(inside: Counter, outside: Counter) -> dict[str, float]:
    """Log odds, a word more on each side."""
    return {x: max(LEAST_TAG, math.log((inside[x] + 1) / (outside[x] + 1))) for x in {*inside, *outside}}


def labels_of(page: Page, body: int, marks: dict[str, float]) -> Iterator[tuple[str, int, bool]]:
    """(tag or empty, words, in the content) of what the marks leave; tags within an article or main element have a + before."""
    levels, bodies = page.levels(marks), page.bodies()
    for i, (tag, text, e) in enumerate(page.events):
        if levels[e] == 0:
            edge = tag.lstrip("/") in ("article", "main")
            yield ("+" if tag and bodies[e] and not edge else "") + tag, _words(text), page.first[body] < i < page.last[body] and not (edge and e == body)


def tag_counts(labelled: list[tuple[Page, int]], marks: dict[str, float]) -> tuple[Counter, Counter]:
    inside, outside = Counter(), Counter()
    for page, body in labelled:
        for tag, words, content in labels_of(page, body, marks):
            if tag.strip("+/") != "content":
                (inside if content else outside)[tag] += words if not tag else 1
    return inside, outside


def _html(body: str, title: str = "T") -> str:
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{body}</body></html>"


#: Words of classes and ids, and roles, under which labelled pages have no content; those that they have on both sides.
OUTSIDE_MARKS = (
    *("ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "banner", "sponsor", "sponsored", "sponsors", "promo", "promos", "promoted", "promotion"),
    *("cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "paywall", "newsletter", "subscribe", "subscription", "signup", "signin", "login"),
    *("social", "share", "sharing", "shares", "follow", "comment", "comments", "commentlist", "disqus", "respond", "replies", "reply", "reactions"),
    *("sidebar", "aside", "rail", "widget", "widgets", "related", "recommended", "recommendations", "trending", "teaser", "teasers"),
    *("nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "skip", "footer", "masthead", "topbar", "copyright"),
    *("popup", "modal", "overlay", "lightbox", "tooltip", "searchbox", "hidden"),
    *(f"role={r}" for r in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar", "tablist")),
)
EITHER_MARKS = ("content", "main", "text", "body", "post", "entry", "story", "section", "discussion", "legal", "print", "popular", "disclaimer", "register", "search", "toc", "header", "box", "info", "note", "list", "wrapper")


def labelled_pages() -> list[tuple[Page, int]]:
    """Pages of common layouts; the content element marks what is content."""
    words = lambda n: " ".join(["word"] * n)
    links = lambda n: "".join(f"<li><a href=x>{words(1 + i % 2)}</a></li>" for i in range(n))
    paragraphs = "".join(f"<p>{words(n)} <b>{words(2)}</b> {words(n // 2)} <a href=x>{words(2)}</a>, <em>{words(1)}</em>.</p>" for n in (40, 12, 60, 5, 30))
    boxes = f"<div><div><p>{words(22)}</p></div><div><p><span>{words(9)}</span> {words(11)}</p><ul><li>{words(7)}</li><li><a href=x>{words(2)}</a> {words(6)}</li></ul></div><section><h2>{words(4)}</h2><p>{words(35)}</p></section></div>"
    rich = f"<h1>{words(7)}</h1><p>{words(30)}</p><h2>{words(4)}</h2>{paragraphs}<ul><li>{words(9)}</li><li>{words(12)}</li></ul><blockquote><p>{words(20)}</p></blockquote><h3>{words(3)}</h3><pre><code>{words(15)}</code></pre><table><tr><th>{words(2)}</th><td>{words(3)}</td></tr></table><figure><img src=x><figcaption>{words(8)}</figcaption></figure><p>{words(25)}<br>{words(10)}</p>{boxes}"
    lists = f"<ul>{''.join(f'<li>{words(n)}</li>' for n in (2, 9, 4, 14, 3, 7, 5, 11))}</ul><ol>{''.join(f'<li><b>{words(1)}</b> {words(n)}</li>' for n in (8, 3, 6))}</ol>"
    rich += lists
    top = f"<div><a href=/><img src=x></a><span>{words(2)}</span></div><div><ul>{links(8)}</ul></div><div><div><span>{words(3)}</span> <span>{words(2)}</span></div></div>"
    bottom = f"<div><div><h4>{words(2)}</h4><ul>{links(6)}</ul></div><div><span>{words(4)}</span><a href=x>{words(2)}</a></div><small>{words(6)}</small></div>"
    element = lambda x, inner: f"<div {'role=' + x[5:] if x.startswith('role=') else 'class=' + x}>{inner}</div>"
    kinds = "".join(f"<{k}>{words(12)}</{k}>" for k in (*sorted(KINDS - {"option", "datalist", "head"}), "header"))
    marked = kinds + "".join(element(x, words(12)) for x in (*OUTSIDE_MARKS, *EITHER_MARKS))
    either = "".join(element(x, f"<p>{words(30)}</p>") for x in EITHER_MARKS)
    layouts = [
        f"{top}<article><content>{rich}</content></article>{bottom}",
        f"{top}<main><content>{rich}</content></main>{bottom}",
        f"{top}<main><article><content><h1>{words(8)}</h1>{paragraphs}</content></article></main>{bottom}",
        f"{top}<div><div><content><h1>{words(8)}</h1>{paragraphs}{lists}{boxes}</content></div><div><h3>{words(2)}</h3><ul>{links(9)}</ul></div></div>{bottom}",
        f"{top}<section><content>{paragraphs}{lists}{paragraphs}</content></section><section><h3>{words(2)}</h3><div><a href=x>{words(5)}</a></div><div><a href=x>{words(6)}</a></div></section>{bottom}",
        f"<table><tr><td>{links(5)}</td><td><content>{paragraphs}</content></td></tr></table>{bottom}",
        f"{top}{marked}<article><content>{paragraphs}{either}</content></article>{bottom}",
    ]
    pages = [Page(_html(body)) for body in layouts]
    return [(p, p.names.index("content")) for p in pages]


def self_labelled(html: str) -> tuple[Page, int] | None:
    """A page with exactly one article or, without any, one main element labels itself."""
    page = Page(html)
    for name in ("article", "main"):
        found = [e for e, x in enumerate(page.names) if x == name]
        if found:
            return (page, found[0]) if len(found) == 1 else None
    return None


def _scan(page: Page, levels: list[float], bodies: list[int], weights: Weights) -> tuple[int, int]:
    """The events [from, to) of the largest sum; a run of what marks leave out costs no more than one tag can."""
    best = (0.0, 0, 0)
    total, start, lost = 0.0, 0, 0.0
    for i, (tag, text, e) in enumerate(page.events):
        if levels[e] < 0:
            step = max(levels[e] * (_words(text) if not tag else 0), LEAST_TAG - lost)
            lost += step
        else:
            lost = 0.0
            step = weights.word * _words(text) if not tag else weights.of("+" + tag if bodies[e] and tag.lstrip("/") not in ("article", "main") else tag)
        total += step
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best[0]:
            best = (total, start, i + 1)
    return best[1], best[2]


def _edges(page: Page, levels: list[float], bodies: list[int], a: int, z: int) -> tuple[int, int]:
    """The region [a, z) moved to where its article ends."""
    inside = [0] * len(page.names)
    shown = [(i, e, _words(text)) for i, (tag, text, e) in enumerate(page.events) if not tag and levels[e] == 0]
    core = [(i, e, n) for i, e, n in shown if a <= i < z and n]
    if not core:
        return a, z
    for _, e, n in core:
        inside[e] += n
    for e in range(len(inside) - 1, 0, -1):
        inside[page.parents[e]] += inside[e]
    marked = sum(n for _, e, n in core if bodies[e])
    most = [e for e, n in enumerate(inside) if bodies[e] == e and e and 2 * n > marked]
    if most and 4 * marked >= sum(n for *_, n in core):
        b = max(most)  # elements are numbered from the outside in
        return page.first[b], page.last[b]
    # the innermost element around the region
    at = core[0][1]
    while not (page.first[at] <= core[0][0] and core[-1][0] < page.last[at]):
        at = page.parents[at]
    while at and page.names[at] not in BLOCKS:
        at = page.parents[at]
    if at and page.names[at] not in WHOLE:
        linked = [False] * len(page.names)
        for e in range(1, len(linked)):
            linked[e] = page.names[e] == "a" or linked[page.parents[e]]
        for lo, hi in ((page.first[at], a), (z, page.last[at])):
            more = [(e, n) for i, e, n in shown if lo <= i < hi and n]
            if 2 * sum(n for e, n in more if linked[e]) < sum(n for _, n in more):
                a, z = min(a, lo), max(z, hi)
    # a heading right before it
    i = a - 1
    while i >= 0 and (page.events[i][0] or not page.events[i][1].strip() or levels[page.events[i][2]] < 0):
        i -= 1
    e = page.events[i][2] if i >= 0 else 0
    while e and page.names[e] not in HEADINGS and page.names[e] not in BLOCKS:
        e = page.parents[e]
    return (min(a, page.first[e]), z) if page.names[e] in HEADINGS else (a, z)


def main_text(html: str, weights: Weights) -> str:
    page = Page(html)
    levels, bodies = page.levels(weights.marks), page.bodies()
    a, z = _edges(page, levels, bodies, *_scan(page, levels, bodies, weights))
    blocks: list[str] = []
    block: list[str] = []

    def end() -> None:
        line = _SPACE.sub(" ", entities.unescape("".join(block))).strip()
        if line:
            blocks.append(line)
        block.clear()

    for tag, text, e in page.events[a:z]:
        if tag.lstrip("/") in BLOCKS:
            end()
        elif levels[e] == 0:
            block.append(" " if tag == "br" else text)
    end()
    return "\n\n".join(blocks)


def learn_weights(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> Weights:
    rows = pages.select(F.col("html").cast("string").alias("html"), F.xxhash64(F.col("page_id").cast("long"), F.sha2(F.col("html").cast("string"), 256)).alias("place"))
    rows = rows.filter(F.col("html").rlike("(?i)<(article|main)[ >]"))
    some = F.broadcast(rows.select("place").orderBy("place").limit(train_pages).distinct())  # at most train_pages numbers
    marks = Weights.learn(labelled_pages()).marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter() for _ in range(4)]
        for b in batches:
            for h in b.column(0):
                if one := self_labelled(h.as_py()):
                    for total, part in zip(counts, (*mark_counts([one]), *tag_counts([one], marks)), strict=True):
                        total.update(part)
        found = [(i, x, n) for i, c in enumerate(counts) for x, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64()))], names=["kind", "name", "n"])

    # a bounded number of pages; of names there are at most as many rows as those pages have
    sums = in_arrow(rows.join(some, "place", "left_semi").select("html"), run, "kind int, name string, n long").groupBy("kind", "name").agg(F.sum("n").alias("n")).collect()
    counts = [Counter({r["name"]: r["n"] for r in sums if r["kind"] == k}) for k in range(4)]
    known = Weights.learn(labelled_pages())
    return known.with_other(Weights.of_counts(counts[2], counts[3], mark_odds(counts[0], counts[1]))) if sums else known


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    w = weights or learn_weights(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), w) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return in_arrow(rows, run, "page_id long, url string, text string, n_chars long")
