"""Links, listing tables and the frontier of a crawl.

HTML is parsed in Arrow batches with the standard library; what follows from the parse are Columns and joins.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamplight.functions.dates import extract_date
from lamplight.functions.naming import category, is_followed_link, is_pdf_link
from lamplight.functions.strings import SPACE, or_default, strip_chars, text_or_empty
from lamplight.sources.shared import in_pandas, stored

from .incremental import numbered

# Fixed values, to ORDER_LABEL: extensions that are no pages; the words in a listing's header cells and the fields that they
# name; what is cut off the end of an order number.
SKIPPED = (".pdf", ".jpg", ".jpeg", ".png", ".gif", ".zip", ".xlsx", ".xls", ".doc", ".docx", ".ppt", ".pptx", ".mp4", ".mp3", ".rar", ".csv")
HEADER_WORDS = (("ವಿಷಯ", "subject"), ("ದಿನಾಂಕ", "order"), ("ಮೂಲ", "source_org"), ("ಮಾಧ್ಯಮ", "medium"), ("ಗಾತ್ರ", "size_reported"))
TRAILING_DATE = rf"[,;]?{SPACE}*\p{{Nd}}{{1,2}}[/.-]\p{{Nd}}{{1,2}}[/.-]\p{{Nd}}{{4}}{SPACE}*$"
ORDER_LABEL = rf"[,;]?{SPACE}*ದಿನಾಂಕ{SPACE}*[:ः]?{SPACE}*$"

_VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
_IMPLIED = {"tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}


class _Page(HTMLParser):
    """Anchors with their text, their cell's row and that row's table; the title."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.title: list[str] = []
        self.anchors: list[dict] = []
        self.tables: list[dict] = []  # open tables
        self.open_anchor: dict | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._imply(tag)
        if tag == "table":
            self.tables.append({"rows": []})
        elif tag == "tr" and self.tables:
            self.tables[-1]["rows"].append({"cells": [], "th": False, "strong": False})
        elif tag in ("td", "th") and self._row():
            self._row()["cells"].append([])
            self._row()["th"] |= tag == "th"
        elif tag == "strong" and self._row():
            self._row()["strong"] = True
        elif tag == "a":
            href = dict(attrs).get("href")
            if href is not None:
                table = self.tables[-1] if self.tables and self.tables[-1]["rows"] else None
                self.open_anchor = {"href": href, "text": [], "table": table, "row": table["rows"][-1] if table else None}
                self.anchors.append(self.open_anchor)
        if tag not in _VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.stack:
            return
        while (top := self.stack.pop()) != tag:
            self._close(top)
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if "title" in self.stack and not self.tables:
            self.title.append(data)
        if "script" in self.stack or "style" in self.stack:
            return
        if self.open_anchor is not None:
            self.open_anchor["text"].append(data)
        for t in self.tables:
            if t["rows"] and t["rows"][-1]["cells"]:
                t["rows"][-1]["cells"][-1].append(data)

    def _row(self) -> dict | None:
        return self.tables[-1]["rows"][-1] if self.tables and self.tables[-1]["rows"] else None

    def _imply(self, tag: str) -> None:
        """A row or cell ends where the next one of its table begins."""
        while self.stack and self.stack[-1] != "table" and tag in _IMPLIED and any(x in _IMPLIED[tag] for x in self._within_table()):
            self._close(self.stack.pop())

    def _within_table(self) -> list[str]:
        at = len(self.stack) - 1 - self.stack[::-1].index("table") if "table" in self.stack else -1
        return self.stack[at + 1 :]

    def _close(self, tag: str) -> None:
        if tag == "table" and self.tables:
            self.tables.pop()
        elif tag == "a":
            self.open_anchor = None


def _visible(parts: list[str]) -> str:
    return re.sub(r"\s+", " ", " ".join(p.strip() for p in parts if p.strip())).strip()


def listing_fields(table: dict, row: dict) -> dict[str, str]:
    """The fields of a row that the table's header names; without a header of two cells or more, or with a wider one, none."""
    rows = table["rows"]
    header = next((r for r in rows if r["th"]), rows[0] if rows[0]["strong"] else None)
    if header is None or not 2 <= len(header["cells"]) <= len(row["cells"]):
        return {}
    out: dict[str, str] = {}
    for head, cell in zip(header["cells"], row["cells"], strict=False):
        field = next((f for word, f in HEADER_WORDS if word in _visible(head)), None)
        if field and _visible(cell):
            out[field] = _visible(cell)
    return out


LINK_ROWS = 10_000
LINKS = "page_url string, page_title string, ord int, href string, url string, link_text string, fields map<string,string>"


def links_of(page_url: str | None, html: str | None) -> Iterator[tuple]:
    page = _Page()
    page.feed(html or "")
    page.close()
    title = _visible(page.title)
    for i, a in enumerate(page.anchors):
        try:
            url = urldefrag(urljoin(page_url or "", a["href"].strip())).url
        except ValueError:
            url = a["href"]
        yield page_url, title, i, a["href"].strip(), url, _visible(a["text"]), listing_fields(a["table"], a["row"]) if a["table"] else {}


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """A row for each a[href] of each page: page_url, page_title, ord, href, url (absolute), link_text, fields."""
    names = [x.split()[0] for x in LINKS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for u, h in zip(b["u"], b["h"], strict=True):
                rows += links_of(u, h)
                if len(rows) > LINK_ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return in_pandas(pages.select(F.col(url).alias("u"), F.col(html).alias("h")), run, LINKS)


def followed(links: DataFrame) -> DataFrame:
    return links.filter(is_followed_link("href"))


def pdf_links(links: DataFrame) -> DataFrame:
    return followed(links).filter(is_pdf_link("href"))


def netloc(url: Column | str) -> Column:
    """The network location with its port; raw spaces and other scripts in the rest do no harm."""
    return F.regexp_extract(text_or_empty(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column | str) -> Column:
    return F.lower(netloc(url))


def site_pages(links: DataFrame, domain: str) -> DataFrame:
    """Links to pages of the same site: http or https, no file extension that is skipped."""
    path = F.lower(F.regexp_replace(F.col("url"), r"(?s)[?#].*$", ""))
    file = F.lit(False)
    for e in SKIPPED:
        file = file | path.endswith(e)
    return followed(links).filter((netloc("url") == domain) & F.col("url").rlike("^https?://") & ~file & ~is_pdf_link("href"))


def listing_columns(fields: Column) -> dict[str, Column]:
    """subject, source_org, medium, size_reported, order_no and table_date of a link's fields."""
    out = {f: F.try_element_at(fields, F.lit(f)) for f in ("subject", "source_org", "medium", "size_reported")}
    order = F.try_element_at(fields, F.lit("order"))
    bare = strip_chars(F.regexp_replace(F.regexp_replace(order, TRAILING_DATE, ""), ORDER_LABEL, ""), " ,;:")
    return out | {"order_no": F.nullif(bare, F.lit("")), "table_date": extract_date(order)}


def crawl(start: list[str], fetch: Callable[[DataFrame], DataFrame], max_depth: int = 2, max_pages: int | None = None, domain: str | None = None, spark=None) -> tuple[DataFrame, DataFrame]:
    """(pages, pdfs) of a breadth-first crawl.

    fetch: from url to url, html (null for what is no page) and, if it can tell, is_pdf: a page address that answers with a
    document, as download handlers do. It is the only part that meets the network. A level of the frontier is one job; what
    was seen is an anti-join over stored tables, so lineage stays short and a lost executor costs a level at most.
    max_pages counts pages in the order of discovery. pdfs: url, page_url, page_title, link_text, fields, depth, by_handler.
    """
    domain = domain or urlsplit(start[0]).netloc
    frontier = spark.createDataFrame([(u, i + 1, u, "") for i, u in enumerate(start)], "url string, ord long, page_url string, link_text string")
    visited, pages, pdfs = frontier.select("url").limit(0), None, None
    left = max_pages
    for depth in range(max_depth + 1):
        todo = stored(frontier.join(visited, "url", "left_anti"), "todo")
        if left is not None:
            todo = stored(todo.orderBy("ord").limit(max(0, left)), "todo")
        answers = fetch(todo.select("url"))
        if "is_pdf" not in answers.columns:
            answers = answers.withColumn("is_pdf", F.lit(False))
        answers = stored(answers.select("url", "html", F.coalesce("is_pdf", F.lit(False)).alias("is_pdf")).join(todo, "url"), "pages")
        got = answers.filter(F.col("html").isNotNull() & ~F.col("is_pdf")).select("url", "html", "ord")
        visited = stored(visited.unionByName(todo.select("url")).distinct(), "visited")
        n = got.count()
        if left is not None:
            left -= n
        links = page_links(got).join(got.select(F.col("url").alias("page_url"), F.col("ord").alias("__page")), "page_url")
        links = stored(links, "links")
        place = F.struct("__page", "ord")
        linked = pdf_links(links).groupBy("url").agg(F.min_by(F.struct("page_url", "page_title", "link_text", "fields"), place).alias("f")).select("url", "f.*", F.lit(depth).alias("depth"), F.lit(False).alias("by_handler"))
        served = answers.filter("is_pdf").select("url", "page_url", F.lit("").alias("page_title"), "link_text", F.create_map().cast("map<string,string>").alias("fields"), F.lit(depth).alias("depth"), F.lit(True).alias("by_handler"))
        served = served.join(linked.select("url"), "url", "left_anti")
        new_pdfs = stored(linked.unionByName(served), "pdfs")
        pages = got.withColumn("depth", F.lit(depth)) if pages is None else pages.unionByName(got.withColumn("depth", F.lit(depth)))
        pdfs = new_pdfs if pdfs is None else pdfs.unionByName(new_pdfs.join(pdfs.select("url"), "url", "left_anti"))
        found = site_pages(links, domain).groupBy("url").agg(F.min_by(F.struct("__page", "ord", "page_url", "link_text"), place).alias("f")).select("url", "f.*")
        # numbered level by level, so the order key stays small however deep the crawl goes
        frontier = numbered(found.withColumnRenamed("ord", "__link"), ["__page", "__link"], name="ord").select("url", F.col("ord").cast("long").alias("ord"), "page_url", or_default("link_text", "url").alias("link_text"))
        if not n or (left is not None and left <= 0):
            break
    return pages, pdfs


def crawl_records(pdfs: DataFrame, state_key: str, state: str, pdf_dir: str, crawled_at: str, dates: DataFrame | None = None, filename: str = "filename") -> DataFrame:
    """The metadata records of found documents, which have a file name: ten fields and those of a listing table.

    dates: (url, document_date) read from the files; a listing's date goes before it.
    """
    rows = pdfs.join(dates, "url", "left") if dates is not None else pdfs.withColumn("document_date", F.lit(None).cast("string"))
    table = listing_columns(F.col("fields"))
    return rows.select(
        F.col(filename).alias("filename"), F.concat(F.lit(pdf_dir.rstrip("/") + "/"), F.col(filename)).alias("file_path"), F.col("url").alias("pdf_url"), F.col("page_url").alias("source_page"), F.lit(state).alias("state"), F.lit(state_key).alias("state_key"),
        category("url", "page_title", "link_text").alias("category"), "link_text", or_default(table["table_date"], "document_date").alias("document_date"), F.lit(crawled_at).alias("crawled_at"), *[c.alias(n) for n, c in table.items()],
    )
