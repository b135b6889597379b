"""Filters of the search API: an expression tree, compiled to one Column that Parquet can use."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamplight.functions.strings import strip, text_or_empty

_OPS = {"$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(*v), "$nin": lambda c, v: ~c.isin(*v)}


def epoch(iso: str | None) -> int | None:
    """Seconds since 1970 of yyyy-MM-dd, None for anything else."""
    try:
        return (date(*map(int, iso.split("-"))) - date(1970, 1, 1)).days * 86_400 if iso and len(iso) == 10 else None
    except ValueError:
        return None


def build_where(state: str | None = None, category: str | None = None, date_from: str | None = None, date_to: str | None = None) -> dict | None:
    """The tree of what is given: none, a bare term, or $and; a bound that is no date is left out."""
    low, high = epoch(date_from), epoch(date_to)
    terms: list[dict] = [{k: v} for k, v in (("state", state), ("category", category)) if v]
    terms += [{"document_date_epoch": {op: v}} for op, v in (("$gte", low), ("$lte", high)) if v is not None]
    return None if not terms else terms[0] if len(terms) == 1 else {"$and": terms}


def compile_where(where: Mapping | None, columns: Mapping[str, str] | None = None) -> Column:
    """A Column for the tree; columns may rename its fields. Rows with a null field fail its terms."""
    if not where:
        return F.lit(True)
    if "$and" in where:
        return reduce(and_, [compile_where(t, columns) for t in where["$and"]])
    if "$or" in where:
        return reduce(lambda a, b: a | b, [compile_where(t, columns) for t in where["$or"]])
    out = []
    for field, test in where.items():
        c = F.col((columns or {}).get(field, field))
        out += [_OPS[op](c, v) for op, v in test.items()] if isinstance(test, Mapping) else [c == test]
    return reduce(and_, out)


def by_field(column: str, value: str | None) -> Column:
    """Exact equality; an empty or missing value filters nothing."""
    return F.col(column) == value if value else F.lit(True)


def by_date(column: str, date_from: str | None = None, date_to: str | None = None) -> Column:
    """Inclusive bounds, compared as strings; with a bound undated rows go."""
    if not date_from and not date_to:
        return F.lit(True)
    d = F.col(column)
    terms = [d.isNotNull(), d != ""]
    terms += [d >= date_from] if date_from else []
    terms += [d <= date_to] if date_to else []
    return reduce(and_, terms)


def keyword(query: str, fields: list[str], body: str | None = None) -> Column:
    """The literal query in lower case within the space-joined fields or the body; an empty one matches nothing."""
    q = query.lower().strip()
    if not q:
        return F.lit(False)
    hit = F.contains(F.lower(F.concat_ws(" ", *[text_or_empty(f) for f in fields])), F.lit(q))
    return hit | F.contains(F.lower(text_or_empty(body)), F.lit(q)) if body else hit


def has_text(column: str) -> Column:
    return F.length(strip(text_or_empty(column))) > 0
