"""Dates in the header of a document: candidates, scores and the choice between them, as one Column.

Numeric, year-first and month-word dates of the first HEADER_CHARS characters compete; an issue anchor in the WINDOW
characters before a candidate raises it, a deadline anchor lowers it, month words weigh more than numbers; ties go to
the earliest. There is no UDF: matches are fenced with sentinels, split out, and placed by the lengths before them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import DIGIT, SPACE, col, let, or_default

HEADER_CHARS, WINDOW = 4000, 60
FIRST_YEAR, LAST_YEAR = 1990, 2035

# The digits and month names that are read, and the words that anchor a date.
DEVANAGARI_DIGITS = "०१२३४५६७८९"
MONTHS = {
    **{"january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12},
    **{"जनवरी": 1, "फरवरी": 2, "फ़रवरी": 2, "मार्च": 3, "अप्रैल": 4, "मई": 5, "जून": 6, "जुलाई": 7, "अगस्त": 8, "सितंबर": 9, "सितम्बर": 9, "अक्टूबर": 10, "नवंबर": 11, "दिसंबर": 12},
}
#: English names of three letters match too, but name no month.
MONTH_NAMES = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
    "|जनवरी|फरवरी|फ़रवरी|मार्च|अप्रैल|मई|जून|जुलाई|अगस्त|सितंबर|सितम्बर|अक्टूबर|नवंबर|दिसंबर"
)
ISSUE_ANCHOR = r"दिनांक\s*[:ः]?|दि\.|dated|date\s*[:]"
DEADLINE_ANCHOR = "अंतिम तिथि|अंतिम दिनांक|अंतिम तारीख|last date"

_EDGE = rf"(?<![{DIGIT}/.-])"
_END = rf"(?![{DIGIT}/.-])"
NUMERIC = rf"{_EDGE}({DIGIT}{{1,2}})[/.-]({DIGIT}{{1,2}})[/.-]({DIGIT}{{4}}){_END}"
YEAR_FIRST = rf"{_EDGE}({DIGIT}{{4}})[/.-]({DIGIT}{{1,2}})[/.-]({DIGIT}{{1,2}}){_END}"
MONTH_WORD = rf"(?iu){_EDGE}({DIGIT}{{1,2}}){SPACE}*[,.-]?{SPACE}+({MONTH_NAMES}){SPACE}*[,.-]?{SPACE}+({DIGIT}{{4}})(?!{DIGIT})"


def ascii_digits(c: Column) -> Column:
    """Decimal digits of the Indic scripts as ASCII ones, character by character."""
    blocks = [0x0660, 0x06F0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0xFF10]
    return F.translate(c, "".join(chr(b + i) for b in blocks for i in range(10)), "0123456789" * len(blocks))


def valid_iso(day: Column, month: Column, year: Column) -> Column:
    """yyyy-MM-dd of a real date within the years that count, else null."""
    d, m, y = (ascii_digits(x).try_cast("int") for x in (day, month, year))
    made = F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    return F.when(y.between(FIRST_YEAR, LAST_YEAR), F.date_format(made, "yyyy-MM-dd"))


def date_epoch(iso: Column | str) -> Column:
    """Seconds since 1970 of yyyy-MM-dd, null for anything else."""
    c = col(iso)
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.unix_date(F.try_to_date(c, "yyyy-MM-dd")).cast("long") * F.lit(86400).cast("long"))


def _month_number(name: Column) -> Column:
    numbers = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.try_element_at(numbers, F.lower(name)).cast("string")


def matches(text: Column, pattern: str) -> Column:
    """array<struct<match, pos>> of all matches, pos counted in code points from 0."""
    fenced = F.split(F.regexp_replace(F.translate(text, "\x01\x02", "  "), pattern, "\x01$0\x02"), "[\x01\x02]")

    def placed(parts: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))
        odd = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))
        none = F.array().cast("array<struct<match:string,pos:int>>")
        return F.when(F.size(parts) < 3, none).otherwise(F.transform(odd, lambda i: F.struct(parts[i].alias("match"), before(i).alias("pos"))))

    return let(fenced, placed)


def _score(text: Column, pos: Column, weight: int) -> Column:
    start = F.greatest(F.lit(0), pos - WINDOW)
    window = F.substr(text, start + 1, pos - start)
    issue, late = (window.rlike(p.replace(r"\s", SPACE)) for p in (ISSUE_ANCHOR, DEADLINE_ANCHOR))
    return F.lit(weight) + F.when(issue, 4).otherwise(0) - F.when(late, 3).otherwise(0)


def candidates(text: Column | str, header_chars: int = HEADER_CHARS) -> Column:
    """array<struct<score, order, iso>> of the valid dates of the header; order: the larger, the earlier."""
    start = F.translate(F.substring(F.coalesce(col(text), F.lit("")), 1, header_chars), DEVANAGARI_DIGITS, "0123456789")
    return let(start, _of_header)


def _of_header(header: Column) -> Column:
    def found(pattern: str, d: int, m: int, y: int, weight: int, word: bool = False) -> Column:
        part = lambda x, g: F.regexp_extract(x["match"], pattern, g)
        month = (lambda x: _month_number(part(x, m))) if word else (lambda x: part(x, m))
        return F.transform(matches(header, pattern), lambda x: F.struct(_score(header, x["pos"], weight).alias("score"), (-x["pos"]).alias("order"), valid_iso(part(x, d), month(x), part(x, y)).alias("iso")))

    every = F.concat(found(NUMERIC, 1, 2, 3, 1), found(YEAR_FIRST, 3, 2, 1, 1), found(MONTH_WORD, 1, 2, 3, 2, word=True))
    return F.filter(every, lambda x: x["iso"].isNotNull())


def extract_date(text: Column | str, header_chars: int = HEADER_CHARS) -> Column:
    return F.array_max(candidates(text, header_chars))["iso"]


def document_date(table_date: Column | str, text: Column | str, crawl_date: Column | str) -> Column:
    """A listing's date goes before the text's, and that before the crawl's."""
    return or_default(F.nullif(col(table_date), F.lit("")), F.coalesce(extract_date(text), F.nullif(col(crawl_date), F.lit(""))))
