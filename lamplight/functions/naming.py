"""Categories, file names, labels and keys, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import SPACE, WORD, col, contains_any, strip, strip_chars, text_or_empty

DEFAULT_CATEGORY = "General / Uncategorized"
# The first group with a keyword in the text names the category.
CATEGORIES = (
    ("Acts & Rules", ("act", "अधिनियम", "rules", "नियम", "ಅಧಿನಿಯಮ", "ಕಾಯ್ದೆ", "ನಿಯಮ")),
    ("Circulars & Orders", ("circular", "परिपत्र", "notification", "अधिसूचना", "order", "आदेश", "ಸುತ್ತೋಲೆ", "ಪರಿಪತ್ರ", "ಅಧಿಸೂಚನೆ", "ಆದೇಶ")),
    ("Schemes & Programs", ("scheme", "योजना", "program", "programme", "ಯೋಜನೆ", "ಕಾರ್ಯಕ್ರಮ")),
    ("SOPs & Guidelines", ("sop", "guideline", "दिशा-निर्देश", "disha-nirdesh", "ಮಾರ್ಗಸೂಚಿ", "ನಿರ್ದೇಶನ")),
    ("Reports", ("report", "प्रतिवेदन", "annual", "ವರದಿ", "ವಾರ್ಷಿಕ")),
)


def category(url: Column | str, title: Column | str, link_text: Column | str) -> Column:
    every = F.lower(F.concat_ws(" ", *[text_or_empty(c) for c in (url, title, link_text)]))
    out = F.lit(DEFAULT_CATEGORY)
    for name, needles in reversed(CATEGORIES):
        out = F.when(contains_any(every, needles), F.lit(name)).otherwise(out)
    return out


def safe_filename(text: Column | str, index: Column | str) -> Column:
    """ASCII letters, digits, _ and - of a title, spaces as _, 50 characters; else document_<index>."""
    clean = strip(F.regexp_replace(text_or_empty(text), rf"[^\p{{L}}\p{{N}}_\p{{IsWhite_Space}}\x1c-\x1f-]", ""))
    plain = F.regexp_replace(strip(F.regexp_replace(clean, r"[^\x00-\x7F]+", "")), f"(?:{SPACE})+", "_")
    return F.when(F.length(plain) > 0, F.substring(plain, 1, 50)).otherwise(F.concat(F.lit("document_"), col(index).cast("string")))


def url_path(url: Column | str) -> Column:
    """The path of a URL, without query and fragment; raw spaces and other scripts are left alone."""
    bare = F.regexp_replace(text_or_empty(url), r"[?#](?s:.*)$", "")
    return F.regexp_replace(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/]*)?", "")


def filename_from_url(url: Column | str, index: Column | str, taken: Column | None = None) -> Column:
    """The base name of a URL as a file name; a name in taken (array) gets the index."""
    number = col(index).cast("string")
    name = F.regexp_extract(F.regexp_replace(url_path(url), "/+$", ""), "[^/]*$", 0)
    stem = strip_chars(F.regexp_replace(name, "[^A-Za-z0-9._-]", "_"), "._-")
    stem = F.when(F.lower(stem).endswith(".pdf"), F.regexp_replace(stem, r"(?i)\.pdf$", "")).otherwise(stem)
    named = F.concat(stem, F.lit(".pdf"))
    other = F.concat(stem, F.lit("_"), number, F.lit(".pdf"))
    chosen = named if taken is None else F.when(F.coalesce(F.array_contains(taken, named), F.lit(False)), other).otherwise(named)
    return F.when(F.length(stem) > 0, chosen).otherwise(F.concat(F.lit("document_"), number, F.lit(".pdf")))


def trailing_number(name: Column | str, prefix: str) -> Column:
    """n of <prefix><n>, null for other names."""
    return F.regexp_extract(text_or_empty(name), rf"^{prefix}(\d+)$", 1).try_cast("bigint")


def option_label(name: Column | str, n: Column | str) -> Column:
    return F.format_string("%s (%d)", col(name), col(n))


def strip_count(label: Column | str) -> Column:
    c = col(label)
    return F.when(c.endswith(")") & F.contains(c, F.lit(" (")), F.regexp_replace(c, r"(?s)^(.*) \(.*$", "$1")).otherwise(c)


def chunk_id(state_key: Column | str, doc_id: Column | str, index: Column | str) -> Column:
    return F.concat_ws(":", col(state_key), col(doc_id), col(index).cast("string"))


def cache_key(model: Column | str, text: Column | str) -> Column:
    return F.substring(F.sha2(F.concat(col(model), F.lit("\x00"), col(text)), 256), 1, 32)


def posix_path(path: Column | str) -> Column:
    return F.replace(col(path), F.lit("\\"), F.lit("/"))


def is_pdf_response(content_type: Column | str, body: Column | None = None) -> Column:
    """By the content type; a type that says nothing needs the first bytes of a PDF."""
    kind = F.lower(strip(F.element_at(F.split(text_or_empty(content_type), ";"), 1)))
    magic = F.lit(False) if body is None else F.coalesce(F.substring(body, 1, 4) == F.lit(b"%PDF"), F.lit(False))
    vague = kind.isin("application/octet-stream", "binary/octet-stream", "application/download")
    return kind.startswith("application/pdf") | (vague & magic)


def is_pdf_link(href: Column | str) -> Column:
    return F.element_at(F.split(F.lower(text_or_empty(href)), "\\?"), 1).endswith(".pdf")


def is_followed_link(href: Column | str) -> Column:
    h = text_or_empty(href)
    return (F.length(h) > 0) & ~h.startswith("#") & ~h.startswith("mailto:") & ~h.startswith("tel:") & ~h.startswith("javascript:")


def normalize_section_query(query: Column | str) -> Column:
    return strip(F.regexp_replace(F.lower(text_or_empty(query)), rf"^(?:section|sec\.?){SPACE}*", ""))
