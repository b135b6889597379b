"""Column expressions with the string semantics of Python, for Unicode text in any script.

Java's \\w, \\s, \\d and \\b are ASCII-only or count vowel signs as word characters; the classes here agree with
Python's. They are written so that RE2 reads them too, but for the look-arounds of `word_bounded`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
DIGIT = r"\p{Nd}"
#: What ends a line for Python's splitlines.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, also where it stands in branches and lambdas."""
    return F.transform(F.array(value), body)[0]


def count_of(c: Column, inside: str) -> Column:
    """How many characters are in a class: the length of what is left without the runs of others."""
    return F.length(F.regexp_replace(c, f"[^{inside}]+", ""))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def or_default(c: Column | str, *others: Column | str) -> Column:
    """The first that is neither null nor empty; the last is taken as it is."""
    every = [c, *others]
    return F.coalesce(*[F.nullif(col(x), F.lit("")) for x in every[:-1]], col(every[-1]))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"^(?:{SPACE})+|(?:{SPACE})+$", "")


def strip_chars(c: Column | str, chars: str) -> Column:
    """Without leading and trailing characters out of chars; a run at each end."""
    inside = "".join("\\" + x if x in "\\]^-[" else x for x in chars)
    return F.regexp_replace(col(c), f"^[{inside}]+|[{inside}]+$", "")


def is_blank(c: Column | str) -> Column:
    return F.length(strip(text_or_empty(c))) == 0


def lines(c: Column | str) -> Column:
    """Like splitlines: no empty last line."""
    ended = F.regexp_replace(col(c), rf"(?:{LINE_END})\z", "")
    return F.when(F.length(col(c)) == 0, F.array().cast("array<string>")).otherwise(F.split(ended, LINE_END))


def words(c: Column | str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(f"{WORD}+"), F.lit(0))


def collapse_space(c: Column | str) -> Column:
    return strip(F.regexp_replace(col(c), f"(?:{SPACE})+", " "))


def contains_any(c: Column, needles: list[str] | tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(c, F.lit(n))
    return out


def word_bounded(pattern: str) -> str:
    r"""pattern with \b, \w and \s in Python's sense, for a Java regex."""
    edge = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
    return pattern.replace(r"\b", edge).replace(r"\w", WORD).replace(r"\s", SPACE)
