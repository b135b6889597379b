"""Guards over extracted and translated text, as Columns: scripts, phrases, repetition, readability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import WORD, col, count_of, let, lines, strip, text_or_empty, word_bounded, words

DEVANAGARI, ODIA = r"[\x{0900}-\x{097F}]", r"[\x{0B00}-\x{0B7F}]"

# Fixed values, to LEAST_VOWELS: phrases of a contaminated translation model, of a model that talks about its task, and of
# legacy fonts; the thresholds of the checks.
CONTAMINATION = (
    r"\bjehovah\b",
    r"\bwatchtower\b",
    r"\bwatch\s+tower\b",
    r"\bkingdom\s+(?:preacher|publisher|hall|proclaimer)s?\b",
    r"\bjw\.org\b",
    r"\bbible\s+and\s+tract\s+society\b",
    r"\bbible\s+students?\b",
    r"\bawake\s*!",
    r"\bthe\s+watchtower\b",
    r"\bfield\s+ministry\b",
    r"\bpioneer\s+service\b",
    r"\bcongregation\s+(?:elder|meeting)s?\b",
    r"\bspiritual\s+paradise\b",
    r"\bnew\s+world\s+translation\b",
    r"\bgod'?s\s+kingdom\b",
)
COMMENTARY = (
    r"\bi\s+(?:can'?t|cannot|am\s+unable\s+to|won'?t)\b",
    r"\bi\s+(?:don'?t|do\s+not)\s+(?:see|have|understand)\b",
    r"\bi'?m\s+ready\s+to\s+translate\b",
    r"\bi'?(?:ll|d)\s+(?:be\s+happy\s+to|gladly)?\s*translate\b",
    r"\b(?:can|could)\s+you\s+please\s+(?:provide|supply|share|clarify)\b",
    r"\bplease\s+(?:provide|paste|share|supply)\b",
    r"\bgo\s+ahead\s+and\s+(?:provide|paste|share)\b",
    r"\bwaiting\s+for\s+(?:the|your)\b",
    r"\bas\s+an\s+ai\b",
    r"\bappears?\s+to\s+be\s+(?:a\s+)?(?:single\s+)?(?:space|blank|empty)\b",
    r"\bdoes\s+not\s+contain\s+any\s+(?:meaningful|readable|translatable)\b",
    r"\bno\s+(?:hindi\s+)?text\s+(?:was\s+)?(?:provided|given|supplied)\b",
    r"\bhere\s+is\s+(?:the|my)\s+(?:english\s+)?translation\b",
    r"\bthe\s+(?:hindi\s+)?text\s+(?:you\s+)?provided\s+is\b",
    r"\bit\s+seems\s+(?:like\s+)?(?:you|there)\b",
    r"\b(?:note|disclaimer)\s*:\s*(?:this|the)\s+translation\b",
)
LEGACY_SIGNATURES = ("NRR", "kklu", "=kk", "<+", "'kk", "vkS", "jgs", "fd;", "gksx", "ç", "â", "ã", "¸", "Ø", "¹", "»")

LONG_SOURCE = 40
LONG_BAND, SHORT_BAND = (0.45, 2.60), (0.20, 6.00)
LEAST_LATIN, MOST_DEVANAGARI, MOST_REPEAT, LEAST_DISTINCT = 0.60, 0.15, 0.50, 0.12
LEAST_SAMPLE, LEAST_LETTERS, LEAST_VOWELS = 100, 50, 0.22


def _alternatives(patterns: tuple[str, ...]) -> str:
    """One regex; all patterns begin with a letter at a word's edge, so edge and letter are looked at once for all of them."""
    bare = [p.removeprefix(r"\b") for p in patterns]
    first = {x[0] for p in bare for x in (p[3 : p.index(")")].split("|") if p.startswith("(?:") else [p])}
    return f"(?iu)(?<!{WORD})(?=[{''.join(sorted(first))}])(?:" + "|".join(word_bounded(p) for p in bare) + ")"


def phrases(text: Column | str, patterns: tuple[str, ...]) -> Column:
    """Distinct lower-cased matches, sorted."""
    found = F.regexp_extract_all(text_or_empty(text), F.lit(_alternatives(patterns)), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.lower(x))))


def find_contamination(text: Column | str) -> Column:
    return phrases(text, CONTAMINATION)


def find_commentary(text: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(phrases(text, COMMENTARY), lambda x: strip(x))))


def _refuses(bare: Column, n: Column) -> Column:
    return (F.length(bare) == 0) | ((n > 0) & ((F.length(bare) < 400) | (n >= 2)))


def is_refusal(text: Column | str) -> Column:
    return let(strip(text_or_empty(text)), lambda bare: let(F.size(find_commentary(bare)), lambda n: _refuses(bare, n)))


def _without(every: Column, some: Column) -> Column:
    """The lines without commentary; a line can only hold some if the whole text does."""
    kept = F.when(some, F.filter(every, lambda x: ~x.rlike(_alternatives(COMMENTARY)))).otherwise(every)
    clean = lambda k: F.regexp_replace(strip(F.array_join(k, "\n")), "\n{3,}", "\n\n")
    return let(kept, lambda k: F.struct(clean(k).alias("text"), (F.size(every) - F.size(k)).alias("removed")))


def strip_commentary(text: Column | str) -> Column:
    """struct<text, removed>: without the lines that hold commentary; three line feeds and more become two."""
    return let(lines(text_or_empty(text)), lambda every: _without(every, F.lit(True)))


def commentary(text: Column | str) -> Column:
    """struct<phrases, refusal, text, removed>: all about a text's commentary from one search of the whole text.

    White space at the ends takes no part in a match, so the search also serves the refusal, which looks at bare text.
    """
    t = text_or_empty(text)

    def judged(found: Column) -> Column:
        bare = strip(t)
        rest = let(lines(t), lambda every: _without(every, F.size(found) > 0))
        return let(rest, lambda r: F.struct(found.alias("phrases"), let(bare, lambda b: _refuses(b, F.size(found))).alias("refusal"), r["text"].alias("text"), r["removed"].alias("removed")))

    return let(find_commentary(t), judged)


def has_translatable(text: Column | str) -> Column:
    bare = strip(text_or_empty(text))
    return (F.length(bare) >= 3) & (bare.rlike(DEVANAGARI) | (F.regexp_count(bare, F.lit(f"{WORD}+")) >= 2))


def script_ratios(text: Column | str) -> Column:
    """struct<devanagari, latin>: shares of the letters of the two scripts, both 0 without one."""
    t = text_or_empty(text)
    counts = F.struct(count_of(t, DEVANAGARI.strip("[]")).alias("d"), count_of(t, "A-Za-z").alias("n"))

    def shares(c: Column) -> Column:
        total = c["d"] + c["n"]
        share = lambda x: F.when(total == 0, F.lit(0.0)).otherwise(x / total)
        return F.struct(share(c["d"]).alias("devanagari"), share(c["n"]).alias("latin"))

    return let(counts, shares)


def line_repeat_ratio(text: Column | str) -> Column:
    """The share of the most frequent line among stripped lines over 12 characters, 0 with fewer than 4 of them.

    Sorted, equal lines are runs; one fold finds the longest, so a text of many lines stays linear but for the sort.
    """
    long = F.array_sort(F.filter(F.transform(lines(text_or_empty(text)), lambda x: strip(x)), lambda x: F.length(x) > 12))
    start = F.struct(F.lit(None).cast("string").alias("line"), F.lit(0).alias("run"), F.lit(0).alias("most"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["line"].eqNullSafe(x), a["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("line"), run.alias("run"), F.greatest(a["most"], run).alias("most"), (a["n"] + 1).alias("n"))

    return F.aggregate(long, start, step, lambda a: F.when(a["n"] >= 4, a["most"] / a["n"]).otherwise(F.lit(0.0)))


def distinct_word_ratio(text: Column | str) -> Column:
    """Distinct lower-cased words over words, 1 with fewer than 30."""
    return let(words(F.lower(text_or_empty(text))), lambda w: F.when(F.size(w) >= 30, F.size(F.array_distinct(w)) / F.size(w)).otherwise(F.lit(1.0)))


def check_translation(source: Column | str, output: Column | str) -> Column:
    """struct<ok, reasons, metrics>; reasons name the check, metrics are unrounded."""
    raw = text_or_empty(output)
    facts = F.struct(
        F.length(strip(text_or_empty(source))).alias("src"), F.length(strip(raw)).alias("out"), script_ratios(raw).alias("scripts"), line_repeat_ratio(raw).alias("repeat"),
        distinct_word_ratio(raw).alias("distinct"), find_contamination(raw).alias("bad"), find_commentary(raw).alias("meta"),
    )
    return let(facts, _judged)


def _judged(f: Column) -> Column:
    n_src, n_out, scripts, repeat, distinct = f["src"], f["out"], f["scripts"], f["repeat"], f["distinct"]
    ratio = n_out / F.nullif(n_src, F.lit(0))
    band = lambda b: ratio.between(F.lit(b[0]), F.lit(b[1]))
    named = lambda label, found, n: F.when(F.size(found) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.slice(found, 1, n), ", ")))
    tests = [
        F.when(~F.when(n_src >= LONG_SOURCE, band(LONG_BAND)).otherwise(band(SHORT_BAND)), F.lit("length ratio")),
        F.when(scripts["latin"] < LEAST_LATIN, F.lit("too little Latin script")),
        F.when(scripts["devanagari"] > MOST_DEVANAGARI, F.lit("still Devanagari (untranslated)")),
        named("contamination", f["bad"], 5),
        named("model commentary", f["meta"], 3),
        F.when(repeat > MOST_REPEAT, F.lit("identical lines (degenerate output)")),
        F.when(distinct < LEAST_DISTINCT, F.lit("few distinct words (degenerate output)")),
    ]
    reasons = F.when(n_src == 0, F.array(F.lit("empty source"))).when(n_out == 0, F.array(F.lit("empty translation"))).otherwise(F.filter(F.array(*tests), lambda x: x.isNotNull()))
    measured = {"source_chars": n_src, "output_chars": n_out, "length_ratio": ratio, "latin_ratio": scripts["latin"], "devanagari_ratio": scripts["devanagari"], "line_repeat_ratio": repeat, "distinct_word_ratio": distinct}
    full = F.create_map(*[x for k, v in measured.items() for x in (F.lit(k), v.cast("double"))])
    short = F.create_map(F.lit("source_chars"), n_src.cast("double"))
    metrics = F.when(n_src == 0, F.create_map().cast("map<string,double>")).when(n_out == 0, short).otherwise(full)
    return let(reasons, lambda r: F.struct((F.size(r) == 0).alias("ok"), r.alias("reasons"), metrics.alias("metrics")))


def looks_like_legacy_font(text: Column | str) -> Column:
    t = text_or_empty(text)
    n = sum((F.contains(t, F.lit(s)).cast("int") for s in LEGACY_SIGNATURES), F.lit(0))
    return ~t.rlike(DEVANAGARI) & (n >= 2)


def vowel_ratio(text: Column | str) -> Column:
    return let(_letters(text), lambda x: F.when(F.length(x) == 0, F.lit(0.0)).otherwise(count_of(x, "AEIOUaeiou") / F.length(x)))


def _letters(text: Column | str) -> Column:
    return F.regexp_replace(text_or_empty(text), "[^A-Za-z]+", "")


def looks_like_readable_latin(text: Column | str) -> Column:
    return let(_letters(text), lambda x: (F.length(x) >= LEAST_LETTERS) & (count_of(x, "AEIOUaeiou") / F.length(x) >= LEAST_VOWELS))


def needs_ocr(sample: Column | str, indic: tuple[str, ...] = (DEVANAGARI, ODIA)) -> Column:
    """Whether a text layer's sample is of no use; scripts not named in indic count as such."""

    def judge(s: Column) -> Column:
        unicode = F.lit(False)
        for script in indic:
            unicode = unicode | s.rlike(script)
        return F.when(F.length(s) < LEAST_SAMPLE, True).when(unicode, False).when(looks_like_legacy_font(s), True).otherwise(~looks_like_readable_latin(s))

    return let(strip(text_or_empty(sample)), judge)


def layer_facts(text: Column | str, indic: tuple[str, ...] = (DEVANAGARI, ODIA)) -> Column:
    """struct<legacy_font, readable_latin, needs_ocr> of a text layer, each part looked at once: white space at the ends
    counts for its length only."""
    t = text_or_empty(text)

    def judge(f: Column) -> Column:
        unicode = F.lit(False)
        for script in indic:
            unicode = unicode | t.rlike(script)
        scan = F.when(F.length(strip(t)) < LEAST_SAMPLE, True).when(unicode, False).when(f["legacy"], True).otherwise(~f["latin"])
        return F.struct(f["legacy"].alias("legacy_font"), f["latin"].alias("readable_latin"), scan.alias("needs_ocr"))

    return let(F.struct(looks_like_legacy_font(t).alias("legacy"), looks_like_readable_latin(t).alias("latin")), judge)


def infer_title(text: Column | str, fallback: Column | str) -> Column:
    """The first line of 6 to 200 characters that holds a word and is no legacy font, cut to 150; else the fallback."""
    stripped = F.transform(F.split(text_or_empty(text), "\n"), lambda x: strip(x))
    good = F.filter(stripped, lambda x: F.length(x).between(6, 200) & ~looks_like_legacy_font(x) & x.rlike(rf"{WORD}|{DEVANAGARI}"))
    return F.coalesce(F.substring(F.try_element_at(good, F.lit(1)), 1, 150), col(fallback))
