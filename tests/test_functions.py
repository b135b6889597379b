"""Text functions against plain Python on fixed and on random mixed-script strings."""

from __future__ import annotations

import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from lamplight.functions import chunking, dates, naming, quality, strings

ENGLISH = "The Department of Women and Child Development hereby notifies the revised guidelines for all district officers in the state."
GARBLE = "NRRhlx<+ 'kklu vkS jgs fd; gksx kkk mmm NRRhlx<+ 'kklu vkS jgs fd; gksx lk nwljk NRRhlx<+ 'kklu vkS jgs fd; gksx lk nwljk"
HINDI = "छत्तीसगढ़ शासन महिला एवं बाल विकास विभाग मंत्रालय दिनांक " * 4


def ask(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def mixed(seed, n, alphabet):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(n)]


ALPHABET = [*"abZ 1\n\t", "é", "क", "ि", "ಕ", "१", " ", "\x1c", " ", "\x85", "𝒳", "_", "-", "."]


def test_strip_words_lines_match_python(spark):
    texts = mixed(1, 400, ALPHABET)
    assert ask(spark, texts, strings.strip) == [t.strip() for t in texts]
    assert ask(spark, texts, strings.words) == [re.findall(r"\w+", t) for t in texts]
    assert ask(spark, texts, strings.lines) == [t.splitlines() for t in texts]
    assert ask(spark, texts, strings.collapse_space) == [re.sub(r"\s+", " ", t).strip() for t in texts]
    assert ask(spark, [None, "", "  ", "a"], strings.is_blank) == [True, True, True, False]


def test_needs_ocr(spark):
    cases = [(ENGLISH, False), (HINDI, False), ("ଓଡ଼ିଶା ସରକାର " * 20, False), ("", True), (None, True), ("   ", True), ("Page 1", True), (GARBLE, True), ("12 34 " * 60, True), (ENGLISH * 3, False), ("ಕನ್ನಡ ಸರ್ಕಾರ " * 20, True)]
    assert ask(spark, [c[0] for c in cases], quality.needs_ocr) == [c[1] for c in cases]
    assert ask(spark, [ENGLISH, "ಕನ್ನಡ ಸರ್ಕಾರ " * 20], lambda c: quality.needs_ocr(c, (*quality.DEVANAGARI.split(), r"[\x{0C80}-\x{0CFF}]"))) == [False, False]
    assert ask(spark, [ENGLISH, HINDI, GARBLE, "'kklu"], quality.looks_like_legacy_font) == [False, False, True, True]


@pytest.mark.parametrize(
    ("text", "iso"),
    [
        ("दिनांक: 15/03/2024", "2024-03-15"), ("दि. १५.०३.२०२४", "2024-03-15"), ("Dated 5-1-2023", "2023-01-05"), ("12 March, 2024", "2024-03-12"), ("15 मार्च 2024", "2024-03-15"), ("15 Jan 2024", None),
        ("last date 01/05/2024 " + "x" * 70 + " dated 02/04/2024", "2024-04-02"), ("last date: 01/05/2024", "2024-05-01"), ("2024-03-15", "2024-03-15"), ("no date", None), ("", None), (None, None),
        ("31/02/2024", None), ("15/13/2024", None), ("15/03/1985", None), ("1/2/2020 3/4/2021", "2020-02-01"), ("अंतिम दिनांक 01/05/2024", "2024-05-01"), ("x" * 4100 + " 15/03/2024", None), ("updated 05/06/2020", "2020-06-05"), ("12/03/2024/5", None), ("೧೫/೦೩/೨೦೨೪", "2024-03-15"),
    ],
)
def test_extract_date(spark, text, iso):
    assert ask(spark, [text], dates.extract_date) == [iso]


def test_date_matches_have_python_offsets(spark):
    texts = mixed(2, 300, [*"12345/.-", " ", "क", "𝒳", "१"])
    pattern = r"(?<![\d/.-])(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})(?![\d/.-])"
    got = ask(spark, texts, lambda c: dates.matches(c, dates.NUMERIC))
    assert [[(m["match"], m["pos"]) for m in g] for g in got] == [[(m.group(), m.start()) for m in re.finditer(pattern, t)] for t in texts]


def test_date_epoch(spark):
    assert ask(spark, ["1970-01-02", "junk", "", None, "2024-13-40", "2050-01-01"], dates.date_epoch) == [86400, None, None, None, None, (date(2050, 1, 1) - date(1970, 1, 1)).days * 86400]


def test_phrases_and_refusals(spark):
    good = "The department will provide support to children under the scheme."
    refusal = "I can't provide a translation of that text as it appears to be a single space."
    assert ask(spark, ["Jehovah", "the WATCHTOWER magazine", "kingdom hall", "awake !", "God's kingdom", good, "क्jehovah"], lambda c: F.size(quality.find_contamination(c))) == [1, 1, 1, 1, 1, 0, 1]
    assert ask(spark, [refusal, good, "", None, " "], quality.is_refusal) == [True, False, True, True, True]
    clean = ask(spark, ["Line one.\nI'm ready to translate. Please provide the Hindi text.\nLine two.", good, None], quality.strip_commentary)
    assert [(c["text"], c["removed"]) for c in clean] == [("Line one.\nLine two.", 1), (good, 0), ("", 0)]
    assert ask(spark, ["", "  ", ".", "-", "बाल कल्याण", "two words", "one"], quality.has_translatable) == [False, False, False, False, True, True, False]


def test_check_translation(spark):
    pairs = [("बाल कल्याण समिति का गठन किया गया है और उसके सदस्य", "The child welfare committee was formed with its members"), ("शीर्षक", "Jehovah's kingdom hall " * 8), ("पाठ " * 20, "पाठ " * 20), ("पाठ", ""), ("", "text"), ("पाठ " * 60, "same line of text here\n" * 20), (None, None)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, s string, o string")
    got = [r["c"] for r in rows.select("i", quality.check_translation("s", "o").alias("c")).orderBy("i").collect()]
    assert [g["ok"] for g in got] == [True, False, False, False, False, False, False]
    assert any("contamination" in r for r in got[1]["reasons"]) and any("length" in r for r in got[1]["reasons"])
    assert got[3]["reasons"] == ["empty translation"] and got[4]["reasons"] == ["empty source"] and got[4]["metrics"] == {}
    assert any("identical lines" in r for r in got[5]["reasons"])


def test_ratios(spark):
    assert [tuple(r) for r in ask(spark, ["abcd", "शासन", "", "12"], quality.script_ratios)][0::2] == [(0.0, 1.0), (0.0, 0.0)]
    lines = ["a long line of words"] * 3 + ["another long line here"]
    assert ask(spark, ["\n".join(lines), "x", None], quality.line_repeat_ratio) == [0.75, 0.0, 0.0]
    assert ask(spark, ["w " * 40, "a b", None], quality.distinct_word_ratio) == [1 / 40, 1.0, 1.0]


def test_windows(spark):
    texts = ["x" * 2500, "ab " * 1700, "", "   ", None, "a" * 801, "𝒳" * 900]
    for size, overlap in ((800, 100), (50, 50), (7, 2)):
        got = ask(spark, texts[2:] if size < 50 else texts, lambda c, s=size, o=overlap: chunking.windows(c, s, o))
        for t, ws in zip(texts[2:] if size < 50 else texts, got, strict=True):
            want, at, step = [], 0, max(1, size - overlap)
            while t:
                end = min(at + size, len(t))
                if t[at:end].strip():
                    want.append((t[at:end].strip(), at, end))
                if end >= len(t):
                    break
                at += step
            assert [(w["chunk"], w["start"], w["end"]) for w in ws] == want


def test_split_for_translation():
    text = "यह वाक्य है। " * 60
    pieces = chunking.pieces_of(text, 200)
    assert all(len(p) <= 200 for p in pieces) and re.sub(r"\s", "", "".join(pieces)) == re.sub(r"\s", "", text)
    assert sum(map(len, chunking.pieces_of("x" * 500, 100))) == 500
    assert chunking.pieces_of("") == chunking.pieces_of(None) == chunking.pieces_of(" \n ") == []


def test_names(spark):
    rows = [("https://x.in/a/media%20to.pdf?x=1#f", 7), ("https://x.in/", 7), ("https://x.in/Down.ashx?Id=1", 3), ("https://x.in/doc42.pdf", 9), (None, 1), ("http://x.in/क ख.pdf", 2)]
    df = spark.createDataFrame(rows, "u string, i int")
    assert [r[0] for r in df.select(naming.filename_from_url("u", "i", F.array(F.lit("doc42.pdf")))).collect()] == ["media_20to.pdf", "document_7.pdf", "Down.ashx.pdf", "doc42_9.pdf", "document_1.pdf", "pdf.pdf"]
    assert ask(spark, ["A (b) c!", "", None, "  ", "कखग x-y"], lambda c: naming.safe_filename(c, F.lit(5))) == ["A_b_c", "document_5", "document_5", "document_5", "x-y"]
    assert ask(spark, ["a (3)", "a (b) (3)", "plain", "x)"], naming.strip_count) == ["a", "a (b)", "plain", "x)"]
    assert ask(spark, ["Section 302", "sec. 4", "SEC4", "theft"], naming.normalize_section_query) == ["302", "4", "4", "theft"]


def test_category(spark):
    cases = [("/contact", "Acts & Rules"), ("border", "Circulars & Orders"), ("Download", naming.DEFAULT_CATEGORY), ("ಯೋಜನೆ", "Schemes & Programs"), ("ಮಾರ್ಗಸೂಚಿ", "SOPs & Guidelines"), ("ವರದಿ", "Reports"), (None, naming.DEFAULT_CATEGORY)]
    assert ask(spark, [c[0] for c in cases], lambda c: naming.category(F.lit(""), F.lit(None).cast("string"), c)) == [c[1] for c in cases]


def test_pdf_responses(spark):
    df = spark.createDataFrame([("application/pdf; x", b""), ("Application/Octet-Stream", b"%PDF-1"), ("application/octet-stream", b"<html"), ("image/png", b"%PDF"), ("", b"%PDF"), (None, None)], "t string, b binary")
    assert [r[0] for r in df.select(naming.is_pdf_response("t", F.col("b"))).collect()] == [True, True, False, False, False, False]
    assert ask(spark, ["a.PDF?x", "a.pdfx", None], naming.is_pdf_link) == [True, False, False]
    assert ask(spark, ["", "#a", "mailto:x", "x", None], naming.is_followed_link) == [False, False, False, True, False]


def test_title(spark):
    texts = ["abc\n  A fine title  \nmore", "x", None, "1" * 160, GARBLE[:60] + "\nReal title"]
    assert ask(spark, texts, lambda c: quality.infer_title(c, F.lit("fb"))) == ["A fine title", "fb", "fb", "1" * 150, "Real title"]


def test_layer_facts_agree_with_their_parts(spark):
    texts = [None, "", "  short ", "a readable line of text that goes on for long enough to be read " * 3, "bcdfg hjklm " * 20, "kklu NRR " * 20, "बाल कल्याण समिति " * 10, " " * 200, "NRR kklu " + "समिति " * 30]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(quality.layer_facts("t").alias("f"), quality.looks_like_legacy_font("t").alias("a"), quality.looks_like_readable_latin("t").alias("b"), quality.needs_ocr("t").alias("c")).collect()
    assert all(tuple(r.f) == (r.a, r.b, r.c) for r in rows) and len({tuple(r.f) for r in rows}) >= 4
