"""Secret scans: three base patterns, and strings in a sensitive context that dictionary-primed zstandard cannot shrink.

Base spans are leftmost non-overlapping matches of each kind: assign, access, hex. Beside them, a run of ASCII
letters, digits and +/_=.~- of LEAST_CHARS or more that begins within REACH characters behind a sensitive word is a
candidate. Its cost is its marginal compressed size: bytes of (surroundings + candidate) less bytes of (surroundings), both
under a raw zstandard dictionary of identifiers, code and the words of a public vocabulary file; the surroundings are the
AROUND characters on each side. Its novelty is that cost over the mean cost of SHUFFLES arrangements of the same characters,
which hold no word: a name, a path or a known string costs much less than its letters in disorder, a random string as
much. A candidate of at least LEAST_NOVELTY, and LEAST_RATIO bytes a character, that touches no base span is a span of the
kind `novel`. What lies further off than REACH or AROUND is no context of a candidate; every candidate is measured.

Offsets are code points, ends exclusive; whole texts are read. Defined results: a null text counts as empty and has no
span, whose digest is that of the empty string; rows that repeat each keep a row; an empty table gives an empty result;
only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import in_arrow, whole_text

KINDS = ("assign", "access", "hex", "novel")
#: The contract's patterns; failing lengths are dropped after matching.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ASSIGN_CHARS = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: One of these is in every assign match.
_HINTS = ("pass", "secret", "token", "api")

CONTEXT = re.compile(r"passw|passphrase|secret|token|api.?key|credential|private.?key|access.?key|signature|bearer|authori[sz]ation|client.?id|encryption.?key|\bpwd\b|\bsalt\b|\bhmac\b", re.IGNORECASE | re.ASCII)
#: One of these, in lower case, is in every context match.
_CONTEXT_HINTS = ("pass", "secret", "token", "key", "credential", "signature", "bearer", "authori", "client", "pwd", "salt", "hmac")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
REACH, AROUND = 96, 512
LEAST_CHARS, LEAST_NOVELTY, LEAST_RATIO = 16, 0.96, 0.5
SHUFFLES, LEVEL = 6, 15

#: Identifiers and code that surround secrets.
DICTIONARY = (
    " ".join(f"{a}_{b}" for a in ("access", "api", "auth", "client", "private", "public", "secret", "session", "user", "database", "service", "account", "storage", "refresh") for b in ("key", "token", "secret", "password", "id", "name", "url", "path", "config", "value"))
    + " https://www.example.com/index.html http://localhost:8080/api/v1/users/ /usr/local/bin/ /etc/config/ import from return function class public static void const string boolean true false null undefined None self this"
    " -----BEGIN PRIVATE KEY----- Authorization: Bearer password= token= secret= export AWS_ACCESS_KEY_ID AWS_SECRET_ACCESS_KEY application/json content-type charset=utf-8 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789"
    " getUser setPassword userToken apiKey clientSecret accessToken sessionId getElementById addEventListener setAttribute configuration environment development production the and that with from this have"
).encode()


def vocabulary_words(model_file: str, common: int = 3000) -> bytes:
    """The words of four ASCII letters or more in a public sentencepiece vocabulary, as they are and with a capital; its
    first ones also as parts of identifiers."""
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=model_file)
    words = list(dict.fromkeys(w for i in range(lib.get_piece_size()) if re.fullmatch("[A-Za-z]{4,}", w := lib.id_to_piece(i).lstrip("\u2581"))))
    first = [w for w in words if w.islower()][:common]
    parts = [*words, *dict.fromkeys(w.capitalize() for w in words), *(f"_{w}" for w in first), *(f"-{w}" for w in first), "".join(w.capitalize() for w in first), ""]
    return " ".join(parts).encode()


class Novelty:
    """Marginal compressed bytes under the dictionary, and their share of what the same characters cost in disorder."""

    def __init__(self, words: bytes = b"", level: int = LEVEL):
        data = zstandard.ZstdCompressionDict(words + DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.compress = zstandard.ZstdCompressor(dict_data=data, compression_params=params).compress

    def found(self, before: str, candidate: str, after: str) -> bool:
        around = f"{before} {after}".encode(errors="replace") + b" "
        alone = len(self.compress(around))
        cost = lambda s: len(self.compress(around + s.encode())) - alone
        own = cost(candidate)
        if own < LEAST_RATIO * len(candidate):
            return False
        order, chars, total = random.Random(candidate), list(candidate), 0
        for _ in range(SHUFFLES):
            order.shuffle(chars)
            total += cost("".join(chars))
        return own * SHUFFLES >= LEAST_NOVELTY * total


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    low = text.lower()
    if not any(h in low for h in _CONTEXT_HINTS):
        return []
    out: list[tuple[int, int, int]] = []
    # base spans as disjoint stretches: sorted starts and the furthest end so far
    starts, ends = [], []
    for a, _, z in base:
        starts.append(a)
        ends.append(max(z, ends[-1]) if ends else z)
    done = 0
    for m in CONTEXT.finditer(text):
        at = max(done, m.end())
        limit = m.end() + REACH
        for c in CANDIDATE.finditer(text, at):
            if c.start() >= limit:
                break
            done = c.end()
            s = c.group().strip(".=-~")
            a = c.start() + (c.group().find(s) if s else 0)
            z = a + len(s)
            before = bisect(starts, z - 1)
            if len(s) < LEAST_CHARS or before and ends[before - 1] > a:
                continue
            if novelty.found(text[max(0, a - AROUND) : a], s, text[z : z + AROUND]):
                out.append((a, 3, z))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in sorted(spans))


def scan(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel.

    vocabulary: the path of a sentencepiece vocabulary file, which is read on the driver.
    """
    words = vocabulary_words(vocabulary) if vocabulary else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(words)
        for b in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for t in b.column(1):
                text = t.as_py()
                base = base_spans(text)
                every = base + novel_spans(text, base, novelty)
                for k, c in enumerate(counts):
                    c.append(sum(s[1] == k for s in every))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            n = [pa.array(c, pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays([b.column(0), *n[:3], pa.array(digests, pa.string()), pa.array(spans, pa.string()), n[3]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return in_arrow(rows, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
