"""Encoding each distinct chunk of text once and joining the ids back by position.

A chunk table maps a chunk to its ids as little-endian unsigned 32-bit integers. It lives in a task, in two
generations of TABLE_CHUNKS chunks: a full one becomes the old one, from which chunks in use come back. So its memory
is bounded and no chunk is ever shuffled. One table for the whole corpus was measured on 16,000 documents (32 MB of Parquet,
9.7 million chunks, 628,000 distinct): what has to move are the distinct chunks of each batch (27 MB at 8 MB a batch), the same
again with their ids, and 25 MB of chunk numbers in compressed form, written and then shuffled to their dictionaries: 2.5
to 3 times the input, while encoding the distinct chunks takes about a quarter of the time of a task (4 of 15 s).
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable

TABLE_CHUNKS = 100_000
#: Parts of words, which are shorter than chunks.
PART_CHUNKS = 250_000


class ChunkTable:
    def __init__(self, encode: Callable[[list[str]], list], limit: int = TABLE_CHUNKS):
        self.encode, self.limit, self.table, self.old = encode, limit, {}, {}

    def rows(self, chunks: Iterable[str]) -> dict:
        """A table that has all of chunks."""
        new = set(chunks).difference(self.table)
        if new:
            if len(self.table) + len(new) > self.limit:
                self.table, self.old = {}, self.table
                new = set(chunks)
            self.table.update([(c, self.old[c]) for c in new if c in self.old])
            missing = [c for c in new if c not in self.old]
            self.table.update(zip(missing, self.encode(missing), strict=True))
        return self.table


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class PieceEncoder:
    """Exactly the sentencepiece library's ids and its decode(ids), chunk by chunk.

    It holds for a model whose pieces cross neither white-space markers nor line feeds: no piece has a marker after
    another character, none has a line feed, the normaliser is the identity, and a marker is put before the text.
    `supports` checks this; for another model, whole texts go to the library. Where no piece has a full stop or comma
    after a letter either, chunks end there too, which makes fewer distinct ones.
    """

    CHUNK = re.compile(r" +[^ \n]*|\n|[^ \n]+")
    LETTERS = "[A-Za-zÀ-ÖØ-öø-ɏ]"
    FINER = re.compile(rf" +(?:{LETTERS}+(?![^ \n.,])|[^ \n]*)|\n|{LETTERS}+(?![^ \n.,])|[^ \n]+")
    MARK = "▁"

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        self.lib = SentencePieceProcessor(model_file=model_file)
        self.begin, self.end = pack([self.lib.bos_id()]), pack([self.lib.eos_id()])
        self.head = self.lib.encode("\n")
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.lib.is_byte(i) else p.replace(self.MARK, " ").encode() for i, p in enumerate(pieces)]
        self.by_chunk = self.supports()
        finer = not any(re.search(rf"{self.LETTERS}[.,]", self.lib.id_to_piece(i)) for i in range(self.lib.get_piece_size()))
        self.cut = (self.FINER if finer else self.CHUNK).findall
        self.chunks = ChunkTable(self._encode)

    def supports(self) -> bool:
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        if sum(self.lib.is_byte(i) for i in range(len(pieces))) < 256:  # what no piece covers would be an unknown piece
            return False
        whole = not any("\n" in p or re.search(f"[^{self.MARK}]{self.MARK}", p) for p in pieces)
        probe = "Å  é  x \n\t ﬁ"  # changes under any normaliser but the identity
        return whole and self.lib.decode(self.lib.encode(probe)) == probe and self.lib.encode(" ")[:1] != self.lib.encode("")[:1]

    def _encode(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        # after a line feed no marker is put before a chunk; what stands for marker and line feed comes off again
        n, of, out = len(self.head), self.bytes_of, []
        for ids in self.lib.encode(["\n" + c for c in chunks], num_threads=1):
            out.append((pack(ids[n:]), b"".join([of[i] for i in ids[n:]])))
        return out

    def encode_decode(self, text: str) -> tuple[bytes, bytes]:
        """(ids with begin and end, little-endian; the decoded text in UTF-8)."""
        if not self.by_chunk or not text:
            ids = self.lib.encode(text, add_bos=True, add_eos=True)
            return pack(ids), self.lib.decode(ids).encode()
        chunks = self.cut(" " + text.replace(self.MARK, " "))
        table = self.chunks.rows(chunks)
        got = [table[c] for c in chunks]
        return self.begin + b"".join([g[0] for g in got]) + self.end, b"".join([g[1] for g in got])[1:]

    def encode(self, text: str) -> bytes:
        return self.encode_decode(text)[0]

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


class WordEncoder:
    """Exactly the tokenizers library's ids for a tokenizer that drops white space, word by word.

    Words are what spaces and line feeds separate; they are encoded apart. Words of Latin letters, marks and digits go
    straight to the model, in the parts that the tokenizer's pattern makes; those with other characters go to the
    library as they are.
    """

    CHUNK = re.compile(r"[^ \n]+")
    PART = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
    ODD = re.compile(r"[^ \n!-&(-;=-~À-ÖØ-öø-ÿ]")  # an apostrophe, < and all that PART does not cut
    ODD_WORD = re.compile(rf"[^ \n]*{ODD.pattern}[^ \n]*")
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, tokenizer_file: str):
        import json

        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = PieceOfSpec.drops_space(spec)
        self.direct = self.by_word and PieceOfSpec.splits_by(spec, self.PATTERN)
        self.chunks, self.parts = ChunkTable(self._encode), ChunkTable(self._encode_parts, PART_CHUNKS)

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        tokenize, letters = self.lib.model.tokenize, _BYTE_LETTERS.__getitem__
        return [pack([t.id for t in tokenize(p if p.isascii() else "".join(map(letters, p.encode())))]) for p in parts]

    def _encode(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(chunks), 4096):
            out += [pack(e.ids) for e in self.lib.encode_batch(chunks[i : i + 4096], add_special_tokens=False)]
        return out

    def _plain(self, text: str) -> bytes:
        parts = self.PART.findall(text.lower())
        table = self.parts.rows(parts)
        return b"".join([table[p] for p in parts])

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return pack(self.lib.encode(text, add_special_tokens=False).ids)
        if not self.direct:
            chunks = self.CHUNK.findall(text)
            table = self.chunks.rows(chunks)
            return b"".join([table[c] for c in chunks])
        if not self.ODD.search(text):
            return self._plain(text)
        # words with an odd character go to the library, what lies between them is plain
        out, at = [], 0
        odd = [m.span() for m in self.ODD_WORD.finditer(text)]
        table = self.chunks.rows([text[a:z] for a, z in odd])
        for a, z in odd:
            out += [self._plain(text[at:a]), table[text[a:z]]]
            at = z
        return b"".join([*out, self._plain(text[at:])])


class PieceOfSpec:
    @staticmethod
    def drops_space(spec: dict) -> bool:
        """White space ends words and leaves no id, and nothing looks across it."""
        norm = spec.get("normalizer") or {}
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        kinds = [n.get("type") for n in norm.get("normalizers", [norm])]
        return set(kinds) <= {"NFC", "Replace", "Lowercase"} and spec.get("post_processor") is None and pre[0].get("type") == "Split" and pre[0].get("invert") is True and pre[0].get("behavior") == "Removed" and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))

    @staticmethod
    def splits_by(spec: dict, pattern: str) -> bool:
        pre = spec["pre_tokenizer"]["pretokenizers"]
        lower = any(n.get("type") == "Lowercase" for n in spec["normalizer"]["normalizers"])
        return lower and len(pre) == 2 and pre[0]["pattern"].get("Regex") == pattern and pre[1]["type"] == "ByteLevel" and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"] and spec["model"]["dropout"] is None


def _byte_letters() -> list[str]:
    """The printable letter that byte-level models write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in plain else chr(256 + extra))
        extra += b not in plain
    return out


_BYTE_LETTERS = _byte_letters()