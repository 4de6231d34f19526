"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The last token of a word's encoding is unique for each of its prefixes: it is the vocabulary match ending there that
forms a compatible pair with the last token of what precedes it. One pass of an automaton over the vocabulary (of failure
links, after Aho and Corasick) gives the tokens that are suffixes of each prefix, longest first; the pair test undoes the two tokens' merges and looks for an earlier merge across their border. Back-pointers then
give exactly the ids that merging by rank gives, in time linear in the word.

Null texts encode as empty; empty texts give no ids, the digests of nothing and n_tokens 0. Texts are encoded whole;
words are remembered, up to a bound, since most recur. Special tokens' strings in a text become their ids, as in the
library's default. Repeated rows are encoded each on its own; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Callable
from pathlib import Path

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import map_texts, table

END = "</w>"
SPACE = r"\x09-\x0D\x20\x85\xA0  -     　"
#: Pieces of at most so many characters are remembered, and so many of them in each of two generations.
REMEMBER_CHARS, REMEMBER_WORDS = 64, 120_000
#: Outcomes of the pair test that are remembered.
REMEMBER_PAIRS = 400_000
#: The alphabet of a word's last byte, beside that of its other bytes.
LAST = 256


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Tokens as strings over 512 symbols, their two parts, and the pairs that merge; ids rise with a merge's rank."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.names = [""] * (max(model["vocab"].values(), default=-1) + 1)
        for name, i in model["vocab"].items():
            self.names[i] = name
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_names = {i: s for s, i in self.special.items()}
        ids, letters = model["vocab"], byte_letters()
        self.symbols: dict[int, str] = {}
        for b, letter in enumerate(letters):
            self.symbols[ids[letter]], self.symbols[ids[letter + END]] = chr(b), chr(b + LAST)
        self.parts = {i: (i, i) for i in self.symbols}
        self.pairs: dict[tuple[int, int], int] = {}
        last = max(self.symbols)
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, made = ids[left], ids[right], ids[left + right]
            if made <= last:
                raise ValueError("ids do not rise with the merges' ranks")
            last = made
            self.parts[made], self.pairs[a, b] = (a, b), made
            self.symbols[made] = self.symbols[a] + self.symbols[b]
        self.tested: dict[tuple[int, int], bool] = {}
        self.matches = ahocorasick.Automaton()
        for i, text in self.symbols.items():
            self.matches.add_word(text, (len(text), i))
        self.matches.make_automaton()

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before those that made the two tokens."""
        parts, pairs, limit = self.parts, self.pairs, len(self.names)
        while True:
            if pairs.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, left = left, parts[left][1]
                if left == limit:
                    limit, right = right + 1, parts[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, parts[right][0]
                if right + 1 == limit:
                    limit, left = left, parts[left][1]
                    if left == limit:
                        return True

    def encode_word(self, data: bytes) -> list[int]:
        word = data[:-1].decode("latin-1") + chr(data[-1] + LAST)
        last: list[tuple[int, int]] = []
        tested = self.tested
        if len(tested) > REMEMBER_PAIRS:
            tested.clear()
        for end, match in self.matches.iter(word):  # the longest match at an end comes first
            if end < len(last):
                continue
            size, token = match
            if size <= end:
                pair = last[end - size][1], token
                fits = tested.get(pair)
                if fits is None:
                    fits = tested[pair] = self.compatible(*pair)
                if not fits:
                    continue
            last.append(match)
        if len(last) < len(word):
            raise ValueError("the vocabulary does not cover this word")
        ids, at = [], len(word)
        while at:
            size, token = last[at - 1]
            ids.append(token)
            at -= size
        return ids[::-1]


def unassigned() -> re.Pattern:
    """The characters that Python's Unicode tables do not know yet and the library's may."""
    spans: list[list[int]] = []
    for c in range(0x110000):
        if unicodedata.category(chr(c)) == "Cn":
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]")


def lower(text: str) -> str:
    """Lower case letter by letter, so that a capital sigma does not look at its neighbours."""
    return "σ".join(x.lower() for x in text.split("Σ")) if "Σ" in text else text.lower()


class Remembered(dict):
    """What make() gives for a key, in two generations: the older one goes when the younger is full."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        made = self.older.get(key) or self.make(key)
        if len(key) <= REMEMBER_CHARS:
            if len(self) >= REMEMBER_WORDS:
                self.older = dict(self)
                self.clear()
            self[key] = made
        return made


class Encoder:
    def __init__(self, spec: dict):
        self.vocab = Vocabulary(spec)
        self.names = [self.vocab.special_names.get(i, name) for i, name in enumerate(self.vocab.names)]
        self.names += [self.vocab.special_names.get(i, "") for i in range(len(self.names), max(self.vocab.special_names, default=-1) + 1)]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", SPACE)).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.vocab.special)) + ")") if self.vocab.special else None
        self.known = Remembered(self._piece)
        self.new = unassigned()
        self.new_lower = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.new_split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)

    def _piece(self, piece: str) -> bytes:
        """The ids' bytes of a lower-case piece; no word crosses white space."""
        words = self.words(piece)
        if not piece.isascii() and self.new.search(piece):  # letters newer than Python's tables: the library's classes
            words = [w for w, _ in self.new_split.pre_tokenize_str(self.new_lower.normalize_str(piece))]
        ids = [i for w in words for i in self.vocab.encode_word(w.encode("utf-8"))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out, known = [], self.known.__getitem__
        for part in self.specials.split(text or "") if self.specials else [text or ""]:
            if self.specials and part in self.vocab.special:
                out.append(struct.pack("<I", self.vocab.special[part]))
            elif part:
                part = lower(unicodedata.normalize("NFC", part))
                # split() also cuts at these four, which the pattern takes as symbols
                out += map(known, [part] if any(map(part.__contains__, "\x1c\x1d\x1e\x1f")) else part.split())
        return b"".join(out)

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode(text), "<i4")

    def decode(self, ids: list[int]) -> str:
        """The vocabulary file names no decoder: tokens are joined by one space."""
        return " ".join(map(self.names.__getitem__, ids))

    def ids_and_digest(self, text: str | None) -> tuple[int, np.ndarray, str]:
        ids = self.ids(text)
        return len(ids), ids, hashlib.sha256(self.decode(ids.tolist()).encode("utf-8")).hexdigest()

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of ids and of the text that the ids decode to."""
        data = self.encode(text)
        decoded = self.decode(np.frombuffer(data, "<i4").tolist())
        return len(data) // 4, hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()


_ENCODERS: dict[str, Encoder] = {}


def encoder(spec_text: str) -> Encoder:
    """One encoder for each vocabulary in a Python worker."""
    if (key := hashlib.sha256(spec_text.encode()).hexdigest()) not in _ENCODERS:
        _ENCODERS[key] = Encoder(json.loads(spec_text))
    return _ENCODERS[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def with_encoder(df: DataFrame, path: str | None, columns: list[str], method: Callable[[Encoder], Callable[..., tuple]], schema: str, keep: list[str]) -> DataFrame:
    """The driver reads the vocabulary, of a fixed size, and broadcasts it."""
    spec = df.sparkSession.sparkContext.broadcast(Path(path or default_vocabulary()).read_text())
    return map_texts(df, columns, lambda: method(encoder(spec.value)), schema, keep)


def encode_texts(df: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """ids: the encoding of each whole text."""
    return with_encoder(df, path, ["text"], lambda e: lambda text: (e.ids(text),), "ids array<int>", keep or ["doc_id"])


def decode_ids(df: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """decoded: the text of each row's ids; null for null."""
    return with_encoder(df, path, ["ids"], lambda e: lambda ids: (None if ids is None else e.decode(ids),), "decoded string", keep or ["doc_id"])


def digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """Number of ids and digests of ids and of the decoded text, for every row."""
    return with_encoder(df, path, ["text"], lambda e: e.digest, "n_tokens long, ids_sha256 string, decoded_sha256 string", ["doc_id"])


def encode_corpus(df: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """n_tokens, ids, and the digest of the text that the ids decode to."""
    return with_encoder(df, path, ["text"], lambda e: e.ids_and_digest, "n_tokens long, ids array<int>, decoded_sha256 string", keep or ["doc_id"])


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
