"""Trigrams of lower-cased texts, counted in batches of documents: for tables of documents, where text.py's columns make a
row or an array entry of each occurrence."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Characters that are counted at once.
MOST_CHARS = 1_000_000


@cache
def _alnum() -> np.ndarray:
    """For each code point whether it is a letter or a number."""
    return np.fromiter((unicodedata.category(chr(i))[0] in "LN" for i in range(0x110000)), bool, 0x110000)


def _count(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """doc (a place in texts), gram (a place in the names), how often, and the names; by document, then by trigram."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    used, at = np.unique(chars, return_inverse=True) if len(chars) < 3 else _places(chars)
    n = len(used)
    if n**3 * len(texts) >= 2**63:  # then there are many texts: a single one has 1,114,112 characters at the most
        half = len(texts) // 2
        return _joined(_count(texts[:half]), _count(texts[half:]), half)
    if len(chars) < 3:
        return (np.zeros(0, np.int64),) * 3 + (pa.array([], pa.string()),)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(texts)), lengths)
    whole = np.ones(len(chars), bool)
    for back in (1, 2):
        whole[(ends - back)[lengths >= back]] = False
    good = _alnum()[used][at]
    starts = np.flatnonzero(whole[:-2] & (good[:-2] | good[1:-1] | good[2:]))
    keys = ((doc[starts] * n + at[starts]) * n + at[starts + 1]) * n + at[starts + 2]
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(keys)))
    doc, code = np.divmod(keys[first], n**3)
    kinds, gram = np.unique(code, return_inverse=True)
    letters = [chr(c) for c in used]
    names = pa.array([letters[k // (n * n)] + letters[k // n % n] + letters[k % n] for k in kinds.tolist()], pa.string())
    return doc, gram, times, names


def _places(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct characters and each one's place among them."""
    seen = np.zeros(0x110000, bool)
    seen[chars] = True
    used = np.flatnonzero(seen)
    place = np.zeros(0x110000, np.int64)
    place[used] = np.arange(len(used))
    return used, place[chars]


def _joined(a: tuple, b: tuple, behind: int) -> tuple:
    names = pa.concat_arrays([a[3], b[3]])
    kinds = names.dictionary_encode()
    to = kinds.indices.to_numpy()
    return np.append(a[0], b[0] + behind), to[np.append(a[1], b[1] + len(a[3]))], np.append(a[2], b[2]), kinds.dictionary


def _slices(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batch in runs of documents of so many characters, or of one longer document."""
    texts = [t or "" for t in b.column("text").to_pylist()]
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > MOST_CHARS:
            yield b.slice(start, i - start), texts[start:i]
            start, size = i, 0
        size += len(t)
    if texts:
        yield b.slice(start), texts[start:]


def counted(id_type: pa.DataType) -> Callable:
    """id, trigram and tf of batches of id and text."""
    kind = pa.schema([("id", id_type), ("trigram", pa.string()), ("tf", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in _slices(b):
                doc, gram, times, names = _count(texts)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(doc)).cast(id_type), names.take(pa.array(gram)), pa.array(times, pa.int64())], schema=kind)

    return run


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """trigram, docs and occurrences of each batch of text; a null trigram has the documents with any."""
    kind = pa.schema([("trigram", pa.string()), ("docs", pa.int64()), ("occurrences", pa.int64())])
    for b in batches:
        for _, texts in _slices(b):
            doc, gram, times, names = _count(texts)
            docs = np.bincount(gram, minlength=len(names))
            occurrences = np.bincount(gram, times, len(names)).astype(np.int64)
            columns = [pa.concat_arrays([names, pa.array([None], pa.string())]), pa.array(np.append(docs, len(np.unique(doc))), pa.int64()), pa.array(np.append(occurrences, 0), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=kind)


def blocks(id_type: pa.DataType) -> Callable:
    """trigram with lists of ids, words and tfs, of batches of id, words and text."""
    lists = [(c, pa.list_(t)) for c, t in (("ids", id_type), ("words", pa.int64()), ("tfs", pa.int64()))]
    kind = pa.schema([("trigram", pa.string()), *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in _slices(b):
                doc, gram, times, names = _count(texts)
                order = np.argsort(gram, kind="stable")
                ends = pa.array(np.append(0, np.cumsum(np.bincount(gram, minlength=len(names)))), pa.int32())
                rows = pa.array(doc[order])
                values = (part.column("id").take(rows).cast(id_type), part.column("words").take(rows).cast(pa.int64()), pa.array(times[order], pa.int64()))
                yield pa.RecordBatch.from_arrays([names, *(pa.ListArray.from_arrays(ends, v) for v in values)], schema=kind)

    return run
