"""Vectorised tokenising and hashing of many texts at once, in bounded slices of a batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .common import as_binary

SLICE_BYTES = 1 << 19
SLICE_TEXTS = 1 << 12
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEED = np.random.default_rng(20240607)
#: One random 64-bit value for each byte: the letters of the polynomial hash.
_LETTER = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power(kind: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, made once by doubling."""
    have = _powers.get(kind, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[kind] = have
    return have[:n]


class Words(NamedTuple):
    """The words of a slice of texts, in order."""

    doc: np.ndarray  # index of the text within the slice
    start: np.ndarray  # byte offsets within the slice's buffer
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray  # the normalised bytes of the slice
    offsets: np.ndarray  # byte offsets of the texts within the slice's buffer


def byte_table(is_word) -> np.ndarray:
    """For each byte its lower-cased value, or 0 where it parts words."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        low = b + 32 if 65 <= b <= 90 else b
        out[b] = low if is_word(low) else 0
    return out


#: Words of letters, digits and everything beyond ASCII.
ALNUM = byte_table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
#: Words between ASCII white space. NUL is part of a word; as 0 parts words, it takes a code that no byte of a text has:
#: 0xFF is not found in UTF-8.
BLANK = byte_table(lambda b: b != 0x20 and not 9 <= b <= 13)
BLANK[0] = 0xFF


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) for runs of whole texts of about SLICE_BYTES; one longer text is a run of its own."""
    column = as_binary(texts)
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32 if column.type == pa.binary() else np.int64)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        to = min(max(to, at + 1), at + SLICE_TEXTS, n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, by one running polynomial over the whole buffer."""
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * _power("up", _BASE, len(data)), out=run[1:])
    return mix((run[end] - run[start]) * _power("down", _INVERSE, len(data) + 1)[start] + (end - start).astype(np.uint64) * _ODD)


def words(data: np.ndarray, offsets: np.ndarray, code: np.ndarray) -> Words:
    """The words of texts that lie one behind the other; a word never crosses texts."""
    low = code[data]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = low != 0
    starts = inside[1:-1] & ~inside[:-2]
    cut = offsets[1:-1]
    cut = cut[cut < len(low)]
    starts[cut] = inside[1:-1][cut]
    ends = inside[1:-1] & ~inside[2:]
    before = cut[cut > 0] - 1
    ends[before] = inside[1:-1][before]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(doc, start, end, span_hash(low, start, end), low, offsets)


def shingles(w: Words, n: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of the n-word shingles of each text; a shorter text is one shingle."""
    counts = np.bincount(w.doc, minlength=texts)
    first = np.cumsum(counts) - counts
    h = w.hash
    m = len(h) - n + 1
    docs, out = [], []
    if m > 0:
        same = w.doc[:m] == w.doc[n - 1 :]
        x = np.zeros(m, np.uint64)
        for i in range(n):
            x = mix(x + h[i : i + m] + np.uint64(i + 1))
        docs.append(w.doc[:m][same])
        out.append(x[same])
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        x = np.full(len(short), 0x1234567, np.uint64)
        for i in range(n - 1):
            has = counts[short] > i
            x[has] = mix(x[has] + h[first[short[has]] + i] * _ODD + np.uint64(i + 11))
        docs.append(short)
        out.append(x)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(out)


def shingle_sets(w: Words, n: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, 52-bit hash) of the distinct n-word shingles of each text, sorted by text, then hash."""
    doc, x = shingles(w, n, texts)
    # texts < SLICE_TEXTS: the index and 52 bits of the hash sort as one number
    key = np.sort((doc.astype(np.uint64) << np.uint64(52)) | (x >> np.uint64(12)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(52)).astype(np.int64), key & np.uint64((1 << 52) - 1)
