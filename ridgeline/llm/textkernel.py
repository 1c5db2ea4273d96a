"""Vectorised text primitives over Arrow string columns (NumPy, no per-word Python).

Texts are handled as one byte buffer with offsets, the layout Arrow uses itself, so
a batch is viewed, never decoded.  Every routine works on whole texts; batches are cut
between documents into pieces of about ``PIECE`` bytes to bound temporary arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 2 << 20

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes of words ``[^\x20\x09-\x0D]+``
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(raw: np.ndarray, offsets: np.ndarray, size: int = PIECE):
    """Yield (first document, last document + 1, bytes, offsets) of about ``size`` bytes."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Starts and ends of maximal runs of word bytes, and n+1 word offsets by document."""
    size = len(data)
    if size == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = table[data]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    before = np.empty(size, bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(size, bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def loads(data: np.ndarray) -> np.ndarray:
    """The little-endian 8-byte word at each byte position, zero-padded at the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ascontiguousarray(np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,)))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection whose output bits depend on all input bits."""
    h = h ^ (h >> _S33)
    h *= _M1
    h ^= h >> _S33
    h *= _M2
    h ^= h >> _S33
    return h


def span_hashes(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each byte span, from ``loads()``."""
    h = mix(words[starts] & _MASK[np.minimum(lengths, 8)] ^ (lengths.astype(np.uint64) * _GOLD + np.uint64(seed)))
    left = np.flatnonzero(lengths > 8)
    at = 8
    while left.size:
        lane = words[starts[left] + at] & _MASK[np.minimum(lengths[left] - at, 8)]
        h[left] = mix((h[left] ^ lane) * _GOLD + np.uint64(at))
        at += 8
        left = left[lengths[left] > at]
    return h


def hash_bytes(text: bytes, seed: int = 1) -> int:
    """``span_hashes`` of one string, for small vocabularies."""
    data = np.frombuffer(text, np.uint8)
    return int(span_hashes(loads(data), np.zeros(1, np.int64), np.array([len(data)], np.int64), seed)[0])
