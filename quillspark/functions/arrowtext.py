"""Vectorised text primitives over Arrow string buffers.

Everything here works on whole Arrow batches with numpy, inside ``mapInArrow``
workers: a batch of texts is one byte buffer, and words, hashes and shingles are
arrays over it.  Nothing depends on Python's salted ``hash``; the same text has
the same hash on every executor and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in slices of about this many bytes, which bounds a worker's memory.
SLICE_BYTES = 1 << 20

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_S33, _S29, _S32 = np.uint64(33), np.uint64(29), np.uint64(32)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other (a bijection)."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


#: A random value for each byte and the powers used inside one word.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * _A)
_POWERS = np.cumprod(np.full(1 << 16, _B, dtype=np.uint64))

#: Bytes that belong to words: ASCII letters and digits, and all bytes of longer UTF-8 characters.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[ord("0") : ord("9") + 1] = True
WORD_BYTE[ord("A") : ord("Z") + 1] = True
WORD_BYTE[ord("a") : ord("z") + 1] = True
WORD_BYTE[128:] = True

#: Punctuation and spaces beyond ASCII that fold() turns into plain spaces (RE2 syntax).
_NOT_WORD = r"&(?:[A-Za-z]{2,8}|#\d{1,7}|#x[0-9A-Fa-f]{1,6});|<[^<>]{0,40}>|[\x{80}-\x{bf}\x{2000}-\x{206f}\x{3000}-\x{303f}\x{feff}\x{fffd}]"


def fold(texts: pa.Array) -> pa.Array:
    """Lower case, with entities, tags and typographic punctuation as spaces; null becomes ''."""
    texts = pc.fill_null(texts, "")
    return pc.replace_substring_regex(pc.utf8_lower(texts), pattern=_NOT_WORD, replacement=" ")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n + 1 offsets into them; null becomes ''."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Cut a string array into parts of about ``most`` bytes (one row at least), with each part's first row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, len(texts)
    while at < n:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield at, texts.slice(at, end - at)
        at = end


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes: first byte, end and row of each. No word spans two rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = WORD_BYTE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offs[:-1][offs[:-1] < len(data)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    begins = np.cumsum(sizes) - sizes
    within = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(begins, sizes)
    values = BYTE_VALUES[data[within + np.repeat(starts, sizes)]] * _POWERS[within & 0xFFFF]
    return mix64(np.add.reduceat(values, begins) + sizes.astype(np.uint64) * _A)


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each k consecutive words of one row, and the index of its first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ hashes[j : j + n]) * _B + _A
    at = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return mix64(out[at]), at


def signed(hashes: np.ndarray) -> np.ndarray:
    """The same bits as Spark's bigint."""
    return hashes.view(np.int64)
