"""Vectorised word and shingle hashing on Arrow string buffers: no Python object is made for a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)
#: Blanks between words: ASCII white space.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Powers for the polynomial hash of a word; positions beyond the table start again, which only weakens the hash.
_SPAN = 1 << 12
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(_SPAN, U(0x100000001B3), dtype=U))
#: Bytes of text that are hashed at a time.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """texts in order, in parts of about SLICE_BYTES; a longer text is a part of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    part = np.cumsum(sizes) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield texts.slice(a, b - a)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of all texts, and the text that each belongs to; a null text has none."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    wide = pa.types.is_large_string(low.type)
    offsets = np.frombuffer(low.buffers()[1], dtype=np.int64 if wide else np.int32, count=len(low) + 1, offset=low.offset * (8 if wide else 4)).astype(np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(0, U), np.zeros(0, np.int64)
    data = np.frombuffer(low.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    word = ~_BLANK[data]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.zeros(len(data), np.int64)
    at[starts] = starts
    np.maximum.accumulate(at, out=at)
    at = (np.arange(len(data)) - at) & (_SPAN - 1)
    with np.errstate(over="ignore"):
        value = (data.astype(U) + U(1)) * _POWERS[at]
        value[~word] = 0
        return mix(np.add.reduceat(value, starts)), np.searchsorted(offsets, starts, side="right") - 1


def multisets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The multiset of k-word shingles of each text: text, shingle hash and count, sorted by text and hash.

    A text of fewer than k words, but at least one, has one shingle of them all.
    """
    words, doc = word_hashes(texts)
    if not len(words):
        return doc, words, np.zeros(0, np.int64)
    count = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    with np.errstate(over="ignore"):
        factor = [mix(np.array([U(j + 1) * GOLD]))[0] | U(1) for j in range(k)]
        n = max(0, len(words) - k + 1)
        whole = np.flatnonzero(doc[:n] == doc[k - 1 : k - 1 + n]) if n else np.zeros(0, np.int64)
        value = np.zeros(len(whole), U)
        for j in range(k):
            value += words[whole + j] * factor[j]
        short = np.flatnonzero((count > 0) & (count < k))
        brief = count[short].astype(U) * GOLD
        for j in range(k - 1):
            more = count[short] > j
            brief[more] += words[first[short[more]] + j] * factor[j]
        value, doc = mix(np.concatenate([value, brief])), np.concatenate([doc[whole], short])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]))
    return doc[new], value[new], np.diff(np.concatenate([new, [len(value)]]))


def items(texts: pa.Array, k: int) -> list[bytes | None]:
    """For each text the sorted hashes of its shingles, each occurrence of a shingle counting as another: a set for a multiset."""
    doc, value, count = multisets(texts, k)
    times = np.repeat(np.arange(len(value)), count)
    nth = np.arange(len(times)) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        value, doc = mix(value[times] + nth.astype(U) * GOLD), doc[times]
    order = np.lexsort((value, doc))
    value, ends = value[order], np.searchsorted(doc, np.arange(len(texts) + 1))
    return [value[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
