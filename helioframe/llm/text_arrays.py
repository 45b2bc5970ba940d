"""Arrow text columns as byte arrays: word spans and 64-bit word hashes, vectorised in numpy.

A null text counts as an empty one everywhere in this module.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words of `[^\x20\x09-\x0D]+`: whatever is not ASCII white space.
SPACE_SPLIT = np.ones(256, dtype=bool)
SPACE_SPLIT[[0x20, *range(0x09, 0x0E)]] = False

#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, a-z, non-ASCII.
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[list(range(0x30, 0x3A)) + list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20260131)
_BYTE_KEYS = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_KEYS_LOWER = _BYTE_KEYS[LOWER]
_POSITION_KEYS = _rng.integers(1, 2**63, 1 << 16, dtype=np.uint64) | np.uint64(1)
_STEP_KEYS = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all bits depend on all others (murmur's finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about most_bytes of text each; a longer text stands alone."""
    sizes = np.diff(text_bytes(batch.column(column))[1])
    if not len(sizes):
        return
    block = np.cumsum(sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def word_spans(raw: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in raw, and the first word of each text (n+1 indexes)."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    w = np.zeros(len(raw) + 1, dtype=np.int8)
    w[:-1] = in_word[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[offsets[:-1]] = True
    first[-1] = True
    here, before = w[:-1].view(bool), np.concatenate(([False], w[:-2].view(bool)))
    starts = np.flatnonzero(here & (~before | first[:-1]))
    ends = np.flatnonzero(here & (~w[1:].view(bool) | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit multilinear hash of each word's bytes, with A-Z lower-cased unless lower is false."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    inside = np.zeros(len(raw) + 1, dtype=np.int8)
    inside[starts] += 1
    inside[ends] -= 1  # words of two texts can touch: their marks cancel
    letters = raw[np.cumsum(inside[:-1], dtype=np.int8).view(bool)] if int(lengths.sum()) != len(raw) else raw
    within = np.arange(len(letters), dtype=np.int64) - np.repeat(heads, lengths) if len(letters) >> 31 else np.arange(len(letters), dtype=np.int32) - np.repeat(heads.astype(np.int32), lengths)
    keys = (_BYTE_KEYS_LOWER if lower else _BYTE_KEYS)[letters]
    keys *= _POSITION_KEYS[within & 0xFFFF]
    if lengths.max() > 0xFFFF:  # no two positions of a word have the same key
        keys *= mix((within >> 16).astype(np.uint64) * _BYTE_KEYS[7]) | np.uint64(1)
    return mix(np.add.reduceat(keys, heads) + lengths.astype(np.uint64))


def shingle_sets(hashes: np.ndarray, first_word: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin (n+1 indexes).

    A text of fewer than width words, but not none, has its whole word sequence as one shingle.
    """
    n_words = np.diff(first_word)
    n = len(n_words)
    count = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    doc = np.repeat(np.arange(n), count)
    heads = np.concatenate(([0], np.cumsum(count)[:-1]))
    at = np.arange(total) - np.repeat(heads, count) + np.repeat(first_word[:-1], count)
    padded = np.concatenate((hashes, np.zeros(width, np.uint64)))
    h = np.zeros(total, np.uint64)
    size = n_words[doc]
    short = size < width
    for k in range(width):
        part = padded[at + k] * _STEP_KEYS[k]
        if short.any():
            part[short & (size <= k)] = 0
        h += part
    h[short] += size[short].astype(np.uint64) * _STEP_KEYS[15]
    h = mix(h)
    fresh = np.ones(total, dtype=bool)
    for a, b in zip(heads.tolist(), (heads + count).tolist()):
        if b - a > 1:
            h[a:b].sort()
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[fresh], doc[fresh]
    return h, np.searchsorted(doc, np.arange(n + 1))
