"""Terms of Arrow string columns: runs of chosen bytes, cut out and grouped without a loop over documents.

The texts of a slice lie end to end in one buffer of UTF-8. A lookup table of 256
entries tells which bytes belong to terms and another one lower-cases A-Z, so
boundaries are NumPy operations over the buffer. Equal terms are grouped by a hash
of their bytes, and each one's bytes are compared with those of its group's first
term: terms that only share a hash are told apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from .text import Words, text_bytes

_LETTERS = [*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]
#: ASCII letters and all bytes of other characters.
LETTERS = np.zeros(256, bool)
LETTERS[_LETTERS] = True
#: The same with the digits 0-9.
LETTERS_DIGITS = LETTERS.copy()
LETTERS_DIGITS[ord("0") : ord("9") + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def terms_of(texts: pa.Array, keep: np.ndarray) -> Words:
    """The maximal runs of bytes of ``keep``, A-Z lower-cased; a null text has none."""
    data, offsets = text_bytes(texts)
    return Words(_LOWER[data], offsets, keep)


def _flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of all slices, end to end."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def same_bytes(a: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether each slice of ``a``, none of which is empty, has the bytes of the slice of ``b`` beside it."""
    same = a_end - a_start == b_end - b_start
    at = np.flatnonzero(same)
    size = (a_end - a_start)[at]
    if len(at):
        differ = a[_flat(a_start[at], size)] != b[_flat(b_start[at], size)]
        same[at] = np.add.reduceat(differ, np.cumsum(size) - size, dtype=np.int64) == 0
    return same


def grouped(words: Words, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(group of each term, a term of each group); terms are of one group if and only if their bytes are equal."""
    if not len(words.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = words.data.tobytes()
    places = zip(words.start.tolist(), words.end.tolist())
    hashes = np.fromiter((digest(raw[s:e]) for s, e in places), np.uint64, len(words.start))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    leader = first[group]
    same = same_bytes(words.data, words.start, words.end, words.data, words.start[leader], words.end[leader])
    others: dict[bytes, int] = {}
    more = []
    for k in np.flatnonzero(~same):
        term = raw[words.start[k] : words.end[k]]
        if term not in others:
            others[term] = len(first) + len(more)
            more.append(k)
        group[k] = others[term]
    return group, np.concatenate([first, np.array(more, np.int64)])


def strings(words: Words, which: np.ndarray) -> pa.Array:
    """The terms at ``which`` as an Arrow array."""
    size = (words.end - words.start)[which]
    offsets = np.zeros(len(which) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    data = words.data[_flat(words.start[which], size)] if len(which) else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of ``keys``, ascending, and how often each is there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))
