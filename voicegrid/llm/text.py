"""Vectorised tokenising and hashing of Arrow string columns.

All helpers work on a slice of an Arrow batch at a time: the bytes of its texts
lie end to end in one buffer, so word boundaries, word hashes and per-document
counts are NumPy operations over that buffer and no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time.
SLICE_BYTES = 1 << 21
_SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Word bytes: everything but white space (0x20, 0x09-0x0D).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes: a-z, 0-9 and all bytes of non-ASCII letters (for lower-cased text).
ALNUM = np.zeros(256, bool)
ALNUM[ord("a") : ord("z") + 1] = True
ALNUM[ord("0") : ord("9") + 1] = True
ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """Independent hash of ``x`` for each ``seed``."""
    return mix(x + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % (1 << 64)))


def slices(batches: Iterator[pa.RecordBatch], columns: str | tuple[str, ...], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the columns hold about ``limit`` bytes, one row at least."""
    columns = (columns,) if isinstance(columns, str) else columns
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.utf8_lower(texts)
    texts = texts.cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = _SEGMENT
    while size < n + 1:
        size *= 2
    if size not in _powers:
        tables = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            tables.append(np.cumprod(p, dtype=np.uint64))
        if size > _SEGMENT:  # a single word of over a megabyte: not kept
            return tables[0], tables[1]
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


class Words:
    """Words of a slice: start and end byte, document row, and prefix hashes on demand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, keep: np.ndarray):
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        inside = keep[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        first[begins] = inside[begins]
        last[ends] = inside[ends]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.bounds)
        self.row = np.repeat(np.arange(self.n_docs), self.counts)

    def hashes(self, *prefixes: int) -> list[np.ndarray]:
        """64-bit hash of each whole word, then of its first p bytes for each p in ``prefixes``."""
        n = len(self.start)
        out = [np.empty(n, np.uint64) for _ in range(1 + len(prefixes))]
        at = 0
        while at < n:
            origin = int(self.start[at])
            to = max(at + 1, int(np.searchsorted(self.end, origin + _SEGMENT - 1, "right")))
            stop = int(self.end[to - 1])
            power, inverse = _power_tables(stop - origin)
            sums = np.zeros(stop - origin + 1, np.uint64)
            np.cumsum((self.data[origin:stop].astype(np.uint64) + np.uint64(1)) * power[: stop - origin], out=sums[1:])
            s, e = self.start[at:to] - origin, self.end[at:to] - origin
            for k, p in enumerate((None, *prefixes)):
                to_byte = e if p is None else np.minimum(e, s + p)
                out[k][at:to] = mix((sums[to_byte] - sums[s]) * inverse[s])
            at = to
        return out

    def ngram(self, hashes: np.ndarray, gaps: tuple[int, ...], seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of every tuple of words at i and i + gap, for all gaps, within one document."""
        span = max(gaps)
        n = len(hashes) - span
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        whole = self.row[:n] == self.row[span:]
        h = hashes[:n].copy()
        for g in gaps:
            h *= np.uint64(0xD1342543DE82EF95)
            h ^= h >> np.uint64(29)
            h += hashes[g : g + n]
        return seeded(h[whole], seed), self.row[:n][whole]


def words_of(texts: pa.Array, lower: bool = False, keep: np.ndarray = NOT_SPACE) -> Words:
    return Words(*text_bytes(texts, lower), keep)
