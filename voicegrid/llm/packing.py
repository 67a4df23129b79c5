"""Best-fit packing of token sequences by exact complements, planned on counts of lengths.

A document is its token ids and one ``END`` more. One of over ``SEQUENCE`` ids is cut from
its end into pieces of ``SEQUENCE``, so that only its first piece may be shorter; all
others are one piece. Where a piece goes depends on nothing but its length, so the plan
is made for the counts of lengths, of which there are ``SEQUENCE`` at most, however
many documents there are:

* From the longest length down, a piece opens a sequence and its gap is looked up
  among the lengths that are left: first, for all openers, one that equals it, then two
  that sum up to it, then three. A combination that fits exactly is used as often as its
  lengths are available, all at once. Lengths are the slots of a table of counts, so a
  pair or triple is found by looking up what its longer pieces leave of the gap.
* What has no exact complement is packed best-fit, longest first: into the smallest gap
  that holds it, sequences of like gap together; pieces that fit nowhere open sequences.
* Triples may use up short pieces that would have filled more gaps alone, so plans with
  complements of up to three, two, one and no pieces are made, and the one with the
  fewest sequences is taken.

Each step uses up a length or a group of sequences, so the plan has some thousand
rows at most: (length, ranks from, to, sequence, offset, repeats). Pieces are numbered
among those of like length: within a task as they are cut, and across tasks by sums
of the tasks' counts. A piece's rank tells its place in the plan, by a search in the
broadcast plan, whose size is bounded. Texts are read once and never shuffled; what is
written in between is a row a piece, without its ids.

Null and empty texts are the one id ``END``. Documents that repeat, or have null ids, are
packed each on its own; pieces of like length are alike, so ties don't matter. Very long
texts are cut whole. An empty table gives an empty result; other columns, whatever their
names, don't matter.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import _PIECE, _has_safe_places, default_vocabulary
from .store import materialize
from .text import slices

#: Ids in a sequence at most, and the id behind each document.
SEQUENCE, END = 2048, 0
#: Characters of the pieces that a worker keeps, about; beyond that it starts anew.
KEPT = 16_000_000
#: Fixed value: the pattern of byte-level pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The end of Unicode's Latin blocks, in which all places are taken.
LATIN_END = "\u0250"
#: A space beside other white space.
_UNSAFE = re.compile(r"\s(?: |(?<= )\s)")

#: Lengths of a sequence, longest first, and how many such sequences there are.
Filled = tuple[tuple[int, ...], int]


class Ids:
    """Token ids of texts as little-endian 32-bit numbers; lives as long as its worker.

    Vocabularies with safe places (``bpe``) let a text be put together from its pieces
    between single spaces, which are kept by what follows their space. New pieces are
    encoded by the library, or, where that is known to give the same ids, by the
    faster one of tiktoken: if merges ascend with the ids that they make, and each
    id beyond the bytes is made by one merge, then both libraries merge the same
    pairs in the same order; Latin letters are of the same kind in either's tables.
    """

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.safe = _has_safe_places(self.library)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.quick = self._ranked() if self.safe else None
        self.known: dict[str, bytes] = {}  # ids of a space and the text
        self.heads: dict[str, bytes] = {}  # ids of the text, which begins a document
        self.held = 0

    def _ranked(self):
        """tiktoken's encoder of the same vocabulary, or None where it isn't known to be the same."""
        spec = json.loads(self.library.to_str())["model"]
        vocab = {k: n for k, n in spec["vocab"].items() if k not in self.special}
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["merges"]]
        if spec.get("ignore_merges") or any(x >= y for x, y in zip(made, made[1:])) or len(made) + 256 != len(vocab):
            return None
        import tiktoken

        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in visible]
        byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in k): n for k, n in vocab.items()}
        return tiktoken.Encoding("same", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def _encoded(self, texts: list[str]) -> list[bytes]:
        plain = [k for k, t in enumerate(texts) if self.quick and max(t, default="") < LATIN_END and not any(s in t for s in self.special)]
        out: list[bytes] = [b""] * len(texts)
        for k in plain:
            out[k] = array("I", self.quick(texts[k])).tobytes()
        rest = sorted(set(range(len(texts))).difference(plain))
        for k, found in zip(rest, self.library.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = np.array(found.ids, "<u4").tobytes()
        return out

    def _learn(self, into: dict[str, bytes], new: list[str], before: str) -> None:
        into.update(zip(new, self._encoded([before + t for t in new]), strict=True))
        self.held += sum(map(len, new))

    def of(self, texts: list[str]) -> list[bytes]:
        if not self.safe:
            return self._encoded(texts)
        if self.held > KEPT:
            self.known, self.heads, self.held = {}, {}, 0
        cut = []
        for t in texts:
            if _UNSAFE.search(t):
                first, *more = _PIECE.findall(t)
                cut.append([first, *(p[1:] for p in more)])
            else:
                cut.append(t.split(" "))
        self._learn(self.heads, list({c[0] for c in cut} - self.heads.keys()), "")
        found = [list(map(self.known.get, c[1:])) for c in cut]
        new = {p for c, f in zip(cut, found) if None in f for p, ids in zip(c[1:], f) if ids is None}
        if new:
            self._learn(self.known, list(new), " ")
            found = [list(map(self.known.get, c[1:])) if None in f else f for c, f in zip(cut, found)]
        return [self.heads[c[0]] + b"".join(f) for c, f in zip(cut, found)]


_ids: dict[str, Ids] = {}


def pieces(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of ``docs`` (doc_id, text), with its task (part) and its rank among those of its length there (at)."""
    vocabulary = vocabulary or default_vocabulary()
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _ids:
            _ids[vocabulary] = Ids(vocabulary)
        seen, task = [0] * (sequence + 1), TaskContext.get().partitionId()
        for part in slices(batches, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            rows, found = [], []
            for row, ids in enumerate(_ids[vocabulary].of(texts)):
                ids += last
                n = len(ids) // 4
                start, stop, piece = 0, n % sequence or min(n, sequence), 0
                while start < n:
                    length = stop - start
                    rows.append(row)
                    found.append((piece, start, length, zlib.crc32(ids[4 * start : 4 * stop]), task, seen[length]))
                    seen[length] += 1
                    start, stop, piece = stop, stop + sequence, piece + 1
            columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(6)]
            columns[0] = columns[0].cast(pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows, pa.int64())), *columns], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "at"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, part long, at long")


class Lengths:
    """How many pieces of each length are left, with an index of sums."""

    def __init__(self, counts: dict[int, int], sequence: int):
        self.left = np.zeros(sequence + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n

    def _enough(self, *lengths: int) -> int:
        """How often the lengths can be taken together."""
        return min(int(self.left[x]) // lengths.count(x) for x in lengths)

    def pair(self, gap: int, most: int) -> tuple[int, int] | None:
        """Two lengths of ``most`` at most that sum up to ``gap``, the longer as long as can be."""
        a = np.arange(min(gap - 1, most), (gap + 1) // 2 - 1, -1)
        here = np.flatnonzero((self.left[a] > 0) & (self.left[gap - a] > (2 * a == gap)))
        return (int(a[here[0]]), int(gap - a[here[0]])) if len(here) else None

    def triple(self, gap: int) -> tuple[int, int, int] | None:
        """Three lengths that sum up to ``gap``, the longest as long as can be."""
        for a in range(gap - 2, (gap + 2) // 3 - 1, -1):
            if self.left[a]:
                self.left[a] -= 1
                rest = self.pair(gap - a, min(a, gap - a - 1))
                self.left[a] += 1
                if rest:
                    return (a, *rest)
        return None

    def complement(self, gap: int, size: int) -> tuple[int, ...] | None:
        """As many lengths as ``size`` (1 to 3) that are left and fill ``gap`` exactly."""
        if size == 1:
            return (gap,) if self.left[gap] else None
        return self.pair(gap, gap - 1) if size == 2 else self.triple(gap)

    def take(self, opener: int, rest: tuple[int, ...]) -> int:
        """Use up an opener and its complement as often as both are there."""
        n = self._enough(opener, *rest)
        for x in (opener, *rest):
            self.left[x] -= n
        return n


def plan(counts: dict[int, int], sequence: int = SEQUENCE) -> list[Filled]:
    """Sequences that hold ``counts`` pieces of each length: the fewest of those that complements of up to 3, 2, 1 pieces lead to."""
    return min((_plan(counts, sequence, largest) for largest in (3, 2, 1, 0)), key=lambda filled: sum(n for _, n in filled))


def _plan(counts: dict[int, int], sequence: int, largest: int) -> list[Filled]:
    """Exact complements of one piece for all lengths, then of two, and so on to ``largest``; then best-fit."""
    lengths = Lengths(counts, sequence)
    left = lengths.left
    out: list[Filled] = [((sequence,), int(left[sequence]))] if left[sequence] else []
    for size in range(1, largest + 1):
        for opener in range(sequence - 1, 0, -1):
            while left[opener]:
                left[opener] -= 1
                found = lengths.complement(sequence - opener, size)
                left[opener] += 1
                if not found:
                    break
                out.append(((opener, *found), lengths.take(opener, found)))
    rest = [(x, int(left[x])) for x in range(sequence - 1, 0, -1) if left[x]]
    # Best fit: gaps ascend; each has its groups of sequences.
    gaps: list[int] = []
    open_: dict[int, list[list]] = {}

    def put(filled: tuple[int, ...], gap: int, n: int) -> None:
        if gap not in open_:
            open_[gap] = []
            insort(gaps, gap)
        open_[gap].append([filled, n])

    for length, n in rest:
        while n:
            k = bisect_left(gaps, length)
            if k == len(gaps):
                each = sequence // length
                if n >= each:
                    put((length,) * each, sequence - each * length, n // each)
                if n % each:
                    put((length,) * (n % each), sequence - n % each * length, 1)
                break
            gap = gaps[k]
            filled, many = open_[gap].pop()
            if not open_[gap]:
                del open_[gap], gaps[k]
            each = min(gap // length, n)  # the gap that is left stays the smallest that fits
            used = min(many, n // each)
            if many > used:
                put(filled, gap, many - used)
            put(filled + (length,) * each, gap - each * length, used)
            n -= used * each
    return out + [(filled, n) for groups in open_.values() for filled, n in groups]


def placed(filled: list[Filled]) -> np.ndarray:
    """Rows (length, rank from, sequence from, offset, repeats in a sequence), by length, then rank."""
    next_rank: dict[int, int] = {}
    rows, first = [], 0
    for lengths, n in filled:
        offset = 0
        for length in dict.fromkeys(lengths):
            repeats = lengths.count(length)
            rank = next_rank.get(length, 0)
            rows.append((length, rank, first, offset, repeats))
            next_rank[length] = rank + repeats * n
            offset += repeats * length
        first += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs`` (doc_id, text)."""
    cut = materialize(pieces(docs, vocabulary, sequence, end), "pieces")
    tasks = materialize(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length
    table = placed(plan(counts, sequence))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    before = tasks.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("at") + F.col("before")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        begin = np.searchsorted(table[:, 0], np.arange(sequence + 2))
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = np.zeros(len(length), np.int64)
            for x in np.unique(length):
                mine = length == x
                row[mine] = begin[x] + np.searchsorted(table[begin[x] : begin[x + 1], 1], rank[mine], "right") - 1
            _, first, base, offset, repeats = table[row].T
            columns = [pa.array(base + (rank - first) // repeats), pa.array(offset + (rank - first) % repeats * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
