"""Ranked lexical search: the best documents for each item, by sort-based accumulation of impacts.

Terms are runs of letters and digits, A-Z lower-cased (``terms``). A document scores, for
each term of an item, repeats included, the term's weight (from the number of documents
that hold it) times its impact (from its occurrences in the document and the
document's length); ``weight`` and ``impact`` are the formulas. Weights are computed in
doubles, all else in whole numbers.

Items are queries against all documents. They are dealt by hash to blocks of about
``BLOCK_BYTES`` of text, so what is broadcast, the index of one block's terms, is
bounded; each block reads the documents twice. First the block's terms are counted in
the documents where they lie, which gives weights. Then every slice of documents
finds its matches in the index, with a check of the bytes, and joins them to the items
that hold the term: arrays of (document, item, impact). Keys packed from document and item
are sorted by radix, 16 bits a pass, and equal keys are summed by ``reduceat``. Heaps
of ``TOP`` documents an item live as long as a task; what they hold at its end is all that
a task returns. These rows are written, dealt by ranges of items and ranked.

A null or empty text has no term, as a document or as an item. Rows of documents that
repeat are documents of their own; a null doc_id comes last among equal scores. Each
row of the items is an item, so rows that repeat have the same documents again. Very
long texts are searched whole; tables without rows, or items without terms, give
nothing; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import materialize
from .terms import LETTERS_DIGITS, grouped, same_bytes, strings, tallied, terms_of
from .text import Words, slices

TOP = 10
#: Bytes of the texts of items that are searched for together, about.
BLOCK_BYTES = 4 << 20
#: Matches of terms and items that are sorted at once, about.
SORTED = 1 << 21
_FILTER_BITS = 20


def weight(n_docs: int, holding: int) -> int:
    """Of a term that ``holding`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def impact(times: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Of a term that is ``times`` in a document of ``length`` terms; ``n_terms`` is the terms of all documents."""
    m = 100 - 75 + 75 * length * n_docs // max(1, n_terms)
    return 1_000_000_000 * times // (1000 * times + 8 * m)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned keys, 16 bits a pass from the lowest; NumPy sorts such digits by radix."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    shift, most = 16, int(keys.max()) if len(keys) else 0
    while most >> shift:
        digit = (keys[order] >> np.uint64(shift) & np.uint64(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
        shift += 16
    return order


@dataclass
class Index:
    """Terms of a block of items, by their hashes, and the items that hold each."""

    hashes: np.ndarray
    words: Words
    place: np.ndarray  # of each term among ``words``
    names: list[str]
    begin: np.ndarray  # where each term's items begin in ``items``
    items: np.ndarray
    times: np.ndarray  # occurrences of the term in the item
    n_items: int
    _near: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self._near = np.zeros(1 << _FILTER_BITS, bool)
        self._near[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True
        # Terms that share a hash stand side by side; all but never there is one a hash.
        self.most = int(tallied(self.hashes)[1].max(initial=0))

    @classmethod
    def of(cls, texts: list[str]) -> Index:
        words = terms_of(pa.array(texts, pa.string()), LETTERS_DIGITS)
        term, first = grouped(words)
        (hashes,) = words.hashes()
        order = np.argsort(hashes[first], kind="stable")
        number = np.empty(len(first), np.int64)
        number[order] = np.arange(len(first))
        pairs, times = tallied(number[term] * max(1, len(texts)) + words.row)
        first = first[order]
        begin = np.searchsorted(pairs, np.arange(len(first) + 1) * max(1, len(texts)))
        return cls(hashes[first], words, first, strings(words, first).to_pylist(), begin, pairs % max(1, len(texts)), times, len(texts))

    def found(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(row, term) of each occurrence of a term of the index in the documents of ``words``."""
        (hashes,) = words.hashes()
        near = np.flatnonzero(self._near[hashes >> np.uint64(64 - _FILTER_BITS)])
        at = np.searchsorted(self.hashes, hashes[near])
        rows, terms = [], []
        for k in range(self.most):
            here = np.minimum(at + k, len(self.hashes) - 1)
            hit = self.hashes[here] == hashes[near]
            which, here = near[hit], here[hit]
            place = self.place[here]
            same = same_bytes(words.data, words.start[which], words.end[which], self.words.data, self.words.start[place], self.words.end[place])
            rows.append(words.row[which[same]])
            terms.append(here[same])
        return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(terms or [np.zeros(0, np.int64)])

    def postings(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, occurrences) by row, then term."""
        row, term = self.found(words)
        keys, times = tallied(row * max(1, len(self.hashes)) + term)
        return keys // max(1, len(self.hashes)), keys % max(1, len(self.hashes)), times


def counted(docs: DataFrame, index: Index) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and for each term of the index the documents that hold it."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        holding, n_docs, n_terms = np.zeros(len(index.hashes), np.int64), 0, 0
        for part in slices(batches, "text"):
            words = terms_of(part.column("text"), LETTERS_DIGITS)
            n_docs, n_terms = n_docs + int((words.counts > 0).sum()), n_terms + len(words.start)
            holding += np.bincount(index.postings(words)[1], minlength=len(holding))
        some = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([[n_docs, n_terms], holding[some]]))], ["term", "n"])

    # A row for each term of the block.
    found = dict(docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(k, 0) for k in range(len(index.hashes))], np.int64)


def accumulated(index: Index, words: Words, weights: np.ndarray, n_docs: int, n_terms: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, item, score) of the documents of ``words`` that share a term with an item, some rows at a time."""
    row, term, times = index.postings(words)
    size = np.diff(index.begin)[term]
    worth = impact(times, words.counts[row], n_docs, n_terms)
    ends, at = np.cumsum(size), 0
    while at < len(row):
        # Whole rows: as many as make about SORTED matches.
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SORTED, "right"))
        to = int(np.searchsorted(row, row[min(max(to, at + 1), len(row)) - 1], "right"))
        many, base = size[at:to], int(row[at])
        place = np.repeat(index.begin[term[at:to]] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        keys = (np.repeat(row[at:to] - base, many) * index.n_items + index.items[place]).astype(np.uint64)
        gain = np.repeat(worth[at:to] * weights[term[at:to]], many) * index.times[place]
        order = radix_order(keys)
        keys, gain = keys[order], gain[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        if len(first):
            key = keys[first].astype(np.int64)
            yield key // index.n_items + base, key % index.n_items, np.add.reduceat(gain, first)
        at = to


def _block(docs: DataFrame, items: list[tuple], top: int) -> DataFrame:
    """item, item_id, copies, doc_id, score of the ``top`` documents, at least, of each of ``items`` (item_id, text, copies), numbered from 0."""
    index = Index.of([text or "" for _, text, _ in items])
    n_docs, n_terms, holding = counted(docs, index)
    weights = np.array([weight(n_docs, int(h)) for h in holding], np.int64)
    known = [(i, copies) for i, _, copies in items]
    shared = docs.sparkSession.sparkContext.broadcast((index, known, weights, n_docs, n_terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known, weights, n_docs, n_terms = shared.value
        heaps: list[list[tuple]] = [[] for _ in range(index.n_items)]
        least = np.ones(index.n_items, np.int64)  # scores that still count
        for part in slices(batches, "text"):
            ids = part.column("doc_id").to_pylist()
            for row, item, score in accumulated(index, terms_of(part.column("text"), LETTERS_DIGITS), weights, n_docs, n_terms):
                good = np.flatnonzero(score >= least[item])
                for k, i, s in zip(row[good].tolist(), item[good].tolist(), score[good].tolist()):
                    heap, entry = heaps[i], (s, ids[k] is not None, -(ids[k] or 0))
                    if len(heap) < top:
                        heapq.heappush(heap, entry)
                    else:
                        heapq.heappushpop(heap, entry)
                    if len(heap) == top:
                        least[i] = heap[0][0]
        rows = [(i, *known[i], -d if has_id else None, s) for i, heap in enumerate(heaps) for s, has_id, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["item", "item_id", "copies", "doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "item long, item_id long, copies long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``items`` (item_id, text) the ``top`` best of ``docs`` (doc_id, text) with a score above 0."""
    spark = docs.sparkSession
    distinct = materialize(items.groupBy("item_id", "text").agg(F.count("*").alias("copies")), "items")
    size = distinct.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    blocks = -(-size // block_bytes)
    found = spark.createDataFrame([], "block int, item long, item_id long, copies long, doc_id long, score long")
    for k in range(blocks):
        rows = distinct.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # about block_bytes
        if rows:
            found = found.unionByName(_block(docs, [tuple(r) for r in rows], top).withColumn("block", F.lit(k)))
    best = materialize(found, "found").repartitionByRange("block", "item")
    rank = F.row_number().over(Window.partitionBy("block", "item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    best = best.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("item_id", "rank", "doc_id", "score")


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
every AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs),
postings AS (SELECT r, doc_id, length, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS length, unnest(terms) AS term FROM docs) GROUP BY ALL),
wanted AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark)) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, every GROUP BY term),
scored AS (SELECT i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * length * n_docs) // n_terms))))::BIGINT AS score
  FROM wanted JOIN postings USING (term) JOIN weights USING (term), every GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""
