"""Document fingerprints by I-Match over randomised lexicon subsets.

The lexicon is the terms (lower-cased words of letters and digits) whose inverse
document frequency, counted over all documents, lies in a band: neither words
of every text nor words of a few. Of a document with n terms in the band, the
distinct terms in order are cut down to randomised subsets of the lexicon, which
keep a term with chance 1/m, 1/2m and 1/4m for the power of two m next below n;
``SUBSETS`` subsets at each of the three levels. The hash of what a subset keeps
is one part of the fingerprint: it stays as long as none of the few terms that
the subset keeps comes or goes. That holds for any number of terms; a text without
a term in the band has the digest of its whole text for a fingerprint, which is like
that of equal texts alone.

Likeness is the share of equal parts among those that either of two fingerprints
has, over the levels that both have; 1 for equal fingerprints.

The documents' frequencies sum to the distinct terms of all documents, so at
most (mean distinct terms of a document) * exp(``IDF[1]``) terms are in the band,
however many documents there are. The lexicon is always the whole band. It is counted before it
is collected: up to ``MOST_TERMS`` terms are broadcast; where documents are so long that there are
more, the terms of every few documents meet the band in a join, and these documents meet the part of
it that they hold. Both ways have the same results.

``edited`` sets each document against the next one by ascending doc_id (the last
against the first; null ids first, ties by text). Texts are dealt by ranges of
doc_id, compressed, and handled in order; the first and last documents of ranges
meet in a small join. A table of one row follows itself.

Null and empty texts have no term and are like one another. Very long texts are
fingerprinted whole. Rows that repeat give a row each, an empty table none; further
columns of the documents, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import materialize, shuffle_partitions
from .text import ALNUM, mix, seeded, slices, words_of

#: Inverse document frequencies, natural logarithms: 1/7 to 1/1097 of all documents.
IDF = (2.0, 7.0)
SUBSETS, LEVELS = 16, 3
#: Terms of a lexicon that is broadcast at most, 8 bytes each; larger ones are joined.
MOST_TERMS = 1 << 22
_FLUSH = 1 << 20


def distinct_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(term hashes, rows, documents): the distinct terms of each document, in order."""
    words = words_of(texts, lower=True, keep=ALNUM)
    (hashes,) = words.hashes()
    order = np.lexsort((hashes, words.row))
    h, row = hashes[order], words.row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[fresh], row[fresh], words.n_docs


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text to term, n: documents of the partition that hold each term."""
    terms, n, fresh, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate([terms, *fresh])
        counts = np.concatenate([n, np.ones(len(every) - len(terms), np.int64)])
        order = np.argsort(every, kind="stable")
        every, counts = every[order], counts[order]
        at = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
        return every[at], np.add.reduceat(counts, at) if len(at) else counts

    def rows() -> Iterator[pa.RecordBatch]:
        for at in range(0, len(terms), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(terms[at : at + 100_000].view(np.int64)), pa.array(n[at : at + 100_000])], ["term", "n"])

    for part in slices(batches, "text"):
        h, _, _ = distinct_terms(part.column("text"))
        fresh.append(h)
        waiting += len(h)
        if waiting > _FLUSH:
            terms, n = merged()
            fresh, waiting = [], 0
            if len(terms) > 2 * _FLUSH:
                yield from rows()
                terms, n = terms[:0], n[:0]
    terms, n = merged()
    yield from rows()


def lexicon_terms(docs: DataFrame, idf: tuple[float, float] = IDF) -> DataFrame:
    """term: hashes, as signed integers, of all terms of ``docs`` (text) in the band."""
    documents = docs.count()
    counts = docs.select("text").mapInArrow(_counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    least, most = documents * np.exp(-idf[1]), documents * np.exp(-idf[0])
    return materialize(counts.where((F.col("n") >= float(least)) & (F.col("n") <= float(most))).select("term"), "band")


def _collected(terms: DataFrame) -> np.ndarray:
    return np.sort(terms.toArrow().column("term").to_numpy().view(np.uint64))


def lexicon(docs: DataFrame, idf: tuple[float, float] = IDF, most_terms: int | None = None) -> np.ndarray:
    """Ascending hashes of the terms of ``docs`` (text) in the band, all of them; with ``most_terms``, which ``compare`` never gives, about that many, chosen by hash."""
    terms = lexicon_terms(docs, idf)
    if most_terms is not None and (size := terms.count()) > most_terms:
        terms = terms.where(F.shiftrightunsigned(F.xxhash64("term"), 34) < int((1 << 30) * most_terms / size))
    return _collected(terms)


def fingerprints(texts: pa.Array, band: np.ndarray) -> list[str]:
    """The lowest level and the parts, four hexadecimal digits each, 0000 for a part without terms; ``=`` and a digest for a text without a term in the band."""
    h, row, n = distinct_terms(texts)
    known = np.zeros(1 << 20, bool)
    known[band >> np.uint64(44)] = True
    maybe = np.flatnonzero(known[h >> np.uint64(44)])
    inside = np.zeros(len(h), bool)
    if len(band):
        at = np.minimum(np.searchsorted(band, h[maybe]), len(band) - 1)
        inside[maybe] = band[at] == h[maybe]
    parts = _parts(h[inside], row[inside], n)
    return [part or _digest(text.as_py()) for part, text in zip(parts, texts, strict=True)]


def _digest(text: str | None) -> str:
    return f"={hashlib.md5((text or '').encode()).hexdigest()}"


def _parts(h: np.ndarray, row: np.ndarray, n: int) -> list[str | None]:
    """Level and parts of ``n`` documents from their distinct terms in the lexicon, those of a row side by side; None without any."""
    counts = np.bincount(row, minlength=n)
    level = np.floor(np.log2(np.maximum(counts, 1))).astype(np.uint64)
    parts = np.zeros((n, LEVELS * SUBSETS), np.uint16)
    for s in range(SUBSETS):
        draw = seeded(h, 100 + s)
        at = level[row]
        # Chance 2^-level; a shift by 64 isn't defined, so level 0 keeps all.
        kept = np.flatnonzero((at == 0) | ((draw >> (np.uint64(64) - np.maximum(at, np.uint64(1)))) == 0))
        for j in range(LEVELS):
            if j:
                kept = kept[draw[kept] >> (np.uint64(64) - at[kept] - np.uint64(j)) == 0]
            if len(kept):
                owner = row[kept]
                begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                total = np.add.reduceat(mix(h[kept] + np.uint64(s)), begins)
                parts[owner[begins], j * SUBSETS + s] = np.maximum((mix(total) >> np.uint64(48)).astype(np.uint16), 1)
    return [f"{int(level[k]):02d}:{parts[k].astype('>u2').tobytes().hex()}" if counts[k] else None for k in range(n)]


def likeness(one: str, two: str) -> float:
    if one == two:
        return 1.0
    if "=" in (one[:1], two[:1]):
        return 0.0
    width = 4 * SUBSETS
    levels = [{int(f[:2]) + j: f[3 + j * width : 3 + (j + 1) * width] for j in range(LEVELS)} for f in (one, two)]
    same = either = 0
    for level in levels[0].keys() & levels[1].keys():
        a, b = (x[level] for x in levels)
        for k in range(0, width, 4):
            if a[k : k + 4] != "0000" or b[k : k + 4] != "0000":
                either += 1
                same += a[k : k + 4] == b[k : k + 4]
    return same / either if either else 0.0


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _batch(ids: pa.Array, texts: list[str], edited: list[str], own: list[str], theirs: list[str], nexts: list[str]) -> pa.RecordBatch:
    columns = {
        "doc_id": ids,
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        "fingerprint": pa.array(own, pa.string()),
        "edited_fingerprint": pa.array(theirs, pa.string()),
        "near_edited": pa.array([likeness(a, b) for a, b in zip(own, theirs, strict=True)], pa.float64()),
        "near_next": pa.array([likeness(a, b) for a, b in zip(own, nexts, strict=True)], pa.float64()),
    }
    return pa.RecordBatch.from_pydict(columns)


def _compared(ids: pa.Array, texts: list[str], band: np.ndarray) -> pa.RecordBatch:
    """Results of all documents but the last, which has no id; each is followed by the next."""
    every = fingerprints(pa.array(texts, pa.large_string()), band)
    changed = [_edited(a, b) for a, b in zip(texts, texts[1:])]
    theirs = fingerprints(pa.array(changed, pa.large_string()), band)
    return _batch(ids, texts[:-1], changed, every[:-1], theirs, every[1:])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3, write_content_size=True)
    for part in slices(batches, "text"):
        packed = [pack.compress((t or "").encode()) for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), part.column("row"), pa.array(packed, pa.binary())], ["doc_id", "tie", "row", "packed"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of about two million characters a time."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        ids, texts, held, first = batch.column("doc_id"), [], 0, 0
        for k, packed in enumerate(batch.column("packed")):
            texts.append(unpack.decompress(packed.as_py()).decode())
            held += len(texts[-1])
            if held > 2_000_000 or k == batch.num_rows - 1:
                yield ids.slice(first, k + 1 - first), texts
                texts, held, first = [], 0, k + 1


def _followed(docs: DataFrame, result: str, work: Callable[[pa.Array, list[str]], pa.RecordBatch]) -> DataFrame:
    """Rows (``result``) of ``work(doc_ids, texts)`` over ``docs`` in order, a slice at a time, and ``at``, another number for each row.

    ``work`` gets one text more than ids, that which follows the last.
    """
    spark = docs.sparkSession
    id_type = dict(docs.dtypes)["doc_id"]
    result = f"{result}, at long"
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"), "text")
    packed = keyed.mapInArrow(_packed, f"doc_id {id_type}, tie long, row long, packed binary")
    order = ("doc_id", "tie", "row")
    dealt = packed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0

        def done(batch: pa.RecordBatch, head: bool | None = None, text: str | None = None, end_id: pa.Array | None = None) -> pa.RecordBatch:
            n = batch.num_rows
            batch = batch.append_column("at", pa.array((part << 40) + seen + np.arange(n), pa.int64()))
            for name, value, kind in (("range", part, pa.int32()), ("head", head, pa.bool_()), ("text", text, pa.string())):
                batch = batch.append_column(name, pa.array([value] * n, kind))
            return batch.append_column("end_id", pa.nulls(n, ids.type) if end_id is None else end_id)

        def end(ids: pa.Array, text: str, head: bool) -> pa.RecordBatch:
            # Of this row only what ``done`` appends is read.
            return done(work(ids, ["", ""]), head, text, ids)

        held: tuple[pa.Array, str] | None = None
        for ids, texts in _unpacked(batches):
            if held is None:
                yield end(ids.slice(0, 1), texts[0], True)
                mine, own = ids, texts
            else:
                mine, own = pa.concat_arrays([held[0], ids]), [held[1], *texts]
            held = mine.slice(len(own) - 1, 1), own[-1]
            if len(own) > 1:
                batch = work(mine.slice(0, len(own) - 1), own)
                yield done(batch)
                seen += batch.num_rows
        if held is not None:
            yield end(held[0], held[1], False)

    found = materialize(dealt.mapInArrow(run, f"{result}, range int, head boolean, text string, end_id {id_type}"), "fingerprints")
    heads = found.where("head").select(F.col("range").alias("after"), F.col("text").alias("following"))
    # The last row of a range has a number that no other one was given.
    tails = found.where("not head").select("range", "end_id", "at", "text")
    # One row for each range: which range comes after it, the first after the last.
    ranges = heads.select("after")
    turn = Window.orderBy("range")
    after = ranges.select(F.col("after").alias("range")).withColumn("after", F.coalesce(F.lead("range").over(turn), F.first("range").over(turn)))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row = work(one.column("end_id"), [one.column("text")[0].as_py(), one.column("following")[0].as_py()])
                yield row.append_column("at", one.column("at"))

    last = tails.join(after, "range").join(heads, "after").select("end_id", "at", "text", "following").mapInArrow(close, result)
    return found.where("head is null").drop("range", "head", "text", "end_id").union(last)


def _result(docs: DataFrame) -> str:
    return f"doc_id {dict(docs.dtypes)['doc_id']}, {_RESULT}"


def edited(docs: DataFrame, band: np.ndarray) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of ``docs``; the lexicon is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(band)
    return _followed(docs, _result(docs), lambda ids, texts: _compared(ids, texts, shared.value)).drop("at")


def _bundle(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
    """One row: the documents, compressed together, and all terms that they or their edited texts have."""
    every = [*texts, *(_edited(a, b) for a, b in zip(texts, texts[1:]))]
    h, _, _ = distinct_terms(pa.array(every, pa.large_string()))
    raw = [t.encode() for t in texts]
    columns = {
        "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        "sizes": pa.array([[len(t) for t in raw]], pa.list_(pa.int64())),
        "texts": pa.array([zstandard.compress(b"".join(raw))], pa.binary()),
        "terms": pa.array([np.unique(h).tobytes()], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(columns)


def _unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """at, terms to a row for each term."""
    for batch in batches:
        for at, terms in zip(batch.column("at").to_pylist(), batch.column("terms").to_pylist(), strict=True):
            every = np.frombuffer(terms, np.int64)
            for k in range(0, len(every), 100_000):
                term = every[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(term), at, np.int64)), pa.array(term)], ["at", "term"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """at, term, sorted by at, to a row for each at with its terms, ascending."""

    def row(at: int, terms: list[np.ndarray]) -> pa.RecordBatch:
        band = np.sort(np.concatenate(terms).view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([band.tobytes()], pa.binary())], ["at", "band"])

    now, terms = None, []
    for batch in batches:
        at, term = batch.column("at").to_numpy(), batch.column("term").to_numpy()
        begins = np.flatnonzero(np.append(True, at[1:] != at[:-1])).tolist() if len(at) else []
        for first, end in zip(begins, [*begins[1:], len(at)]):
            if at[first] != now and terms:
                yield row(now, terms)
                terms = []
            now = int(at[first])
            terms.append(term[first:end])
    if terms:
        yield row(now, terms)


def edited_by_join(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of ``edited`` with a lexicon (term) of any size: a task holds of it what some two million characters of text hold."""
    id_type = dict(docs.dtypes)["doc_id"]
    every = _followed(docs, f"ids array<{id_type}>, sizes array<long>, texts binary, terms binary", _bundle)
    held = every.select("at", "terms").mapInArrow(_unfolded, "at long, term long").join(terms, "term", "left_semi")
    dealt = held.select("at", "term").repartition(shuffle_partitions(docs.sparkSession), "at").sortWithinPartitions("at")
    bands = dealt.mapInArrow(_gathered, "at long, band binary")
    met = every.select("at", "ids", "sizes", "texts").join(bands, "at", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ends = np.cumsum([0, *batch.column("sizes")[k].as_py()]).tolist()
                raw = zstandard.decompress(batch.column("texts")[k].as_py())
                texts = [raw[a:b].decode() for a, b in zip(ends, ends[1:])]
                band = np.frombuffer(batch.column("band")[k].as_py() or b"", np.uint64)
                yield _compared(batch.column("ids")[k].values, texts, band)

    return met.mapInArrow(run, _result(docs))


def compare(docs: DataFrame, most_terms: int = MOST_TERMS) -> DataFrame:
    """The result for every row of ``docs`` with the lexicon of ``docs``: broadcast, if it has ``most_terms`` terms at most, else joined, with the same result."""
    terms = lexicon_terms(docs)
    return edited_by_join(docs, terms) if terms.count() > most_terms else edited(docs, _collected(terms))
