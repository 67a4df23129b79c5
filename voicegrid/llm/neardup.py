"""Near-duplicate documents by DartMinHash signatures of weighted word shingles.

A document is the multiset of its five-word shingles (words: runs of anything
but white space; a text of fewer words is one shingle). Two documents are near
copies if the weighted Jaccard similarity of their multisets is 0.8 or more.

* Every unit of an element's weight throws hashed darts, a Poisson process of
  rate one over the element's weight and a rank axis. A document of weight W
  looks at ranks below about ``k (ln k + 4) / W``, so that all take equal work;
  each dart falls on one of k coordinates and the earliest dart of a coordinate
  is its signature there. Coordinates left empty are looked for at further
  ranks, so signatures are exact. Two signatures agree at a coordinate with
  the weighted Jaccard similarity as probability.
* Bands of four coordinates are hashed; in each band's bucket all members meet
  the bucket's centre, the first in one of a few random orders of all texts.
  Members unlike their centre are dealt anew, to smaller buckets by the hashes of
  a few more bands each, and meet a centre again, ``STARS`` rounds in all. So a
  bucket of m members makes m pairs a round and never all m*m, and the buckets of
  a large group of copies have few different centres.
* Pairs whose signatures agree clearly are links, pairs that disagree clearly
  are not, and all between are compared by their whole texts.
* Classes are the connected components of the links, by label propagation with
  pointer jumping over tables in the shared folder.
* A text may be near to members of a bucket but not to its centre. So every two
  texts that share a bucket and are not of one class yet are compared: the texts
  outside a bucket's largest class with all of its members, in cells of about ``BLOCK``
  by ``BLOCK`` texts. A first pass compares signatures in each cell and tells which of
  its texts have a doubtful partner; a second one fetches the texts of just these and
  compares them whole, pairs that agree most first and none that a link found before
  has joined. Cells send on the links that join classes, fewer than they have texts:
  the pairs are never rows. No pair that shares a bucket is left out.

Texts that are equal are one vertex: rows are grouped by a 128-bit hash of the text
before any band is dealt, and a vertex has a number of its own. So a group of exact
copies of any size costs one vertex and one row for each copy.

Null and empty texts count as copies of one another. Rows with a null doc_id
take part; a class has the smallest doc_id of its members, null if all are null.
Repeated rows stay (``near_duplicates``) or are reduced to one (``keep_one``); of ties
in doc_id, the text met first in the table of texts is kept. Very long texts are seen
whole; cells hold fewer of them. Columns other than doc_id and text, whatever their
names, pass through ``keep_one`` untouched; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize, renamed, scratch
from .text import NOT_SPACE, Words, mix, seeded, slices, text_bytes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
#: Further bands by each of which members unlike their centre are dealt anew.
SPREAD = 3
#: Texts, and bytes of them, that a cell holds of each side, about.
BLOCK, BLOCK_BYTES = 1024, 1 << 24
#: Pairs of signatures that are held at once, and pairs of texts compared at once.
_PAIRS, _STEP = 1 << 16, 64
#: From so many pairs a text on, texts are read once for a cell of pairs, of about so many bytes, instead of once for a pair.
DENSE, CELL = 16, 1 << 24
#: Rounds of members meeting centres of the bands' buckets.
STARS = 3
#: Random orders that bands take their centres by, in turn.
ORDERS = 4
#: Signature agreement from which on, and under which, no look at the texts is needed: about four standard deviations from 0.8.
SURE, NEVER = 0.96, 0.64

_RANK_BITS, _FRACTION_BITS = 40, 27
#: Poisson(1): cumulative probabilities of 0, 1, 2, ... darts in a unit region.
_POISSON = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 12)]))


def shingles(words: Words, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Unit elements of each document: (hash of shingle and occurrence number, row), sorted by row."""
    (hashes,) = words.hashes()
    h, row = words.ngram(hashes, tuple(range(1, width)), seed=1)
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = words.counts[short] > k
            extra[has] = mix(extra[has] * np.uint64(31) + hashes[words.bounds[short[has]] + k])
        h, row = np.concatenate([h, extra]), np.concatenate([row, short])
    key = np.sort((row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    at = np.arange(len(key))
    nth = at - np.maximum.accumulate(np.where(fresh, at, 0))
    element = (key & np.uint64((1 << 40) - 1)) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return element, (key >> np.uint64(40)).astype(np.int64)


def dart_signatures(element: np.ndarray, row: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(n_docs, k) signatures of unit elements, and which documents have any."""
    weight = np.bincount(row, minlength=n_docs)
    signature = np.zeros((n_docs, k), np.uint32)
    todo = np.flatnonzero(weight)
    reach = np.zeros(n_docs)
    reach[todo] = k * (np.log(k) + 4) / weight[todo]
    while len(todo):
        mine = np.isin(row, todo) if len(todo) < n_docs else slice(None)
        e, r = element[mine], row[mine]
        cells = np.ceil(reach[r]).astype(np.int64)
        unit = np.repeat(e, cells)
        owner = np.repeat(r, cells)
        cell = np.arange(len(unit)) - np.repeat(np.cumsum(cells) - cells, cells)
        region = mix(unit + cell.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        darts = np.searchsorted(_POISSON, (region >> np.uint64(11)).astype(np.float64) / (1 << 53), "right")
        hit = np.repeat(np.arange(len(unit)), darts)
        number = np.arange(len(hit)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = seeded(region[hit] + number.astype(np.uint64), 2)
        owner, cell = owner[hit], cell[hit]
        rank = (cell.astype(np.uint64) << np.uint64(_FRACTION_BITS)) | (dart >> np.uint64(64 - _FRACTION_BITS))
        seen = rank < (reach[owner] * (1 << _FRACTION_BITS)).astype(np.uint64)
        dart, owner, rank = mix(dart[seen]), owner[seen], rank[seen]
        slot = owner * k + ((dart >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((dart, rank))[::-1]
        flat = np.zeros(n_docs * k, np.uint32)
        found = np.zeros(n_docs * k, bool)
        found[slot] = True
        flat[slot[order]] = dart[order].astype(np.uint32)  # the last one written is the earliest
        full = found.reshape(n_docs, k)[todo].all(1)
        done = todo[full]
        signature[done] = flat.reshape(n_docs, k)[done]
        todo = todo[~full]
        reach[todo] *= 2
    return signature, weight > 0


def _signed(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """doc_id, hash, text to doc_id, hash, size, sig, bands; of equal texts of a slice, one is signed."""
    k = bands * rows
    for part in slices(batches, "text", 1 << 20):
        coded = part.column("hash").dictionary_encode()
        nth = coded.indices.to_numpy()
        one = np.empty(len(coded.dictionary), np.int64)
        one[nth[::-1]] = np.arange(part.num_rows)[::-1]
        data, offsets = text_bytes(part.column("text").take(pa.array(one)))
        words = Words(data, offsets, NOT_SPACE)
        signature, has = dart_signatures(*shingles(words), words.n_docs, k)
        hashes = np.zeros((words.n_docs, bands), np.uint64)
        for j in range(rows):
            hashes = mix(hashes * np.uint64(31) + signature[:, j::rows])
        hashes = seeded(hashes + np.arange(bands, dtype=np.uint64), 3).view(np.int64)
        counts = np.where(has, bands, 0)
        banded = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(hashes[has].ravel()))
        signed = pa.array([s.tobytes() if ok else None for s, ok in zip(signature, has, strict=True)], pa.binary())
        columns = [pa.array(np.diff(offsets)), signed, banded]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("hash"), *(c.take(coded.indices) for c in columns)], ["doc_id", "hash", "size", "sig", "bands"])


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to pairs of signatures the share of coordinates at which they agree."""
    for batch in batches:
        if not batch.num_rows:
            continue
        one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sig", "other_sig"))
        yield pa.RecordBatch.from_arrays([batch.column("vid"), batch.column("other"), pa.array((one == two).mean(1))], ["vid", "other", "agreement"])


def _similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted Jaccard similarity of the two texts of each pair."""
    for part in slices(batches, ("text", "other_text"), 1 << 21):
        sets = []
        for c in ("text", "other_text"):
            words = Words(*text_bytes(part.column(c)), NOT_SPACE)
            element, row = shingles(words)
            sets.append((element ^ mix(row.astype(np.uint64)), np.bincount(row, minlength=words.n_docs), row))
        (a, n_a, row), (b, n_b, _) = sets
        common = np.bincount(row[np.isin(a, b)], minlength=part.num_rows)
        yield pa.RecordBatch.from_arrays([part.column("vid"), part.column("other"), pa.array(common / np.maximum(1, n_a + n_b - common))], ["vid", "other", "similarity"])


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each count, one after the other."""
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


def _whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``by`` with the bounds of their groups, no group cut."""
    rest = None
    for batch in batches:
        if batch.num_rows:
            rest = pa.concat_tables([*([rest] if rest is not None else []), pa.Table.from_batches([batch])])
            keys = np.stack([rest.column(c).to_numpy() for c in by])
            bounds = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)])
            if len(bounds) > 1:
                yield rest.slice(0, bounds[-1]), bounds
                rest = rest.slice(bounds[-1])
    if rest is not None:
        yield rest, np.array([0, rest.num_rows])


class _Sets:
    """Disjoint sets of 0, 1, ..., n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart."""
        a, b = self.find(a), self.find(b)
        self.up[a] = b
        return a != b


def _cell_pairs(table: pa.Table, bounds: np.ndarray, label: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(asking, asked, agreement) of the pairs of different labels in the cells that may be near, each in its first common band."""
    vid, band, asks, outside = (table.column(c).to_numpy() for c in ("vid", "band", "asks", "outside"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(vid), -1)
    first, size = np.repeat(bounds[:-1], np.diff(bounds)), np.repeat(np.diff(bounds), np.diff(bounds))
    ask = np.flatnonzero(asks)
    start = 0
    while start < len(ask):
        stop = max(start + 1, int(np.searchsorted(np.cumsum(size[ask[start:]]), _PAIRS, "right")) + start)
        mine, start = ask[start:stop], stop
        q, o = np.repeat(mine, size[mine]), _ranges(first[mine], size[mine])
        use = ~asks[o] & (label[q] != label[o]) & (~outside[o] | (vid[q] < vid[o]))
        q, o = q[use], o[use]
        same = sig[q] == sig[o]
        agreement = same.mean(1)
        near = np.flatnonzero(agreement >= NEVER)
        near = near[same[near].reshape(len(near), sig.shape[1] // rows, rows).all(2).argmax(1) == band[q[near]]]
        yield q[near], o[near], agreement[near]


_CELL = ["bucket", "asking", "asked"]
_OF_CELL = ["bucket", "asking", "asked", "asks", "band", "outside", "vid"]


def _sure_and_doubtful(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Of cells with signatures: links (vid, other) that join labels, and the rows with a doubtful partner, whose ``other`` is null."""
    for table, bounds in _whole_groups(batches, _CELL):
        code = np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
        sets, doubtful, ends = _Sets(int(code.max()) + 1), np.zeros(table.num_rows, bool), []
        for q, o, agreement in _cell_pairs(table, bounds, code, rows):
            clear = np.flatnonzero(agreement >= SURE)
            _, one = np.unique(np.stack([code[q[clear]], code[o[clear]]]), axis=1, return_index=True)
            ends += [(int(q[k]), int(o[k])) for k in clear[one] if sets.join(int(code[q[k]]), int(code[o[k]]))]
            rest = np.flatnonzero(agreement < SURE)
            root = np.array([sets.find(k) for k in range(len(sets.up))])
            rest = rest[root[code[q[rest]]] != root[code[o[rest]]]]
            doubtful[q[rest]] = doubtful[o[rest]] = True
        vid = table.column("vid").to_numpy()
        ends = np.array(ends, np.int64).reshape(-1, 2)
        linked = table.take(pa.array(ends[:, 0])).select(_OF_CELL).append_column("other", pa.array(vid[ends[:, 1]]))
        needed = table.filter(pa.array(doubtful)).select(_OF_CELL)
        yield from pa.concat_tables([linked, needed.append_column("other", pa.nulls(needed.num_rows, pa.int64()))]).combine_chunks().to_batches()


def _near_in_cells(batches: Iterator[pa.RecordBatch], rows: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Of cells with signatures and texts: links (vid, other) between texts of that similarity that join labels."""
    for table, bounds in _whole_groups(batches, _CELL):
        for s, e in zip(bounds, bounds[1:]):
            cell, vid = table.slice(s, e - s), table.column("vid").to_numpy()[s:e]
            code = np.unique(cell.column("label").to_numpy(), return_inverse=True)[1]
            texts = _Shingled(cell.column("text").combine_chunks())
            sets, ends = _Sets(int(code.max()) + 1), []
            for q, o, agreement in _cell_pairs(cell, np.array([0, e - s]), code, rows):
                order = np.lexsort((-agreement, q))
                q, o = q[order], o[order]
                for part in np.split(o, np.flatnonzero(np.diff(q)) + 1) if len(q) else []:
                    mine, q = int(q[0]), q[len(part) :]
                    with texts.against(mine) as similar:
                        while len(part):
                            here = sets.find(int(code[mine]))
                            part = part[np.array([sets.find(int(k)) != here for k in code[part]])]
                            found = part[:_STEP][similar(part[:_STEP]) >= similarity]
                            ends += [(mine, int(k)) for k in found if sets.join(int(code[mine]), int(code[k]))]
                            part = part[_STEP:]
            yield pa.RecordBatch.from_arrays([pa.array(vid[x]) for x in np.array(ends, np.int64).reshape(-1, 2).T], ["vid", "other"])


class _Shingled:
    """Texts, each cut into shingles once, to be compared with one of them at a time."""

    def __init__(self, texts: pa.Array):
        words = Words(*text_bytes(texts), NOT_SPACE)
        element, row = shingles(words)
        self.weight = np.bincount(row, minlength=words.n_docs)
        self.first = np.cumsum(self.weight) - self.weight
        self.ids = np.unique(element, return_inverse=True)[1][np.argsort(row, kind="stable")]
        self.held = np.zeros(len(self.ids) + 1, bool)

    @contextmanager
    def against(self, one: int):
        """A function that gives the weighted Jaccard similarities of others to ``one``."""
        mine = self.ids[self.first[one] : self.first[one] + self.weight[one]]
        self.held[mine] = True

        def similar(others: np.ndarray) -> np.ndarray:
            hit = self.held[self.ids[_ranges(self.first[others], self.weight[others])]]
            common = np.bincount(np.repeat(np.arange(len(others)), self.weight[others]), hit, len(others))
            return common / np.maximum(1, self.weight[one] + self.weight[others] - common)

        yield similar
        self.held[mine] = False


def _cell_similarity(pairs: pa.Table, texts: pa.Table) -> pa.Table:
    """Weighted Jaccard similarity of the pairs of a cell, whose texts are each cut into shingles once."""
    vids = texts.column("of").to_numpy()
    shingled = _Shingled(texts.column("text").combine_chunks())
    by = np.argsort(vids)
    a, b = (by[np.searchsorted(vids, pairs.column(c).to_numpy(), sorter=by)] for c in ("vid", "other"))
    similarity, order = np.zeros(len(a)), np.argsort(a, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(a[order])) + 1) if len(order) else []:
        with shingled.against(int(a[part[0]])) as similar:
            for at in range(0, len(part), 1024):
                similarity[part[at : at + 1024]] = similar(b[part[at : at + 1024]])
    return pa.table({"vid": pairs.column("vid"), "other": pairs.column("other"), "similarity": pa.array(similarity)})


def components(links: DataFrame) -> DataFrame:
    """(vid, label) of all ends of ``links`` (vid, other): one vid of each connected component.

    Each round hooks every end to its smallest neighbour and contracts the links,
    so few are left after the first one, however large a component is.
    """
    edges = materialize(links.select(F.least("vid", "other").alias("vid"), F.greatest("vid", "other").alias("other")).where("vid != other").distinct(), "edges")
    labels = None
    while True:
        both = edges.union(edges.select("other", "vid"))
        hooks = materialize(both.groupBy("vid").agg(F.least(F.min("other"), F.col("vid")).alias("label")), "hooks")
        jump = hooks.select(F.col("vid").alias("label"), F.col("label").alias("further"))
        hooks = materialize(hooks.join(jump, "label").select("vid", F.col("further").alias("label")), "hooks")
        if labels is None:
            labels = hooks
        else:
            moved = labels.join(hooks.select(F.col("vid").alias("label"), F.col("label").alias("to")), "label", "left")
            labels = materialize(moved.select("vid", F.coalesce("to", "label").alias("label")), "labels")
        ends = [hooks.select(F.col("vid").alias(c), F.col("label").alias(f"{c}_to")) for c in ("vid", "other")]
        left = edges.join(ends[0], "vid").join(ends[1], "other").select(F.least("vid_to", "other_to").alias("vid"), F.greatest("vid_to", "other_to").alias("other"))
        edges = materialize(left.where("vid != other").distinct(), "edges")
        if edges.isEmpty():
            return labels


def _salt(turn: Column) -> Column:
    """XOR with it puts texts into one of the random orders, and back."""
    return F.xxhash64(F.lit("order"), F.pmod(turn, F.lit(ORDERS)))


def _finer(j: Column) -> Column:
    """A bucket within the bucket: by the j-th further band, the same one for all of its members."""
    here = F.xxhash64("bucket", "centre", j)
    bucket = F.xxhash64(here, F.element_at("bands", (F.pmod(here, F.size("bands")) + 1).cast("int")))
    return F.struct(bucket.alias("bucket"), _salt(j).alias("salt"))


def _agreements(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """(vid, other, agreement) of pairs (vid, other)."""
    joined = pairs.join(sigs.select("vid", "sig"), "vid").join(sigs.select(F.col("vid").alias("other"), F.col("sig").alias("other_sig")), "other")
    return joined.mapInArrow(_agreement, "vid long, other long, agreement double")


def _near(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (vid, other), each given once, whose texts are near copies."""
    ends = pairs.select("vid").union(pairs.select(F.col("other").alias("vid"))).distinct()
    n_pairs, (n_texts, n_bytes) = pairs.count(), texts.join(ends, "vid", "left_semi").agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    if n_pairs > DENSE * n_texts:
        side = max(8, -(-(n_bytes or 0) // CELL))
        cell = [F.pmod(F.xxhash64(c, F.lit("cell")), F.lit(side)) for c in ("vid", "other")]
        dealt = pairs.withColumn("cell", cell[0] * side + cell[1])
        held = dealt.select("cell", "vid").union(dealt.select("cell", "other")).distinct().join(texts, "vid").select(F.col("cell").alias("at"), F.col("vid").alias("of"), F.col("text").alias("text"))
        joined = dealt.groupBy("cell").cogroup(held.groupBy("at")).applyInArrow(_cell_similarity, "vid long, other long, similarity double")
    else:
        joined = pairs.join(texts, "vid").join(texts.select(F.col("vid").alias("other"), F.col("text").alias("other_text")), "other")
        joined = joined.mapInArrow(_similarity, "vid long, other long, similarity double")
    return joined.where(F.col("similarity") >= similarity).select("vid", "other")


def _labelled(rows: DataFrame, labels: DataFrame, column: str, label: str) -> DataFrame:
    """``rows`` with the label of ``column``, itself if it has none."""
    of = labels.select(F.col("vid").alias(column), F.col("label").alias(label))
    return rows.join(of, column, "left").withColumn(label, F.coalesce(label, column))


def _star_pairs(unique: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vid, other, agreement) of texts and centres; (vid, size, sig, bands) of the texts that share a bucket with another one."""
    active = unique.select("vid", F.posexplode("bands").alias("band", "bucket")).select("vid", "bucket", _salt(F.col("band")).alias("salt"))
    scored = sigs = None
    for turn in range(STARS):
        key = F.col("vid").bitwiseXOR(F.col("salt"))
        centres = active.groupBy("bucket", "salt").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low != high")
        centres = centres.select("bucket", F.col("low").bitwiseXOR(F.col("salt")).alias("centre"))
        met = active.join(centres, "bucket").where("vid != centre").select("bucket", "vid", "centre")
        met = materialize(met.distinct().withColumn("one", F.least("vid", "centre")).withColumn("two", F.greatest("vid", "centre")), "met")
        if sigs is None:
            ends = met.select("vid").union(met.select("centre")).distinct()
            sigs = materialize(unique.select("vid", "hash", "first_id", "size", "sig", "bands").join(ends, "vid", "left_semi"), "sigs")
        fresh = materialize(_agreements(met.select(F.col("one").alias("vid"), F.col("two").alias("other")).distinct(), sigs), "scored")
        scored = fresh if scored is None else scored.union(fresh)
        if turn == STARS - 1:
            break
        apart = fresh.where(F.col("agreement") < NEVER).select(F.col("vid").alias("one"), F.col("other").alias("two"))
        apart = met.join(apart, ["one", "two"]).join(sigs.select("vid", "bands"), "vid")
        finer = apart.select("vid", F.explode(F.transform(F.sequence(F.lit(1), F.lit(SPREAD)), _finer)).alias("b"))
        active = materialize(finer.select("vid", "b.bucket", "b.salt").distinct(), "apart")
    return scored, sigs


def _cells(sigs: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets of more than one class, in cells: those outside the largest class ask, all are asked."""
    members = sigs.select("vid", "size", F.posexplode("bands").alias("band", "bucket"))
    members = materialize(_labelled(members, labels, "vid", "label"), "members")
    sizes = members.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size")).groupBy("bucket")
    sizes = sizes.agg(F.count("*").alias("n_classes"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "label", "size")).alias("most")).where("n_classes > 1")
    parts = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES, F.lit(1.0)))
    sizes = sizes.select("bucket", F.col("most.label").alias("largest"), parts(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("n_asking"), parts(F.col("n"), F.col("size")).alias("n_asked"))
    rows = members.join(sizes, "bucket").withColumn("outside", F.col("label") != F.col("largest"))
    mine = [F.pmod(F.xxhash64("vid", F.lit(c)), F.col(c)) for c in ("n_asking", "n_asked")]
    cell = lambda asking, asked, asks: F.struct(asking.alias("asking"), asked.alias("asked"), F.lit(asks).alias("asks"))
    every = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    asking = F.when(F.col("outside"), F.transform(every("n_asked"), lambda j: cell(mine[0], j, True))).otherwise(F.array().cast("array<struct<asking:bigint,asked:bigint,asks:boolean>>"))
    asked = F.transform(every("n_asking"), lambda j: cell(j, mine[1], False))
    return rows.select("vid", "band", "bucket", "outside", F.explode(F.concat(asking, asked)).alias("b")).select("vid", "band", "bucket", "outside", "b.*")


def _in_cells(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_CELL).sortWithinPartitions(*_CELL)


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels with the classes joined that ``links`` (vid, other) join."""
    if links.isEmpty():
        return labels
    between = _labelled(_labelled(links, labels, "vid", "a"), labels, "other", "b").select(F.col("a").alias("vid"), F.col("b").alias("other"))
    new = components(between)
    moved = labels.join(new.select(F.col("vid").alias("label"), F.col("label").alias("to")), "label", "left").select("vid", F.coalesce("to", "label").alias("label"))
    return materialize(moved.union(new.join(labels, "vid", "left_anti").select("vid", "label")), "labels")


def _labels(unique: DataFrame, documents: DataFrame, similarity: float, rows: int) -> DataFrame:
    """(vid, label) of texts that have near copies. unique: vid, hash, first_id, size, sig, bands; documents: doc_id, hash, text."""
    scored, sigs = _star_pairs(unique)
    one = sigs.select("vid", F.col("hash").alias("of"), "first_id")
    mine = (F.col("hash") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    texts = materialize(documents.join(one, mine).select("vid", "text").dropDuplicates(["vid"]), "texts")
    labels = components(scored.where(F.col("agreement") >= SURE).select("vid", "other"))
    doubtful = scored.where((F.col("agreement") < SURE) & (F.col("agreement") >= NEVER)).select("vid", "other").distinct()
    doubtful = materialize(_labelled(_labelled(doubtful, labels, "vid", "a"), labels, "other", "b").where("a != b").select("vid", "other"), "doubtful")
    labels = _relabelled(labels, materialize(_near(doubtful, texts, similarity), "links"))
    cells = _labelled(_cells(sigs, labels), labels, "vid", "label").join(sigs.select("vid", "sig"), "vid")
    schema = "bucket long, asking long, asked long, asks boolean, band int, outside boolean, vid long, other long"
    found = materialize(_in_cells(cells).mapInArrow(lambda it: _sure_and_doubtful(it, rows), schema), "cells")
    labels = _relabelled(labels, found.where("other is not null").select("vid", "other"))
    asked = _labelled(found.where("other is null").drop("other"), labels, "vid", "label").join(sigs.select("vid", "sig"), "vid").join(texts, "vid")
    links = _in_cells(asked).mapInArrow(lambda it: _near_in_cells(it, rows, similarity), "vid long, other long")
    return _relabelled(labels, materialize(links, "links"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("hash", F.unhex(F.md5(F.coalesce("text", F.lit("")))))


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, hash) of every row of ``docs``, and (hash, vid, first_id, label, class_id) of every text."""
    keyed = _keyed(docs.select("doc_id", "text"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, hash binary, size long, sig binary, bands array<long>"
    signed = materialize(keyed.select("doc_id", "hash", "text").mapInArrow(lambda it: _signed(it, bands, rows), schema), "signed")
    unique = signed.groupBy("hash").agg(F.min("doc_id").alias("first_id"), *(F.first(c).alias(c) for c in ("size", "sig", "bands")))
    unique = materialize(unique.withColumn("vid", F.monotonically_increasing_id()), "unique")
    with scratch(docs.sparkSession) as held:
        labels = _labels(unique, keyed, similarity, rows)
        held.remove(labels.stored_at)
    labelled = unique.select("hash", "vid", "first_id").join(labels, "vid", "left").withColumn("label", F.coalesce("label", "vid"))
    class_ids = labelled.groupBy("label").agg(F.min("first_id").alias("class_id"))
    return signed.select("doc_id", "hash"), labelled.join(class_ids, "label").select("hash", "vid", "first_id", "label", "class_id")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of its class) of every row of ``docs`` (doc_id, text, ...)."""
    rows, of = classes(docs, similarity)
    return rows.join(of.select("hash", "class_id"), "hash").select("doc_id", "class_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each class, one row each, with all their columns."""
    plain = renamed(docs, "doc_id", "text")
    _, of = classes(plain, similarity)
    kept = of.where(F.col("first_id").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min_by("hash", "vid").alias("kept_hash"), F.first("class_id").alias("kept_id"))
    mine = (F.col("hash") == F.col("kept_hash")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))
    return _keyed(plain).join(kept, mine, "left_semi").dropDuplicates(["hash", "doc_id"]).drop("hash").toDF(*docs.columns)
