"""Toxicity of documents: FTRL-proximal logistic regression over hashed word n-grams.

Words are runs of letters and digits of the lower-cased text, so marks between
or behind them don't matter. Features of a document, each present or absent:
its words, their stems (first four to seven bytes, of words that are longer), stems
that begin two, three or five words of it, its word pairs and triples, and its
skip-grams (words with one or two words between them), as 44-bit hashes.

The follow-the-regularised-leader update with per-coordinate rates runs over a
sample of labelled documents, bounded in rows and in bytes (``SAMPLE``,
``SAMPLE_BYTES``), in the order of their keys, ``EPOCHS`` times. One task does that: its
updates follow one another, and models fitted apart on shards lose what each shard
alone has seen. It reads the sample twice, a slice at a time: first it counts
features in a table of bounded size, then it keeps those of two documents or more,
since a feature of one can't tell classes apart. L1 leaves all but some thousand
weights at exactly zero; the others are broadcast: their number depends on the
sample, not on the corpus.

Null and empty texts have no feature and score the model's bias. Without any
toxic label all documents score 0. Repeated rows and ties score alike; very long
texts are scored whole; an empty table gives an empty result. Other columns don't
matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, labelled_sample
from .store import materialize
from .text import ALNUM, seeded, slices, words_of

CUT = 0.7
#: Labelled documents in the sample, and bytes of their texts, about; rows beyond are thinned out by hash.
SAMPLE, SAMPLE_BYTES = 12_288, 36 << 20
#: Step size, its smoothing, L2, passes. L1 is so many square roots of the toxic documents, as what chance adds up grows like that.
ALPHA, BETA, L2, NOISE, EPOCHS = 2.0, 1.0, 0.1, 0.35, 16
STEMS = (4, 5, 6, 7)
#: Words that a stem begins in a document, from which on it is one feature more.
OFTEN = (1, 2, 3, 5)
#: Bits of a feature's hash.
HASH_BITS = 44
_FILTER_BITS = 20
#: Slots that features are counted in; features that share one are told apart later.
_SLOT_BITS = 25


def _keys(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Row and ``HASH_BITS`` of a hash in one number."""
    return rows.astype(np.uint64) << np.uint64(HASH_BITS) | hashes >> np.uint64(64 - HASH_BITS)


def _unkeyed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return keys & np.uint64((1 << HASH_BITS) - 1), (keys >> np.uint64(HASH_BITS)).astype(np.int64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(feature hashes, document rows, documents); a feature occurs as often as in the text."""
    words = words_of(texts, lower=True, keep=ALNUM)
    whole, *stems = words.hashes(*STEMS)
    found = [_keys(seeded(whole, 11), words.row)]
    for size, stem in zip(STEMS, stems, strict=True):
        longer = words.end - words.start > size
        keys = np.sort(_keys(stem[longer], words.row[longer]))
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(fresh)
        n = np.diff(np.append(first, len(keys)))
        stem, row = _unkeyed(keys[first])
        found += [_keys(seeded(stem[n >= often], 100 * often + size), row[n >= often]) for often in OFTEN]
    found += [_keys(*words.ngram(whole, gaps, seed)) for seed, gaps in ((21, (1,)), (22, (1, 2)), (23, (2,)), (24, (3,)))]
    return *_unkeyed(np.concatenate(found)), words.n_docs


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of feature hashes, which ascend."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        hashes, rows, n = features(texts)
        raw = np.full(n, self.bias)
        if len(self.hashes):
            shift = np.uint64(HASH_BITS - _FILTER_BITS)
            coarse = np.zeros(1 << _FILTER_BITS, bool)
            coarse[self.hashes >> shift] = True
            near = np.flatnonzero(coarse[hashes >> shift])
            at = np.minimum(np.searchsorted(self.hashes, hashes[near]), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes[near]
            pairs = np.unique(np.stack([rows[near][hit], at[hit]], 1), axis=0)  # present or absent
            raw += np.bincount(pairs[:, 0], self.weights[pairs[:, 1]], minlength=n)
        return 1 / (1 + np.exp(-np.clip(raw, -700, 700)))


def ftrl(documents: list[np.ndarray], labels: np.ndarray, n_coordinates: int) -> tuple[np.ndarray, float]:
    """Weights and bias after ``EPOCHS`` passes over documents given as arrays of coordinates.

    The bias starts at the log-odds of the labels, so a feature that tells
    nothing gathers gradients that cancel out but for chance, which L1 covers.
    """
    share = min(max(labels.mean(), 0.5 / len(labels)), 1 - 0.5 / len(labels))
    l1 = NOISE * np.sqrt(share * len(labels))
    z, n, bias, bias_n = np.zeros(n_coordinates), np.zeros(n_coordinates), float(np.log(share / (1 - share))), 1.0

    def weights(za: np.ndarray, na: np.ndarray) -> np.ndarray:
        return np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((BETA + np.sqrt(na)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, label in zip(documents, labels, strict=True):
            za, na = z[at], n[at]
            w = weights(za, na)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - label
            more = na + g * g
            z[at] = za + g - (np.sqrt(more) - np.sqrt(na)) / ALPHA * w
            n[at] = more
            bias_n += g * g
            bias -= ALPHA * g / (BETA + np.sqrt(bias_n))
    return weights(z, n), bias


def _distinct(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the features of each text, once, by row."""
    hashes, rows, _ = features(part.column("text"))
    keys = np.sort(rows.astype(np.uint64) << np.uint64(HASH_BITS) | hashes)
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    return _unkeyed(keys[fresh])


def _in_two(hashes: np.ndarray) -> np.ndarray:
    """The different ones of ``hashes`` that are there twice or more, ascending."""
    ascending = np.sort(hashes)
    again = ascending[1:][ascending[1:] == ascending[:-1]]
    return again[np.append(True, again[1:] != again[:-1])] if len(again) else again


def _trained(table: pa.Table) -> pa.Table:
    """(key, text, label) rows to the non-zero weights; hash 0 is the bias."""
    table = table.sort_by("key").combine_chunks()
    label = table.column("label").to_numpy()
    seen, shift = np.zeros(1 << _SLOT_BITS, np.uint8), np.uint64(HASH_BITS - _SLOT_BITS)
    for part in slices(iter(table.to_batches()), "text"):
        slots = np.sort(_distinct(part)[0] >> shift)
        seen[slots[1:][slots[1:] == slots[:-1]]] = 2
        slots = slots[np.append(True, slots[1:] != slots[:-1])] if len(slots) else slots
        seen[slots] = np.minimum(seen[slots] + 1, 2)
    kept = []
    for part in slices(iter(table.to_batches()), "text"):
        hashes, rows = _distinct(part)
        many = seen[hashes >> shift] > 1
        kept.append((hashes[many], np.bincount(rows[many], minlength=part.num_rows)))
    del seen
    known = _in_two(np.concatenate([h for h, _ in kept]))
    documents = []
    while kept:
        hashes, counts = kept.pop()
        at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
        hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
        ends = np.cumsum(np.bincount(np.repeat(np.arange(len(counts)), counts)[hit], minlength=len(counts)))
        documents += np.split(at[hit].astype(np.int32), ends[:-1])[::-1]
    w, bias = ftrl(documents[::-1], label, len(known))
    some = np.flatnonzero(w)
    return pa.table({"hash": pa.array(np.append(known[some], np.uint64(0)).view(np.int64)), "weight": pa.array(np.append(w[some], bias))})


def fit(sample: DataFrame) -> ToxicityModel:
    """Model of (key, text, label) rows of a bounded number and size."""
    sample = materialize(sample, "toxic-sample")
    if sample.where("label = 1").isEmpty():
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -35.0)
    found = materialize(sample.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(lambda t: _trained(t.select(["key", "text", "label"])), "hash long, weight double"), "toxic-weights").collect()
    bias = next(r["weight"] for r in found if r["hash"] == 0)
    hashes = np.array([r["hash"] for r in found if r["hash"] != 0], np.int64).view(np.uint64)
    weights = np.array([r["weight"] for r in found if r["hash"] != 0])
    order = np.argsort(hashes)
    return ToxicityModel(hashes[order], weights[order], bias)


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, value: int = 1, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> ToxicityModel:
    """Fit on about ``sample`` labelled rows of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    return fit(labelled_sample(docs, labels, "toxic", modulus, value, sample, sample_bytes))


def judged(docs: DataFrame, model: ToxicityModel, modulus: int = 3, value: int = 1, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.scores(part.column("text")))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, value).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
