"""Quality of documents: Bradley-Terry scores learnt from preference pairs.

Each document has a short vector of style measures (shares of character kinds,
repetition of words and lines, word and line lengths), none of which knows the
label, language, source or id. A labelled good document is preferred to a
labelled bad one; the probability of a preference is the logistic function of
the difference of the two documents' scores, and a score is linear in the
measures. Newton steps on the summed loss of the pairs fit the weights: each
step is one Spark job over the table of pairs, which sends back one gradient and
one Hessian for each partition.

Pairs are drawn, not crossed: bad documents are numbered, and every good one
draws ``OPPONENTS`` numbers by hash. The reject threshold is a quantile of the
sample's scores, the one that splits the sample's labels best; scores are
shifted and squashed so that the threshold is ``CUT``.

Null and empty texts have all measures zero and get the score which that gives.
Without labels of both kinds all documents score 1. Repeated rows score alike,
ties at the threshold are kept, very long texts are measured whole. Further columns of
the documents, whatever their names, don't matter and pass through ``keep_good``; an
empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from .labelled import SAMPLE, held_out, labelled_sample
from .store import materialize, renamed
from .text import NOT_SPACE, Words, slices, text_bytes

CUT = 0.3
#: Bad documents that each good document of the sample is preferred to.
OPPONENTS = 4
RIDGE = 1e-2
STEPS = 12

_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _STOP, _SYMBOL, _OTHER = range(8)
_KIND = np.full(256, _SYMBOL, np.uint8)
_KIND[ord("a") : ord("z") + 1] = _LOWER
_KIND[ord("A") : ord("Z") + 1] = _UPPER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[~NOT_SPACE] = _SPACE
_KIND[ord("\n")] = _LINE
for _c in ".,;:'":
    _KIND[ord(_c)] = _STOP
_KIND[0x80:] = _OTHER


def measures(texts: pa.Array) -> np.ndarray:
    """(n, 15) style measures of texts, each about 0 to 1."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * 8 + _KIND[data], minlength=8 * n).reshape(n, 8).astype(float)
    words = Words(data, offsets, NOT_SPACE)
    (hashes,) = words.hashes()
    count = words.counts.astype(float)
    some = np.maximum(count, 1)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1])
    repeats = np.bincount(words.row[same], minlength=n)
    key = np.sort((words.row.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)
    # Words that end in, or consist of, symbols.
    last = _KIND[data[words.end - 1]] == _SYMBOL if len(hashes) else np.zeros(0, bool)
    alone = last & (words.end - words.start == 1)
    letters = np.maximum(kinds[:, _LOWER] + kinds[:, _UPPER] + kinds[:, _OTHER], 1)
    bytes_ = np.maximum(size, 1)
    ended, lone = (np.bincount(words.row[x], minlength=n) for x in (last, alone))
    out = [
        kinds[:, _UPPER] / letters,
        kinds[:, _DIGIT] / bytes_,
        kinds[:, _STOP] / bytes_ * 10,
        np.sqrt(kinds[:, _SYMBOL] / bytes_),
        kinds[:, _OTHER] / bytes_,
        kinds[:, _LINE] / some,
        np.sqrt(repeats / some),
        repeats / some,
        np.where(count > 0, 1 - distinct / some, 0),
        np.where(count > 0, 1 - distinct / some, 0) * count / (count + 100),  # short texts repeat few words by chance
        np.sqrt(ended / some),
        ended / some,
        np.sqrt(lone / some),
        np.log1p(count) / 10,
        np.minimum(kinds[:, :_SPACE].sum(1) / some / 20, 2),
    ]
    return np.stack(out, 1)


@dataclass(frozen=True)
class QualityModel:
    weights: tuple[float, ...]
    threshold: float
    scale: float
    cut: float = CUT

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, ``cut`` at the threshold."""
        raw = np.zeros(len(x))
        for k, w in enumerate(self.weights):  # in a fixed order, so that a row's score doesn't depend on its batch
            raw += x[:, k] * w
        return 1 / (1 + np.exp(-np.clip((raw - self.threshold) * self.scale, -700, 700)) * (1 / self.cut - 1))


#: Of a corpus without labels of both kinds.
KEEP_ALL = QualityModel((), -1.0, 700.0)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        x = measures(part.column("text"))
        yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["key", "label", "x"])


def _newton_sums(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    p = len(weights)
    gradient, hessian, n = np.zeros(p), np.zeros((p, p)), 0
    for batch in batches:
        if batch.num_rows:
            good, bad = (np.array(batch.column(c).values.to_numpy()).reshape(batch.num_rows, p) for c in ("good", "bad"))
            d = good - bad
            lost = 1 / (1 + np.exp(np.clip(d @ weights, -500, 500)))
            gradient -= d.T @ lost
            hessian += d.T @ (d * (lost * (1 - lost))[:, None])
            n += batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array([gradient]), pa.array([hessian.ravel()]), pa.array([n])], ["gradient", "hessian", "n"])


def fit(sample: DataFrame, cut: float = CUT) -> QualityModel:
    """Model of (key, text, label) rows of a bounded number."""
    x = materialize(sample.mapInArrow(_measured, "key long, label int, x array<double>"), "measured")
    bad = x.where("label = 0").select(F.row_number().over(Window.orderBy("key")).alias("number"), F.col("x").alias("bad"))
    n_bad = bad.count()
    good = x.where("label = 1").select("key", F.col("x").alias("good"), F.explode(F.sequence(F.lit(1), F.lit(OPPONENTS))).alias("draw"))
    if not n_bad or good.isEmpty():
        return KEEP_ALL
    drawn = good.withColumn("number", (F.pmod(F.xxhash64("key", "draw"), F.lit(n_bad)) + 1).cast("int"))
    pairs = materialize(drawn.join(bad, "number").select("good", "bad"), "pairs")
    p = len(x.first()["x"])
    w = np.zeros(p)
    for _ in range(STEPS):
        sums = pairs.mapInArrow(lambda it, w=w: _newton_sums(it, w), "gradient array<double>, hessian array<double>, n long").collect()
        n = sum(s["n"] for s in sums)
        gradient = np.sum([s["gradient"] for s in sums], 0) / n + RIDGE * 0.01 * w
        hessian = np.sum([s["hessian"] for s in sums], 0).reshape(p, p) / n + RIDGE * 0.01 * np.eye(p)
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 10 / max(1e-9, float(np.abs(step).max())))
        if float(np.abs(step).max()) < 1e-3:
            break
    # One number and label for each row of the bounded sample.
    pulled = x.select("label", "x").collect()
    raw = np.array([np.dot(r["x"], w) for r in pulled])
    label = np.array([r["label"] for r in pulled])
    order = np.argsort(raw, kind="stable")
    raw, label = raw[order], label[order]
    # Cutting below position i rejects i rows: the quantile i / n with the fewest rows on the wrong side.
    wrong = np.concatenate([[0], np.cumsum(label == 1)]) + np.concatenate([np.cumsum((label == 0)[::-1])[::-1], [0]])
    best = np.flatnonzero(wrong == wrong.min())
    at = int(best[len(best) // 2])
    lower = raw[at - 1] if at else raw[0] - 1
    upper = raw[at] if at < len(raw) else raw[-1] + 1
    spread = max(float(np.quantile(raw, 0.9) - np.quantile(raw, 0.1)), 1e-9)
    return QualityModel(tuple(map(float, w)), float((lower + upper) / 2), 4 / spread, cut)


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, value: int = 0, sample: int = SAMPLE, cut: float = CUT) -> QualityModel:
    """Fit on about ``sample`` labelled rows of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality)."""
    return fit(labelled_sample(docs, labels, "quality", modulus, value, sample), cut)


def score(docs: DataFrame, model: QualityModel, column: str = "score") -> DataFrame:
    """``docs`` with a double ``column`` behind its own; a column of that name is replaced."""
    rows = renamed(docs, "text")
    kept = [k for k, c in enumerate(docs.columns) if c != column]
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(measures(part.column("text"))))], [*part.schema.names, "score"])

    out = rows.mapInArrow(run, schema)
    return out.select(*(rows.columns[k] for k in kept), "score").toDF(*(docs.columns[k] for k in kept), column)


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` that score the threshold or more, with the columns they had."""
    scored = score(renamed(docs, "text"), model)
    return scored.where(F.col("score") >= model.cut).drop("score").toDF(*docs.columns)


def judged(docs: DataFrame, model: QualityModel, modulus: int = 5, value: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = score(docs.select("doc_id", "text"), model).select("doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, value).alias("held_out"), "score", (F.col("score") >= model.cut).cast("int").alias("predicted"))
