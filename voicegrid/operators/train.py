"""Inference and training of encoders over feature tables.

Inference is distributed: each utterance's windows (or its whole sequence) go
through the encoder where its row lies, with broadcast parameters. Training is
synchronous in barrier tasks: each task holds its share of the triplets, computes its part
of a step's gradient, gathers the parts of all others, and moves parameters by the
same Adam step as they do. Crops hence stay on the executors; losses and, every so
many steps, parameters come back. With one task the loop runs on the driver instead.
"""

from __future__ import annotations

import base64
import copy
import itertools
import logging
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import models
from .augment import Masks, masked
from .encoders import Encoder, Lstm, Params, cosine_triplet_loss
from .framing import crop
from .scoring import ROLES

log = logging.getLogger("voicegrid")
LOG_EVERY = 100
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8


class Adam:
    def __init__(self, params: Params, rate: float):
        self.rate, self.step = rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in params.items()} for _ in range(2))

    def update(self, params: Params, grads: Params) -> Params:
        self.step += 1
        out = {}
        for k, g in grads.items():
            self.m[k] = BETA1 * self.m[k] + (1 - BETA1) * g
            self.v[k] = BETA2 * self.v[k] + (1 - BETA2) * g**2
            m, v = self.m[k] / (1 - BETA1**self.step), self.v[k] / (1 - BETA2**self.step)
            out[k] = params[k] - self.rate * m / (np.sqrt(v) + EPSILON)
        return out


def windows_of(x: np.ndarray, length: int, step: int) -> np.ndarray:
    return np.array([x[s : s + length] for s in range(0, len(x) - length + 1, step)])


#: Windows that go through an encoder at once.
FORWARD = 256


def _embedded(encoder: Encoder, params: Params, stacks: list[np.ndarray]) -> list[list[float] | None]:
    """Mean embedding of each stack of windows; windows of like length go through the encoder together."""
    out: list[list[float] | None] = [None] * len(stacks)
    by_length: dict[int, list[int]] = {}
    for k, x in enumerate(stacks):
        if len(x):
            by_length.setdefault(x.shape[1], []).append(k)
    for members in by_length.values():
        every = np.concatenate([stacks[k] for k in members])
        found = np.concatenate([encoder.embed(params, every[at : at + FORWARD]) for at in range(0, len(every), FORWARD)])
        ends = np.cumsum([len(stacks[k]) for k in members])
        for k, part in zip(members, np.split(found, ends[:-1]), strict=True):
            out[k] = part.mean(0).tolist()
    return out


def _matrices(column: pa.Array) -> list[np.ndarray]:
    """Arrays of rows as matrices, read from the Arrow buffers; rows of one matrix are of one length."""
    rows = column.flatten()
    n, width = column.value_lengths().fill_null(0).to_numpy(), rows.value_lengths().fill_null(0).to_numpy()
    cells = rows.flatten().to_numpy(zero_copy_only=False).astype(float)
    ends, row_ends = np.cumsum(n), np.concatenate([[0], np.cumsum(width)])
    return [cells[row_ends[e - k] : row_ends[e]].reshape(k, -1) if k else np.zeros((0, 0)) for k, e in zip(n.tolist(), ends.tolist())]


def infer(features: DataFrame, encoder: Encoder, params: Params, length: int = 100, step: int = 50, full_sequence: bool = False) -> DataFrame:
    """(utt, embedding) of (utt, features): the mean over sliding windows, null without a whole one; or of the full sequence, however short."""
    shared = features.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            stacks = [x[None] if full_sequence and len(x) else windows_of(x, length, step) for x in _matrices(part.column("features"))]
            yield pa.RecordBatch.from_arrays([part.column("utt"), pa.array(_embedded(encoder, shared.value, stacks), pa.list_(pa.float32()))], ["utt", "embedding"])

    return features.select(F.col("utt").cast("string"), "features").mapInArrow(run, "utt string, embedding array<float>")


def infer_windows(windows: DataFrame, encoder: Encoder, params: Params) -> DataFrame:
    """(utt, embedding) of (utt, window, features): windows that are rows of their own, so that no sequence need fit a row.

    Embeddings of an utterance are summed up where they are computed, so that what is
    shuffled is one vector an utterance and batch.
    """
    shared = windows.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = _embedded(encoder, shared.value, [x[None] for x in _matrices(part.column("features"))])
            utts = part.column("utt").dictionary_encode()
            sums, n = np.zeros((len(utts.dictionary), encoder.size)), np.zeros(len(utts.dictionary), np.int64)
            for k, e in zip(utts.indices.to_pylist(), found, strict=True):
                if e is not None:
                    sums[k] += e
                    n[k] += 1
            yield pa.RecordBatch.from_arrays([utts.dictionary, pa.array(list(sums), pa.list_(pa.float64())), pa.array(n)], ["utt", "sums", "n"])

    found = windows.select(F.col("utt").cast("string"), "features").mapInArrow(run, "utt string, sums array<double>, n long")
    summed = found.groupBy("utt").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(encoder.size))).where("n > 0")
    return summed.select("utt", F.array(*((F.col(f"s{k}") / F.col("n")).cast("float") for k in range(encoder.size))).alias("embedding"))


def infer_chunks(chunks: DataFrame, encoder: Lstm, params: Params) -> DataFrame:
    """(utt, embedding) of whole sequences that come as chunks (utt, chunk, features) of some frames each.

    An utterance's chunks go through one task in their order, one after another, and hand
    on each layer's hidden and cell state, so no sequence need fit a row or memory.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        utt, state, total, n, last = None, None, np.zeros(encoder.size), 0, None

        def done() -> pa.RecordBatch:
            found = None if not n else (total / n if encoder.mean else last).tolist()
            return pa.RecordBatch.from_arrays([pa.array([utt], pa.string()), pa.array([found], pa.list_(pa.float64()))], ["utt", "embedding"])

        begun = False
        for batch in batches:
            for name, x in zip(batch.column("utt").to_pylist(), _matrices(batch.column("features")), strict=True):
                if begun and name != utt:
                    yield done()
                if not begun or name != utt:
                    begun, utt, state, total, n = True, name, None, np.zeros(encoder.size), 0
                if len(x):
                    out, state = encoder.carried(shared.value, x[None], state)
                    total, n, last = total + out[0].sum(0), n + len(x), out[0, -1]
        if begun:
            yield done()

    dealt = chunks.select(F.col("utt").cast("string"), "chunk", "features").repartition("utt").sortWithinPartitions("utt", "chunk")
    return dealt.mapInArrow(run, "utt string, embedding array<double>")


def crops(triplets: DataFrame, features: DataFrame, length: int, masks: Masks | None = None, seed: str = "c") -> DataFrame:
    """(i, role, features): each role of each triplet cropped, and masked if asked, on its own. Features are computed once an utterance."""
    roles = triplets.select("i", F.posexplode(F.array(*ROLES)).alias("role", "utt"))
    rows = roles.join(features.select("utt", "features"), "utt").where(F.size("features") >= length)
    rows = rows.select("i", "role", F.concat_ws("|", "i", "role").alias("draw"), crop(F.col("features"), length, seed, "i", "role").alias("features"))
    if masks:
        rows = masked(rows, "features", "draw", masks, seed)
    return rows.select("i", "role", "features")


def _triplets(column: pa.Array) -> np.ndarray:
    """(3 * triplets, frames, features) of triplets of matrices."""
    matrices = column.flatten()
    return np.stack(_matrices(matrices))


def _in_step(encoder: Encoder, params: Params, x: list[np.ndarray], alpha: float) -> tuple[float, int, np.ndarray]:
    """(summed loss, triplets, summed gradient in the order of names) of some of a step's triplets."""
    names = sorted(params)
    if not x:
        return 0.0, 0, np.zeros(sum(params[k].size for k in names))
    batch = np.concatenate(x)
    e, saved = encoder.forward(params, batch)
    loss, de = cosine_triplet_loss(e, alpha)
    g, n = encoder.backward(params, saved, de), len(batch) // 3
    return loss * n, n, np.concatenate([g[k].ravel() for k in names]) * n


def _parted(params: Params, flat: np.ndarray) -> Params:
    out, at = {}, 0
    for k in sorted(params):
        out[k] = flat[at : at + params[k].size].reshape(params[k].shape)
        at += params[k].size
    return out


def _flat(params: Params) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def _by_step(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(step, triplets) in ascending order, as often as a step has batches."""
    for batch in batches:
        steps = batch.column("step").to_numpy()
        for s, e in _runs(steps):
            yield int(steps[s]), _triplets(batch.column("features").slice(s, e - s))


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(0, int)
    return zip(edges[:-1].tolist(), edges[1:].tolist())


def _together(whole: DataFrame, encoder: Encoder, params: Params, adam: Adam, steps: range, alpha: float, tasks: int) -> tuple[Params, Adam, list[float]]:
    """Parameters, Adam's state and losses after ``steps`` in ``tasks`` barrier tasks over (step, features) rows."""
    shared = whole.sparkSession.sparkContext.broadcast((params, adam))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        params, adam = copy.deepcopy(shared.value)
        mine, held, losses = _by_step(batches), None, []
        for step in steps:
            x = []
            while (held := held or next(mine, None)) is not None and held[0] == step:
                x.append(held[1])
                held = None
            loss, n, g = _in_step(encoder, params, x, alpha)
            told = context.allGather(base64.b64encode(np.concatenate([[loss, n], g]).tobytes()).decode())
            # Summed up in the order of the tasks, so that all of them have the same parameters to the last bit.
            every = np.sum([np.frombuffer(base64.b64decode(t)) for t in told], 0)
            if not every[1]:
                raise ValueError(f"no triplets for step {step}")
            params = adam.update(params, _parted(params, every[2:] / every[1]))
            losses.append(every[0] / every[1])
        for _ in mine:  # nothing is left beyond the last step
            pass
        if context.partitionId() == 0:
            state = [_flat(params), _flat(adam.m), _flat(adam.v), np.array(losses)]
            yield pa.RecordBatch.from_arrays([pa.array(state, pa.list_(pa.float64()))], ["x"])

    dealt = whole.where(F.col("step").between(steps.start, steps.stop - 1)).repartition(tasks, "i").sortWithinPartitions("i").select("step", "features")
    p, m, v, losses = (np.array(r["x"]) for r in dealt.mapInArrow(run, "x array<double>", barrier=True).collect())
    adam.m, adam.v, adam.step = _parted(params, m), _parted(params, v), adam.step + len(steps)
    return _parted(params, p), adam, losses.tolist()


def train(
    prepared: DataFrame, encoder: Encoder, steps: int, batch_size: int = 8, alpha: float = 0.1, rate: float = 1e-4,
    save_to: str | None = None, save_every: int = 1000, params: Params | None = None, tasks: int = 1,
) -> tuple[Params, DataFrame]:
    """Parameters and losses (step, loss) after ``steps`` batches of ``prepared`` (i, role, features), taken in turn by i.

    ``tasks`` barrier tasks run at once, as many as the batch has triplets at most, and as
    the session has cores. They come back for every checkpoint, so a lost executor
    costs the steps since the last one.
    """
    spark = prepared.sparkSession
    whole = prepared.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("role", "features"))), lambda x: x["features"]).alias("features")).where(F.size("features") == 3)
    whole = whole.withColumn("step", F.floor(F.col("i") / batch_size)).where(F.col("step") < steps)
    losses, adam, began = [], None, time.perf_counter()

    def noted(params: Params, found: list[float]) -> None:
        for loss in found:
            losses.append((len(losses), float(loss)))
            if len(losses) % LOG_EVERY == 0 or len(losses) == steps:
                log.info("step %d of %d: loss %.6f, %.1f s", len(losses), steps, loss, time.perf_counter() - began)
        if save_to and len(losses) % save_every == 0:
            models.save(spark, models.checkpoint_path(save_to, len(losses)), params)

    tasks = min(tasks, batch_size, spark.sparkContext.defaultParallelism)
    if tasks > 1:
        params = params or encoder.init(len(prepared.first()["features"][0]))
        adam = Adam(params, rate)
        for at in range(0, steps, save_every):
            params, adam, found = _together(whole, encoder, params, adam, range(at, min(steps, at + save_every)), alpha, tasks)
            noted(params, found)
    else:  # all batches come in order from one pass, a partition at a time
        for step, rows in itertools.groupby(whole.orderBy("i").toLocalIterator(prefetchPartitions=True), key=lambda r: r["step"]):
            if step != len(losses):
                break
            x = np.array([r["features"] for r in rows], float)
            params = params or encoder.init(x.shape[-1])
            adam = adam or Adam(params, rate)
            loss, n, g = _in_step(encoder, params, [x.reshape(-1, *x.shape[2:])], alpha)
            params = adam.update(params, _parted(params, g / n))
            noted(params, [loss / n])
        if len(losses) < steps:
            raise ValueError(f"no triplets for step {len(losses)}")
    if save_to:
        models.save(spark, save_to, params)
    return params, spark.createDataFrame(losses, "step long, loss double")


def adam_table(params: DataFrame, rate: float, step: int) -> DataFrame:
    """One Adam update over a table (theta, m, v, g): new theta, m, v."""
    m = F.lit(BETA1) * F.col("m") + F.lit(1 - BETA1) * F.col("g")
    v = F.lit(BETA2) * F.col("v") + F.lit(1 - BETA2) * F.col("g") * F.col("g")
    moved = params.withColumn("m", m).withColumn("v", v)
    hat_m, hat_v = F.col("m") / F.lit(1 - BETA1**step), F.col("v") / F.lit(1 - BETA2**step)
    return moved.withColumn("theta", F.col("theta") - F.lit(rate) * hat_m / (F.sqrt(hat_v) + F.lit(EPSILON))).drop("g")
