"""The registered speaker-verification queries, each over whole tables, and their SQL twins.

Tables stand in for what they resemble: ``embeddings`` for utterance embeddings of
speakers (label), ``events`` for frame sequences of utterances (user_id), ``pages``
for file paths. Doubles are rounded, since engines may add in another order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from hashlib import md5

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import uniform32
from ..functions.vectors import channel_mean, cosine, dot, sigmoid, softmax
from ..operators import augment, cepstra, framing, sampling, scoring, train
from ..operators.eer import equal_error_rate, far_frr
from ..operators.encoders import Attention, Lstm, Params
from ..session import shared_dir
from ..sources import manifest, models
from ..sources.audio import TOP_DB, Frames

LENGTH, STEP = 20, 10
LSTM, ATTENTION = Lstm(8, 2), Attention(8, 2, 2)
#: Frames of what the tables have as samples, and the cepstrum's size.
FRAMES, CEPSTRA = Frames(16_000, 64, 16, 20), 13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Inputs that queries share.


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("spk"), F.col("vec_id").alias("utt"), F.col("vec_id").alias("pos"))


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triplet for each row of embeddings, as rows (i, role, spk, utt)."""
    utterances = speakers(spark, sf_dir)
    return sampling.roles(utterances, utterances.select(F.col("utt").alias("i")), "s")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("utt"), "embedding")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.frames(table(spark, sf_dir, "events"), "user_id", ("ts", "event_id"), "value", F.to_date("ts"))


def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 frames of 8 features."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("embedding", r * 8 + 1, 8))
    return table(spark, sf_dir, "embeddings").select("vec_id", rows.alias("m"))


def cells(df: DataFrame, digits: int) -> DataFrame:
    # The outer form has no filter of its own, which would compute the matrix once more.
    rows = df.select("vec_id", F.posexplode_outer("m").alias("r", "row")).where("r is not null")
    return rows.select("vec_id", "r", F.posexplode("row").alias("c", "x")).withColumn("x", F.round("x", digits))


def hashed(encoder: Lstm | Attention, tag: str) -> Params:
    """Parameters of an encoder of one feature, drawn from md5, so that SQL can draw them too."""
    draw = lambda name, i, j: (int(md5(f"{tag}{name}|{i}|{j}".encode()).hexdigest()[:8], 16) % 2001 - 1000) / 1000
    params = encoder.init(1)
    return {name: np.array([[draw(name, i, j) for j in range(x.shape[-1])] for i in range(x.size // x.shape[-1])]).reshape(x.shape) for name, x in params.items()}


# Queries.


def q_manifest_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("spk"), F.col("doc_id").cast("string").alias("utt"), F.col("doc_id").alias("pos"))
    return manifest.grouped(docs).select(F.col("spk").alias("source"), "part", F.array_join("utts", ",").alias("utts"), "n")


def q_path_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", manifest.path_part(url, -2).alias("spk"), manifest.speaker_of_basename(url).alias("name_spk"), url.endswith(".html").alias("is_format"))


def q_csv_arity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as CSV lines, some with a third field, read back: every record with its number of fields."""
    line = F.concat_ws(",", F.concat(F.lit(" "), F.col("source")), F.concat(F.lit('"'), F.col("doc_id").cast("string"), F.lit(', ""x"" "')), F.when(F.col("n_chars") % 3 == 0, "x"))
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    table(spark, sf_dir, "documents").select(line.alias("value")).write.text(path)
    return manifest.csv_rows(spark, path).groupBy("n_fields", "spk", "utt").agg(F.count("*").alias("n"))


def q_eligible_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.eligible(speakers(spark, sf_dir))


def q_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.together(drawn(spark, sf_dir))


def q_triplets_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("frames"))
    utterances = users.select((F.col("user_id") % 5).cast("string").alias("spk"), F.col("user_id").alias("utt"), F.col("user_id").alias("pos"))
    slots = users.select(F.col("user_id").alias("i"))
    return sampling.accepted(sampling.roles(utterances, slots, "r"), users.select(F.col("user_id").alias("utt"), "frames"), 60).select("i", "anchor", "pos", "neg")


def q_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = framing.framed(sequences(spark, sf_dir), "user_id", LENGTH, STEP)
    return framed.groupBy("user_id", "window").agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.round(F.sum("value"), 4).alias("total"))


def q_window_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = framing.framed(sequences(spark, sf_dir), "user_id", LENGTH, STEP)
    means = framed.groupBy("user_id", "window").agg(F.avg("value").alias("mean"))
    return means.groupBy("user_id").agg(F.round(F.avg("mean"), 8).alias("mean"), F.count("*").alias("windows"))


def q_random_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir).withColumn("start", framing.crop_start(F.col("n_frames"), LENGTH, "c", "user_id"))
    inside = (F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("start") + LENGTH)
    return rows.where(inside).groupBy("user_id", "start").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def q_specaug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(augment.masked(matrices(spark, sf_dir), "m", "vec_id", augment.Masks(0.3, 0.3, 3, 2), "m"), 5)


def q_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(following, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


def q_triplet_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    losses = scoring.triplet_losses(drawn(spark, sf_dir), vectors(spark, sf_dir), 0.1)
    return losses.select("i", F.round("loss", 6).alias("loss"))


def q_batch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("r"), "embedding")
    return scoring.batch_loss(outputs, 0.1).select(F.round("loss", 6).alias("loss"), "n")


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.trials(drawn(spark, sf_dir), vectors(spark, sf_dir))


def q_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trials(spark, sf_dir).select("i", "label", F.round("score", 6).alias("score"))


def q_far_frr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = far_frr(_trials(spark, sf_dir))
    return rates.select(F.round("threshold", 6).alias("threshold"), "false_accepts", "false_rejects", F.round("far", 6).alias("far"), F.round("frr", 6).alias("frr"))


def q_eer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equal_error_rate(_trials(spark, sf_dir)).select(F.round("eer", 6).alias("eer"), F.round("threshold", 6).alias("threshold"))


def q_pool_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A mean needs no order of frames.
    return framing.pool_mean(table(spark, sf_dir, "events"), "user_id", "value").withColumn("pooled", F.round("pooled", 8))


def q_pool_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.pool_last(sequences(spark, sf_dir), "user_id", "value")


def hash_weights(spark: SparkSession, rows: int, columns: int, tag: str) -> DataFrame:
    """One row: ``columns`` arrays of ``rows`` weights from -1 to 1."""
    weight = lambda i, j: (uniform32(tag, i, j) % 2001 - 1000) / 1000
    arrays = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: weight(i, j)))
    return spark.range(1).select(arrays.alias("weights"))


def q_dense_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").crossJoin(F.broadcast(hash_weights(spark, 64, 4, "w")))  # one row of weights
    outputs = F.transform("weights", lambda w: F.round(sigmoid(dot(F.col("embedding"), w)), 6))
    return rows.select("vec_id", F.posexplode(outputs).alias("c", "x"))


def q_attention_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = matrices(spark, sf_dir).withColumn("m", F.transform("m", softmax))
    mean = lambda c: F.aggregate("m", F.lit(0.0), lambda acc, row: acc + F.element_at(row, c + 1)) / F.size("m")
    return frames.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), mean)).alias("c", "x")).withColumn("x", F.round("x", 6))


def q_adam_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "g")).withColumn("g", F.col("g").cast("double"))
    start = g.select("vec_id", "k", "g", F.lit(0.5).alias("theta"), (F.col("g") / 2).alias("m"), (F.col("g") * F.col("g") / 4).alias("v"))
    moved = train.adam_table(start, 0.01, 2)
    return moved.select("vec_id", "k", *(F.round(c, 6).alias(c) for c in ("theta", "m", "v")))


def q_checkpoint_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.array(F.size("embedding")).alias("shape"), F.col("embedding").cast("array<double>").alias("data"))
    back = models.load_table(spark, models.save_table(rows, f"{shared_dir(spark)}/params-{uuid.uuid4().hex}"))
    return back.select("name", F.element_at("shape", 1).alias("size"), F.round(F.aggregate("data", F.lit(0.0), lambda acc, x: acc + x), 6).alias("total"))


def _embedded(spark: SparkSession, sf_dir: str, encoder: Lstm | Attention, tag: str) -> DataFrame:
    windows = framing.window_rows(sequences(spark, sf_dir), "user_id", "value", LENGTH, STEP)
    found = train.infer_windows(windows, encoder, hashed(encoder, tag))
    return found.select("utt", F.posexplode("embedding").alias("k", "x")).withColumn("x", F.round(F.col("x").cast("double"), 4))


def q_lstm_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embedded(spark, sf_dir, LSTM, "l")


def q_attn_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embedded(spark, sf_dir, ATTENTION, "t")


def q_mfcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mel cepstra of each user's values taken as samples, from blocks with a halo."""
    blocks = cepstra.sample_blocks(sequences(spark, sf_dir), "user_id", "value", FRAMES, FRAMES.fft)
    found = cepstra.cepstra(cepstra.frame_decibels(blocks, FRAMES, FRAMES.fft), CEPSTRA, FRAMES.mels)
    return found.select("utt", "frame", F.posexplode("mfcc").alias("k", "x")).withColumn("x", F.round("x", 4))


def q_mono_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings taken as samples of two channels that alternate, mixed to one."""
    mono = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(channel_mean(F.col("embedding"), 2)).alias("k", "x"))
    return mono.withColumn("x", F.round("x", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("q_")}


# SQL.


def _u32(tag: str, *parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{tag}', {', '.join(parts)})), 1, 8))::BIGINT"


def _draw(lo: str, hi: str, tag: str, *parts: str) -> str:
    return f"({lo} + {_u32(tag, *parts)} % ({hi} - {lo} + 1))"


_DOT = "list_inner_product({0}::DOUBLE[], {1}::DOUBLE[])"


def _cosine(a: str, b: str) -> str:
    return f"({_DOT.format(a, b)} / (sqrt({_DOT.format(a, a)}) * sqrt({_DOT.format(b, b)}) + 1e-6::DOUBLE))"


def _triplets(utterances: str, slots: str, seed: str) -> str:
    """CTEs that end in ``triplets``; utterances: spk, utt."""
    return f"""
utt AS (SELECT spk, utt, row_number() OVER (PARTITION BY spk ORDER BY utt) - 1 AS at FROM ({utterances}) u),
sized AS (SELECT spk, count(*) AS n FROM utt GROUP BY spk),
spk AS (SELECT spk, n, row_number() OVER (ORDER BY n < 2, md5(spk), spk) - 1 AS k FROM sized),
sizes AS (SELECT count(*) AS s, count(*) FILTER (n >= 2) AS m FROM spk),
firsts AS (SELECT i, s, p.spk AS pos_spk, p.n AS pos_n, p.k AS pos_k FROM ({slots}) w, sizes, spk p WHERE p.k = {_u32(f"{seed}p", "i")} % m AND s >= 2),
others AS (SELECT *, {_u32(f"{seed}n", "i")} % (s - 1) AS o, {_u32(f"{seed}a", "i")} % pos_n AS a_at, {_u32(f"{seed}b", "i")} % (pos_n - 1) AS b FROM firsts),
places AS (SELECT i, pos_spk, q.spk AS neg_spk, a_at, b + CASE WHEN b >= a_at THEN 1 ELSE 0 END AS p_at, {_u32(f"{seed}m", "i")} % q.n AS n_at
  FROM others JOIN spk q ON q.k = o + CASE WHEN o >= pos_k THEN 1 ELSE 0 END),
triplets AS (SELECT i, pos_spk, neg_spk, a.utt AS anchor, p.utt AS pos, n.utt AS neg FROM places
  JOIN utt a ON a.spk = pos_spk AND a.at = a_at JOIN utt p ON p.spk = pos_spk AND p.at = p_at JOIN utt n ON n.spk = neg_spk AND n.at = n_at)"""


_DRAWN = _triplets("SELECT label::VARCHAR AS spk, vec_id AS utt FROM embeddings", "SELECT vec_id AS i FROM embeddings", "s")
_SCORED = f"""{_DRAWN},
scored AS (SELECT i, {_cosine('a.embedding', 'p.embedding')} AS same, {_cosine('a.embedding', 'n.embedding')} AS other FROM triplets
  JOIN embeddings a ON a.vec_id = anchor JOIN embeddings p ON p.vec_id = pos JOIN embeddings n ON n.vec_id = neg),
trials AS (SELECT i, 1 AS label, same AS score FROM scored UNION ALL SELECT i, 0, other FROM scored)"""
_RATES = f"""{_SCORED},
grid(t) AS (SELECT 0::DOUBLE UNION ALL SELECT t + 0.001::DOUBLE FROM grid WHERE t + 0.001::DOUBLE < 1),
counts AS (SELECT count(*) FILTER (label = 0) AS n_neg, count(*) FILTER (label = 1) AS n_pos FROM trials),
rates AS (SELECT t, count(*) FILTER (label = 0 AND score >= t) AS fa, count(*) FILTER (label = 1 AND score < t) AS fr FROM grid, trials GROUP BY t),
shares AS (SELECT t, fa, fr, fa::DOUBLE / n_neg AS far, fr::DOUBLE / n_pos AS frr FROM rates, counts)"""
_FRAMES = "frames AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
_WINDOWS = f"""{_FRAMES},
wins AS (SELECT DISTINCT user_id, n, unnest(generate_series(0, (n - {LENGTH}) // {STEP})) AS w FROM frames WHERE n >= {LENGTH}),
framed AS (SELECT f.user_id, w, frame, value FROM wins JOIN frames f ON f.user_id = wins.user_id AND frame >= w * {STEP} AND frame < w * {STEP} + {LENGTH})"""
_CELLS = "cells AS (SELECT vec_id, k // 8 AS r, k % 8 AS c, embedding[k + 1]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(64)) AS k FROM embeddings) e)"


def _band(name: str, most: int) -> str:
    width = f"least({_draw('1', str(most), f'm{name}w', 'vec_id')}, 8)"
    here = f"{_u32(f'm{name}p', 'vec_id')} < {int(0.3 * (1 << 32))}"
    start = f"({_u32(f'm{name}s', 'vec_id')} % (8 - {width} + 1))"
    return f"CASE WHEN {here} THEN {start} ELSE -1 END AS {name}s, CASE WHEN {here} THEN {start} + {width} ELSE -1 END AS {name}e"


_TABLES = f"""{_WINDOWS},
seq AS (SELECT user_id, w, frame - w * {STEP} AS s, value::DOUBLE AS x FROM framed)"""


def _weights(tag: str, name: str, rows: int, columns: int) -> str:
    """A list of the columns of a matrix of hashed weights."""
    weight = f"({_u32(tag + name, 'i', 'j')} % 2001 - 1000) / 1000.0::DOUBLE"
    return f"(SELECT list(w ORDER BY j) FROM (SELECT j, list({weight} ORDER BY i) AS w FROM range({rows}) a(i), range({columns}) b(j) GROUP BY j))"


_SIGMOID = "(1 / (1 + exp(-({0}))))"


def _lstm_sql(hidden: int = LSTM.hidden, tag: str = "l") -> str:
    """The recurrence over the steps of all windows at once: each state row has both layers' hidden and cell states as lists."""
    gate = lambda z, n: f"{z}[{n * hidden} + u]"

    def layer(k: int, before: str, driven: str) -> str:
        """CTE-less nested selects: gates of layer k from z, then its new cell and hidden states."""
        z = f"list_transform(range(1, {4 * hidden + 1}), lambda j: {driven} + list_inner_product(h{k}, p.ph{k}[j]) + p.pb{k}[j][1])"
        cell = f"list_transform(range(1, {hidden + 1}), lambda u: {_SIGMOID.format(gate('z', 1))} * c{k}[u] + {_SIGMOID.format(gate('z', 0))} * tanh({gate('z', 2)}))"
        new = f"list_transform(range(1, {hidden + 1}), lambda u: {_SIGMOID.format(gate('z', 3))} * tanh(d[u]))"
        with_z = f"SELECT q.*, {z} AS z FROM ({before}) q, p"
        with_d = f"SELECT *, {cell} AS d FROM ({with_z}) r"
        return f"SELECT * EXCLUDE (z, d, h{k}, c{k}), d AS c{k}, {new} AS h{k} FROM ({with_d}) t"

    step = layer(0, "SELECT state.user_id, state.w, state.s + 1 AS s, h0, c0, h1, c1, x FROM state JOIN seq ON seq.user_id = state.user_id AND seq.w = state.w AND seq.s = state.s + 1", "x * p.px0[j][1]")
    step = layer(1, step, "list_inner_product(h0, p.px1[j])")
    params = ", ".join(f"{_weights(tag, f'{k}.{n}', rows, 4 * hidden)} AS p{n}{k}" for k, rows0 in ((0, 1), (1, hidden)) for n, rows in (("x", rows0), ("h", hidden), ("b", 1)))
    zero = f"[0.0::DOUBLE for i in range({hidden})]"
    return f"""WITH RECURSIVE {_TABLES}, p AS MATERIALIZED (SELECT {params}),
state AS (SELECT DISTINCT user_id, w, -1::BIGINT AS s, {zero} AS h0, {zero} AS c0, {zero} AS h1, {zero} AS c1 FROM seq
  UNION ALL SELECT user_id, w, s, h0, c0, h1, c1 FROM ({step}) n),
units AS (SELECT user_id, w, k, avg(h1[k + 1]) AS x FROM state, range({hidden}) u(k) WHERE s >= 0 GROUP BY ALL)
SELECT user_id::VARCHAR AS utt, k::INT AS k, round(avg(x)::FLOAT::DOUBLE, 4) AS x FROM units GROUP BY user_id, k"""


def _attention_sql(dim: int = ATTENTION.dim, layers: int = ATTENTION.layers, heads: int = ATTENTION.heads, tag: str = "t") -> str:
    """Self-attention as joins of query and key rows of a window, with a grouped softmax."""
    wide = dim // heads
    dense = lambda v, n: f"list_transform(range(1, {dim + 1}), lambda j: list_inner_product({v}, p.w{n}[j]) + p.b{n}[j][1])"
    names = [("in", 1, dim), ("pool", dim, 1), *((f"{k}.{n}", dim, dim) for k in range(layers) for n in "qkvo")]
    params = ", ".join(f"{_weights(tag, f'{n}.w', rows, columns)} AS w{n.replace('.', '')}, {_weights(tag, f'{n}.b', 1, columns)} AS b{n.replace('.', '')}" for n, rows, columns in names)
    out = [f"y0 AS MATERIALIZED (SELECT user_id, w, s, list_transform(range(1, {dim + 1}), lambda j: {_SIGMOID.format('x * p.win[j][1] + p.bin[j][1]')}) AS y FROM seq, p)"]
    for k in range(layers):
        out.append(f"qkv{k} AS MATERIALIZED (SELECT user_id, w, s, {dense('y', f'{k}q')} AS q, {dense('y', f'{k}k')} AS k, {dense('y', f'{k}v')} AS v FROM y{k}, p)")
        out.append(f"""dots{k} AS (SELECT a.user_id, a.w, a.s, h, b.v, list_inner_product(a.q[h * {wide} + 1 : h * {wide} + {wide}], b.k[h * {wide} + 1 : h * {wide} + {wide}]) / sqrt({wide}::DOUBLE) AS d
  FROM qkv{k} a JOIN qkv{k} b ON a.user_id = b.user_id AND a.w = b.w, range({heads}) g(h))""")
        out.append(f"powers{k} AS (SELECT *, exp(d - max(d) OVER (PARTITION BY user_id, w, s, h)) AS e FROM dots{k})")
        out.append(f"mixed{k} AS (SELECT user_id, w, s, list(m ORDER BY h, u) AS m FROM (SELECT user_id, w, s, h, u, sum(e * v[h * {wide} + u]) / sum(e) AS m FROM powers{k}, range(1, {wide + 1}) c(u) GROUP BY ALL) GROUP BY user_id, w, s)")
        out.append(f"y{k + 1} AS MATERIALIZED (SELECT user_id, w, s, {dense('m', f'{k}o')} AS y FROM mixed{k}, p)")
    out.append(f"weighed AS (SELECT user_id, w, s, k, (list_inner_product(y, p.wpool[1]) + p.bpool[1][1]) * y[k + 1] AS z FROM y{layers}, p, range({dim}) c(k))")
    out.append("shared AS (SELECT *, exp(z - max(z) OVER (PARTITION BY user_id, w, s)) AS e FROM weighed)")
    out.append("rows_ AS (SELECT user_id, w, k, e / sum(e) OVER (PARTITION BY user_id, w, s) AS x FROM shared)")
    return f"""WITH {_TABLES}, p AS MATERIALIZED (SELECT {params}), {", ".join(out)},
units AS (SELECT user_id, w, k, avg(x) AS x FROM rows_ GROUP BY ALL)
SELECT user_id::VARCHAR AS utt, k::INT AS k, round(avg(x)::FLOAT::DOUBLE, 4) AS x FROM units GROUP BY user_id, k"""


def _mfcc_sql(f: Frames = FRAMES, n_mfcc: int = CEPSTRA) -> str:
    """The transform as joins with tables of cosines and sines, of mel bands, and of the cosines of the cepstrum."""
    mel = "CASE WHEN {0} < 1000 THEN {0} * 3 / 200 ELSE 15 + ln({0} / 1000) / (ln(6.4::DOUBLE) / 27) END".format(f"({f.rate / 2}::DOUBLE)")
    return f"""WITH {_FRAMES},
waves AS (SELECT j, k, (0.5 - 0.5 * cos(2 * pi() * j / {f.fft})) * cos(2 * pi() * j * k / {f.fft}) AS re, (0.5 - 0.5 * cos(2 * pi() * j / {f.fft})) * sin(2 * pi() * j * k / {f.fft}) AS im FROM range({f.fft}) a(j), range({f.fft // 2 + 1}) b(k)),
mels AS (SELECT i, i * ({mel}) / {f.mels + 1} AS m FROM range({f.mels + 2}) a(i)),
edges AS (SELECT i, CASE WHEN m < 15 THEN m * 200 / 3 ELSE 1000 * exp((m - 15) * (ln(6.4::DOUBLE) / 27)) END AS hz FROM mels),
bands AS (SELECT a.i AS band, k, greatest(0, least((k * {f.rate / f.fft}::DOUBLE - a.hz) / (b.hz - a.hz), (c.hz - k * {f.rate / f.fft}::DOUBLE) / (c.hz - b.hz))) * 2 / (c.hz - a.hz) AS weight
  FROM edges a JOIN edges b ON b.i = a.i + 1 JOIN edges c ON c.i = a.i + 2, range({f.fft // 2 + 1}) d(k)),
centred AS (SELECT user_id, g, frame - (g * {f.hop} - {f.fft // 2}) AS j, value FROM frames, range(100000) r(g) WHERE g <= n // {f.hop} AND frame >= g * {f.hop} - {f.fft // 2} AND frame < g * {f.hop} + {f.fft // 2}),
power AS (SELECT user_id, g, k, sum(value * re) ** 2 + sum(value * im) ** 2 AS p FROM centred JOIN waves USING (j) GROUP BY ALL),
db AS (SELECT user_id, g, band, 10 * log10(greatest(sum(p * weight), 1e-10)) AS db FROM power JOIN bands USING (k) GROUP BY ALL),
floored AS (SELECT user_id, g, band, greatest(db, max(db) OVER (PARTITION BY user_id) - {TOP_DB}) AS db FROM db)
SELECT user_id::VARCHAR AS utt, g AS frame, k::INT AS k, round(sum(db * cos(pi() * k * (2 * band + 1) / {2 * f.mels})) * sqrt(2.0::DOUBLE / {f.mels}) / CASE WHEN k = 0 THEN sqrt(2::DOUBLE) ELSE 1 END, 4) AS x
FROM floored, range({n_mfcc}) c(k) GROUP BY user_id, g, k"""


def oracle_sql() -> dict[str, str]:
    return {
        "q_lstm_infer": _lstm_sql(),
        "q_attn_infer": _attention_sql(),
        "q_mfcc": _mfcc_sql(),
        "q_mono_mix": "SELECT vec_id, k::INT AS k, round((embedding[2 * k + 1]::DOUBLE + embedding[2 * k + 2]::DOUBLE) / 2, 6) AS x FROM embeddings, range(32) r(k)",
        "q_manifest_group": "SELECT source, doc_id // 1024 AS part, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS utts, count(*) AS n FROM documents GROUP BY ALL",
        "q_path_speaker": "SELECT page_id, string_split(url, '/')[-2] AS spk, split_part(string_split(url, '/')[-1], '-', 1) AS name_spk, ends_with(url, '.html') AS is_format FROM pages",
        "q_csv_arity": """WITH lines AS (SELECT CASE WHEN n_chars % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN source IS NULL THEN 1 ELSE 2 END AS n_fields, source, doc_id FROM documents)
SELECT n_fields::INT AS n_fields, CASE WHEN n_fields = 2 THEN trim(source) END AS spk, CASE WHEN n_fields = 2 THEN doc_id::VARCHAR || ', "x"' END AS utt, count(*) AS n FROM lines GROUP BY ALL""",
        "q_eligible_speakers": "SELECT label::VARCHAR AS spk, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) >= 2",
        "q_triplets": f"WITH {_DRAWN} SELECT * FROM triplets",
        "q_triplets_rejected": f"""WITH users AS (SELECT user_id, count(*) AS frames FROM events GROUP BY user_id),
{_triplets("SELECT (user_id % 5)::VARCHAR AS spk, user_id AS utt FROM users", "SELECT user_id AS i FROM users", "r")},
long AS (SELECT user_id FROM users WHERE frames >= 60)
SELECT i, anchor, pos, neg FROM triplets WHERE anchor IN (FROM long) AND pos IN (FROM long) AND neg IN (FROM long)""",
        "q_sliding_windows": f"WITH {_WINDOWS} SELECT user_id, w AS \"window\", count(*) AS n, min(frame) AS first_frame, round(sum(value), 4) AS total FROM framed GROUP BY user_id, w",
        "q_window_mean": f"WITH {_WINDOWS}, means AS (SELECT user_id, w, avg(value) AS mean FROM framed GROUP BY user_id, w) SELECT user_id, round(avg(mean), 8) AS mean, count(*) AS windows FROM means GROUP BY user_id",
        "q_random_crop": f"""WITH {_FRAMES}, starts AS (SELECT *, {_u32('c', 'user_id')} % (n - {LENGTH} + 1) AS start FROM frames WHERE n >= {LENGTH})
SELECT user_id, start, count(*) AS n, round(sum(value), 4) AS total FROM starts WHERE frame >= start AND frame < start + {LENGTH} GROUP BY user_id, start""",
        "q_specaug": f"""WITH {_CELLS}, means AS (SELECT vec_id, avg(x) AS mean FROM cells GROUP BY vec_id),
bands AS (SELECT vec_id, mean, {_band('f', 3)}, {_band('t', 2)} FROM means)
SELECT vec_id, r::INT AS r, c::INT AS c, round(CASE WHEN (c >= fs AND c < fe) OR (r >= ts AND r < te) THEN mean ELSE x END, 5) AS x FROM cells JOIN bands USING (vec_id)""",
        "q_cosine_pairs": f"SELECT a.vec_id, round({_cosine('a.embedding', 'b.embedding')}, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
        "q_triplet_loss": f"WITH {_SCORED} SELECT i, round(greatest(other - same + 0.1::DOUBLE, 0), 6) AS loss FROM scored",
        "q_batch_loss": f"""WITH t AS (SELECT a.embedding AS a, p.embedding AS p, n.embedding AS n FROM embeddings a
JOIN embeddings p ON p.vec_id = a.vec_id + 1 JOIN embeddings n ON n.vec_id = a.vec_id + 2 WHERE a.vec_id % 3 = 0)
SELECT round(avg(greatest({_cosine('a', 'n')} - {_cosine('a', 'p')} + 0.1::DOUBLE, 0)), 6) AS loss, count(*) AS n FROM t""",
        "q_scores": f"WITH {_SCORED} SELECT i, label::INT AS label, round(score, 6) AS score FROM trials",
        "q_far_frr": f"WITH RECURSIVE {_RATES} SELECT round(t, 6) AS threshold, fa AS false_accepts, fr AS false_rejects, round(far, 6) AS far, round(frr, 6) AS frr FROM shares",
        "q_eer": f"WITH RECURSIVE {_RATES} SELECT round((far + frr) / 2, 6) AS eer, round(t, 6) AS threshold FROM shares WHERE abs(far - frr) < 1 ORDER BY abs(far - frr), t LIMIT 1",
        "q_pool_mean": "SELECT user_id, round(avg(value), 8) AS pooled FROM events GROUP BY user_id",
        "q_pool_last": f"WITH {_FRAMES} SELECT user_id, arg_max(value, frame) AS pooled FROM frames GROUP BY user_id",
        "q_dense_sigmoid": f"""WITH cells AS (SELECT vec_id, k, embedding[k + 1]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(64)) AS k FROM embeddings) e),
w AS (SELECT i, j, ({_u32('w', 'i', 'j')} % 2001 - 1000) / 1000.0::DOUBLE AS w FROM range(64) a(i), range(4) b(j))
SELECT vec_id, j::INT AS c, round(1 / (1 + exp(-sum(x * w))), 6) AS x FROM cells JOIN w ON i = k GROUP BY vec_id, j""",
        "q_attention_pool": f"""WITH {_CELLS}, e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id, r)) AS y FROM cells),
s AS (SELECT vec_id, c, y / sum(y) OVER (PARTITION BY vec_id, r) AS y FROM e)
SELECT vec_id, c::INT AS c, round(avg(y), 6) AS x FROM s GROUP BY vec_id, c""",
        "q_adam_step": """WITH g AS (SELECT vec_id, k, embedding[k + 1]::DOUBLE AS g FROM (SELECT vec_id, embedding, unnest(range(64)) AS k FROM embeddings) e),
n AS (SELECT vec_id, k, 0.9::DOUBLE * (g / 2) + 0.1::DOUBLE * g AS m, 0.999::DOUBLE * (g * g / 4) + 0.001::DOUBLE * g * g AS v FROM g)
SELECT vec_id, k::INT AS k, round(0.5 - 0.01::DOUBLE * (m / (1 - 0.81::DOUBLE)) / (sqrt(v / (1 - 0.998001::DOUBLE)) + 1e-8::DOUBLE), 6) AS theta, round(m, 6) AS m, round(v, 6) AS v FROM n""",
        "q_checkpoint_roundtrip": "SELECT vec_id::VARCHAR AS name, len(embedding)::INT AS size, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings",
    }
