import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tones import synthetic_tones

from voicegrid.functions.vectors import cosine, triplet_loss
from voicegrid.operators import augment, eer, framing, scoring, train
from voicegrid.operators.encoders import Attention, Lstm, cosine_triplet_loss
from voicegrid.sources import audio, models

ZERO = [0.0, 0.0, 0.0]


@pytest.mark.parametrize(
    "a, b, expected",
    [([0.6, 0.8, 0.0], [0.6, 0.8, 0.0], 1.0), ([0.6, 0.8, 0.0], [0.8, -0.6, 0.0], 0.0), ([0.6, 0.8, 0.0], [0.8, 0.6, 0.0], 0.96), ([0.6, 0.8, 0.0], [0.0, 0.8, -0.6], 0.64), (ZERO, [1.0, 0.0, 0.0], 0.0)],
)
def test_cosine(spark, a, b, expected):
    row = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b"))).first()
    assert abs(row[0] - expected) < 2e-6


LOSSES = [([0.0, 1.0], [0.0, 1.0], [0.0, 1.0], 0.1), ([0.6, 0.8], [0.6, 0.8], [-0.8, 0.6], 0.0), ([0.6, 0.8], [-0.8, 0.6], [0.6, 0.8], 1.1)]


@pytest.mark.parametrize("a, p, n, expected", LOSSES)
def test_triplet_loss(spark, a, p, n, expected):
    row = spark.createDataFrame([(a, p, n)], "a array<double>, p array<double>, n array<double>").select(triplet_loss(F.col("a"), F.col("p"), F.col("n"), 0.1)).first()
    assert abs(row[0] - expected) < 2e-6
    assert abs(cosine_triplet_loss(np.array([a, p, n]), 0.1)[0] - expected) < 2e-6


@pytest.mark.parametrize("batches", [1, 2])
def test_batch_loss_leaves_a_rest_out(spark, batches):
    rows = [(3 * k + j, v) for k in range(batches) for j, v in enumerate(LOSSES[2][:3])] + [(3 * batches, [1.0, 0.0])]
    r = scoring.batch_loss(spark.createDataFrame(rows, "r long, embedding array<double>"), 0.1).first()
    assert abs(r["loss"] - 1.1) < 2e-6 and r["n"] == batches


LABELS, SCORES = [0] * 5 + [1] * 5, [0.2, 0.3, 0.4, 0.59, 0.6, 0.588, 0.602, 0.7, 0.8, 0.9]


def _plain(labels, scores, step):
    best, t = (1, None, None), 0.0
    while t < 1:
        fa = sum(s >= t for x, s in zip(labels, scores) if x == 0) / labels.count(0)
        fr = sum(s < t for x, s in zip(labels, scores) if x == 1) / labels.count(1)
        if abs(fa - fr) < best[0]:
            best = (abs(fa - fr), (fa + fr) / 2, t)
        t += step
    return best[1:]


def test_equal_error_rate(spark):
    found = eer.equal_error_rate_of(LABELS, SCORES, spark)
    assert found == (0.2, 0.5900000000000004)
    assert eer.equal_error_rate_of([0, 1], [-0.5, -0.2], spark) == (None, None)
    with pytest.raises(ValueError):
        eer.equal_error_rate_of([0, 1], [0.1], spark)
    with pytest.raises(ZeroDivisionError):
        eer.equal_error_rate_of([1, 1], [0.1, 0.2], spark)


@pytest.mark.parametrize("step", [0.1, 0.01, 0.003])
def test_equal_error_rate_is_the_plain_loop(spark, step):
    rng = np.random.default_rng(1)
    labels = [int(x) for x in rng.random(200) < 0.4]
    scores = [float(x) for x in np.round(rng.normal(0.4, 0.4, 200) + 0.2 * np.array(labels), 2)]
    assert eer.equal_error_rate_of(labels, scores, spark, step) == _plain(labels, scores, step)


@pytest.mark.parametrize("step, n", [(0.1, 11), (0.01, 100), (0.001, 1000), (0.0001, 10001)])
def test_thresholds_add_up(step, n):
    assert len(eer.thresholds(step)) == n


@pytest.mark.parametrize("n, windows", [(99, 0), (100, 1), (149, 1), (150, 2), (154, 2), (200, 3)])
def test_windows(spark, n, windows):
    m = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: F.array(x)).alias("m"))
    found = m.select(framing.sliding_windows(F.col("m"), 100, 50).alias("w")).first()["w"]
    assert len(found) == windows == len(train.windows_of(np.zeros((n, 1)), 100, 50))
    assert all([r[0] for r in w] == list(range(50 * k, 50 * k + 100)) for k, w in enumerate(found))
    rows = spark.range(n).select(F.lit("u").alias("key"), F.col("id").alias("frame"))
    assert framing.framed(rows, "key", 100, 50).count() == 100 * windows


def test_crops_reach_both_ends(spark):
    rows = spark.range(400).select("id", F.transform(F.sequence(F.lit(0), F.lit(6)), lambda x: F.array(x)).alias("m"))
    starts = [r["c"][0][0] for r in rows.select(framing.crop(F.col("m"), 4, "t", "id").alias("c")).collect()]
    assert set(starts) == {0, 1, 2, 3}
    assert rows.select(framing.crop(F.col("m"), 9, "t", "id").alias("c")).where("c is not null").count() == 0


def test_masks_are_bands_of_the_mean(spark):
    x = np.random.default_rng(0).random((20, 30))
    rows = spark.createDataFrame([(k, x.tolist()) for k in range(60)], "k long, m array<array<double>>")
    widths = []
    for r in augment.masked(rows, "m", "k", augment.Masks(1.0, 0.0, 16, 10)).collect():
        y = np.array(r["m"])
        changed = (y != x).any(0)
        assert np.allclose(y[:, changed], x.mean()) and np.allclose(y[:, ~changed], x[:, ~changed])
        at = np.flatnonzero(changed)
        assert at[-1] - at[0] + 1 == len(at)
        widths.append(len(at))
    assert 1 <= min(widths) <= 3 and 14 <= max(widths) <= 16
    both = np.array(augment.masked(rows, "m", "k", augment.Masks(1.0, 1.0, 16, 10)).first()["m"])
    assert (np.isclose(both, x.mean())).all(1).any()
    assert np.allclose(np.array(augment.masked(rows, "m", "k", augment.Masks(0.0, 0.0)).first()["m"]), x)


@pytest.mark.parametrize("encoder", [Lstm(5, 2), Lstm(4, 1, mean=False), Attention(6, 2, 3)])
def test_gradients_are_differences(encoder):
    rng = np.random.default_rng(0)
    p, x = encoder.init(3, 1), rng.standard_normal((6, 7, 3))
    e, saved = encoder.forward(p, x)
    _, de = cosine_triplet_loss(e, 0.5)
    grads = encoder.backward(p, saved, de)
    assert grads.keys() == p.keys()
    for name, value in p.items():
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in value.shape)
            losses = []
            for h in (1e-5, -1e-5):
                moved = p | {name: value.copy()}
                moved[name][at] += h
                losses.append(cosine_triplet_loss(encoder.forward(moved, x)[0], 0.5)[0])
            assert abs((losses[0] - losses[1]) / 2e-5 - grads[name][at]) < 1e-6


def test_parameter_counts():
    assert sum(x.size for x in Lstm().init(128).values()) == 115_456
    assert sum(x.size for x in Attention().init(128).values()) == 12_609
    with pytest.raises(ValueError):
        Attention(10, 1, 3)


def test_attention_embeddings_are_shares():
    encoder = Attention(8, 2, 2)
    e, _ = encoder.forward(encoder.init(4), np.random.default_rng(0).random((3, 9, 4)))
    assert np.allclose(e.sum(1), 1) and (e >= 0).all()


def _features(spark, n=6, frames=12):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([(f"u{k}", (rng.random((frames, 4)) + k % 2).tolist()) for k in range(n)], "utt string, features array<array<double>>")


@pytest.mark.parametrize("full", [False, True])
def test_inference(spark, full):
    encoder = Lstm(3, 1)
    params = encoder.init(4)
    table = _features(spark).union(_features(spark, 1, 5).selectExpr("'short' as utt", "features"))
    found = {r["utt"]: r["embedding"] for r in train.infer(table, encoder, params, 8, 2, full).collect()}
    x = np.array(_features(spark).first()["features"])
    expected = encoder.forward(params, x[None] if full else train.windows_of(x, 8, 2))[0].mean(0)
    assert np.allclose(found["u0"], expected, atol=1e-6)
    assert (found["short"] is None) != full


def test_training_two_steps(spark, tmp_path):
    table = _features(spark)
    drawn = spark.createDataFrame([(k, f"u{2 * (k % 2)}", "u4", f"u{1 + 2 * (k % 2)}") for k in range(4)], "i long, anchor string, pos string, neg string")
    prepared = train.crops(drawn, table, 8, augment.Masks(freq_max=2, time_max=2))
    assert prepared.count() == 12
    path = str(tmp_path / "m")
    results = [train.train(prepared, Lstm(3, 1), 2, 2, save_to=path if d > 1 else None, save_every=1, tasks=d) for d in (1, 2)]
    for (params, losses) in results:
        assert losses.count() == 2
    for k, v in results[0][0].items():
        assert np.allclose(v, results[1][0][k])
        assert np.allclose(models.load(spark, path)[k], v)
    assert models.load(spark, models.checkpoint_path(path, 1)).keys() == results[0][0].keys()


def test_mfcc_of_tones(spark):
    rows = synthetic_tones(spark, 2, 0.5)
    found = audio.feature_table(rows, 20).collect()
    assert all(np.array(r["features"]).shape == (1 + 8000 // 512, 20) for r in found)
    assert audio.mfcc(np.zeros(78_680)).shape == (154, 128)
    t = np.arange(16_000) / 16_000
    power = audio.mel_bands() @ np.abs(np.fft.rfft(np.sin(2 * np.pi * 1000 * t)[:2048] * np.hanning(2048))) ** 2
    edges = np.flatnonzero(power > power.max() / 2)
    assert 38 <= edges.mean() <= 46  # 1 kHz is a third of the way up the scale
    low = audio.resample(np.sin(2 * np.pi * 440 * np.arange(8000) / 8000), 8000)
    assert len(low) == 16_000 and np.abs(low[2000:-2000] - np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)[2000:-2000]).max() < 0.01
    assert np.allclose(audio.dct_matrix(16, 16) @ audio.dct_matrix(16, 16).T, np.eye(16))


def test_config_and_command_line(tmp_path):
    from voicegrid import cli, config

    path = tmp_path / "c.yml"
    path.write_text("model:\n  seq_len: 50\n  lstm:\n    hidden_size: 8\ntrain:\n")
    cfg = config.load(str(path))
    assert (cfg.model.seq_len, cfg.model.lstm.hidden_size, cfg.train.batch_size) == (50, 8, 8)
    path.write_text("model:\n  nonsense: 1\n")
    with pytest.raises(ValueError, match="model.nonsense"):
        config.load(str(path))
    args = cli.parser().parse_args([])
    assert (args.mode, args.config, args.speaker_label_index) == ("train", "myconfig.yml", -2)


def test_jobs_end_to_end(spark, tmp_path):
    from dataclasses import replace

    from voicegrid import config
    from voicegrid.plans import jobs

    for r in synthetic_tones(spark, 6, 0.6).collect():
        k = int(r["utt"][4:])
        (tmp_path / f"s{k % 2}").mkdir(exist_ok=True)
        (tmp_path / f"s{k % 2}" / f"{k}.wav").write_bytes(bytes(r["content"]))
    lines = [f"s{k % 2},{tmp_path}/s{k % 2}/{k}.wav" for k in range(6)]
    (tmp_path / "m.csv").write_text("\n".join(lines))
    cfg = config.Config(
        data=config.Data(train_csv=str(tmp_path / "m.csv"), test_csv=str(tmp_path / "m.csv")),
        model=config.Model(saved_model_path=str(tmp_path / "model"), n_mfcc=12, seq_len=8, sliding_window_step=4, lstm=config.LstmConfig(4, 1)),
        train=config.Train(batch_size=2, num_steps=2, specaug=config.SpecAug(freq_mask_max_width=3, time_mask_max_width=3)),
        eval=config.Eval(num_triplets=10, threshold_step=0.01),
    )
    _, losses = jobs.run_training(spark, cfg)
    assert losses.count() == 2
    for use in (cfg, replace(cfg, eval=config.Eval(True, 10, 0.01))):
        found, at = jobs.run_eval(spark, use)
        assert found is None or 0 <= found <= 1 and 0 <= at < 1


def test_streaming_windows(spark, tmp_path):
    from voicegrid.streaming.windows import windowed_means

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.select("user_id", "ts", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp_ntz, value double").parquet(str(tmp_path / "in"))
    query = windowed_means(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    batch = windowed_means(events.select("user_id", "ts", "value"))
    assert spark.table("windows").count() == batch.count() > 0


def _plain_sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _plain_lstm(p, x, hidden, layers, mean):
    """One frame, one gate, one unit at a time."""
    seq = [list(map(float, f)) for f in x]
    for k in range(layers):
        wx, wh, b = p[f"{k}.x"], p[f"{k}.h"], p[f"{k}.b"]
        h, c, out = [0.0] * hidden, [0.0] * hidden, []
        for f in seq:
            z = [b[j] + sum(f[i] * wx[i, j] for i in range(len(f))) + sum(h[i] * wh[i, j] for i in range(hidden)) for j in range(4 * hidden)]
            gate = lambda n: z[n * hidden : (n + 1) * hidden]  # noqa: E731, B023
            c = [_plain_sigmoid(fg) * old + _plain_sigmoid(i) * np.tanh(g) for i, fg, g, old in zip(gate(0), gate(1), gate(2), c)]
            h = [_plain_sigmoid(o) * np.tanh(v) for o, v in zip(gate(3), c)]
            out.append(h)
        seq = out
    return np.mean(seq, 0) if mean else np.array(seq[-1])


@pytest.mark.parametrize("mean", [True, False])
def test_lstm_forward_is_the_plain_loop(mean):
    encoder = Lstm(3, 2, mean)
    params = encoder.init(4, 5)
    x = np.random.default_rng(0).standard_normal((2, 6, 4))
    found, _ = encoder.forward(params, x)
    for n in range(2):
        assert np.allclose(found[n], _plain_lstm(params, x[n], 3, 2, mean))


def test_attention_forward_is_the_plain_loop():
    encoder = Attention(4, 2, 2)
    p = encoder.init(3, 7)
    x = np.random.default_rng(1).standard_normal((5, 3))
    found, _ = encoder.forward(p, x[None])
    y = [[_plain_sigmoid(sum(f[i] * p["in.w"][i, j] for i in range(3)) + p["in.b"][j]) for j in range(4)] for f in x]
    for k in range(2):
        q, key, v = ([[sum(f[i] * p[f"{k}.{n}.w"][i, j] for i in range(4)) + p[f"{k}.{n}.b"][j] for j in range(4)] for f in y] for n in "qkv")
        mixed = []
        for t in range(5):
            row = []
            for head in (0, 2):
                scores = [np.exp(sum(q[t][head + d] * key[s][head + d] for d in range(2)) / np.sqrt(2)) for s in range(5)]
                row += [sum(scores[s] * v[s][head + d] for s in range(5)) / sum(scores) for d in range(2)]
            mixed.append(row)
        y = [[sum(f[i] * p[f"{k}.o.w"][i, j] for i in range(4)) + p[f"{k}.o.b"][j] for j in range(4)] for f in mixed]
    pooled = []
    for f in y:
        w = sum(f[i] * p["pool.w"][i, 0] for i in range(4)) + p["pool.b"][0]
        e = [np.exp(w * c) for c in f]
        pooled.append([c / sum(e) for c in e])
    assert np.allclose(found[0], np.mean(pooled, 0))


def test_mfcc_is_the_plain_transform():
    """Frame by frame: a direct Fourier sum, triangles drawn point by point, a direct cosine sum."""
    rng = np.random.default_rng(2)
    x = np.sin(np.arange(1500) * 0.2) + 0.1 * rng.standard_normal(1500)
    found = audio.mfcc(x, 5)
    assert found.shape == (1 + 1500 // 512, 5)
    mel = lambda hz: hz * 3 / 200 if hz < 1000 else 15 + 27 * np.log(hz / 1000) / np.log(6.4)
    back = lambda m: m * 200 / 3 if m < 15 else 1000 * 6.4 ** ((m - 15) / 27)
    edges = [back(mel(8000) * k / 129) for k in range(130)]
    padded = np.concatenate([np.zeros(1024), x, np.zeros(1024)])
    levels = []
    for t in range(found.shape[0]):
        frame = padded[512 * t : 512 * t + 2048] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(2048) / 2048))
        bins = np.arange(1025)
        power = np.abs(np.exp(-2j * np.pi * np.outer(bins, np.arange(2048)) / 2048) @ frame) ** 2
        row = []
        for k in range(128):
            low, mid, high = edges[k : k + 3]
            weight = [max(0.0, min((f - low) / (mid - low), (high - f) / (high - mid))) * 2 / (high - low) for f in bins * 16_000 / 2048]
            row.append(10 * np.log10(max(float(np.dot(weight, power)), 1e-10)))
        levels.append(row)
    levels = np.maximum(levels, np.max(levels) - 80)
    for t in range(found.shape[0]):
        for c in range(5):
            direct = sum(levels[t][k] * np.cos(np.pi * c * (2 * k + 1) / 256) for k in range(128)) * np.sqrt((1 if c == 0 else 2) / 128)
            assert abs(direct - found[t, c]) < 1e-6


def test_softmax_and_masks_are_computed_once_a_row(spark):
    import time

    from voicegrid.functions.vectors import softmax

    took = []
    for width in (64, 512):
        rows = spark.range(200).select(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: k / 100.0).alias("v")).persist()
        rows.count()
        began = time.perf_counter()
        (total,) = rows.select(softmax(F.col("v")).alias("s")).agg(F.sum(F.aggregate("s", F.lit(0.0), lambda a, x: a + x))).first()
        took.append(time.perf_counter() - began)
        assert abs(total - 200) < 1e-9
    assert took[1] < 3  # eight times the width; a quadratic form takes minutes
    frames = spark.createDataFrame([(1, np.arange(12.0).reshape(4, 3).tolist())], "id long, m array<array<double>>")
    plan = augment.masked(frames, "m", "id", augment.Masks(1.0, 1.0, 2, 2))._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" in plan and "md5(" not in plan.split("lambdafunction(transform(m")[1]  # not within the transform of cells


def test_training_reads_its_crops_once(spark):
    rng = np.random.default_rng(0)
    rows = [(i, role, rng.standard_normal((4, 3)).tolist()) for i in range(24) for role in range(3)]
    prepared = spark.createDataFrame(rows, "i long, role int, features array<array<double>>")
    jobs = []
    for steps in (2, 12):
        spark.sparkContext.setJobGroup(f"train-{steps}", "")
        _, losses = train.train(prepared, Lstm(2, 1), steps, 2)
        assert [r["step"] for r in losses.orderBy("step").collect()] == list(range(steps))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"train-{steps}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 4  # partitions are fetched, not steps
    with pytest.raises(ValueError, match="no triplets for step 12"):
        train.train(prepared, Lstm(2, 1), 13, 2)


def test_windows_as_rows_give_the_same_embeddings(spark):
    rng = np.random.default_rng(3)
    values = {f"u{k}": rng.standard_normal(n) for k, n in enumerate((5, 12, 23, 40))}
    encoder = Lstm(3, 1)
    params = encoder.init(1, 2)
    features = spark.createDataFrame([(u, [[float(x)] for x in v]) for u, v in values.items()], "utt string, features array<array<double>>")
    whole = {r["utt"]: r["embedding"] for r in train.infer(features, encoder, params, 10, 5).collect()}
    frames = spark.createDataFrame([(u, k, float(x)) for u, v in values.items() for k, x in enumerate(v)], "u string, frame long, value double")
    split = {r["utt"]: r["embedding"] for r in train.infer_windows(framing.window_rows(frames, "u", "value", 10, 5), encoder, params).collect()}
    assert whole["u0"] is None and "u0" not in split
    for u in ("u1", "u2", "u3"):
        assert np.allclose(whole[u], split[u], atol=1e-6)


def test_numbers_by_parts_and_ranges(spark):
    from voicegrid.functions import numbers
    from voicegrid.operators import sampling

    rows = spark.createDataFrame([("a", k, k // 7) for k in range(50)] + [(None, k, 0) for k in range(5)], "key string, at int, part int")
    found = numbers.numbered(rows.repartition(5), "key", ("at",), F.col("part"), "n").collect()
    assert len(found) == 55 and all(r["n"] == r["at"] for r in found)
    sums = numbers.running(rows.where("key = 'a'").repartition(6), F.floor(F.col("at") / 9), ("at",), before=F.col("at"), n=F.lit(1)).collect()
    assert len(sums) == 50 and all(r["before"] == sum(range(r["at"])) and r["n"] == r["at"] for r in sums)
    drawn = spark.createDataFrame([(100 - 7 * k, f"a{k}", "p", "n") for k in range(9)], "i long, anchor string, pos string, neg string")
    assert [(r["i"], r["anchor"]) for r in sampling.renumbered(drawn).orderBy("i").collect()] == [(k, f"a{8 - k}") for k in range(9)]


def test_planning_runs_no_job(spark):
    """Triplets, scores and windows are planned without a job or a table in between."""
    from voicegrid.plans import catalogue

    spark.sparkContext.setJobGroup("planning", "")
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("planning"))
    plans = [getattr(catalogue, q)(spark, "/root/testdata/sf0.001") for q in ("q_triplets", "q_scores", "q_sliding_windows", "q_window_mean", "q_random_crop", "q_mfcc")]
    ran = set(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) - before
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(plans) == 6 and len(ran) <= 7  # one a table that is read, for its schema


@pytest.mark.parametrize("join", ["merge", "broadcast"])
def test_vectors_are_shuffled_once_to_meet_their_slots(spark, join):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1" if join == "merge" else "10m")
    try:
        triplets = spark.createDataFrame([(0, "a", "b", "c"), (1, "b", "b", "a"), (2, "a", "b", "gone"), (3, "a", "b", "null")], "i long, anchor string, pos string, neg string")
        vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [3.0, 4.0]), ("null", None)], "utt string, embedding array<float>")
        found = scoring.with_embeddings(triplets, vectors)
        rows = {r["i"]: r for r in found.collect()}
        plan = found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows.keys() == {0, 1} and rows[0]["e_neg"] == [3.0, 4.0] and rows[0]["n_neg"] == 5.0 and rows[1]["e_anchor"] == rows[1]["e_pos"] == [0.0, 2.0]
    assert plan.count("Join") == 1


# Training in barrier tasks


def _crops(spark, n, frames=5, features=3, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, role, rng.standard_normal((frames, features)).tolist()) for i in range(n) for role in range(3)]
    return spark.createDataFrame(rows, "i long, role int, features array<array<double>>")


@pytest.mark.parametrize("encoder", [Lstm(4, 2), Attention(6, 2, 3)])
def test_barrier_tasks_train_as_one_loop(spark, tmp_path, monkeypatch, encoder):
    prepared = _crops(spark, 55).repartition(7)
    params, losses = train.train(prepared, encoder, 11, 5, rate=1e-2)
    path = str(tmp_path / "together")
    monkeypatch.setattr(type(prepared), "toLocalIterator", lambda *a, **k: pytest.fail("crops on the driver"))
    for tasks in (2, 3):
        mine, found = train.train(prepared, encoder, 11, 5, rate=1e-2, tasks=tasks, save_to=path, save_every=4)
        a, b = ([r["loss"] for r in x.orderBy("step").collect()] for x in (losses, found))
        assert len(a) == 11 and np.abs(np.subtract(a, b)).max() < 1e-9
        assert all(np.abs(mine[k] - params[k]).max() < 1e-9 for k in params)
    saved = [models.load(spark, models.checkpoint_path(path, k)) for k in (4, 8)]
    assert any(np.abs(saved[0][k] - saved[1][k]).max() > 1e-6 for k in params)


def test_barrier_tasks_need_triplets_for_each_step(spark):
    with pytest.raises(Exception, match="no triplets for step 2"):
        train.train(_crops(spark, 4), Lstm(2, 1), 3, 2, tasks=2)


# Cepstra from blocks


def test_blocks_give_the_cepstra_of_the_whole(spark):
    """Recordings of any length, in one block or in many tasks, and one that ends where a block does."""
    from voicegrid.operators import cepstra
    from voicegrid.sources.audio import Frames, mfcc

    rng, frames = np.random.default_rng(0), Frames(16_000, 128, 32, 24)
    lengths = {"a": 20_000, "b": 1, "c": 512, "d": 511, "e": 4096, "f": 4096 + 33}
    x = {k: rng.standard_normal(n) * np.linspace(0.001, 1, n) for k, n in lengths.items()}
    rows = [(k, i, float(v), lengths[k]) for k, values in x.items() for i, v in enumerate(values)]
    samples = spark.createDataFrame(rows, "spk string, frame long, v double, n_frames long").repartition(5)
    for block in (512, 4096):
        blocks = cepstra.sample_blocks(samples, "spk", "v", frames, block)
        assert blocks.where("size(samples) > %d" % (block + 128)).count() == 0
        found = cepstra.cepstra(cepstra.frame_decibels(blocks, frames, block), 13, 24).collect()
        by = {k: np.array([r["mfcc"] for r in sorted((r for r in found if r["utt"] == k), key=lambda r: r["frame"])]) for k in x}
        for k in x:
            whole = mfcc(x[k], 13, frames=frames)
            assert by[k].shape == whole.shape and np.abs(by[k] - whole).max() < 1e-9, (k, block)
    with pytest.raises(ValueError, match="multiple"):
        cepstra.sample_blocks(samples, "spk", "v", frames, 500)


def test_matrices_from_arrow():
    import pyarrow as pa

    column = pa.array([[[9.0]], [[1.0, 2.0], [3.0, 4.0]], None, [], [[5.0]], [[6.0], [7.0], [8.0]]], pa.list_(pa.list_(pa.float64())))
    got = train._matrices(column.slice(1))
    assert [m.tolist() for m in got] == [[[1, 2], [3, 4]], [], [], [[5]], [[6], [7], [8]]]


# Long sequences


@pytest.mark.parametrize("mean", [True, False])
def test_chunks_carry_the_state_on(spark, mean):
    """Whole sequences in chunks of ten frames, as in one piece."""
    rng, encoder = np.random.default_rng(5), Lstm(5, 3, mean)
    params = encoder.init(4)
    sequences = {f"u{k}": rng.standard_normal((n, 4)) for k, n in enumerate((1, 10, 37, 95))}
    rows = [(u, c, x[c * 10 : c * 10 + 10].tolist()) for u, x in sequences.items() for c in range(-(-len(x) // 10))]
    rng.shuffle(rows)
    chunks = spark.createDataFrame([(u, int(c), x) for u, c, x in rows] + [("none", 0, [])], "utt string, chunk long, features array<array<double>>").repartition(6)
    found = {r["utt"]: r["embedding"] for r in train.infer_chunks(chunks, encoder, params).collect()}
    assert found.pop("none") is None
    for u, x in sequences.items():
        assert np.abs(np.array(found[u]) - encoder.forward(params, x[None])[0][0]).max() < 1e-12


@pytest.mark.parametrize("encoder", [Lstm(5, 2), Lstm(4, 1, mean=False), Attention(6, 2, 3)])
def test_embeddings_in_blocks_of_frames(encoder, monkeypatch):
    from voicegrid.operators import encoders

    rng = np.random.default_rng(6)
    params = encoder.init(3)
    for t in (1, 7, 8, 29):
        x = rng.standard_normal((2, t, 3)) * 5
        expected = encoder.forward(params, x)[0]
        for block in (3, 8, 512):
            monkeypatch.setattr(encoders, "BLOCK", block)
            assert np.abs(encoder.embed(params, x) - expected).max() < 1e-12


def test_attention_takes_memory_by_frames():
    import tracemalloc

    encoder = Attention(4, 1, 2)
    params, peaks = encoder.init(2), []
    for t in (2000, 8000):
        x = np.ones((1, t, 2))
        tracemalloc.start()
        encoder.embed(params, x)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 4.5 * peaks[0]  # not sixteen times


# Error rates that go on


def test_counts_of_trials_add_up(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.randrange(2), rng.random() if k % 9 else None) for k in range(900)]
    trials = spark.createDataFrame(rows, "label int, score double")
    halves = [spark.createDataFrame(rows[a:b], "label int, score double") for a, b in ((0, 300), (300, 900))]
    for step in (0.1, 0.005):
        whole = eer.far_frr(trials, step).orderBy("threshold").collect()
        merged = eer.rates(eer.merged(*(eer.counted(h, step) for h in halves)), step).orderBy("threshold").collect()
        assert merged == whole
        path = str(tmp_path / f"counts-{step}")
        for h in halves:
            counts = eer.appended(h, path, step)
        assert eer.nearest(eer.rates(counts, step)).collect() == eer.equal_error_rate(trials, step).collect()


@pytest.mark.parametrize("length, step", [(5, 2), (4, 4), (3, 7)])
def test_streamed_windows_are_the_batch_ones(spark, tmp_path, length, step):
    """However frames are cut into micro-batches."""
    from voicegrid.operators import framing
    from voicegrid.streaming.windows import frame_windows

    rows = [(u, k, float(k * 10 + u)) for u, n in enumerate((3, 17, 30)) for k in range(n)]
    frames = spark.createDataFrame(rows, "u long, frame long, v double")
    expected = sorted((r["utt"], r["window"], r["features"]) for r in framing.window_rows(frames, "u", "v", length, step).collect())
    for cut, edges in enumerate(([0, 30], [0, 1, 2, 9, 10, 11, 30], [*range(0, 30, 4), 30])):
        source = tmp_path / f"in-{cut}"
        source.mkdir()
        stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).json(str(source))
        query = frame_windows(stream, "u", "frame", "v", length, step).writeStream.format("memory").queryName(f"windows_{length}_{step}_{cut}").option("checkpointLocation", str(tmp_path / f"at-{cut}")).start()
        try:
            for a, b in zip(edges, edges[1:]):
                part = frames.where(f"frame >= {a} and frame < {b}").collect()
                (source / f"{a:03d}.json").write_text("\n".join(f'{{"u": {r["u"]}, "frame": {r["frame"]}, "v": {r["v"]}}}' for r in reversed(part)))
                query.processAllAvailable()
            found = spark.table(f"windows_{length}_{step}_{cut}").collect()
        finally:
            query.stop()
        assert sorted((r["utt"], r["window"], r["features"]) for r in found) == expected and all(r["first_frame"] == r["window"] * step for r in found)


def test_rates_of_no_trials_and_of_scores_outside_the_thresholds(spark):
    none = spark.createDataFrame([], "label int, score double")
    assert [tuple(r) for r in eer.far_frr(none, 0.5).orderBy("threshold").collect()] == [(0.0, 0, 0, None, None), (0.5, 0, 0, None, None)]
    odd = spark.createDataFrame([(1, 9.0), (1, -9.0), (0, 0.5), (0, None)], "label int, score double")
    assert [tuple(r) for r in eer.far_frr(odd, 0.25).orderBy("threshold").collect()] == [(0.0, 1, 1, 1.0, 0.5), (0.25, 1, 1, 1.0, 0.5), (0.5, 1, 1, 1.0, 0.5), (0.75, 0, 1, 0.0, 0.5)]
