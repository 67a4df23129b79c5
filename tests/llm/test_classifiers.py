import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from voicegrid.llm import labelled, quality, toxicity
from voicegrid.llm import queries as registered

SF = "/root/testdata/sf0.01"


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def _held_out(spark, rows, label):
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    pairs = [(r["score"], r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    return np.array(pairs).T


def test_quality_on_held_out_labels(spark):
    rows = registered.op9_quality(spark, SF).collect()
    assert len(rows) == 1000 and all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    score, predicted, truth = _held_out(spark, rows, "quality")
    assert (predicted == truth).mean() > 0.95
    assert 0 <= score.min() and score.max() <= 1


def test_toxicity_on_held_out_labels(spark, monkeypatch):
    rows = registered.op1_toxicity(spark, SF).collect()
    assert len(rows) == 1000 and all(r["held_out"] == (crc(r["doc_id"]) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    _, predicted, truth = _held_out(spark, rows, "toxic")
    assert predicted[truth == 0].mean() < 0.01 and predicted[truth == 1].mean() > 0.6  # 33 toxic documents to learn from
    large = SF.replace("0.01", "0.1")
    rows = registered.op1_toxicity(spark, large).collect()
    monkeypatch.setitem(globals(), "SF", large)
    _, predicted, truth = _held_out(spark, rows, "toxic")
    assert predicted[truth == 0].mean() < 0.01 and predicted[truth == 1].mean() >= 0.9  # one in twenty holds none of the words


def plain_features(text):
    """Strings in the place of hashes."""
    words, out = re.findall(r"[^\W_]+", text.lower()), set()
    for k, w in enumerate(words):
        out.add(("word", w))
        for name, ends in (("pair", (1,)), ("triple", (1, 2)), ("skip", (2,)), ("far", (3,))):
            if k + ends[-1] < len(words):
                out.add((name, w, *(words[k + e] for e in ends)))
    for size in toxicity.STEMS:
        stems = Counter(w.encode()[:size] for w in words if len(w.encode()) > size)
        out |= {("stem", size, s, often) for s, n in stems.items() for often in toxicity.OFTEN if n >= often}
    return out


def test_features_are_those_of_a_plain_loop(prose):
    texts = prose(8, 60) + ["one two one two one two", "stemming stemmed stems stem", "", "a", "Ünïcödé wörds ünïcödés", "x! y? x, y. x"]
    hashes, rows, n = toxicity.features(pa.array(texts))
    names = [plain_features(t) for t in texts]
    assert n == len(texts)
    ids = [set(hashes[rows == k].tolist()) for k in range(n)]
    assert [len(i) for i in ids] == [len(x) for x in names]
    for a in range(n):
        for b in range(n):
            assert len(ids[a] & ids[b]) == len(names[a] & names[b])


def plain_ftrl(documents, labels, n_coordinates):
    share = sum(labels) / len(labels)
    l1 = toxicity.NOISE * math.sqrt(share * len(labels))
    z, n, bias, bias_n = [0.0] * n_coordinates, [0.0] * n_coordinates, math.log(share / (1 - share)), 1.0

    def weight(k):
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((toxicity.BETA + math.sqrt(n[k])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for at, label in zip(documents, labels):
            w = {k: weight(k) for k in at}
            g = 1 / (1 + math.exp(-(bias + sum(w.values())))) - label
            for k in at:
                rate = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / toxicity.ALPHA
                z[k] += g - rate * w[k]
                n[k] += g * g
            bias_n += g * g
            bias -= toxicity.ALPHA * g / (toxicity.BETA + math.sqrt(bias_n))
    return [weight(k) for k in range(n_coordinates)], bias


def test_ftrl_is_the_plain_loop():
    rng = np.random.default_rng(0)
    documents = [np.unique(rng.integers(0, 40, 12)) for _ in range(120)]
    labels = np.array([int(3 in d or rng.random() < 0.05) for d in documents])
    w, bias = toxicity.ftrl(documents, labels, 40)
    expected, expected_bias = plain_ftrl([d.tolist() for d in documents], labels.tolist(), 40)
    assert np.allclose(w, expected) and abs(bias - expected_bias) < 1e-9 and 0 < (w != 0).sum() < 40


def plain_measures(text):
    data = text.encode()
    kind = lambda b: "lower" if 97 <= b <= 122 else "upper" if 65 <= b <= 90 else "digit" if 48 <= b <= 57 else "line" if b == 10 else "space" if b in (32, 9, 11, 12, 13) else "stop" if chr(b) in ".,;:'" else "other" if b >= 128 else "symbol"
    n = Counter(map(kind, data))
    words = re.findall(rb"[^\x20\x09-\x0d]+", data)
    some, size = max(1, len(words)), max(1, len(data))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    ended = sum(kind(w[-1]) == "symbol" for w in words)
    alone = sum(kind(w[-1]) == "symbol" and len(w) == 1 for w in words)
    letters = max(1, n["lower"] + n["upper"] + n["other"])
    again = 1 - len(set(words)) / some if words else 0
    solid = n["lower"] + n["upper"] + n["digit"]
    return [
        n["upper"] / letters, n["digit"] / size, n["stop"] / size * 10, math.sqrt(n["symbol"] / size), n["other"] / size, n["line"] / some,
        math.sqrt(repeats / some), repeats / some, again, again * len(words) / (len(words) + 100), math.sqrt(ended / some), ended / some,
        math.sqrt(alone / some), math.log1p(len(words)) / 10, min(solid / some / 20, 2),
    ]


def test_measures_are_those_of_a_plain_loop(prose, odd):
    texts = [t for t in prose(20, 80) + odd + ["A b! c?? 12 # # the the the\n\nX-y; 'z'"] if t is not None and len(t) < 5000]
    assert np.allclose(quality.measures(pa.array(texts)), [plain_measures(t) for t in texts])


def test_bradley_terry_weights_are_at_the_minimum(spark, documents, prose):
    """A plain Newton method over the same pairs ends at the same weights."""
    rng = np.random.default_rng(3)
    texts = [t.upper() if k % 3 == 0 and rng.random() < 0.8 else t for k, t in enumerate(prose(150, 40))]
    docs = documents(list(enumerate(texts)))
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(150)], "doc_id long, quality int, toxic int")
    sample = labelled.labelled_sample(docs, labels, "quality", 5, 0)
    model = quality.fit(sample)
    rows = sorted((r["key"], r["label"], r["text"]) for r in sample.collect())
    bad = [t for _, label, t in rows if not label]
    drawn = sample.where("label = 1").selectExpr("text", "explode(sequence(1, 4)) as draw", "key").selectExpr("text", "cast(pmod(xxhash64(key, draw), %d) as int) as number" % len(bad)).collect()
    x = lambda t: np.array(plain_measures(t))
    d = np.array([x(r["text"]) - x(bad[r["number"]]) for r in drawn])
    w = np.zeros(d.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(d @ w))
        gradient = -(d * p[:, None]).mean(0) + quality.RIDGE * 0.01 * w
        hessian = (d.T * (p * (1 - p))) @ d / len(d) + quality.RIDGE * 0.01 * np.eye(len(w))
        w -= np.linalg.solve(hessian, gradient) * 0.7
    assert np.abs(np.array(model.weights) - w).max() < 0.05 * np.abs(w).max()


def test_planted_words_are_found_and_clean_texts_left(spark, documents, prose):
    texts = [t + (" vile scum here" if k % 4 == 0 else "") for k, t in enumerate(prose(400, 60))]
    docs = documents(list(enumerate(texts)))
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert len(model.hashes) < 2000
    for r in toxicity.judged(docs, model).collect():
        assert r["predicted"] == int(r["doc_id"] % 4 == 0)
    again = toxicity.train(docs, labels)
    assert np.array_equal(model.hashes, again.hashes) and np.array_equal(model.weights, again.weights)


def test_scores_do_not_depend_on_batches(documents, prose):
    texts = prose(6, 50) + ["", "Word word WORD !!!"]
    assert np.array_equal(quality.measures(pa.array(texts)), np.concatenate([quality.measures(pa.array([t])) for t in texts]))
    hashes, rows, _ = toxicity.features(pa.array(texts))
    for k, t in enumerate(texts):
        assert sorted(hashes[rows == k]) == sorted(toxicity.features(pa.array([t]))[0])


def test_sample_is_bounded_and_keeps_the_fold(spark, documents, prose):
    docs = documents([(k, t) for k, t in enumerate(prose(300, 5))] * 2 + [(None, "x")])
    labels = spark.createDataFrame([(k, 1, 0) for k in range(300)] + [(5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = labelled.labelled_sample(docs, labels, "quality", 5, 0).collect()
    assert len(got) == sum(crc(k) % 5 != 0 for k in range(300))
    assert 20 <= labelled.labelled_sample(docs, labels, "quality", 5, 0, 50).count() <= 90


def test_sample_is_bounded_where_a_doc_id_repeats(spark):
    """One labelled doc_id with very many texts counts once; others keep their part of the sample, which is bounded in bytes, too."""
    many = spark.range(50_000).selectExpr("7L as doc_id", "concat('text ', id % 40000, ' of many') as text")
    docs = many.unionByName(spark.createDataFrame([(k, f"another {k} {'x' * (k % 9)}") for k in range(1000)], "doc_id long, text string"))
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1000)], "doc_id long, quality int, toxic int")
    got = labelled.labelled_sample(docs, labels, "quality", 5, 0, 10**6).collect()
    learnt = [k for k in range(1000) if crc(k) % 5 != 0]
    assert len(got) == len(learnt) and sum(r["text"].endswith("of many") for r in got) == (7 in learnt) and len({r["key"] for r in got}) == len(got)
    few = labelled.labelled_sample(docs, labels, "quality", 5, 0, 10**6, 5_000).collect()
    assert 3_500 <= sum(len(r["text"]) for r in few) <= 6_500
    assert sorted(few) == sorted(labelled.labelled_sample(docs, labels, "quality", 5, 0, 10**6, 5_000).collect())
    assert len(quality.fit(labelled.labelled_sample(docs, labels, "quality", 5, 0, 100)).weights) == 15


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows_and_tables(spark, documents, prose, odd, module):
    rows = [(k, t) for k, t in enumerate(prose(60, 30))] + [(100 + k, t) for k, t in enumerate(odd)] + [(None, None), (1, "again")]
    docs = documents(rows)
    labels = spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(110)], "doc_id long, quality int, toxic int")
    got = module.judged(docs, module.train(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    none = labels.limit(0)
    assert module.judged(docs, module.train(docs, none)).count() == len(rows)
    assert module.judged(documents([]), module.train(documents([]), none)).count() == 0


def test_without_bad_labels_all_is_kept(spark, documents, prose):
    docs = documents(list(enumerate(prose(20, 30))))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, quality.train(docs, labels))
    assert kept.columns == docs.columns and kept.count() == 20
    assert {r["predicted"] for r in toxicity.judged(docs, toxicity.train(docs, labels)).collect()} == {0}
