import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from voicegrid.llm import neardup
from voicegrid.llm.text import words_of


def multiset(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    i = sum((a & b).values())
    return i / max(1, sum(a.values()) + sum(b.values()) - i)


def plain_classes(rows):
    texts = {}
    for d, t in rows:
        texts.setdefault(t or "", []).append(d)
    keys = list(texts)
    sets = [multiset(t) for t in keys]
    label = list(range(len(keys)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= 0.8:
                label[find(a)] = find(b)
    groups = {}
    for k, t in enumerate(keys):
        groups.setdefault(find(k), []).extend(texts[t])
    return {d: min((x for x in g if x is not None), default=None) for g in groups.values() for d in g}


def changed(text, n, seed):
    w, rng = text.split(), random.Random(seed)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.random():.6f}"
    return " ".join(w)


def test_signatures_agree_as_often_as_weighted_similarity(prose):
    (base,) = prose(1, 300)
    texts = [base, changed(base, 6, 1), changed(base, 20, 2), base + " " + " ".join(base.split()[:100]), "a b a b a b a b a b a b"]
    words = words_of(pa.array(texts))
    sig, has = neardup.dart_signatures(*neardup.shingles(words), len(texts), 4096)
    assert has.all()
    for k in range(1, len(texts)):
        assert abs((sig[0] == sig[k]).mean() - jaccard(multiset(texts[0]), multiset(texts[k]))) < 0.035


def test_signature_does_not_depend_on_the_batch(prose):
    texts = prose(5, 80) + ["", "one two"]
    together, _ = neardup.dart_signatures(*neardup.shingles(words_of(pa.array(texts))), len(texts), 96)
    for k, t in enumerate(texts):
        alone, _ = neardup.dart_signatures(*neardup.shingles(words_of(pa.array([t]))), 1, 96)
        assert np.array_equal(alone[0], together[k])


def _corpus(prose, odd):
    base = prose(40, 150)
    rows = list(enumerate(base))
    for k in range(12):  # near copies at similarities on both sides of the threshold
        rows += [(100 + 20 * k + n, changed(base[k], n, n)) for n in range(1, 9)]
    rows += [(500 + k, base[20]) for k in range(30)]  # exact copies
    rows += [(600 + k, changed(base[21], 1, k)) for k in range(60)]  # a large group of near copies
    rows += [(700 + k, t) for k, t in enumerate(odd)] + [(800, odd[3]), (None, base[22]), (None, "nowhere else at all in here")]
    return rows


def test_equals_brute_force(documents, prose, odd):
    rows = _corpus(prose, odd)
    found = neardup.near_duplicates(documents(rows))
    assert found.columns == ["doc_id", "class_id"]
    got = found.collect()
    expected = plain_classes(rows)
    assert len(got) == len(rows)
    assert all(r["class_id"] == expected[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert sorted((r["class_id"] for r in got if r["doc_id"] is None), key=str) == [22, None]


def test_keep_one_of_each_class(documents, prose, odd):
    rows = _corpus(prose, odd) + [(0, prose(40, 150)[0])]  # a repeated row
    docs = documents(rows)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    expected = {c for d, c in plain_classes(rows).items() if c is not None} | {None}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(expected, key=str)


def test_empty_table(documents):
    assert neardup.near_duplicates(documents([])).count() == 0
    assert neardup.keep_one(documents([])).count() == 0


def _assert_hot_classes(documents, prose, least, most, few):
    """Copies of one text, each edited apart, the first ``few`` of them hardly."""
    (base,), rng = prose(1, 300), random.Random(1)
    rows = [(k, changed(base, 1 if k < few else rng.randint(least, most), k)) for k in range(160)]
    expected = plain_classes(rows)
    assert 1 < len(set(expected.values())) < 160
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(documents(rows)).collect()} == expected


def test_no_link_of_a_hot_group_is_lost(documents, prose):
    _assert_hot_classes(documents, prose, 3, 5, 0)


def test_members_unlike_their_centre_meet_others(documents, prose):
    _assert_hot_classes(documents, prose, 4, 6, 3)


def test_tables_in_between_are_deleted(spark, documents, prose):
    import os

    from voicegrid.llm.store import materialize, scratch
    from voicegrid.session import shared_dir

    before = set(os.listdir(shared_dir(spark)))
    found = neardup.near_duplicates(documents(list(enumerate(prose(20, 60)))))
    assert found.count() == 20
    left = {p.split("-")[0] for p in set(os.listdir(shared_dir(spark))) - before}
    assert {"signed", "unique"} < left and len(left) == 3  # and the labels
    with scratch(spark) as held:
        gone, kept = (materialize(spark.range(3), name) for name in ("gone", "kept"))
        held.remove(kept.stored_at)
    assert kept.count() == 3 and not os.path.exists(gone.stored_at)
