"""URL filter, mixing, top-k, fingerprints, BPE and the pipeline."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from voicegrid.llm import bpe, fingerprints, mixing, topk, url_filter

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_url_filter", "op6_mixing", "op8_top_k"])
def test_equals_sql(compare, name):
    assert compare(name) == [0, 0]


def test_all_are_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names


# URL filter

URLS = [
    ("http://a.example.org/en/1x", "example.org/en/1", "block"),
    ("http://EXAMPLE.org/es/", "example.org/es/", "block"),
    ("http://example.org/es", "org/", "allow"),
    ("http://notexample.org/es/x", "org/", "allow"),
    ("http://x.com/fr/a?b#c", "com/fr/", "allow"),
    ("http://x.com/de/", "com/de/", "block"),
    ("http://x.com/de", None, "allow"),
    ("http://org", None, "allow"),
    ("http://org/", "org/", "allow"),
    ("http://a.org?x=/", None, "allow"),
    ("http://m.casino-win.net/x", None, "block"),
    ("http://casinos.net/x", None, "allow"),
    ("x://y.org/a://z.com/de/", "org/", "allow"),
    ("no scheme.org/", None, "allow"),
    ("", None, "allow"),
    (None, None, "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(k, u, "x", "y") for k, (u, _, _) in enumerate(URLS)] + [(None, None, None, None)], "page_id long, url string, rule string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    for k, (url, rule, verdict) in enumerate(URLS):
        assert (got[k]["rule"], got[k]["verdict"]) == (rule, verdict), url
    assert got[0]["host"] == "a.example.org" and got[0]["path"] == "/en/1x" and got[None]["host"] == ""
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_index_finds_what_all_rules_find():
    rng = random.Random(0)
    rules = tuple(url_filter.prefix_rule(f"{rng.choice(['a.com', 'b.org', 'com', 'c-d.net'])}/{rng.choice(['', 'x/', 'x/y', 'en/1'])}", rng.choice(["allow", "block"])) for _ in range(30))
    rules = tuple({r.name: r for r in rules}.values()) + url_filter.WORD_RULES
    index = url_filter.RuleIndex(rules, {"com": 9, "a": 1, "x": 4}, "allow")
    for _ in range(500):
        place = rng.choice(["a.com", "z.a.com", "b.org", "c-d.net", "porn.b.org", "za.com"]) + rng.choice(["/", "/x/", "/x/yz", "/en/12", ""])
        fits = [r for r in rules if re.compile(r.pattern, re.DOTALL).search(place)]
        best = max(fits, key=lambda r: r.length, default=None)
        found = index.fits(place)
        assert (found and (found.name if found.length else "word")) == (best and (best.name if best.length else "word"))
    with pytest.raises(ValueError):
        url_filter.RuleIndex(rules[:1] * (url_filter.MAX_RULES + 1), {}, "allow")


WILD = [
    ("||ads.*/banner^", "ads.example.com/banner", True),
    ("||ads.*/banner^", "x.ads.net/a/banner?x", True),
    ("||ads.*/banner^", "bads.net/banner/", False),
    ("||ads.*/banner^", "ads.net/banners", False),
    ("/tag/*/feed|", "a.b/tag/x/feed", True),
    ("/tag/*/feed|", "a.b/tag/x/feed/", False),
    ("?sessionid=", "a.b/c?sessionid=12", True),
    ("&sort=", "a.b/c?x=1&sort=up", True),
    ("&sort=", "a.b/c?resort=1", False),
]


@pytest.mark.parametrize("line, place, fits", WILD)
def test_wildcard_rules(line, place, fits):
    rule = url_filter.wildcard_rule(line, "block")
    assert bool(re.search(rule.pattern, place, re.DOTALL)) == fits
    assert (url_filter.RuleIndex((rule,), {}, "allow").fits(place) is not None) == fits


def test_thousands_of_rules_of_a_table(spark):
    """As trying every rule on every URL, over whole pages and made-up ones."""
    rng = random.Random(6)
    words = [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{k % 97}" for k in range(400)]
    lines = {}
    for k in range(4000):
        a, b = rng.choice(words), rng.choice(words)
        kind, line = rng.choice([("prefix", f"{a}.com/{b}"), ("word", a), ("wildcard", f"||{a}.*/{b}^"), ("wildcard", f"/{a}/*.{b}|"), ("wildcard", f"?{a}={b}"), ("wildcard", f"*{a}{b}*")])
        lines[kind, line] = (k, kind, line, rng.choice(["allow", "block"]))
    rules = url_filter.rules_of(spark.createDataFrame(list(lines.values())[::-1], "position int, kind string, rule string, verdict string"))
    assert len(rules) == len(lines) > 2500 and rules[0].name == list(lines.values())[0][2]
    places = [f"{rng.choice(['', 'www.', 'x-'])}{rng.choice(words)}.{rng.choice(['com', 'net'])}/{rng.choice(words)}/{rng.choice(words)}.{rng.choice(words)}{rng.choice(['', '?' + rng.choice(words) + '=' + rng.choice(words)])}" for _ in range(300)]
    pages = spark.createDataFrame([(k, f"http://{p}") for k, p in enumerate(places)], "page_id long, url string")
    compiled = [(r, re.compile(r.pattern, re.DOTALL)) for r in sorted(rules, key=lambda r: -r.length)]
    for r in url_filter.judge(pages, rules).collect():
        first = next((rule for rule, pattern in compiled if pattern.search(places[r["page_id"]])), None)
        assert (r["rule"] or r["pattern"], r["verdict"]) == ((first.name, first.verdict) if first else (None, "allow"))
    few = url_filter.RuleIndex(rules, url_filter.literal_counts(pages.withColumnRenamed("url", "place"), rules), "allow")
    fetched = [len({k for t in set(re.findall("[A-Za-z0-9]+", p)) for k in few.filed.get(t, ())}) for p in places]
    assert max(fetched) < len(rules) / 10


# Mixing


def plain_targets(sizes):
    """Round by round, as the rule says."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (budget - sum(2 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= over


def test_targets_and_sums(documents, prose, odd):
    rng = random.Random(1)
    rows = [(k, " ".join(t.split()[: rng.randint(1, 60)]), rng.choice(["a", "b", "b", "b", "c", "é", None])) for k, t in enumerate(prose(400, 60))]
    rows += [(900 + k, t, "odd") for k, t in enumerate(odd)] + [(None, "one two three", "a")] * 3
    got = mixing.mix(documents(rows)).collect()
    assert len(got) == len(rows)
    size = {(d, s): len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, s in rows}
    source = {d: s for d, _, s in rows}
    sizes = {}
    for d, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size[d, s]
    expected = plain_targets(sizes)
    sums = {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"], s] and r["source_size"] == sizes[s] and abs(r["target"] - expected[s]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        sums[s] = sums.get(s, 0) + r["taken"]
    for s, total in sums.items():
        assert abs(total - expected[s]) <= 3 + 0.5
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(documents(rows[::-1])).collect()))
    assert mixing.mix(documents([])).count() == 0


def test_repeated_rows_are_what_the_mix_takes(documents, prose):
    rows = [(k, t + (" \n" if k % 3 else ""), "abc"[k % 3]) for k, t in enumerate(prose(90, 25))] + [(500, None, "a"), (501, "", None)]
    docs = documents(rows)
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    words, texts = {}, dict((d, t) for d, t, _ in rows)
    for r in out.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert words == {d: n for d, n in plan.items() if n}


def test_groups_of_a_large_source(documents, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 50)
    got = mixing.mix(documents([(k, "w " * (1 + k % 7), "a" if k % 10 else "b") for k in range(1000)])).collect()
    for s in (0, 1):
        mine = [r for r in got if (r["doc_id"] % 10 == 0) == bool(s)]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 0.5 * 20 + 1


# Top-k


def plain_top_k(vectors, k=20, modulus=20):
    out = []
    whole = [(i, [np.floor(64 * float(np.float32(x))) for x in v]) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for at, (q, mine) in enumerate(whole):
        if q is None or q % modulus:
            continue
        scored = sorted((-sum(a * b for a, b in zip(mine, v)), i is None, i or 0) for n, (i, v) in enumerate(whole) if n != at)
        out += [(q, rank, None if null else i, int(-s)) for rank, (s, null, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["clusters", "alike", "odd"])
def test_top_k_equals_brute_force(spark, kind, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(topk, "QUERIES", 30)  # several groups of either side
    monkeypatch.setattr(topk, "TASK_ROWS", 300)
    if kind == "clusters":
        vectors = [(k, (rng.standard_normal(8) * 0.05 + np.eye(8)[k % 4]).tolist()) for k in range(1500)]
    elif kind == "alike":
        vectors = [(k, [0.5] * 6 if k % 3 else rng.standard_normal(6).tolist()) for k in range(400)]
    else:
        vectors = [(20 * k, [float(k), -1.0]) for k in range(6)] + [(1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf")]), (None, [1.0, 1.0]), (None, [1.0, 1.0]), (None, [99.0, -1.0]), (5, []), (6, [1.0]), (7, [1.0, 2.0, 3.0]), (7, [0.5, 0.5]), (40, [9.0, 9.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, score int")
    got = sorted((tuple(r) for r in topk.top_k(table).collect()), key=str)
    assert got == plain_top_k(vectors)


@pytest.mark.parametrize("cells, sample", [(5, 40), (1, 10), (64, 10**6)])
def test_top_k_with_any_net(spark, monkeypatch, cells, sample):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(topk, "TASK_ROWS", 50)
    monkeypatch.setattr(topk, "CELLS", cells)
    monkeypatch.setattr(topk, "SAMPLE", sample)
    vectors = [(k % 300, (rng.standard_normal(4) * 0.2 + 2 * np.eye(4)[k % 3]).tolist()) for k in range(600)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    assert sorted((tuple(r) for r in topk.top_k(table).collect()), key=str) == plain_top_k(vectors)


def test_repeated_ids_equal_sql(spark, duck):
    vectors = [(0, [1.0, 2.0]), (0, [3.0, -1.0]), (0, [3.0, -1.0]), (7, [1.0, 1.0]), (None, [1.0, 1.0]), (20, [0.5, 0.5]), (21, None)]
    mine = sorted((tuple(r) for r in topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<float>")).collect()), key=str)
    values = ", ".join(f"({'null' if i is None else i}, {'null' if v is None else v}::FLOAT[])" for i, v in vectors)
    theirs = duck.sql(topk.ORACLE_SQL.replace("FROM embeddings", f"FROM (VALUES {values}) AS t(vec_id, embedding)")).fetchall()
    assert mine == sorted(theirs, key=str) and len(mine) == 4 * 5


def test_pairs_of_cells_are_left_out_before_the_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(topk, "TASK_ROWS", 250)
    seen, plain = [], topk.surviving
    monkeypatch.setattr(topk, "surviving", lambda cells, centres: seen.append((len(cells), plain(cells, centres))) or seen[-1][1])
    ways = 10 * np.sign(rng.standard_normal((8, 16)))
    vectors = [(k, (rng.standard_normal(16) * 0.05 + ways[k % 8]).tolist()) for k in range(2000)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in topk.top_k(table).collect()), key=str)
    assert got == plain_top_k(vectors)
    ((cells, pairs),) = seen
    assert cells == 8 and len(pairs) <= 8  # queries of ids divisible by 20 lie in two of eight clusters


def test_jobs_do_not_grow_with_groups_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(4)
    table = spark.createDataFrame([(k, rng.standard_normal(4).tolist()) for k in range(800)], "vec_id long, embedding array<float>")
    jobs = []
    for size in (10**6, 5):
        monkeypatch.setattr(topk, "QUERIES", size)
        spark.sparkContext.setJobGroup(f"top-{size}", "")
        got = sorted(tuple(r) for r in topk.top_k(table).collect())
        jobs.append((len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"top-{size}")), got))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_huge_scores_keep_their_candidates(spark):
    table = spark.createDataFrame([(0, [1e200, 1e200]), (1, [1e200, -1e200]), (2, [-1e300, 0.0]), (3, [1e300, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"]) for r in topk.top_k(table).collect()]
    assert got == [(1, 3), (2, 1), (3, 2)]


def test_trees_cover_and_separate():
    points = np.random.default_rng(1).standard_normal((3000, 3)).round(1)
    tree = topk.CoverTree(points)
    assert sorted(tree.order) == list(range(3000))
    for node, children in enumerate(tree.children):
        s, e = tree.range[node]
        assert np.sqrt(((tree.points[s:e] - tree.centres[node]) ** 2).sum(1)).max() <= tree.radii[node] + 1e-12
        if children:
            assert [tree.range[c] for c in children] and sum(tree.range[c][1] - tree.range[c][0] for c in children) == e - s
            apart = np.sqrt(((tree.centres[children][:, None] - tree.centres[children][None]) ** 2).sum(2))[np.triu_indices(len(children), 1)]
            assert apart.min() >= max(tree.radii[c] for c in children) - 1e-12 and any((tree.centres[c] == tree.centres[node]).all() for c in children)


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_tree_prunes_what_cannot_win():
    rng = np.random.default_rng(0)
    far = np.concatenate([rng.standard_normal((2000, 4)) * 0.01 + 10 * np.sign(rng.standard_normal(4)) for _ in range(8)])
    queries = rng.standard_normal((50, 4)) * 0.01 + np.array([10.0, 10, 10, 10])
    tree, best = topk.CoverTree(queries), None
    best = topk.Best(tree, np.arange(50) + 10**6, 5)
    compared = []
    best._compare, plain = (lambda q, data, d, *rest: (compared.append(np.diff(data.range[d])[0]), plain(q, data, d, *rest))), best._compare
    best.search(topk.CoverTree(far), np.arange(len(far)), np.arange(len(far)))
    expected = np.sort(queries @ far.T, 1)[:, ::-1][:, :5]
    assert np.allclose(best.score, expected[tree.order])
    assert sum(compared) < len(far)


# Fingerprints


def test_edits_and_fingerprints(documents, prose, odd):
    texts = prose(60, 100) + odd
    rows = [(3 * k, t) for k, t in enumerate(texts)] + [(10**6, texts[0]), (None, "first of all")]
    docs = documents(rows)
    got = {r["doc_id"]: r for r in fingerprints.compare(docs).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for k, (d, t) in enumerate(order):
        mine, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(mine) // 2
        edited = mine[: len(mine) - half] + following[:half]
        assert got[d]["n_chars"] == len(mine)
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
    assert got[0]["fingerprint"] == got[10**6]["fingerprint"]
    plain = [got[3 * k] for k in range(60)]
    assert np.mean([r["near_edited"] > r["near_next"] for r in plain]) > 0.8
    assert fingerprints.compare(documents([])).count() == 0
    (one,) = fingerprints.compare(documents([(5, "abc def")])).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abc abc").hexdigest() and one["near_next"] == 1


def test_lexicon_is_the_band(documents, prose):
    texts = prose(300, 40)
    counts = Counter(w for t in texts for w in set(t.split()))
    band = fingerprints.lexicon(documents(list(enumerate(texts))), (2.5, 4.0))
    assert len(band) == sum(300 * np.exp(-4.0) <= n <= 300 * np.exp(-2.5) for n in counts.values())


def test_a_large_lexicon_is_thinned_by_hash(documents, prose, monkeypatch):
    docs = documents([(k, t) for k, t in enumerate(prose(300, 40) * 2)])
    whole = fingerprints.lexicon(docs, (1.0, 6.0))
    some = fingerprints.lexicon(docs, (1.0, 6.0), 100)
    assert len(whole) > 300 and 60 < len(some) < 140 and set(some.tolist()) < set(whole.tolist())
    assert (fingerprints.lexicon(docs, (1.0, 6.0), 100) == some).all()
    found = {r["doc_id"]: r["fingerprint"] for r in fingerprints.edited(docs, some).collect()}
    assert len(found) == 600 and all(found[k] == found[k + 300] for k in range(300))


def test_a_joined_lexicon_gives_what_a_broadcast_one_gives(documents, prose, odd):
    texts = prose(200, 60) + odd + prose(60, 3, 5) + ["", "zzz", "ab cd"]
    rows = [(3 * k, t) for k, t in enumerate(texts)] + [(10**6, texts[0]), (10**6, texts[0]), (None, "first of all"), (9, texts[1])]
    for some in (rows, rows[:1], [(1, None), (2, "")], []):
        docs = documents(some)
        broadcast = sorted(map(tuple, fingerprints.compare(docs).collect()), key=repr)
        joined = sorted(map(tuple, fingerprints.compare(docs, -1).collect()), key=repr)
        assert len(joined) == len(some) and joined == broadcast
    found = fingerprints.compare(documents(rows), -1)
    assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert found.where("fingerprint not like '=%'").count() > 200


def test_the_lexicon_is_whole_beyond_the_bound_of_its_broadcast(spark):
    from pyspark.sql import functions as F
    import pyarrow as pa

    # Eight documents of 600,000 terms of their own, 4.8 million in the band.
    words = F.transform(F.sequence(F.lit(0), F.lit(599_999)), lambda x: F.lower(F.hex(x + F.col("id") * 600_000)))
    docs = spark.range(0, 8, 1, 4).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    band = fingerprints.lexicon(docs)
    assert len(band) == 4_800_000 > fingerprints.MOST_TERMS
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    found = [r["fingerprint"] for r in fingerprints.compare(docs).orderBy("doc_id").collect()]
    assert found == fingerprints.fingerprints(pa.array(texts), band)


def plain_fingerprint(text, terms_in_band):
    """Parts by a plain loop over the text's terms; hashes are those of the module."""
    from voicegrid.llm.text import words_of, ALNUM, mix, seeded
    import pyarrow as pa

    (hashes,) = words_of(pa.array([text]), True, ALNUM).hashes()
    mine = sorted({int(h) for h in hashes} & terms_in_band)
    if not mine:
        return "=" + hashlib.md5(text.encode()).hexdigest()
    level, parts = len(mine).bit_length() - 1, []
    for j in range(fingerprints.LEVELS):
        for s in range(fingerprints.SUBSETS):
            total, some = 0, False
            for h in mine:
                draw = int(seeded(np.array([h], np.uint64), 100 + s)[0])
                if draw >> (64 - level - j) == 0 if level + j else True:
                    total = (total + int(mix(np.array([(h + s) % 2**64], np.uint64))[0])) % 2**64
                    some = True
            parts.append(max(int(mix(np.array([total], np.uint64))[0]) >> 48, 1) if some else 0)
    return f"{level:02d}:" + "".join(f"{p:04x}" for p in parts)


def test_fingerprints_equal_a_plain_loop(prose, odd):
    import pyarrow as pa

    texts = prose(30, 60) + prose(10, 5, 3) + prose(10, 2, 4) + [t for t in odd if t and len(t) < 1000] + ["", "zzz"]
    terms, _, _ = fingerprints.distinct_terms(pa.array(texts))
    band = np.unique(terms)[::2]
    found, known = fingerprints.fingerprints(pa.array(texts), band), set(map(int, band))
    assert found == [plain_fingerprint(t, known) for t in texts]

    def plain_likeness(a, b):
        if a == b:
            return 1.0
        if "=" in a[0] + b[0]:
            return 0.0
        split = lambda f: {(int(f[:2]) + k // 16, k % 16): f[3 + 4 * k : 7 + 4 * k] for k in range(48)}
        x, y = split(a), split(b)
        pairs = [(x[k], y[k]) for k in x.keys() & y.keys() if x[k] != "0000" or y[k] != "0000"]
        return sum(p == q for p, q in pairs) / len(pairs) if pairs else 0.0

    for a in found[:20]:
        for b in found[10:50]:
            assert fingerprints.likeness(a, b) == plain_likeness(a, b)
    assert fingerprints.likeness(found[-1], found[-2]) == 0.0


# BPE


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def test_ids_and_texts_are_the_librarys(spark, documents, prose, odd):
    rng = random.Random(5)
    long = prose(3, 4000)
    texts = long + [long[0][:9000] + " changed " + long[0][9000:], long[1] + long[2]] + odd
    texts += ["a<|endoftext|>b <|endoftext|> c<|end", "it's  \n x  y don't'll" * 90, "é" * 6000, " " * 5000, "<|endoftext|> " * 300, "x\x1c y \x85 z \u2003w" * 200, "\r\n\r\n a\n b \n\n" * 200]
    texts += ["".join(rng.choice("ab  \n\t'é😀1.<|>") for _ in range(3000)) for _ in range(8)]
    got = {r["doc_id"]: r for r in bpe.encode_and_decode(documents([(k, t) for k, t in enumerate(texts)] + [(None, "x"), (0, texts[0])]), outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()}
    plain = library()
    for k, t in enumerate(texts):
        ids = plain.encode(t or "", add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids) and got[k]["ids"] == ",".join(map(str, ids)), k
        assert got[k]["decoded"] == plain.decode(ids, skip_special_tokens=False)
        assert got[k]["ids_sha256"] == hashlib.sha256(got[k]["ids"].encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(got[k]["decoded"].encode()).hexdigest()
    assert bpe.encode_and_decode(documents([])).count() == 0


def test_copies_share_chunks_and_stores_stay_small(prose, monkeypatch):
    from voicegrid.llm.text import text_bytes
    import pyarrow as pa

    (a,) = prose(1, 3000)
    texts = [a, "another beginning " + a[500:]]
    data, offsets = text_bytes(pa.array(texts))
    begins = bpe.cuts(data, offsets)
    chunks = [set(), set()]
    for s, e in zip(begins, [*begins[1:], len(data)]):
        chunks[int(s >= offsets[1])].add(data[s:e].tobytes())
    assert len(chunks[0] & chunks[1]) >= len(chunks[0]) - 3 > 3
    monkeypatch.setattr(bpe, "KEPT_PIECES", 2000)
    monkeypatch.setattr(bpe, "KEPT_CHUNKS", 3000)
    encoder, plain = bpe.Encoder(bpe.default_vocabulary()), library()
    for t in prose(40, 400, 9):
        ((ids, text),) = encoder.documents([[t[:777], t[777:]]])
        assert ids == ",".join(map(str, plain.encode(t, add_special_tokens=False).ids)) and text == t
        assert encoder.pieces.held <= 2000 + len(t) and encoder.chunks.held <= 3000 + len(t)


def test_joins_are_repaired_for_any_vocabulary(documents, prose):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(3)
    letters = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(9000))
    marked = "".join(rng.choice(["日本", "語の", "テキスト", "。", "、", "x1", "'s ", "\u0301"]) for _ in range(4000))
    coded = "".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(9000))
    texts = [letters, letters[3000:] + "x", marked, "y" + marked, coded, "Hello  World it's " * 900, "<|endoftext|>" * 300, coded[:4000] + "<|endoftext|>" + letters, "é" * 5000, "", None]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        vocabulary = public_tokenizers.path(name)
        plain = Tokenizer.from_file(vocabulary)
        for r in bpe.encode_and_decode(documents(list(enumerate(texts))), vocabulary).collect():
            ids = plain.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
            assert r["ids"] == ",".join(map(str, ids)) and r["decoded"] == plain.decode(ids, skip_special_tokens=False)
    encoder, calls = bpe.Encoder(vocabulary), []
    encoder._encoded, real = (lambda text, base=0: (calls.append(len(text)), real(text, base))[1]), encoder._encoded
    chunks = [marked[k : k + 500] for k in range(0, len(marked), 500)]
    assert encoder.repaired(chunks) == plain.encode(marked, add_special_tokens=False).ids
    assert sum(calls) < len(marked) / 2  # joins only; the chunks were encoded once, and not again for another text
    before = encoder.split.held
    encoder.repaired(chunks[::-1])
    assert encoder.split.held == before


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    from test_neardup import jaccard, multiset
    from test_spans import plain_pii

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES][1] == "MinHash near-dedup"
    before = rows
    before_texts = {}
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if number < 4:
            assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        after = [(r["doc_id"], r["text"]) for r in docs.collect()] if number < 4 else []
        if number == 0:
            kept = {d for d, _ in after}
            assert np.mean([(d in kept) == bool(q) for d, q in labels.items()]) > 0.95
        elif number == 1:
            sets = {d: multiset(t) for d, t in after}
            assert len(after) == len(sets)
            by = {}
            for d, s in sets.items():
                for x in s:
                    by.setdefault(x, []).append(d)
            near = {(a, b) for m in by.values() if len(m) < 50 for a in m for b in m if a < b}
            assert not any(jaccard(sets[a], sets[b]) >= 0.8 for a, b in near)
            for d, t in before.items():  # whatever went has a near relative of a smaller id that stayed or went itself
                if d not in sets:
                    assert any(e < d and jaccard(multiset(t), multiset(before[e])) >= 0.7 for e in before)
        elif number == 2:
            assert len(after) == len(before)
            assert not any(plain_pii(t) for _, t in after)
            assert sum(t != before[d] for d, t in after) <= 1.05 * sum(bool(plain_pii(t)) for t in before.values()) + 3
        elif number == 3:
            words = {d: 0 for d, _ in after}
            for d, t in after:
                words[d] += len(t.split())
            assert abs(sum(words.values()) - 1.5 * sum(len(t.split()) for t in before.values())) < 60
        else:
            plain, expected = library(), Counter()
            for d, texts in before_texts.items():  # every row of the stage before, those that repeat a doc_id too
                for t in texts:
                    ids = plain.encode(t or "", add_special_tokens=False).ids
                    expected[d, len(ids), ",".join(map(str, ids)), hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
            assert max(map(len, before_texts.values())) > 1
            assert Counter((r["doc_id"], r["n_tokens"], r["ids"], r["decoded_sha256"]) for r in docs.collect()) == expected
        before_texts = {}
        for d, t in after:
            before_texts.setdefault(d, []).append(t)
        before = dict(after)


def test_pipeline_leaves_one_table(spark):
    import corpus_pipeline
    from voicegrid.session import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, SF)
    left = [x for x in os.listdir(folder) if x not in before]
    assert len(left) == 1 and left[0].startswith("stage-4-") and out.count() > 100


STRANGE = ("__quality", "__vid", "a.b", "a`b", "x0", "Score", "hash")


def test_pipeline_with_strange_rows_and_columns(spark, prose, odd, tmp_path):
    import corpus_pipeline

    good = prose(40, 120)
    texts = good + odd + [good[0], good[0], "x0 mail me@x.yz " + good[1]]
    rows = [(k if k != 45 else None, t, "en", "ab"[k % 2] if k % 7 else None, len(t) if t is not None else None, *(f"{c}-{k}" for c in STRANGE)) for k, t in enumerate(texts)] + [(0, good[0], "en", "b", 1, *(f"{c}-0" for c in STRANGE))] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long, `__quality` string, `__vid` string, `a.b` string, `a``b` string, x0 string, Score string, hash string"
    for name, table in (("full", rows), ("empty", [])):
        folder = tmp_path / name
        spark.createDataFrame(table, schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(k, int(k % 9 > 0), 0) for k in range(40 if table else 0)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        columns, marks = docs.columns, {r["doc_id"]: tuple(r)[5:] for r in docs.collect()}
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            docs = stage(spark, docs, str(folder))
            assert docs.columns == columns
            out = docs.collect()
            docs = spark.createDataFrame(out, docs.schema)
            assert all(tuple(r)[5:] == marks[r["doc_id"]] for r in out if r["doc_id"] not in (None, 0))
            if number == 1:
                assert len({r["doc_id"] for r in out}) == len(out)
            if number == 2:
                assert not any("me@x.yz" in (r["text"] or "") for r in out)
        got = corpus_pipeline.STAGES[-1][1](spark, docs, str(folder)).collect()
        assert len(got) == len(out) and (not table or len(got) > 20)


def test_a_table_of_equal_rows(documents):
    """Rows that repeat are counted before anything is dealt by their key."""
    docs = documents([(None, "one and the same text", "a")] * 20_000 + [(1, "another text altogether", "b")])
    from voicegrid.llm import neardup

    taken = mixing.mix(docs).collect()
    assert len(taken) == 20_001 and len({r["taken"] for r in taken if r["doc_id"] is None}) == 1
    assert neardup.near_duplicates(docs).groupBy("class_id").count().collect()[0]["count"] in (1, 20_000)
    assert neardup.keep_one(docs).count() == 2
