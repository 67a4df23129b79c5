"""Source divergence, ranked search and packing against plain loops and the library."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from voicegrid.llm import divergence, packing, search, terms
from voicegrid.llm.bpe import default_vocabulary

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS_DIGITS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text, pattern):
    return pattern.findall((text or "").translate(UPPER))


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_ranked_search"])
def test_equals_sql(compare, name):
    assert compare(name) == [0, 0]


# Terms


def test_terms_are_grouped_by_their_bytes(odd):
    texts = odd + ["Straße STRASSE straße x1 X2 Ünder ünder", "a" * 70_000 + " b a", "İ I i"]
    for keep, pattern in ((terms.LETTERS, LETTERS), (terms.LETTERS_DIGITS, LETTERS_DIGITS)):
        words = terms.terms_of(pa.array(texts), keep)
        for digest in (lambda b: len(b) % 3, __import__("xxhash").xxh3_64_intdigest):  # hashes that collide, too
            group, first = terms.grouped(words, digest)
            names = terms.strings(words, first).to_pylist()
            assert len(set(names)) == len(names)
            expected = [(k, t) for k, text in enumerate(texts) for t in plain_terms(text, pattern)]
            assert [(r, names[g]) for r, g in zip(words.row.tolist(), group.tolist())] == expected


# Divergence


def plain_divergences(rows, least=10, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    holding, counts = Counter(), defaultdict(Counter)
    for lang, source, text in rows:
        found = plain_terms(text, LETTERS)
        counts[lang, source].update(found)
        holding.update((lang, t) for t in set(found))
    out = []
    for lang in {r[0] for r in rows}:
        kept = [t for (x, t), n in holding.items() if x == lang and n >= least]
        sources = sorted({s for x, s in counts if x == lang})
        share = lambda n, total: 1 + 10**9 * (n + 2) // (total + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: {t: share(counts[lang, s][t], sum(counts[lang, s][u] for u in kept)) for t in kept} for s in sources}
        every = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        q = {t: share(every[t], sum(every.values())) for t in kept}
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(sorted(pair), 1)]
            term = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(sorted(term)[:top], 1)]
    return sorted(out)


def labelled(spark, rows):
    return spark.createDataFrame([(k, *r, 1, 2, "x") for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string, n int, block long, term string")


@pytest.mark.parametrize("rows_, block", [(200_000, 256), (40, 2)])  # one matrix, and many of few terms and sources
def test_divergences_equal_a_plain_loop(spark, odd, monkeypatch, rows_, block):
    monkeypatch.setattr(divergence, "ROWS", rows_)
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "COUNTED", 2000)
    rng = random.Random(3)
    words = ["Über", "über", "alpha", "BETA", "gamma", "δέλτα", "日本", "x", "y9z", "rare"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(rng.choice(["en", "de"]), rng.choice(["a", "b", "c", "é", None, "d"]), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(150)]
    rows += [(None, "only", "few words"), (None, None, None), ("fr", "s", ""), ("en", "hot", "alpha " * 5000)] + [("en", "hot", "alpha beta")] * 30
    rows += [("odd", rng.choice("pq"), t) for t in odd for _ in range(12)]
    got = sorted(tuple(r) for r in divergence.divergences(labelled(spark, rows)).collect())
    assert got == plain_divergences(rows)


def test_divergences_of_nothing(spark):
    assert divergence.divergences(labelled(spark, []).where("false")).count() == 0
    assert [tuple(r) for r in divergence.divergences(labelled(spark, [("en", "a", "b"), ("en", "c", None)])).sort("source").collect()] == [("en", "a", "pair", "c", 0, 1), ("en", "c", "pair", "a", 0, 1)]


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(300):
        total = rng.randrange(1, 10 ** rng.randint(1, 15))
        n, v = rng.randrange(0, total + 1), rng.randrange(1, 10**5)
        assert int(divergence.shares(np.array([n]), total, v)[0]) == 1 + 10**9 * (n + 2) // (total + 2 * v)


# Search


def plain_search(docs, items, top=10):
    found = [(d, Counter(plain_terms(t, LETTERS_DIGITS))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in found:
            m = 25 + 75 * sum(c.values()) * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in plain_terms(text, LETTERS_DIGITS) if c[t])
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(item, k, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("sort, block", [(1 << 21, 4 << 20), (50, 200)])
def test_search_equals_a_plain_loop(spark, documents, prose, odd, monkeypatch, sort, block):
    monkeypatch.setattr(search, "SORTED", sort)
    rng = random.Random(2)
    texts = prose(150, 60) + [t.upper() for t in prose(20, 60)] + odd
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, texts[5]), (5, texts[5]), (None, texts[3]), (None, texts[3])] + [(1000 + k, "same words here") for k in range(30)]
    items = [(k, " ".join(rng.sample(texts[k].split(), 12))) for k in range(40)] + [(7, "same words words"), (7, "same words words"), (8, None), (9, ""), (None, texts[3]), (10, "nowhere9"), (11, texts[0] + " Über日本 x1 ")]
    items = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, item long, score int")
    got = sorted((tuple(r) for r in search.search(documents(rows), items, block_bytes=block).collect()), key=str)
    assert got == plain_search(rows, [(r["item_id"], r["text"]) for r in items.collect()])


def test_search_of_nothing(spark, documents):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.search(documents([]), items).count() == 0
    assert search.search(documents([(1, "a")]), items.limit(0)).count() == 0
    assert search.search(documents([(1, None), (2, "")]), items).count() == 0


def test_radix_order_is_stable():
    rng = np.random.default_rng(0)
    for most in (1, 60_000, 1 << 20, 1 << 40):
        keys = rng.integers(0, most, 5000).astype(np.uint64)
        assert (search.radix_order(keys) == np.argsort(keys, kind="stable")).all()


def test_terms_with_equal_hashes_are_told_apart(monkeypatch):
    from voicegrid.llm.text import Words

    monkeypatch.setattr(Words, "hashes", lambda self, *p: [np.full(len(self.start), 7, np.uint64)])
    index = search.Index.of(["one two", "two three three"])
    row, term, times = index.postings(terms.terms_of(pa.array(["three two two four", "one"]), terms.LETTERS_DIGITS))
    assert sorted((r, index.names[t], n) for r, t, n in zip(row.tolist(), term.tolist(), times.tolist())) == [(0, "three", 1), (0, "two", 2), (1, "one", 1)]


# Packing


def best_fit(lengths, sequence):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - x)
        else:
            gaps.append(sequence - x)
    return len(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_plans_hold_all_and_waste_little(seed):
    rng = random.Random(seed)
    sequence = rng.choice([10, 64, 2048])
    draw = [lambda: rng.randint(1, sequence), lambda: max(1, min(sequence, int(rng.lognormvariate(math.log(sequence) / 2, 1)))), lambda: rng.randint(sequence // 3, sequence // 2 + 1)][seed % 3]
    lengths = [draw() for _ in range(rng.choice([1, 30, 600]))]
    plan = packing.plan(dict(Counter(lengths)), sequence)
    held = Counter()
    for filled, n in plan:
        assert n > 0 and sum(filled) <= sequence
        for x in filled:
            held[x] += n
    assert held == Counter(lengths)
    assert sum(n for _, n in plan) <= best_fit(lengths, sequence)


def test_complements_fill_gaps_exactly():
    lengths = packing.Lengths({3: 1, 4: 2, 5: 1, 9: 1}, 20)
    assert lengths.complement(9, 1) == (9,) and lengths.complement(8, 2) == (5, 3) and lengths.complement(11, 2) is None
    assert lengths.complement(12, 3) == (5, 4, 3) and lengths.complement(12, 2) == (9, 3) and lengths.complement(10, 2) is None
    assert lengths.take(4, (4,)) == 1 and lengths.left[4] == 0
    # Two, three and four pieces to a sequence, and as many at once as there are.
    assert packing.plan({2000: 10**12, 48: 10**12}) == [((2000, 48), 10**12)]
    assert sum(n for _, n in packing.plan({1000: 10**6, 600: 10**6, 448: 10**6})) == 10**6


def test_pieces_are_placed_once_without_gaps(spark, documents, prose, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_vocabulary())
    texts = prose(120, 300) + prose(3, 5000, 4) + odd + ["a<|endoftext|>b", "it's  x\n\n y " * 40]
    rows = [(k, t) for k, t in enumerate(texts)] + [(900, None), (901, None)]
    docs = documents(rows).repartition(5)
    got = packing.pack(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        mine, at = sorted(by_doc[d], key=lambda r: r["piece"]), 0
        assert [r["piece"] for r in mine] == list(range(-(-len(ids) // 2048)))
        for r in mine:
            assert r["start"] == at and (r["length"] == 2048 or r["piece"] == 0)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    lengths = [r["length"] for r in got]
    assert len(by_sequence) <= best_fit(lengths, 2048)
    assert packing.pack(documents([])).count() == 0


def test_pieces_without_a_doc_id_and_other_vocabularies(documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    name = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(name)
    text = "Hello  World it's " * 50
    got = packing.pack(documents([(None, text), (None, text), (1, "")]), name, sequence=64, end=9).collect()
    ids = [*library.encode(text, add_special_tokens=False).ids, 9]
    assert sum(r["length"] for r in got if r["doc_id"] is None) == 2 * len(ids)
    assert {r["ids_crc32"] for r in got if r["doc_id"] == 1} == {zlib.crc32(np.array([9], "<u4").tobytes())}
    first = ids[: len(ids) % 64 or 64]
    assert sum(r["ids_crc32"] == zlib.crc32(np.array(first, "<u4").tobytes()) for r in got) == 2


def test_ids_are_the_librarys(prose, odd, monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 2000)
    ids, rng = packing.Ids(default_vocabulary()), random.Random(8)
    assert ids.quick
    texts = prose(20, 400, 9) + [t or "" for t in odd] + ["", " ", "  ", " a", "a ", "a  b", "a \n b", "\n\na", "it's 1 ²³ ªº ÀÉ ǅ ɏ ɐ İ", "x<|endoftext|> y", "<|endof text|>", "\u0085 \u00a0a\u00a0 \x1c b"]
    texts += ["".join(rng.choice("ab  \n\t'é😀1.<|>ßɐ\u00a0\x1f") for _ in range(500)) for _ in range(40)]
    texts += ["".join(chr(rng.randrange(1, 0x250)) for _ in range(300)) for _ in range(60)]
    for t in texts:
        (found,) = ids.of([t])
        assert found == np.array(ids.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
        assert ids.held <= 2000 + 2 * len(t)
    assert ids.of(texts) == [ids.of([t])[0] for t in texts]


def test_other_orders_of_merges_are_left_to_the_library(tmp_path):
    import json

    spec = json.load(open(default_vocabulary(), encoding="utf-8"))
    merges = spec["model"]["merges"]
    merges[300], merges[301] = merges[301], merges[300]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    ids = packing.Ids(str(path))
    assert ids.safe and ids.quick is None
    assert ids.of(["the other order of merges"]) == [np.array(ids.library.encode("the other order of merges").ids, "<u4").tobytes()]
