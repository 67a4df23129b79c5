"""Audit of sources: how far each lies from the other sources and from all of its language, by term counts.

Terms are runs of letters, lower-cased (``terms``). Each language keeps the terms in at
least ``LEAST`` of its documents. A group (language, source) and a language give every
kept term a share of ``SCALE``, smoothed by ``SMOOTH`` occurrences; the divergence of two
shares p and q is floor((p - q)^2 / (p + q)). ``divergences`` returns, for each group,
its summed divergence to every other source of its language (part ``pair``) and the
``TOP`` terms that it has above its language's share, by divergence (part ``term``).
All of it is integer arithmetic, so results are exact and reruns agree.

How it runs: texts are counted where they lie, slice by slice, and a term's counts
are added up before they are shuffled. One exchange by (language, term) brings
the sources of a term together, which is a row a source, however frequent the
term. The counts that are left are dealt by hash of the term to matrices of about
``ROWS`` counts, and sources to blocks of about ``BLOCK``: a matrix holds some terms of a
language for two blocks. In it, sources are rows of a compressed sparse matrix, and
the divergences of one row to all others are one pass over their entries: terms that
both lack are told by their number alone. What matrices say of a pair is summed
up. So neither a frequent term, a large source nor a language of most documents
is one task, and nothing but counters reaches the driver.

A null text, language or source is the empty one. Rows that repeat are documents of
their own. Texts are counted whole, however long; equal divergences are ranked by the
UTF-8 of their items; an empty table gives an empty result; other columns
don't matter. A language without kept terms has pairs of value 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import materialize
from .terms import LETTERS, grouped, strings, tallied, terms_of
from .text import slices

#: Documents of a language that a kept term is in, at least; ranks of terms that are returned.
LEAST, TOP = 10, 10
SCALE, SMOOTH = 10**9, 2
#: Counts in a matrix and sources in a block, about.
ROWS, BLOCK = 200_000, 256
#: Bytes of text that are counted at once.
COUNTED = 4 << 20


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", COUNTED):
        words = terms_of(part.column("text"), LETTERS)
        if not len(words.start):
            continue
        term, first = grouped(words)
        lang, source = (pc.dictionary_encode(part.column(c)) for c in ("lang", "source"))
        place = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        in_row, n = tallied(words.row * len(first) + term)
        key = place[in_row // len(first)] * len(first) + in_row % len(first)
        order = np.argsort(key, kind="stable")
        kept, docs = tallied(key)
        total = np.add.reduceat(n[order], np.cumsum(docs) - docs)
        where, term = kept // len(first), kept % len(first)
        columns = [lang.dictionary.take(pa.array(where // len(source.dictionary))), source.dictionary.take(pa.array(where % len(source.dictionary)))]
        yield pa.RecordBatch.from_arrays([*columns, strings(words, first[term]), pa.array(total), pa.array(docs.astype(np.int64))], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs of ``docs`` (lang, source, text)."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term, n of the terms in ``least`` documents of their language, with their occurrences in it (every) and ``first``, 1 in one row a term."""
    alike = Window.partitionBy("lang", "term")
    summed = counts.select("lang", "source", "term", "n", F.sum("n").over(alike).alias("every"), F.sum("docs").over(alike).alias("docs"), F.row_number().over(alike.orderBy("source")).alias("at"))
    return summed.where(F.col("docs") >= least).select("lang", "source", "term", "n", "every", (F.col("at") == 1).cast("int").alias("first"))


def shares(n: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)), digits by threes so that nothing overflows."""
    whole = np.asarray(total, np.int64) + SMOOTH * terms
    rest = np.asarray(n, np.int64) + SMOOTH
    out = rest // whole
    rest = rest % whole
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Matrix:
    """Counts of some terms of a language: sources as rows, of which each holds its terms only."""

    def __init__(self, source: np.ndarray, term: np.ndarray, n: np.ndarray, totals: np.ndarray, n_terms: int, kept: int):
        """source, term, n: the entries; totals: occurrences by source; n_terms: terms in here; kept: terms of the language."""
        order = np.lexsort((term, source))
        self.row, self.term, self.n = source[order], term[order], n[order]
        self.begin = np.searchsorted(self.row, np.arange(len(totals) + 1))
        self.n_terms = n_terms
        self.none = shares(np.zeros(len(totals), np.int64), totals, kept)  # the share of a term that the source lacks
        self.share = shares(self.n, totals[self.row], kept)

    def pairs(self, s: int, lo: int, hi: int) -> np.ndarray:
        """Divergences of row ``s`` to the rows from ``lo`` to ``hi``, summed over the terms in here."""
        mine = np.full(self.n_terms, self.none[s])
        mine[self.term[self.begin[s] : self.begin[s + 1]]] = self.share[self.begin[s] : self.begin[s + 1]]
        # As if the others had no terms: equal shares of mine count together.
        value, times = np.unique(mine, return_counts=True)
        out = np.array([(divergence(value, none) * times).sum() for none in self.none[lo:hi]], np.int64)
        # Then put right the terms that they have.
        a, b = self.begin[lo], self.begin[hi]
        p, size = mine[self.term[a:b]], np.diff(self.begin[lo : hi + 1])
        more = divergence(p, self.share[a:b]) - divergence(p, np.repeat(self.none[lo:hi], size))
        some = np.flatnonzero(size)
        if len(some):
            out[some] += np.add.reduceat(more, self.begin[lo:hi][some] - a)
        return out

    def above(self, s: int, every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term, divergence) of those of row ``s`` above ``every``, the language's shares by term; terms ascend."""
        mine = slice(self.begin[s], self.begin[s + 1])
        q = every[self.term[mine]]
        over = self.share[mine] > q
        return self.term[mine][over], divergence(self.share[mine][over], q[over])


_FOUND = "lang string, source string, part string, item string, value long, terms long, base long, kept long"


def _compared(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """One matrix: counts of terms (left) of all sources of two blocks (right)."""
    lang, _, a, b = (k.as_py() for k in key)
    right = right.sort_by([("block", "ascending"), ("source", "ascending")])
    names, kept = right.column("source").to_pylist(), right.column("kept")[0].as_py() if right.num_rows else 0
    totals = right.column("total").to_numpy()
    first = sum(x == a for x in right.column("block").to_pylist())
    number = {name: k for k, name in enumerate(names)}
    terms = left.column("term").combine_chunks().dictionary_encode()
    words = sorted(terms.dictionary.to_pylist(), key=str.encode)  # in the order that ties are ranked in
    place = {w: k for k, w in enumerate(words)}
    code = np.array([place[w] for w in terms.dictionary.to_pylist()], np.int64)[terms.indices.to_numpy()] if words else np.zeros(0, np.int64)
    source = np.fromiter((number[s] for s in left.column("source").to_pylist()), np.int64, left.num_rows)
    out: dict[str, list] = {c.split()[0]: [] for c in _FOUND.split(", ")}

    def put(source: str, part: str, item: str, value: int, terms: int = 0, base: int = 0, kept: int = 0) -> None:
        for name, x in zip(out, (lang, source, part, item, value, terms, base, kept), strict=True):
            out[name].append(x)

    if kept:
        matrix = Matrix(source, code, left.column("n").to_numpy(), totals, len(words), kept)
        every = np.zeros(len(words), np.int64)
        every[code] = left.column("every").to_numpy()
        every = shares(every, int(right.column("all")[0].as_py()), kept)
    for s in range(first):
        lo, hi = (s + 1, first) if a == b else (first, len(names))
        values = matrix.pairs(s, lo, hi) if kept else np.zeros(hi - lo, np.int64)
        for t, value in zip(range(lo, hi), values.tolist()):
            base = int(divergence(matrix.none[s], matrix.none[t])) if kept else 0
            put(names[s], "pair", names[t], value, len(words), base, kept)
            put(names[t], "pair", names[s], value, len(words), base, kept)
        if a == b and kept:
            found, value = matrix.above(s, every)
            for k in np.lexsort((found, -value))[:TOP]:
                put(names[s], "term", words[found[k]], int(value[k]))
    return pa.table({name: pa.array(x, pa.string() if name in ("lang", "source", "part", "item") else pa.int64()) for name, x in out.items()})


def divergences(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (text, lang, source), as the module says."""
    kept = materialize(kept_counts(term_counts(docs), least), "term-counts")
    every = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("kept"))
    groups = every.join(totals, ["lang", "source"], "left").na.fill(0, ["total", "kept"])
    alike = Window.partitionBy("lang")  # a row a source
    groups = groups.select("lang", "source", "total", F.sum("kept").over(alike).alias("kept"), F.sum("total").over(alike).alias("all"), F.count("*").over(alike).alias("sources"))
    groups = materialize(groups, "sources")
    counters = groups.agg(F.max("sources").alias("sources"), F.max("kept").alias("kept")).first()
    blocks = -(-(counters["sources"] or 1) // BLOCK)
    buckets = -(-max(1, kept.count()) // ROWS)
    whole = F.sequence(F.lit(0), F.lit(blocks - 1))
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")

    def dealt(rows: DataFrame) -> DataFrame:
        """Each row once for every block that its own meets."""
        rows = rows.withColumn("block", block).withColumn("other", F.explode(whole))
        return rows.withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other")).drop("other")

    left = dealt(kept.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))).groupBy("lang", "bucket", "a", "b")
    right = dealt(groups.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))).groupBy("lang", "bucket", "a", "b")
    found = left.cogroup(right).applyInArrow(_compared, _FOUND)
    # Terms that neither of a pair has in a matrix of its own are as far apart as their smoothed shares.
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"), F.max("base").alias("base"), F.max("kept").alias("kept"))
    summed = summed.select("lang", "source", "part", "item", (F.col("value") + (F.col("kept") - F.col("terms")) * F.col("base")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return summed.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = f"""WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS terms FROM documents),
words AS (SELECT r, lang, source, unnest(terms) AS term FROM docs),
keep AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST}),
v AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM keep GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN keep USING (lang, term) GROUP BY ALL),
every AS (SELECT g.lang, g.source, k.term, k.n AS m, coalesce(c.n, 0) AS n FROM groups g JOIN keep k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shared AS (SELECT lang, source, term, n, 1 + ({SCALE}::HUGEINT * (n + {SMOOTH})) // (sum(n) OVER (PARTITION BY lang, source) + {SMOOTH} * v) AS p, 1 + ({SCALE}::HUGEINT * (m + {SMOOTH})) // (total + {SMOOTH} * v) AS q FROM every JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM shared a JOIN shared b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
named AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
found AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM named LEFT JOIN pairs USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shared WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
