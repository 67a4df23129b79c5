"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

A document's size is its number of words. The sources, in code-point order with
null last, weigh 3, 1, 2, 3, 1, 2, ... and share ``BUDGET`` times all words.
A target stops at ``EPOCHS`` times its source's size; the excess is shared anew
by weight until no target is above. Running sums over the sources in the order of
cap by weight give the water level, the words for one unit of weight, in one pass.

A source's rate is its target by its size. Every document is taken whole
floor(rate) times. For the fraction left, a source's documents are dealt by a
seeded hash to groups of about ``GROUP``; a group takes its documents once more
in the order of their hashes until its share of words is full, so that one
document of a group is taken in part. Sums hence miss a target by half a word a
group, and a source with most of the rows is as many groups as it needs. What a
group takes is told by the hash of that one document and the words taken of it,
so the texts are never shuffled: they meet a table of one row a group.

Null and empty texts have size 0 and take 0; very long texts are counted whole. A null
source is a source. A null doc_id takes part. Rows with equal doc_id and text are
documents of their own, counted together before anything is dealt by their key; where a
group's share ends among such ties, they share what is left alike. An empty table gives
an empty result. Other columns don't matter to ``mix``; ``repeated`` keeps them, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import materialize, renamed

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
EPOCHS = 2
#: Documents in a group, about.
GROUP = 2048
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def _running(rows: DataFrame, order: list[Column], name: str, **summed: Column) -> DataFrame:
    """``rows`` with the sums of ``summed`` over all rows before; ranges are summed apart and shifted by the sums of those before."""
    dealt = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = dealt.groupBy("part").agg(*(F.sum(c).alias(k) for k, c in summed.items()))
    ranges = ranges.select("part", *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}_before") for k in summed))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(k) for k, c in summed.items())).join(ranges, "part")
    for k in summed:
        out = out.withColumn(k, F.col(k) + F.col(f"{k}_before")).drop(f"{k}_before")
    return out.drop("part")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """source, n, source_size, target of (source, n, size) rows, each of which stands for n documents.

    Sources reach their caps in the order of cap by weight. If all before one of them
    are full, the others share what is left by weight, which is a level; the first
    source that its level doesn't fill gives the final level.
    """
    sources = sizes.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    ranked = _running(sources, [F.col("source").asc_nulls_last()], "sources", rank=F.lit(1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = ranked.select("source", "n", "source_size", weight.alias("weight"), (F.col("source_size") * epochs).alias("cap"))
    order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    filled = materialize(_running(weighed, order, "weights", nth=F.lit(1), capped=F.col("cap"), gone=F.col("weight")), "filled")
    words, every = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(budget * (words or 0)) - F.col("capped")) / (F.lit(every or 0) - F.col("gone"))
    last = filled.select("nth", "cap", "weight", level.alias("level")).where("cap >= weight * level").agg(F.min_by("level", "nth")).first()[0]
    target = F.col("cap").cast("double") if last is None else F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(last))
    return filled.select("source", "n", "source_size", target.alias("target"))


def _key(seed: int) -> Column:
    """The seeded order of documents."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))


def _grouped(sizes: DataFrame, of: DataFrame) -> DataFrame:
    """Rows (source, __size, __key, ...) with what is known of their source, and their group in it."""
    known = of.select(F.col("source").alias("__of"), F.col("n").alias("__n"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    group = F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") % F.ceil(F.col("__n") / GROUP)
    joined = sizes.join(known, F.col("source").eqNullSafe(F.col("__of")))
    return joined.withColumn("__rate", rate).withColumn("__group", group)


def cuts(sizes: DataFrame, of: DataFrame) -> DataFrame:
    """(__in, __at, __cut, __left): for each source and group, the last key that takes words and the words that it takes.

    sizes: source, __key, __size, __alike, one row for all documents of a key.
    """
    rows = _grouped(sizes, of)
    mine = Window.partitionBy("source", "__group")
    words = F.col("__size") * F.col("__alike")
    before = F.coalesce(F.sum(words).over(mine.orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.floor((F.col("__rate") - F.floor("__rate")) * F.sum(words).over(mine) + 0.5)
    left = F.greatest(F.lit(0), F.least(F.col("__size"), F.floor((F.col("__share") - F.col("__before")) / F.col("__alike"))))
    rows = rows.withColumn("__before", before).withColumn("__share", share).withColumn("__left", left)
    last = rows.where("__left > 0").groupBy("source", "__group").agg(F.max("__key").alias("__cut"), F.max_by("__left", "__key").alias("__left"))
    return last.select(F.col("source").alias("__in"), F.col("__group").alias("__at"), "__cut", "__left")


def _taken(sizes: DataFrame, of: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows (source, __size, __key, ...) with __taken, __source_size and __target."""
    rows = _grouped(sizes, of).join(ends, F.col("source").eqNullSafe(F.col("__in")) & (F.col("__group") == F.col("__at")), "left")
    more = F.when(F.col("__key") < F.col("__cut"), F.col("__size")).when(F.col("__key") == F.col("__cut"), F.col("__left")).otherwise(F.lit(0))
    return rows.withColumn("__taken", (F.floor("__rate") * F.col("__size") + more).cast("long"))


def _planned(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes and keys of all documents, what is known of their sources, and where groups end.

    Rows alike are counted before anything is dealt by key, so a million of them are one.
    """
    sizes = materialize(docs.select("doc_id", "source", size_of().alias("__size"), _key(seed).alias("__key")), "sizes")
    counted = materialize(sizes.groupBy("source", "__key").agg(F.max("__size").alias("__size"), F.count("*").alias("__alike")), "counted")
    of = targets(counted.select("source", F.col("__alike").alias("n"), F.col("__size").alias("size")))
    return sizes, of, materialize(cuts(counted, of), "cuts")


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs`` (doc_id, text, source, ...)."""
    return _taken(*_planned(docs, seed)).select("doc_id", *(F.col(f"__{c}").alias(c) for c in ("size", "source_size", "target", "taken")))


def repeated(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mixed corpus: rows of ``docs`` as often as they are taken, whole, and a last time cut to the words left.

    Columns stay as they are but for a cut text, whose n_chars, if there is that
    column, follows. Rows that take nothing go.
    """
    plain = renamed(docs, "doc_id", "text", "source", "n_chars")
    _, of, ends = _planned(plain, seed)
    rows = _taken(plain.withColumn("__size", size_of()).withColumn("__key", _key(seed)), of, ends).where("__taken > 0")
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("__taken") / F.col("__size")).cast("int"))))
    left = F.col("__taken") - (F.col("__copy") - 1) * F.col("__size")
    new = {c: F.col(c) for c in plain.columns}
    new["text"] = F.when(left < F.col("__size"), first_words(F.col("text"), left)).otherwise(F.col("text"))
    if "n_chars" in new:
        new["n_chars"] = F.when(left < F.col("__size"), F.length(new["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.select(*(value.alias(c) for c, value in new.items())).toDF(*docs.columns)


def first_words(text: Column, n: Column) -> Column:
    """The first n words of a text, as they stand in it."""
    words = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    return F.array_join(F.slice(words, 1, n.cast("int")), "")


ORACLE_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('0|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS key
  FROM documents),
summed AS (SELECT source, count(*) AS n, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap
  FROM summed),
budget AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS words FROM summed),
level(k, high, low) AS (
  SELECT 0, (SELECT words FROM budget) / (SELECT sum(weight)::DOUBLE FROM weighed), 0::DOUBLE
  UNION ALL
  SELECT k + 1,
         ((SELECT words FROM budget) - (SELECT coalesce(sum(CASE WHEN cap < weight * high THEN cap END), 0)::DOUBLE FROM weighed))
           / (SELECT sum(CASE WHEN cap < weight * high THEN NULL ELSE weight END)::DOUBLE FROM weighed), high
  FROM level WHERE high > low AND k < 1000),
targets AS (SELECT *, least(cap::DOUBLE, weight * (SELECT max(high) FROM level)) AS target FROM weighed),
joined AS (
  SELECT s.*, n, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
dealt AS (SELECT *, ('0x' || substr(key, 1, 8))::BIGINT % ceil(n / 2048.0)::BIGINT AS grp FROM joined),
filled AS (
  SELECT *, count(*) OVER (PARTITION BY source, grp, key) AS alike,
         sum(size) OVER (PARTITION BY source, grp ORDER BY key RANGE UNBOUNDED PRECEDING) - size * alike AS before,
         floor((rate - floor(rate)) * (sum(size) OVER (PARTITION BY source, grp))::DOUBLE + 0.5) AS share
  FROM dealt)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (floor(rate) * size + greatest(0, least(size, floor((share - before) / alike))))::BIGINT AS taken
FROM filled
"""
