"""Seeded sampling of (anchor, positive, negative) triplets from a manifest.

Speakers, those with two utterances or more first, and the utterances of each are
numbered; a slot draws the numbers of both its speakers by md5, and its three
utterances are rows (i, role) that fetch what their numbers stand for by two
equi-joins. So the cost is linear in slots and in utterances, slots are independent,
reruns agree, and any engine with md5 draws the same. A slot's first speaker is one of those with two utterances at least, its
second any other: the distribution of drawing pairs of speakers until the first is
eligible. Anchor and positive differ in position; a repeated row may be both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.draws import uniform32
from ..session import stored

#: Rows of one key that are numbered together.
PART = 1 << 16


def slots(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"))


def numbered(manifest: DataFrame, part: Column | None = None) -> DataFrame:
    """``manifest`` (spk, utt, pos) with ``at``, 0, 1, ... within each speaker in the order of pos."""
    return numbers.numbered(manifest, "spk", ("pos", "utt"), F.floor(F.col("pos") / PART) if part is None else part, "at")


def _counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("spk").agg(F.count("*").alias("n"))


def speakers(manifest: DataFrame) -> DataFrame:
    """(spk, n, k): one row a speaker, numbered by md5 of the name, those with two utterances at least before the others."""
    part, order = numbers.hash_order("spk")
    single = F.when(F.col("n") >= 2, 0).otherwise(1)
    return numbers.running(_counts(manifest), single * numbers.PARTS + part, (single, order, "spk"), k=F.lit(1)).select("spk", "n", "k")


def eligible(manifest: DataFrame) -> DataFrame:
    """(spk, n) of the speakers with two utterances at least."""
    return _counts(manifest).where("n >= 2")


def renumbered(drawn: DataFrame) -> DataFrame:
    """Triplets with i 0, 1, ... in the order it had."""
    moved = numbers.numbered(drawn.withColumn("__all", F.lit(0)), "__all", ("i",), F.floor(F.col("i") / PART), "__i")
    return moved.select(F.col("__i").alias("i"), *(c for c in drawn.columns if c != "i"))


#: What the rows of a triplet are, by ``role``.
ROLES = ("anchor", "pos", "neg")


def roles(manifest: DataFrame, wanted: DataFrame, seed: str = "s") -> DataFrame:
    """(i, role, spk, utt): three rows for each slot i of ``wanted``; none if there aren't two speakers."""
    n_at_least_2 = F.count(F.when(F.col("n") >= 2, 1))
    sizes = _counts(manifest).agg(F.count("*").alias("s"), n_at_least_2.alias("m"))
    drawn = wanted.crossJoin(F.broadcast(sizes)).where("s >= 2 and m >= 1")  # one row
    drawn = drawn.withColumn("first", uniform32(f"{seed}p", "i") % F.col("m")).withColumn("other", uniform32(f"{seed}n", "i") % (F.col("s") - 1))
    second = F.col("other") + F.when(F.col("other") >= F.col("first"), 1).otherwise(0)
    rows = drawn.select("i", F.posexplode(F.array("first", "first", second)).alias("role", "k")).join(speakers(manifest), "k")
    anchor = uniform32(f"{seed}a", "i") % F.col("n")
    another = uniform32(f"{seed}b", "i") % F.greatest(F.col("n") - 1, F.lit(1))
    at = F.when(F.col("role") == 0, anchor).when(F.col("role") == 1, another + F.when(another >= anchor, 1).otherwise(0)).otherwise(uniform32(f"{seed}m", "i") % F.col("n"))
    return rows.select("i", "role", "spk", at.alias("at")).join(numbered(manifest).select("spk", "at", "utt"), ["spk", "at"]).select("i", "role", "spk", "utt")


def together(rows: DataFrame) -> DataFrame:
    """(i, pos_spk, neg_spk, anchor, pos, neg) of rows (i, role, spk, utt); slots without all three go, rows that repeat count once."""
    of = lambda c, k: F.first(F.when(F.col("role") == k, F.col(c)), ignorenulls=True)
    found = rows.groupBy("i").agg(of("spk", 1).alias("pos_spk"), of("spk", 2).alias("neg_spk"), *(of("utt", k).alias(r) for k, r in enumerate(ROLES)), F.bit_or(F.expr("1 << role")).alias("__roles"))
    return found.where("__roles = 7").drop("__roles")


def apart(drawn: DataFrame) -> DataFrame:
    """(i, role, spk, utt) of triplets."""
    row = lambda spk, utt: F.struct(F.col(spk).alias("spk"), F.col(utt).alias("utt"))
    return drawn.select("i", F.posexplode(F.array(row("pos_spk", "anchor"), row("pos_spk", "pos"), row("neg_spk", "neg"))).alias("role", "r")).select("i", "role", "r.spk", "r.utt")


def triplets(manifest: DataFrame, wanted: DataFrame, seed: str = "s") -> DataFrame:
    """(i, pos_spk, neg_spk, anchor, pos, neg) for each slot i of ``wanted``; none if there aren't two speakers. A slot that is named twice is one."""
    return together(roles(manifest, wanted, seed))


def accepted(drawn: DataFrame, lengths: DataFrame, least: int) -> DataFrame:
    """The triplets, given as such or by ``roles``, of which all three utterances have ``least`` frames; lengths: utt, frames.

    The whole triplet is rejected, so speakers with short utterances keep less
    than their share, as in drawing anew; filtering utterances first would not.
    """
    rows = drawn if "role" in drawn.columns else apart(drawn)
    return together(rows.join(lengths.where(F.col("frames") >= least).select("utt"), "utt", "left_semi"))


def accepted_triplets(manifest: DataFrame, lengths: DataFrame, least: int, wanted: int, seed: str = "s", oversample: int = 4, rounds: int = 6) -> DataFrame:
    """The first ``wanted`` slots whose triplets are accepted; draws twice as many slots at each of ``rounds`` tries, then fails."""
    n = wanted * oversample
    for _ in range(rounds):
        found = stored(accepted(roles(manifest, slots(manifest.sparkSession, n), seed), lengths, least).orderBy("i").limit(wanted), "triplets")
        if found.count() == wanted:
            return found
        n *= 2
    raise ValueError(f"under {wanted} of {n // 2} triplets have {least} frames in each utterance")
