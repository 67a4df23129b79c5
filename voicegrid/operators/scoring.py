"""Scores of triplets as labelled trials, and losses of triplets and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, norm, triplet_loss
from .sampling import ROLES


def with_embeddings(triplets: DataFrame, embeddings: DataFrame, norms: bool = True) -> DataFrame:
    """i with e_<role> and n_<role> of triplets, given as such or by ``sampling.roles``; embeddings: utt, embedding. Triplets without all three go.

    Roles are rows when they meet the embeddings, which hence are shuffled once, and
    columns again when a slot's three vectors come together. Several embeddings
    of an utterance, or several triplets of a slot i, aren't expected.
    """
    known = embeddings.where("embedding is not null").select("utt", "embedding", *([norm(F.col("embedding")).alias("norm")] if norms else []))
    rows = triplets if "role" in triplets.columns else triplets.select("i", F.posexplode(F.array(*ROLES)).alias("role", "utt"))
    roles = rows.select("i", "role", "utt").join(known, "utt")
    column = lambda c, k: F.first(F.when(F.col("role") == k, F.col(c)), ignorenulls=True)
    found = [column("embedding", k).alias(f"e_{role}") for k, role in enumerate(ROLES)] + [column("norm", k).alias(f"n_{role}") for k, role in enumerate(ROLES) if norms]
    return roles.groupBy("i").agg(F.bit_or(F.expr("1 << role")).alias("roles"), *found).where("roles = 7").drop("roles")


def trials(triplets: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(i, label, score): for each triplet a trial of the same and one of different speakers."""
    scored = with_embeddings(triplets, embeddings)
    same = cosine(F.col("e_anchor"), F.col("e_pos"), F.col("n_anchor"), F.col("n_pos"))
    other = cosine(F.col("e_anchor"), F.col("e_neg"), F.col("n_anchor"), F.col("n_neg"))
    both = F.explode(F.array(F.struct(F.lit(1).alias("label"), same.alias("score")), F.struct(F.lit(0).alias("label"), other.alias("score"))))
    return scored.select("i", both.alias("t")).select("i", "t.label", "t.score")


def triplet_losses(triplets: DataFrame, embeddings: DataFrame, alpha: float = 0.1) -> DataFrame:
    scored = with_embeddings(triplets, embeddings, norms=False)
    return scored.select("i", triplet_loss(F.col("e_anchor"), F.col("e_pos"), F.col("e_neg"), alpha).alias("loss"))


def batch_loss(outputs: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(loss, n): mean loss of model outputs (r, embedding) whose rows 3i, 3i+1, 3i+2 are a triplet; the rest of a division is left out."""
    roles = outputs.select(F.floor(F.col("r") / 3).alias("i"), (F.col("r") % 3).alias("role"), "embedding")
    whole = roles.groupBy("i").agg(*(F.max(F.when(F.col("role") == k, F.col("embedding"))).alias(f"e{k}") for k in range(3)), F.count("*").alias("n")).where("n = 3")
    return whole.agg(F.avg(triplet_loss(F.col("e0"), F.col("e1"), F.col("e2"), alpha)).alias("loss"), F.count("*").alias("n"))
