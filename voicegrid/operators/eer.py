"""False-accept and false-reject rates, and the equal error rate, of labelled trials.

Thresholds go from ``start`` in steps that are added up one by one, below ``stop``
(so 0.1 gives eleven). A trial is accepted if its score is the threshold or more.
Scores are binned by the thresholds first, which leaves a row for each threshold
and label whatever the number of trials; running sums over these give all rates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def thresholds(step: float = 0.001, start: float = 0.0, stop: float = 1.0) -> list[float]:
    out, t = [], start
    while t < stop:
        out.append(t)
        t += step
    return out


def _grid(values: list[float]) -> Column:
    """The thresholds as one literal."""
    return F.expr(f"array({', '.join(f'{v!r}D' for v in values)})" if values else "cast(array() as array<double>)")


def counted(trials: DataFrame, step: float = 0.001, start: float = 0.0, stop: float = 1.0) -> DataFrame:
    """(k, neg, pos): trials of either label by the number k of thresholds that accept them.

    This is all that the rates have to know of the trials, a row a threshold, and counts
    of several runs or batches add up (``merged``), so trials are read once.
    """
    values = thresholds(step, start, stop)
    # The number of thresholds that accept a score: close by division, then put right by the thresholds around it.
    near = F.floor((F.col("score") - start) / step).cast("int")
    at = F.greatest(F.lit(-1), F.least(F.lit(len(values)), near))
    around = F.sequence(F.greatest(F.lit(0), at - 2), F.greatest(F.lit(0), F.least(F.lit(len(values) - 1), at + 2)))
    accepted = F.greatest(F.lit(0), at - 2) + F.size(F.filter(around, lambda k: F.get(_grid(values), k) <= F.col("score")))
    return trials.where(F.col("score").isNotNull()).select("label", accepted.alias("k")).groupBy("k").agg(
        F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("neg"), F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("pos")
    )


def merged(*counts: DataFrame) -> DataFrame:
    """The counts of all trials of several ``counted`` with the same thresholds."""
    every = counts[0]
    for other in counts[1:]:
        every = every.unionByName(other)
    return every.groupBy("k").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))


def appended(trials: DataFrame, path: str, step: float = 0.001, start: float = 0.0, stop: float = 1.0) -> DataFrame:
    """Add the counts of new trials to those stored at ``path``, if any, and return the counts of all so far; only the new trials are read."""
    counted(trials, step, start, stop).coalesce(1).write.mode("append").parquet(path)
    return merged(trials.sparkSession.read.parquet(path))


def far_frr(trials: DataFrame, step: float = 0.001, start: float = 0.0, stop: float = 1.0) -> DataFrame:
    """(threshold, false_accepts, false_rejects, far, frr); rates are null without trials of their label."""
    return rates(counted(trials, step, start, stop), step, start, stop)


def rates(counts: DataFrame, step: float = 0.001, start: float = 0.0, stop: float = 1.0) -> DataFrame:
    """The same of counts (k, neg, pos), a row each k."""
    # One row, of as many entries as there are thresholds, is all that is left of the trials.
    every = counts.agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("neg", "pos")))).alias("at"), *(F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}") for c in ("neg", "pos")))
    grid = every.select("*", F.posexplode(_grid(thresholds(step, start, stop))).alias("j", "threshold"))
    # A trial with k accepting thresholds is accepted at indexes 0 .. k - 1, so threshold j rejects those with k <= j.
    rejected = Window.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    here = F.try_element_at("at", F.col("j"))
    summed = grid.select("threshold", "n_neg", "n_pos", *(F.sum(F.coalesce(here[c], F.lit(0))).over(rejected).alias(f"{c}_below") for c in ("neg", "pos")))
    accepts = F.col("n_neg") - F.col("neg_below")
    return summed.select("threshold", accepts.alias("false_accepts"), F.col("pos_below").alias("false_rejects"), F.try_divide(accepts.cast("double"), "n_neg").alias("far"), F.try_divide(F.col("pos_below").cast("double"), "n_pos").alias("frr"))


def equal_error_rate(trials: DataFrame, step: float = 0.001, start: float = 0.0, stop: float = 1.0) -> DataFrame:
    """One row (eer, threshold): where the rates are nearest, the lowest threshold of ties; nulls if they nowhere come nearer than 1."""
    return nearest(far_frr(trials, step, start, stop))


def nearest(found: DataFrame) -> DataFrame:
    """The same of the rates of all thresholds."""
    gap = F.abs(F.col("far") - F.col("frr"))
    best = found.where("far is not null and frr is not null").where(gap < 1).agg(F.min_by(F.struct(((F.col("far") + F.col("frr")) / 2).alias("eer"), "threshold"), F.struct(gap, "threshold")).alias("b"))
    return best.select("b.eer", "b.threshold")


def equal_error_rate_of(labels: list[int], scores: list[float], spark: SparkSession, step: float = 0.001) -> tuple[float | None, float | None]:
    """Of two lists, which must be as long as one another and hold both labels."""
    if len(labels) != len(scores):
        raise ValueError("labels and scores differ in length")
    if len(set(labels)) < 2:
        raise ZeroDivisionError("trials of both labels are needed")
    rows = spark.createDataFrame([(int(a), float(b)) for a, b in zip(labels, scores, strict=True)], "label int, score double")
    r = equal_error_rate(rows, step).first()
    return r["eer"], r["threshold"]
