"""Numbering of rows in tasks of bounded size, however large a key or a table is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def before(rows: DataFrame, keys: tuple[str, ...], order: tuple[Column | str, ...], part: Column, totals: dict[str, str] | None = None, **summed: Column) -> DataFrame:
    """``rows`` with the sums of ``summed`` over the rows of the same keys before in that order, and ``totals`` (name: summed) over all of them.

    ``part`` never falls along the order. A key's rows are summed up part by part and
    shifted by the sums of its parts before, so a key with most of the rows is as
    many tasks as it has parts.
    """
    parted = rows.withColumn("__dealt", F.struct(*(F.col(k).alias(f"key{n}") for n, k in enumerate(keys)), part.alias("part")))
    # Structs compare equal where their nulls do, so the join finds rows dealt as the window needs them.
    parts = parted.groupBy("__dealt").agg(*(F.sum(c).alias(f"__before_{k}") for k, c in summed.items()))
    alike = Window.partitionBy(*(f"__dealt.key{n}" for n in range(len(keys))))
    earlier = alike.orderBy("__dealt.part").rowsBetween(Window.unboundedPreceding, -1)
    every = [F.sum(f"__before_{k}").over(alike).alias(name) for name, k in (totals or {}).items()]
    parts = parts.select("__dealt", *(F.coalesce(F.sum(f"__before_{k}").over(earlier), F.lit(0)).alias(f"__before_{k}") for k in summed), *every)
    within = Window.partitionBy("__dealt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parted.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(k) for k, c in summed.items())).join(parts, "__dealt")
    for k in summed:
        out = out.withColumn(k, F.col(k) + F.col(f"__before_{k}")).drop(f"__before_{k}")
    return out.drop("__dealt")


def numbered(rows: DataFrame, key: str, order: tuple[str, ...], part: Column, name: str, total: str | None = None) -> DataFrame:
    """``rows`` with ``name``, 0, 1, ... within each key in that order, and, if asked for, ``total``, how many rows the key has."""
    return before(rows, (key,), order, part, {total: name} if total else None, **{name: F.lit(1)})


#: Parts that ``hash_order`` deals rows to.
PARTS = 1 << 12


def hash_order(c: str) -> tuple[Column, Column]:
    """(part, order) of rows by the md5 of a column, so that any engine with md5 orders the same: parts ascend along the order."""
    return F.conv(F.substring(F.md5(F.col(c)), 1, 3), 16, 10).cast("int"), F.md5(F.col(c))


def running(rows: DataFrame, part: Column, order: tuple[Column | str, ...], **summed: Column) -> DataFrame:
    """``rows`` with the sums of ``summed`` over all rows before in that order.

    ``part``, which has ``PARTS`` values at most and never falls along the order, deals
    the rows; parts are summed up apart and shifted by the sums of the parts before, a
    table of a row a part. Nothing runs while the plan is made.
    """
    parted = rows.withColumn("__part", part)
    earlier = Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    parts = parted.groupBy(F.col("__part").alias("__of")).agg(*(F.sum(c).alias(k) for k, c in summed.items()))
    parts = parts.select("__of", *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"__before_{k}") for k in summed))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parted.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(k) for k, c in summed.items()))
    out = out.join(F.broadcast(parts), F.col("__part").eqNullSafe(F.col("__of")))  # PARTS rows at most
    for k in summed:
        out = out.withColumn(k, F.col(k) + F.col(f"__before_{k}")).drop(f"__before_{k}")
    return out.drop("__part", "__of")
