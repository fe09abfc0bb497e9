"""Sizes of groups of children: counts by key, capped and binned histograms, percentile caps, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.functions.accountant import tau_of
from kinweave.functions.encode import size_bin


def group_sizes(child: DataFrame, fk: str) -> DataFrame:
    """fk and n of the groups that have rows."""
    return child.groupBy(fk).agg(F.count(F.lit(1)).alias("n"))


def all_sizes(parent: DataFrame, pk: str, child: DataFrame, fk: str, keep: Sequence[str] = ()) -> DataFrame:
    """pk, the kept columns and n of every parent, 0 for the childless; children without parent don't count."""
    sizes = group_sizes(child, fk).withColumnRenamed(fk, "__fk")
    out = parent.select(pk, *keep).join(sizes, F.col(pk) == F.col("__fk"), "left")
    return out.select(pk, *keep, F.coalesce("n", F.lit(0)).alias("n"))


def capped(n: Column, tau: int) -> Column:
    return F.least(n, F.lit(tau)).cast("int")


def tau(child: DataFrame, fk: str) -> int:
    """The cap by the 95th percentile of the sizes of groups with rows; 12 for an empty table."""
    p95 = group_sizes(child, fk).agg(F.percentile("n", F.lit(0.95))).first()[0]
    return tau_of(p95 or 0.0)


def size_histogram(
    parent: DataFrame, pk: str, child: DataFrame, fk: str, attr: str | None = None, tau: int | None = None,
    edges: Sequence[int] | None = None, zeros: bool = False,
) -> DataFrame:
    """(attr,) size, groups: how many parents have how many children, by a parent attribute if one is named.

    Sizes are capped at tau, or binned by edges. Childless parents count (as size 0) only with `zeros`.
    """
    keep = [attr] if attr else []
    rows = all_sizes(parent, pk, child, fk, keep)
    rows = rows if zeros else rows.filter("n > 0")
    size = F.col("n").cast("int")
    if tau is not None:
        size = capped(F.col("n"), tau)
    if edges is not None:
        size = F.when(F.col("n") == 0, F.lit(-1)).otherwise(size_bin(F.col("n"), edges)) if zeros else size_bin(F.col("n"), edges)
    return rows.groupBy(*keep, size.alias("size")).agg(F.count(F.lit(1)).alias("groups"))


def with_weights(child: DataFrame, fk: str, tau: int, weight: str = "w", per_row: bool = False) -> DataFrame:
    """child with weight 1 / min(size of its group, tau), or 1 with `per_row`.

    Sizes come from a combined count joined back by key, not from a window over whole groups, so a group of any
    size is never held together.
    """
    if per_row:
        return child.withColumn(weight, F.lit(1.0))
    sizes = group_sizes(child, fk).select(F.col(fk).alias("__fk"), (F.lit(1.0) / capped(F.col("n"), tau)).alias(weight))
    return child.join(sizes, F.col(fk) == F.col("__fk")).drop("__fk")


def truncated(child: DataFrame, fk: str, order: Sequence[str], tau: int) -> DataFrame:
    """The first tau rows of each group, in the given order.

    The rank limit is pushed below the shuffle, so a group of any size sends on no more than tau rows of a task.
    """
    own = Window.partitionBy(fk).orderBy(*order)
    return child.withColumn("__r", F.row_number().over(own)).filter(F.col("__r") <= tau).drop("__r")


def size_tv(real: DataFrame, synthetic: DataFrame, cap: int, size: str = "n") -> DataFrame:
    """Total variation of two tables of sizes, over bins 1 to cap and one beyond; one row, column tv."""

    def histogram(df: DataFrame, name: str) -> DataFrame:
        share = F.count(F.lit(1)).alias(name)
        return df.filter(F.col(size) > 0).groupBy(F.least(F.col(size), F.lit(cap + 1)).alias("b")).agg(share)

    both = histogram(real, "x").join(histogram(synthetic, "y"), "b", "full")
    sums = both.agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    both = both.join(sums, F.lit(True))
    gap = F.abs(F.coalesce("x", F.lit(0)) / F.col("sx") - F.coalesce("y", F.lit(0)) / F.col("sy"))
    return both.agg((F.lit(0.5) * F.sum(gap)).alias("tv"))


def merged_size_tv(real: DataFrame, synthetic: DataFrame, cap: int = 20, zero_bin: bool = True) -> DataFrame:
    """As size_tv, with sizes beyond cap counted as cap; zeros have a bin of their own, or else count as 1."""
    lo = 0 if zero_bin else 1

    def histogram(df: DataFrame, name: str) -> DataFrame:
        b = F.least(F.greatest(F.col("n"), F.lit(lo)), F.lit(cap)).alias("b")
        return df.groupBy(b).agg(F.count(F.lit(1)).alias(name))

    both = histogram(real, "x").join(histogram(synthetic, "y"), "b", "full")
    sums = both.agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    gap = F.abs(F.coalesce("x", F.lit(0)) / F.col("sx") - F.coalesce("y", F.lit(0)) / F.col("sy"))
    return both.join(sums, F.lit(True)).agg((F.lit(0.5) * F.sum(gap)).alias("tv"))


def gini(df: DataFrame, value: str = "n") -> DataFrame:
    """Gini coefficient of a column of counts; one row, column gini (null for no rows or a sum of 0).

    Equal values are ranked as one block, so only distinct values meet in the ordered sum.
    """
    blocks = df.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy(F.lit(0)).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("b", F.coalesce(F.sum("c").over(before), F.lit(0)))
    # Ranks of a block are b + 1 to b + c; their sum is c b + c (c + 1) / 2.
    ranks = F.col("c") * F.col("b") + F.col("c") * (F.col("c") + 1) / 2
    sums = blocks.agg(
        F.sum(F.col("v") * ranks).alias("iv"),
        F.sum(F.col("v") * F.col("c")).alias("s"),
        F.sum("c").alias("n"),
    )
    return sums.select(
        F.try_divide(2 * F.col("iv") - (F.col("n") + 1) * F.col("s"), F.col("n") * F.col("s")).alias("gini"),
    )
