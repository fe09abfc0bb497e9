"""Comparisons of a real and a synthetic database: effects, association and pair distances, retention, strata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def delta(df: DataFrame, bit: Column, by: Column) -> DataFrame:
    """One row, delta: mean of the bit where `by` is 1 less its mean where it is 0."""
    return df.agg((F.avg(F.when(by == 1, bit)) - F.avg(F.when(by == 0, bit))).alias("delta"))


def contrast(df: DataFrame, bit: Column, a: Column, b: Column) -> DataFrame:
    """One row, contrast: m(1,1) - m(1,0) - m(0,1) + m(0,0), m being cell means; null where a cell is empty."""
    mean = {(i, j): F.avg(F.when((a == i) & (b == j), bit)) for i in (0, 1) for j in (0, 1)}
    return df.agg((mean[1, 1] - mean[1, 0] - mean[0, 1] + mean[0, 0]).alias("contrast"))


def fidelity(df: DataFrame, bit: Column, expected: Column) -> DataFrame:
    """One row, phi: how often the bit is what the planted rule says."""
    return df.agg(F.avg((bit == expected).cast("int")).alias("phi"))


def association_tv(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row, tv: half the sum over x and y of |P(y | x) - P(y)|; pairs that don't occur count as well."""
    counts = df.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))
    xs = counts.groupBy(x).agg(F.sum("n").alias("nx"))
    ys = counts.groupBy(y).agg(F.sum("n").alias("ny"))
    total = counts.agg(F.sum("n").alias("nn"))
    # A pair that doesn't occur adds P(y); so the sum is that of pairs that do, and what they leave of each x.
    seen = counts.join(xs, x).join(ys, y).join(total, F.lit(True))
    p, q = F.col("n") / F.col("nx"), F.col("ny") / F.col("nn")
    gap = seen.agg(F.sum(F.abs(p - q)).alias("g"), F.sum(q).alias("covered"))
    k = xs.agg(F.count(F.lit(1)).alias("k"))
    return gap.join(k, F.lit(True)).select((0.5 * (F.col("g") + F.col("k") - F.col("covered"))).alias("tv"))


def association_to_mean(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row, tv: the mean over x of the total variation of P(y | x) to the unweighted mean of these rows."""
    counts = df.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select(x).distinct().join(counts.select(y).distinct(), F.lit(True))
    full = grid.join(counts, [x, y], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    p = full.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(x)))
    gap = p.withColumn("g", F.abs(F.col("p") - F.avg("p").over(Window.partitionBy(y))))
    return gap.groupBy(x).agg((0.5 * F.sum("g")).alias("t")).agg(F.avg("t").alias("tv"))


def pair_tv(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row, tv: total variation of the joint distributions of the columns."""
    columns = list(columns)
    a = real.groupBy(*columns).agg(F.count(F.lit(1)).alias("x"))
    b = synthetic.groupBy(*columns).agg(F.count(F.lit(1)).alias("y"))
    both = a.join(b, columns, "full")
    sums = both.agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    gap = F.abs(F.coalesce("x", F.lit(0)) / F.col("sx") - F.coalesce("y", F.lit(0)) / F.col("sy"))
    return both.join(sums, F.lit(True)).agg((0.5 * F.sum(gap)).alias("tv"))


def big_group_share_gap(sizes: DataFrame, by: str, big: int) -> DataFrame:
    """One row, gap: the range over `by` of the share of groups of at least `big` rows."""
    share = sizes.groupBy(by).agg(F.avg((F.col("n") >= big).cast("int")).alias("s"))
    return share.agg((F.max("s") - F.min("s")).alias("gap"))


def retention_error(df: DataFrame, real: str = "real", synthetic: str = "synthetic", out: str = "error") -> DataFrame:
    """|synthetic - real| / |real|; null where real is 0."""
    return df.withColumn(out, F.try_divide(F.abs(F.col(synthetic) - F.col(real)), F.abs(F.col(real))))


def reused(records: DataFrame, cell: Sequence[str], seed: str, value: str) -> DataFrame:
    """cell columns and reused: whether two or more seeds of a cell hold just the same values."""
    per_seed = records.groupBy(*cell, seed).agg(F.sort_array(F.collect_list(value)).alias("v"))
    return per_seed.groupBy(*cell).agg((F.count(F.lit(1)) > F.count_distinct("v")).alias("reused"))


def stratified(records: DataFrame, dataset: str, seed: str, cls: str, value: str) -> DataFrame:
    """cls, value: mean over keys, then median over seeds, then median over datasets."""
    keys = records.groupBy(cls, dataset, seed).agg(F.avg(value).alias("v"))
    seeds = keys.groupBy(cls, dataset).agg(F.median("v").alias("v"))
    return seeds.groupBy(cls).agg(F.median("v").alias(value))


def strength_range(records: DataFrame, cell: Sequence[str], value: str) -> DataFrame:
    return records.groupBy(*cell).agg(F.min(value).alias("lowest"), F.max(value).alias("highest"))


def preferred(records: DataFrame, key: Sequence[str], usable: Column, label: str, tie: Sequence[str] = ()) -> DataFrame:
    """One record for each key: usable ones before others, then by label, then by the tie columns."""
    own = Window.partitionBy(*key).orderBy(F.desc(usable.cast("int")), label, *tie)
    return records.withColumn("__r", F.row_number().over(own)).filter("__r = 1").drop("__r")


def replaced(base: DataFrame, other: DataFrame, key: Sequence[str]) -> DataFrame:
    """base with the rows whose key `other` has replaced by other's."""
    return base.join(other, list(key), "left_anti").unionByName(other)


def missing_cells(expected: DataFrame, found: DataFrame, key: Sequence[str]) -> DataFrame:
    """Expected keys that `found` lacks."""
    return expected.select(*key).join(found, list(key), "left_anti")


def usable_records(
    records: DataFrame, modes: Sequence[str], grid: Sequence[float], mode: str = "mode", value: str = "eps",
    needed: Sequence[str] = (), may_lack: str | None = None, out: str = "key_eps", tolerance: float = 1e-9,
) -> DataFrame:
    """Records of the modes whose value lies within the tolerance of a point of the grid, with that point as `out`.

    Records that lack a needed field go; those that lack `may_lack` stay and are marked in `degraded`.
    """
    point = F.coalesce(*(F.when(F.abs(F.col(value) - F.lit(float(g))) < tolerance, F.lit(float(g))) for g in reversed(list(grid))))
    kept = records.filter(F.col(mode).isin(*modes)).withColumn(out, point).filter(F.col(out).isNotNull())
    for c in needed:
        kept = kept.filter(F.col(c).isNotNull())
    return kept.withColumn("degraded", F.col(may_lack).isNull() if may_lack else F.lit(False))


def planted_stats(wide: DataFrame, pairs: Sequence[tuple[str, str]], sizes: DataFrame, by: str, big: int, measure: str) -> DataFrame:
    """stat, value: association distance of each pair, the range over `by` of the share of big groups, a mean."""
    out = sizes.sparkSession.createDataFrame([], "stat string, value double")
    for x, y in pairs:
        out = out.unionByName(association_tv(wide, x, y).select(F.lit(f"tv {x} {y}").alias("stat"), F.col("tv").alias("value")))
    out = out.unionByName(big_group_share_gap(sizes, by, big).select(F.lit("big groups").alias("stat"), F.col("gap").alias("value")))
    return out.unionByName(wide.agg(F.avg(measure).alias("value")).select(F.lit(f"mean {measure}").alias("stat"), "value"))


def ratios(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """stat, real, synthetic, ratio; null where the real value is 0."""
    both = real.withColumnRenamed("value", "real").join(synthetic.withColumnRenamed("value", "synthetic"), "stat")
    return both.withColumn("ratio", F.try_divide("synthetic", "real"))


def first_runtime(records: DataFrame, fields: Sequence[str], out: str = "runtime") -> DataFrame:
    """The first of the fields that is there and not null."""
    there = [c for c in fields if c in records.columns]
    return records.withColumn(out, F.coalesce(*there) if there else F.lit(None).cast("double"))
