"""Encoders that are fitted on a table: distinct ranks, top-k with the rest merged, medians, quantiles, binarisers.

Fits are aggregates whose results are a few numbers or a domain; applying them is an expression or a join.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.functions.encode import passed
from kinweave.functions.noise import bits
from kinweave.operators.views import closure, dense_keys, ranked, running
from kinweave.schema import Schema
from kinweave.scratch import cut


def sorted_ranks(df: DataFrame, value: str, code: str) -> DataFrame:
    """value, code: the place of each distinct non-null value in sorted order."""
    found = df.select(value).filter(F.col(value).isNotNull()).distinct()
    return ranked(found, [], [value], code).withColumn(code, F.col(code).cast("int"))


def encode_sorted(df: DataFrame, value: str, code: str) -> DataFrame:
    """df with the rank of its value among the distinct ones; nulls get the number of distinct values."""
    ranks = sorted_ranks(df, value, code).withColumnRenamed(value, "__v")
    n = ranks.agg(F.count(F.lit(1)).cast("int").alias("__n"))
    out = df.join(ranks, df[value] == ranks["__v"], "left").join(n, F.lit(True))
    return out.withColumn(code, F.coalesce(code, "__n")).drop("__v", "__n")


def top_values(df: DataFrame, value: str, k: int, by: str = "count") -> DataFrame:
    """value, code, n: the k - 1 most frequent values get codes 0 to k - 2, the others k - 1.

    Ties go to the smaller value. If no more than k values occur, each has its own code: in order of frequency
    (`by` = count) or of the values (`by` = value). Nulls are no value and belong to the others.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    # Only the k most frequent values are put in order, and one more tells whether there are others.
    head = counts.orderBy(F.desc("n"), value).limit(k + 1)
    places = Window.partitionBy(F.lit(0))
    head = head.select(
        F.col(value).alias("__v"),
        (F.row_number().over(places.orderBy(F.desc("n"), value)) - 1).alias("r"),
        (F.row_number().over(places.orderBy(value)) - 1).alias("place"),
        F.count(F.lit(1)).over(places).alias("all"),
    )
    few = F.col("r") if by == "count" else F.col("place")
    code = F.when(F.col("all") <= k, few).otherwise(F.least(F.col("r"), F.lit(k - 1)))
    head = head.select("__v", F.coalesce(code, F.lit(k - 1)).cast("int").alias("code"))
    # At most k + 1 rows go to every task.
    found = counts.join(F.broadcast(head), counts[value] == head["__v"], "left")
    return found.select(value, F.coalesce("code", F.lit(k - 1)).alias("code"), "n")


def encode_top(df: DataFrame, value: str, code: str, k: int, by: str = "count") -> DataFrame:
    codes = top_values(df, value, k, by).select(F.col(value).alias("__v"), F.col("code").alias(code))
    out = df.join(codes, df[value] == codes["__v"], "left").drop("__v")
    return out.withColumn(code, F.coalesce(code, F.lit(k - 1)))


def median_split(df: DataFrame, value: str, code: str) -> DataFrame:
    """1 where the value exceeds the exact median, else 0; nulls are 0."""
    cut_at = next(iter(quantile_cuts(df, value, [0.5])), None)
    above = F.lit(False) if cut_at is None else F.coalesce(F.col(value) > F.lit(float(cut_at)), F.lit(False))
    return df.withColumn(code, above.cast("int"))


def quantile_cuts(df: DataFrame, value: str, shares: Sequence[float]) -> list[float]:
    """Exact quantiles with linear interpolation; none for a column without values.

    Equal values are counted first, and the distinct ones are put in order by ranges, so that no task holds all of
    them; what comes to the driver are the two values around each quantile.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed = cut(running(counts, ["v"], "n", "before", "all"))
    n = placed.agg(F.max("all")).first()[0]
    if not n:
        return []
    at = [q * (n - 1) for q in shares]
    ranks = sorted({int(k) for x in at for k in (math.floor(x), math.ceil(x))})
    wanted = F.explode(F.filter(F.array(*map(F.lit, ranks)), lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n"))))
    found = {r["k"]: r["v"] for r in placed.select("v", wanted.alias("k")).collect()}
    low, high = ([found[int(f(x))] for x in at] for f in (math.floor, math.ceil))
    return [a + (b - a) * (x - math.floor(x)) for a, b, x in zip(low, high, at, strict=True)]


def quantile_bins(df: DataFrame, value: str, code: str, n: int, inclusive: bool = True) -> DataFrame:
    """The number of inner quantiles the value has reached (inclusive) or exceeded; nulls get n."""
    cuts = quantile_cuts(df, value, [k / n for k in range(1, n)])
    return df.withColumn(code, F.when(F.col(value).isNull(), F.lit(n)).otherwise(passed(F.col(value), cuts, inclusive)))


@dataclass(frozen=True)
class Binariser:
    """x > cut, or x in a set of codes; fitted on one table and applied to any."""

    cut: float | None = None
    codes: tuple[int, ...] = ()

    def __call__(self, x: Column) -> Column:
        if self.cut is not None:
            return (x > F.lit(self.cut)).cast("int")
        return (x.isin(*self.codes) if self.codes else F.lit(False)).cast("int")


def fit_binariser(df: DataFrame, attr: str, size: int, ordered: bool, band: float = 0.05) -> Binariser:
    """Two codes stay as they are; ordered domains split at the median; others by a set of codes of half the rows.

    The set takes codes from the most frequent on until its share is within `band` of a half, or would pass it.
    """
    if size <= 2:
        return Binariser(codes=(1,))
    if ordered:
        return Binariser(cut=float(df.agg(F.median(attr)).first()[0] or 0.0))
    counts = sorted(
        ((r["n"], r[attr]) for r in df.groupBy(attr).agg(F.count(F.lit(1)).alias("n")).collect()),
        key=lambda x: (-x[0], x[1]),
    )
    whole, held, chosen = sum(n for n, _ in counts), 0, []
    for n, code in counts:
        if chosen and held / whole >= 0.5 - band:
            break
        chosen.append(code)
        held += n
    return Binariser(codes=tuple(sorted(chosen)))


def rebalanced(df: DataFrame, bit: str, key: str, seed: int, lo: float = 0.35, hi: float = 0.65) -> DataFrame:
    """df with its bit flipped on floor(|1/2 - share| n) rows of the more frequent value if its share leaves [lo, hi].

    Rows are chosen by the least hash of their key; the cut-off is found from counts by hash range, and only the
    rows of one range are ranked.
    """
    n, ones = df.agg(F.count(F.lit(1)), F.sum(bit)).first()
    share = (ones or 0) / n if n else 0.5
    if lo <= share <= hi:
        return df
    flips, value = int(abs(0.5 - share) * n), int(share > hi)
    return df.withColumn("__h", bits(seed, "flip", F.col(key))).transform(
        lambda d: flip_least(d, bit, value, flips, "__h", key)
    ).drop("__h")


def flip_least(df: DataFrame, bit: str, value: int, flips: int, score: str, key: str, ranges: int = 4096) -> DataFrame:
    """df with the bit flipped on the `flips` rows of that value with the least scores (52-bit whole numbers)."""
    bucket = F.floor(F.col(score) / F.lit((1 << 52) // ranges))
    mine = df.filter(F.col(bit) == value).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    before, edge = 0, None
    for b, n in sorted(map(tuple, mine)):
        if before + n > flips:
            edge = b
            break
        before += n
    if edge is None:
        return df.withColumn(bit, F.when(F.col(bit) == value, 1 - F.col(bit)).otherwise(F.col(bit)).cast("int"))
    chosen = df.filter((F.col(bit) == value) & (bucket == edge)).select(key, score)
    chosen = ranked(chosen, [], [score, key], "r").filter(F.col("r") < flips - before).select(F.col(key).alias("__k"))
    out = df.join(chosen, df[key] == chosen["__k"], "left")
    hit = (F.col(bit) == value) & ((bucket < edge) | F.col("__k").isNotNull())
    return out.withColumn(bit, F.when(hit, 1 - F.col(bit)).otherwise(F.col(bit)).cast("int")).drop("__k")


#: Bits of a hash by whose values rows are counted at once, and rows whose whole hashes are counted on the driver.
STEP_BITS, LAST_ROWS = 12, 10_000


def _by_hash(df: DataFrame, score: Column, bits_left: int) -> list[tuple[int, int]]:
    """(value, rows) of the bits of the score above its `bits_left` lowest, in order."""
    counted = df.groupBy(F.shiftright(score, bits_left).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return sorted(map(tuple, counted.collect()))


def _least_hash(
    df: DataFrame, key: str, n: int, score: Column, counts: Sequence[tuple[int, int]]
) -> DataFrame:
    """The n rows of least score, then key, of df (all, if fewer); counts: `_by_hash` of its first STEP_BITS.

    Counts by ranges of the score lead to the score where the sample ends, so the sample is a filter of df and nothing
    is sorted. Only rows of that very score are ranked, if not all of them are taken.
    """
    if n <= 0:
        return df.limit(0)
    left, before, first = 52 - STEP_BITS, 0, 0
    while True:
        edge = None
        for b, m in counts:
            if before + m >= n:
                edge = (b, m)
                break
            before += m
        if edge is None:
            return df
        first = edge[0] << left
        if before + edge[1] == n or not left:
            break
        within = df.filter(score.between(first, first + (1 << left) - 1))
        left = 0 if edge[1] <= LAST_ROWS else max(0, left - STEP_BITS)
        counts = _by_hash(within, score, left)
    last = first + (1 << left) - 1
    if before + edge[1] == n:
        return df.filter(score <= last)
    equal = df.filter(score == last).withColumn("__at", F.monotonically_increasing_id())
    taken = ranked(equal, [], [key, "__at"], "__r").filter(F.col("__r") < n - before).drop("__r", "__at")
    return df.filter(score < last).unionByName(taken)


def sample_exact(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement (all, if fewer): those with the least hashes of their key."""
    score = bits(seed, "sample", F.col(key))
    return _least_hash(df, key, n, score, _by_hash(df, score, 52 - STEP_BITS))


def sample_capped(df: DataFrame, key: str, n: int, seed: int, grow, cap: int, tries: int = 3, slack: float = 0.97):
    """Sample n rows, let `grow` derive what belongs to them, and shrink n until that has at most `cap` rows.

    Returns (sample, what grow made); at most `tries` attempts, the last of which may exceed the cap.
    """
    return sample_counted(df, key, n, seed, grow, cap, tries, slack)[:2]


def sample_counted(df: DataFrame, key: str, n: int, seed: int, grow, cap: int, tries: int = 3, slack: float = 0.97):
    """`sample_capped`, with the number of rows that grow made as a third result."""
    score = bits(seed, "sample", F.col(key))
    counts = _by_hash(df, score, 52 - STEP_BITS)
    for left in reversed(range(tries)):
        rows = _least_hash(df, key, n, score, counts)
        grown = grow(rows)
        total = grown.count()
        if total <= cap or not left:
            break
        n = max(1, int(n * cap / total * slack))
    return rows, grown, total


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """The rows whose key's hash falls into the share: one scan, no shuffle, about fraction of the rows."""
    return df.filter(bits(seed, "share", F.col(key)) < F.lit(int(fraction * (1 << 52))))


def gather_ratio(df: DataFrame, condition: Column, given: Column) -> DataFrame:
    """One row: the share of rows that satisfy `condition` among those that satisfy `given`."""
    return df.filter(given).agg(F.avg(condition.cast("int")).alias("share"), F.count(F.lit(1)).alias("n"))


def crosstab_shares(df: DataFrame, row: str, col: str) -> DataFrame:
    """row, col, share: P(col | row)."""
    counts = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(row))).drop("n")


def subset_by_root(
    schema: Schema, tables: Mapping[str, DataFrame], root: str, fraction: float, seed: int, redense: bool = False
) -> dict[str, DataFrame]:
    """A part of a database that is closed under its foreign keys: a share of a root, and what belongs to it.

    Children whose parents went go, and other roots keep the rows that children still point to. With `redense`,
    every role's keys, which must be unique then, are numbered anew from 0 in their old order, and the keys that
    point to them follow.
    """
    kept = sample_fraction(tables[root], schema.roles[root].key, fraction, seed)
    out = closure(schema, tables, {root: kept})
    for name, role in schema.roles.items():
        pointing = [(c, r.parents[name]) for c, r in schema.roles.items() if name in r.parents]
        if not role.parents and name != root and pointing:
            used = reduce(DataFrame.union, (out[c].select(F.col(fk).alias("__fk")) for c, fk in pointing))
            out[name] = out[name].join(used, F.col(role.key) == F.col("__fk"), "left_semi")
    if redense:
        for name, role in schema.roles.items():
            ids = dense_keys(out[name].select(F.col(role.key).alias("__old")), ["__old"], "__new")
            out[name] = out[name].join(
                ids,
                F.col(role.key) == F.col("__old"),
            ).drop(role.key, "__old").withColumnRenamed("__new", role.key)
            for c, r in schema.roles.items():
                if name in r.parents:
                    fk = r.parents[name]
                    out[c] = out[c].join(
                        ids,
                        F.col(fk) == F.col("__old"),
                    ).drop(fk, "__old").withColumnRenamed("__new", fk)
    return out


def common_keys(frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """The keys that all frames have."""
    return reduce(DataFrame.intersect, (f.select(*key) for f in frames))
