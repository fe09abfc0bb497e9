"""Planting of known effects across joins, under exact one-hop counts, and the audit of what was planted.

Rows are chosen by hash ranks within classes; what the driver sees are the counts of 2 x 2 cells by class.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.encode import rule
from kinweave.functions.noise import bits, uniform
from kinweave.operators.calibrate import shuffled_rank


def planted_bit(key: str, rule_name: str, strength: float, u: Column, x1: Column, x2: Column, old: Column, seed: int) -> Column:
    """The rule's bit on a share of the rows, chosen by hash, and the old bit on the others."""
    chosen = bits(seed, "plant", F.col(key)) < F.lit(int(strength * (1 << 52)))
    return F.when(chosen, rule(rule_name, u, x1, x2)).otherwise(old).cast("int")


def with_class_counts(df: DataFrame, key: str, classes: list[str], new: str, old: str, seed: int) -> DataFrame:
    """df whose bit `new` has, within each class, as many ones as the bit `old`.

    Of the rows of a class that hold too much of a value, those of least hash flip. Classes may be as large as
    the table: ranks are taken in hash ranges.
    """
    counts = df.groupBy(*classes).agg(F.sum(new).alias("__a"), F.sum(old).alias("__b"))
    off = df.join(counts, classes).withColumn("__d", F.col("__a") - F.col("__b"))
    surplus = (F.col(new) == (F.col("__d") > 0).cast("int")) & (F.col("__d") != 0)
    ranked = shuffled_rank(off.withColumn("__c", surplus.cast("int")), key, seed, f"swap {new}", [*classes, "__c"])
    flip = (F.col("__c") == 1) & (F.col("__rank") < F.abs("__d"))
    return ranked.withColumn(
        new,
        F.when(flip, 1 - F.col(new)).otherwise(F.col(new)).cast("int"),
    ).drop("__a", "__b", "__d", "__c", "__rank")


def plant_chain(
    wide: DataFrame, key: str, old: str, u: str, x1: str, x2: str, middle: list[str], rule_name: str, strength: float, seed: int, out: str = "planted",
) -> DataFrame:
    """wide (leaf rows with bits of their top and middle) with a planted leaf bit.

    Within each class of the middle's attributes and of u, the planted bit has the count that the old one had, so
    every one-hop table of middle and leaf stays what it was.
    """
    bit = planted_bit(key, rule_name, strength, F.col(u), F.col(x1), F.col(x2), F.col(old), seed)
    return with_class_counts(wide.withColumn(out, bit), key, [*middle, u], out, old, seed)


def plant_star(
    wide: DataFrame, key: str, old: str, u: str, x1: str, x2: str, rule_name: str, strength: float, seed: int, out: str = "planted", rounds: int = 30,
) -> DataFrame:
    """wide (child rows with bits of both roots) with a planted bit that keeps its counts by x1 and by x2.

    The counts of ones in the four cells of (x1, x2) are brought to the closest whole numbers with the old row and
    column sums; then rows flip by hash rank, so that each cell holds its count.
    """
    bit = planted_bit(key, rule_name, strength, F.col(u), F.col(x1), F.col(x2), F.col(old), seed)
    df = wide.withColumn(out, bit)
    cells = {
        (r[0], r[1]): (r["n"], r["a"], r["b"])
        for r in df.groupBy(x1, x2).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(out).alias("a"),
            F.sum(old).alias("b"),
        ).collect()
    }
    goal = projected(
        {k: v[0] for k, v in cells.items()},
        {k: v[1] for k, v in cells.items()},
        {k: v[2] for k, v in cells.items()},
    )
    moves = F.create_map(*(F.lit(x) for k, v in cells.items() for x in (k[0] * 2 + k[1], v[1] - goal[k])))
    off = df.withColumn("__d", moves[F.col(x1) * 2 + F.col(x2)])
    surplus = (F.col(out) == (F.col("__d") > 0).cast("int")) & (F.col("__d") != 0)
    ranked = shuffled_rank(off.withColumn("__c", surplus.cast("int")), key, seed, f"cells {out}", [x1, x2, "__c"], sum(v[0] for v in cells.values()))
    flip = (F.col("__c") == 1) & (F.col("__rank") < F.abs("__d"))
    return ranked.withColumn(
        out,
        F.when(flip, 1 - F.col(out)).otherwise(F.col(out)).cast("int"),
    ).drop("__d", "__c", "__rank")


def projected(rows: dict[tuple[int, int], int], ones: dict[tuple[int, int], int], old: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """Counts of ones by cell with the old sums by row and column, as near to `ones` as whole numbers allow.

    The old counts with t moved along the one cycle of a 2 x 2 table are all tables with these sums; t is chosen
    nearest to what `ones` asks for, within 0 and the cells' numbers of rows. Tables that lack a cell stay old.
    """
    corners = {(0, 0): 1, (0, 1): -1, (1, 0): -1, (1, 1): 1}
    if set(rows) != set(corners):
        return dict(old)
    want = sum(s * (ones[k] - old[k]) for k, s in corners.items()) / 4
    lo = max(-old[k] if s > 0 else old[k] - rows[k] for k, s in corners.items())
    hi = min(rows[k] - old[k] if s > 0 else old[k] for k, s in corners.items())
    t = int(min(max(round(want), lo), hi))
    return {k: old[k] + s * t for k, s in corners.items()}


def calibrate(effect: Callable[[float, int], float], target: float, seeds: tuple[int, ...] = (1, 2), steps: int = 12) -> float:
    """The strength in [0, 1] at which the mean effect over seeds comes nearest to the target, by bisection."""
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        if sum(effect(mid, s) for s in seeds) / len(seeds) < target:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def audit(wide: DataFrame, old: str, new: str, by: list[str]) -> DataFrame:
    """by, n, ones_old, ones_new, changed: what planting did to each class."""
    return wide.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(old).alias("ones_old"), F.sum(new).alias("ones_new"),
        F.sum((F.col(old) != F.col(new)).cast("int")).alias("changed"),
    )


def segment_plant(customers: DataFrame, key: str, nation: str, segments: int, share: float, seed: int, out: str) -> DataFrame:
    """A segment that follows nation modulo `segments` on a share of the rows, and is drawn alike on the others."""
    follows = bits(seed, "segment", F.col(key)) < F.lit(int(share * (1 << 52)))
    free = F.floor(uniform(seed, "free", F.col(key)) * segments)
    return customers.withColumn(
        out,
        F.when(follows, F.pmod(F.col(nation), F.lit(segments))).otherwise(free).cast("int"),
    )
