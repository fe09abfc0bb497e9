"""Integer calibration: largest remainders, quotas, proportional rescaling, repair of histograms, IPF and RAS.

What touches rows is a DataFrame; what touches released tables, whose size their domains bound, is plain Python.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.functions.noise import bits
from kinweave.operators.views import number_within, ranked


def largest_remainder(weights: Sequence[float], total: int) -> list[int]:
    """Whole numbers that add up to total, in proportion to the weights; ties of remainders go to earlier places.

    Weights that add up to 0 share alike.
    """
    w = np.maximum(np.asarray(weights, float), 0.0)
    if not len(w):
        return []
    w = np.full(len(w), 1 / len(w)) if w.sum() <= 0 else w / w.sum()
    exact = w * total
    out = np.floor(exact + 1e-9).astype(int)
    rest = int(total - out.sum())
    order = np.argsort(-(exact - out), kind="stable")
    for k in range(abs(rest)):
        out[order[k % len(w)]] += 1 if rest > 0 else -1
    return out.tolist()


def remainder_ranks(cells: DataFrame, group: Sequence[str], share: str, total: Column, key: Sequence[str], out: str = "quota") -> DataFrame:
    """Largest-remainder quotas of a table of cells, within groups: floor, then one more by falling remainder."""
    exact = F.col(share) * total
    rows = cells.withColumn("__floor", F.floor(exact)).withColumn(
        "__rest",
        exact - F.col("__floor"),
    ).withColumn("__total", total)
    own = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    rank = F.row_number().over(own.orderBy(F.desc("__rest"), *key))
    left = F.max("__total").over(own) - F.sum("__floor").over(own)
    rows = rows.withColumn("__r", rank).withColumn("__left", F.round(left).cast("long"))
    more = (F.col("__r") <= F.col("__left")).cast("long")
    return rows.withColumn(out, (F.col("__floor") + more).cast("long")).drop(
        "__floor",
        "__rest",
        "__total",
        "__r",
        "__left",
    )


def grown_at_cap(sizes: Sequence[int], target: int, hi: int, lo: int = 0) -> list[int]:
    """Sizes whose sum is raised to target by the groups at hi alone, alike, earlier ones first for the rest.

    A surplus, and sizes of which none is at hi, are scaled in proportion instead.
    """
    sizes = list(sizes)
    short = target - sum(sizes)
    at = [i for i, s in enumerate(sizes) if s >= hi]
    if short < 0 or short and not at:
        return rescaled(sizes, target, lo)
    for k, i in enumerate(at):
        sizes[i] += short // len(at) + (k < short % len(at))
    return sizes


def rescaled(sizes: Sequence[int], target: int, lo: int, hi: int | None = None) -> list[int]:
    """Sizes scaled in proportion above lo to add up to target, within [lo, hi], by largest remainders.

    A target that the limits can't meet gives all lo or all hi. Room left by hi is filled where there is some.
    """
    n = len(sizes)
    if not n:
        return []
    if target <= lo * n:
        return [lo] * n
    if hi is not None and target >= hi * n:
        return [hi] * n
    over = np.maximum(np.asarray(sizes, float) - lo, 0)
    top = np.inf if hi is None else float(hi - lo)
    share, spend = np.zeros(n), float(target - lo * n)
    free = np.ones(n, bool)
    # Proportional shares; what would pass the cap stays at it, and the rest is shared out anew among the others.
    while free.any() and spend > 0:
        weight = np.where(free, over if over[free].sum() > 0 else 1.0, 0.0)
        part = weight * (spend / weight.sum())
        full = free & (part >= top)
        if not full.any():
            share = np.where(free, part, share)
            break
        share[full] = top
        spend -= top * int(full.sum())
        free &= ~full
    out = np.floor(share + 1e-9).astype(int)
    rest = target - lo * n - int(out.sum())
    for i in np.argsort(-(share - out), kind="stable").tolist() * 2:
        if rest > 0 and out[i] < top:
            out[i] += 1
            rest -= 1
    return (out + lo).tolist()


def rescale_groups(sizes: DataFrame, group: Sequence[str], key: str, size: str, target: Column, lo: int, out: str) -> DataFrame:
    """Proportional rescaling of a column of sizes within groups, distributed: floors, then one more by remainder.

    Rows of a group are put in order of their remainders by ranges, so a group may be as large as the table.
    """
    over = F.greatest(F.col(size) - lo, F.lit(0))
    sums = sizes.groupBy(*group).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(over).alias("__whole"), F.first(target).alias("__goal")
    )
    rows = sizes.join(sums, list(group)) if group else sizes.join(sums, F.lit(True))
    spend = F.greatest(F.col("__goal") - F.col("__n") * lo, F.lit(0))
    share = F.when(F.col("__whole") > 0, over / F.col("__whole")).otherwise(F.lit(1.0) / F.col("__n"))
    rows = rows.withColumn("__s", spend).withColumn("__x", share * spend).drop("__n", "__whole", "__goal")
    rows = rows.withColumn("__f", F.floor(F.col("__x") + F.lit(1e-9))).withColumn("__d", F.col("__f") - F.col("__x"))
    rows = ranked(rows, list(group), ["__d", key], "__r")
    left = rows.groupBy(*group).agg((F.max("__s") - F.sum("__f")).alias("__left"))
    rows = rows.join(left, list(group)) if group else rows.join(left, F.lit(True))
    more = (F.col("__r") < F.col("__left")).cast("long")
    return rows.withColumn(out, (F.col("__f") + more + lo).cast("long")).drop("__x", "__f", "__s", "__d", "__r", "__left")


def ras(cells: np.ndarray, margins: Sequence[np.ndarray], sweeps: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """A tensor scaled, axis by axis, to the margins; margins are first brought to one grand total.

    Mass of a margin's value that has no cells is spread over the others in proportion.
    """
    x = np.asarray(cells, float).copy()
    totals = [float(np.sum(m)) for m in margins if np.sum(m) > 0]
    if not totals or x.sum() <= 0:
        return x
    grand = float(np.mean(totals))
    goals = []
    for axis, m in enumerate(margins):
        m = np.maximum(np.asarray(m, float), 0)
        m = np.where(x.sum(axis=tuple(k for k in range(x.ndim) if k != axis)) > 0, m, 0)
        goals.append(m * (grand / m.sum()) if m.sum() > 0 else m)
    for _ in range(sweeps):
        worst = 0.0
        for axis, goal in enumerate(goals):
            have = x.sum(axis=tuple(k for k in range(x.ndim) if k != axis))
            worst = max(worst, float(np.abs(have - goal).max()))
            factor = np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)
            x *= factor.reshape([-1 if k == axis else 1 for k in range(x.ndim)])
        if worst < tolerance * max(1.0, grand):
            break
    return x


def ipf(cells: Mapping[tuple[int, ...], float], targets: Sequence[tuple[tuple[int, ...], Mapping[tuple[int, ...], float]]], sweeps: int = 200, tolerance: float = 1e-10) -> dict[tuple[int, ...], float]:
    """Iterative proportional fitting on the occupied cells; targets are (axes, margin) pairs.

    Cells that are 0 stay 0, so leaving them out changes nothing, and the product of all domains never arises.
    """
    names = list(cells)
    x = np.array([cells[c] for c in names], float)
    index = []
    for axes, goal in targets:
        keys = {k: i for i, k in enumerate(sorted({tuple(c[a] for a in axes) for c in names}))}
        at = np.array([keys[tuple(c[a] for a in axes)] for c in names])
        index.append((at, np.array([goal.get(k, 0.0) for k in keys], float)))
    for _ in range(sweeps):
        worst = 0.0
        for at, goal in index:
            have = np.bincount(at, x, minlength=len(goal))
            factor = np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)
            worst = max(worst, float(np.abs(factor[have > 0] - 1).max(initial=0)))
            x = x * factor[at]
        if worst < tolerance:
            break
    return dict(zip(names, x.tolist(), strict=True))


def row_target(weights: Sequence[float], total: int) -> list[int]:
    """A histogram of rows in proportion to the weights."""
    return largest_remainder(weights, total)


def leaf_target(size_table: Sequence[Sequence[float]], size_values: Sequence[float], conditional: Sequence[Sequence[float]], total: int) -> list[int]:
    """A histogram of leaves: parents by value and size, weighted by size, spread by the conditional of the leaf."""
    mass = np.asarray(size_table, float) @ np.asarray(size_values, float)
    return largest_remainder((mass @ np.asarray(conditional, float)).tolist(), total)


def averaged_targets(targets: Sequence[Sequence[float]], total: int) -> list[int]:
    """A histogram of rows in proportion to the mean of several."""
    return largest_remainder(np.mean(np.asarray(targets, float), axis=0).tolist(), total)


def quota_draw(df: DataFrame, key: str, out: str, counts: Sequence[int], seed: int) -> DataFrame:
    """df with codes dealt so that code c occurs counts[c] times, in an order shuffled by the key's hash.

    Rows are ranked by hash within hash ranges and the ranges' counts are added, so no task ranks all rows.
    """
    numbered = shuffled_rank(df, key, seed, f"quota {out}", rows=int(sum(counts)))
    ends = np.cumsum(np.asarray(counts, int)).tolist()
    code = F.lit(0)
    for e in ends[:-1]:
        code = code + (F.col("__rank") >= F.lit(e)).cast("int")
    return numbered.withColumn(out, code.cast("int")).drop("__rank")


#: Rows that one range of hashes holds on average where rows are ranked in them.
RANGE_ROWS = 50_000


def shuffled_rank(
    df: DataFrame, key: str, seed: int, purpose: str, group: Sequence[str] = (), rows: int | None = None
) -> DataFrame:
    """df with __rank from 0 in an order shuffled by the key's hash, within groups.

    Rows are dealt over equal ranges of hashes, one for every RANGE_ROWS rows; `rows` saves counting them.
    """
    rows = df.count() if rows is None else rows
    step = (1 << 52) // max(1, rows // RANGE_ROWS) + 1
    hashed = df.withColumn("__h", bits(seed, purpose, F.col(key))).withColumn(
        "__cell",
        F.floor(F.col("__h") / F.lit(step)),
    )
    return number_within(hashed, list(group), ["__h", key], "__rank", "__cell").drop("__h")


def repair(df: DataFrame, key: str, code: str, target: Mapping[int, int], support: Column, seed: int = 0) -> DataFrame:
    """df with its codes' histogram brought to the target by moving rows from surplus codes to codes in deficit.

    Of a code with a surplus, the rows of least support move, ties in an order shuffled by the key's hash, so that
    no parent's rows go together; freed rows and open places are matched by rank. Rows that stay keep their code.
    The target must add up to the number of rows. A code's rows are ranked by ranges, so it may have all of them.
    """
    have = {r[0]: r[1] for r in df.groupBy(code).agg(F.count(F.lit(1))).collect()}
    codes = sorted({*have, *target})
    if sum(target.values()) != sum(have.values()):
        raise ValueError("the target must have as many rows as the table")
    surplus = {c: have.get(c, 0) - target.get(c, 0) for c in codes if have.get(c, 0) > target.get(c, 0)}
    open_places = [(c, target.get(c, 0) - have.get(c, 0)) for c in codes if target.get(c, 0) > have.get(c, 0)]
    if not surplus:
        return df
    quota = F.create_map(*(F.lit(x) for kv in surplus.items() for x in kv))
    rows = df.filter(F.col(code).isin(*surplus)).select(
        F.col(key).alias("__k"), F.col(code).alias("__c"), support.alias("__s"), bits(seed, "repair", F.col(key)).alias("__h")
    )
    losers = ranked(rows, ["__c"], ["__s", "__h", "__k"], "__r").filter(F.col("__r") < quota[F.col("__c")])
    before, at = {}, 0
    for c in sorted(surplus):
        before[c] = at
        at += surplus[c]
    slot = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))[F.col("__c")] + F.col("__r")
    new, end = F.lit(open_places[-1][0]), 0
    bounds = []
    for c, n in open_places:
        end += n
        bounds.append((end, c))
    for e, c in reversed(bounds):
        new = F.when(slot < e, F.lit(c)).otherwise(new)
    moved = losers.select("__k", new.cast("int").alias("__new"))
    out = df.join(moved, df[key] == moved["__k"], "left")
    return out.withColumn(code, F.coalesce("__new", code).cast("int")).drop("__k", "__new")


def shrunk_joint(joint: Sequence[Sequence[float]], m1: Sequence[float], m2: Sequence[float], sigma: float, kappa: float, total: float) -> np.ndarray:
    """w x + (1 - w) total share1 share2, w = x / (kappa sigma) within [0, 1]."""
    x = np.asarray(joint, float)
    w = np.clip(x / (kappa * sigma), 0, 1) if sigma > 0 else np.ones_like(x)
    a, b = (np.asarray(m, float) / max(np.sum(m), 1e-300) for m in (m1, m2))
    return w * x + (1 - w) * total * np.outer(a, b)


def lift(joint: np.ndarray, m1: np.ndarray, m2: np.ndarray, smooth: float = 1e-6) -> np.ndarray:
    """(J + s / size(J)) / (m1 m2 + s), the margins normalised."""
    a, b = np.asarray(m1, float), np.asarray(m2, float)
    a, b = a / max(a.sum(), 1e-300), b / max(b.sum(), 1e-300)
    return (joint + smooth / joint.size) / (np.outer(a, b) + smooth)


def snr_shrunk(table: np.ndarray, count: np.ndarray, sigma: float, factor: float = 5.0) -> np.ndarray:
    """1 + (lift - 1) min(count / (factor sigma), 1): lifts that noise drowns fall back to 1."""
    w = np.clip(count / (factor * sigma), 0, 1) if sigma > 0 else 1.0
    return 1 + (table - 1) * w


def normalised(x: np.ndarray) -> np.ndarray:
    """A distribution; alike everywhere if there is no mass."""
    x = np.maximum(np.asarray(x, float), 0)
    return x / x.sum() if x.sum() > 0 else np.full(x.shape, 1 / max(1, x.size))


def conditional(joint: np.ndarray) -> np.ndarray:
    """Rows divided by their sums; rows without mass stay 0."""
    s = joint.sum(axis=1, keepdims=True)
    return joint / np.where(s > 0, s, 1)


def bisect(f, lo: float, hi: float, steps: int = 60) -> float:
    """The root of a rising f in [lo, hi]; an end where there is none inside."""
    for _ in range(steps):
        mid = (lo + hi) / 2
        if f(mid) < 0:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2 if math.isfinite(lo + hi) else lo
