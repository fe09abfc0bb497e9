"""Synthesis of whole databases from released arrays alone; nothing here reads the real tables.

Attributes are drawn role by role from the top: a role's attribute follows its one-way marginal times the lifts of
the pairs that were released with attributes already known for the row. Group sizes follow the summed size
histogram times the lifts by the parent's attributes. Options then bring sizes and histograms to released totals.
All attributes of a role are drawn in one pass over its rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.noise import bits
from kinweave.functions.options import Options
from kinweave.operators.calibrate import (
    averaged_targets, conditional, largest_remainder, leaf_target, lift, normalised, quota_draw, ras, repair, row_target,
    shuffled_rank, snr_shrunk,
)
from kinweave.operators.sampling import Drawn, children, draw_all, random_member
from kinweave.operators.views import column
from kinweave.plans.release import Release, skips_level
from kinweave.scratch import cut

#: How many times its noise an estimate must be to count in full.
SNR = 5.0
#: Prefix of the columns that hold the probability a drawn code had.
SUPPORT = "__s_"


def _joint(rel: Release, known: tuple[str, str], new: tuple[str, str]) -> tuple[np.ndarray, str] | None:
    """The pair's released counts, rows by the known attribute's codes, and the object's name."""
    for pair in ((known, new), (new, known)):
        if pair in rel.joint:
            x = rel.joint[pair]
            return (x if pair[0] == known else x.T), "*".join(f"{r}.{a}" for r, a in pair)
    return None


def pair_lift(rel: Release, known: tuple[str, str], new: tuple[str, str]) -> np.ndarray | None:
    """Rows by the known attribute's codes, columns by the new one's; None if the pair wasn't released.

    A pair that skips a level is guarded: its lift falls back to 1 where the cell is not well above the noise, and
    where the known attribute's own count is not, as then the rows it stands for were drawn from noise.
    """
    found = _joint(rel, known, new)
    if found is None:
        return None
    counts, name = found
    joint = counts / max(counts.sum(), 1e-300)
    table = lift(joint, joint.sum(axis=1), joint.sum(axis=0))
    if skips_level(rel.schema, known, new):
        sigma = rel.sigma.get(name, 0.0)
        table = guarded(table, counts, rel.one[known], sigma, SNR, rel.cross.guard_cell, rel.cross.guard_ancestor)
    return table


def guarded(
    table: np.ndarray, counts: np.ndarray, ancestor: np.ndarray, sigma: float, factor: float = SNR, by_cell: bool = True,
    by_ancestor: bool = True,
) -> np.ndarray:
    """1 + (lift - 1) w, w the share that the cell's count, and that the ancestor's, reach of factor sigma."""
    if sigma <= 0:
        return table
    w = np.ones_like(table)
    if by_cell:
        w = w * np.clip(counts / (factor * sigma), 0, 1)
    if by_ancestor:
        w = w * np.clip(np.asarray(ancestor) / (factor * sigma), 0, 1)[:, None]
    return 1 + (table - 1) * w


def one_way(rel: Release, role: str, attr: str, options: Options, n: int | None = None) -> np.ndarray:
    """The attribute's weights, brought to n in all if given.

    With `ratiotop` a top attribute's are the sums over its first pair with the level below, or else with a lower one.
    """
    x = rel.one[role, attr]
    if "ratiotop" in options and not rel.schema.roles[role].parents:
        pairs = [(k, v) for k, v in rel.joint.items() if len(k) == 2 and k[0] == (role, attr) and k[1][0] != role]
        pairs.sort(key=lambda kv: role not in rel.schema.roles[kv[0][1][0]].parents)
        sums = next((s for _, v in pairs if (s := v.sum(axis=1)).sum() > 0), None)
        x = x if sums is None else sums
    return x * (n / x.sum()) if n is not None and x.sum() > 0 else x


def add_attributes(
    df: DataFrame, key: str, rel: Release, role: str, known: list[tuple[str, str]], options: Options, seed: int | str,
    total: int | None, support: bool = False,
) -> DataFrame:
    """df with role__attr columns, each drawn given those known before it.

    The first pair of a top role is drawn from its joint counts. With `exactmarg` attributes without conditions are
    dealt so that their histogram is exact; so is the first pair, if there are as many rows as SNR times the noise
    of its cells asks for. `support` adds the probability of each drawn code.
    """
    attrs, drawn, known = list(rel.schema.roles[role].attrs), [], list(known)
    exact = "exactmarg" in options and total
    if not known and len(attrs) > 1 and "ratiotop" not in options:
        first = _joint(rel, (role, attrs[0]), (role, attrs[1]))
        if first is not None:
            counts, name = first
            wide = counts.shape[1]
            if exact and total >= SNR * rel.sigma.get(name, 0.0) * counts.size:
                df = quota_draw(df, key, "__pair", largest_remainder(counts.ravel().tolist(), total), seed)
            else:
                df = draw_all(df, key, [Drawn("__pair", counts.ravel())], seed)
            df = df.withColumn(column(role, attrs[0]), F.expr(f"cast(__pair div {wide} as int)")).withColumn(
                column(role, attrs[1]), (F.col("__pair") % wide).cast("int")
            ).drop("__pair")
            known += [(role, a) for a in attrs[:2]]
            attrs = attrs[2:]
    for a in attrs:
        base = one_way(rel, role, a, options)
        lifts = {column(*k): x for k in known if (x := pair_lift(rel, k, (role, a))) is not None}
        if exact and not lifts:
            df = quota_draw(df, key, column(role, a), largest_remainder(base.tolist(), total), seed)
        else:
            drawn.append(Drawn(column(role, a), base, lifts))
        known.append((role, a))
    return draw_all(df, key, drawn, seed, SUPPORT if support else None)


def add_sizes(df: DataFrame, key: str, rel: Release, child: str, parent: str, options: Options, seed: int | str, least: int) -> DataFrame:
    """df with `size`, the number of children of the role, brought to the child's total if there is one."""
    tables = {a: x for (r, a), x in rel.sizes.items() if r == child}
    reps = np.asarray(rel.reps[child])
    if not tables:
        raise ValueError(f"no size histogram of {child} was released")
    base = np.sum([x.sum(axis=0) for x in tables.values()], axis=0)
    base = np.where(reps >= least, base, 0)
    lifts = {}
    for a, x in tables.items():
        sigma = rel.sigma.get(f"SZ.{child}.{a}", 0.0)
        joint = x / max(x.sum(), 1e-300)
        lifts[column(parent, a)] = snr_shrunk(lift(joint, joint.sum(axis=1), joint.sum(axis=0)), x, sigma, SNR)
    df = draw_all(df, key, [Drawn(f"__bin_{child}", base, lifts)], seed)
    df = df.withColumn(
        "size",
        F.element_at(F.array(*map(F.lit, reps.tolist())), F.col(f"__bin_{child}") + 1).cast("long"),
    ).drop(f"__bin_{child}")
    total = rel.totals.get(child)
    if total is None:
        return df
    return to_total(cut(df), key, rel, child, parent, total, least, options, seed)


def quotas(rel: Release, child: str, parent: str) -> dict[str, np.ndarray]:
    """By parent attribute with a size histogram: the mean, over its pairs with the child, of the counts by its codes."""
    out = {}
    for r, a in rel.sizes:
        sums = [x.sum(axis=1) for k, x in rel.joint.items() if len(k) == 2 and k[0] == (parent, a) and k[1][0] == child]
        if r == child and sums:
            out[a] = np.mean(sums, axis=0)
    return out


def to_total(
    df: DataFrame, key: str, rel: Release, child: str, parent: str, total: int, least: int, options: Options, seed: int | str = 0
) -> DataFrame:
    """Sizes changed in proportion, size class by size class, so that they add up to the total.

    The histogram of sizes is calibrated on the driver: a class of size s becomes rows of floor(x) and of
    floor(x) + 1, as many of each as its share of the total asks for. With `szquota` there is a histogram for each
    cell of the attributes that have quotas, and the cells' totals are what the sizes give, scaled axis by axis to all
    quotas. Its size is bounded by these domains. Rows of a class are told apart by the rank of their hash, in
    hash ranges.
    """
    wanted = quotas(rel, child, parent) if "szquota" in options else {}
    group = [column(parent, a) for a in wanted]
    counts = {tuple(r)[:-1]: r["n"] for r in df.groupBy(*group, "size").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_cell: dict[tuple, dict[int, int]] = {}
    for k, n in counts.items():
        by_cell.setdefault(k[:-1], {})[k[-1]] = n
    whole = {(): total}
    if wanted:
        cells = np.zeros([len(q) for q in wanted.values()])
        for k, n in counts.items():
            cells[k[:-1]] += max(k[-1], 1e-9) * n
        goal = ras(cells, list(wanted.values()))
        # Every row keeps the least size; what is above that is shared out among the cells.
        floors = {head: sum(own.values()) * least for head, own in sorted(by_cell.items())}
        above = [max(goal[c] - f, 0.0) for c, f in floors.items()]
        spend = max(total - sum(floors.values()), 0)
        whole = {c: f + x for (c, f), x in zip(floors.items(), largest_remainder(above, spend), strict=True)}
    cap = max(rel.reps[child])
    steps = [
        (*head, *step) for head, goal in whole.items()
        for step in _class_steps(by_cell.get(head, {}), goal, least, cap if "growcap" in options else None)
    ]
    names = [*group, "size", "__low", "__more"]
    plan = df.sparkSession.createDataFrame([tuple(map(int, x)) for x in steps], ", ".join(f"{n} long" for n in names))
    numbered = shuffled_rank(df, key, seed, f"total {child}", [*group, "size"], sum(counts.values()))
    # One row for each class of size, at most the quota attributes' domains times the number of bins.
    return numbered.join(F.broadcast(plan), [*group, "size"]).withColumn(
        "size",
        F.col("__low") + (F.col("__rank") < F.col("__more")).cast("long"),
    ).drop("__low", "__more", "__rank")


def _class_steps(own: Mapping[int, int], goal: int, least: int, cap: int | None) -> list[tuple[int, int, int]]:
    """(size, new size, rows that get one more) for a histogram of sizes whose sum is to be `goal`.

    With a cap, a deficit goes to the rows at it alone; everything else is shared out in proportion above `least`.
    """
    sizes = sorted(own)
    have = sum(s * n for s, n in own.items())
    if cap is not None and goal > have and own.get(cap):
        low, more = divmod(goal - have, own[cap])
        return [(s, s, 0) for s in sizes if s != cap] + [(cap, cap + low, more)]
    spend = max(goal - sum(own.values()) * least, 0)
    over = [max(s - least, 0) * own[s] for s in sizes]
    weights = over if sum(over) else [own[s] for s in sizes]
    out = []
    for s, mass in zip(sizes, largest_remainder(weights, spend), strict=True):
        low, more = divmod(mass, own[s])
        out.append((s, least + low, more))
    return out


def target_of(rel: Release, role: str, attr: str, parent: str, options: Options, n: int) -> list[int]:
    """The histogram of an attribute of leaves that `repair` aims at.

    With `rowleaf` the released marginal counts rows, and is scaled to n. Else rows were released at weights by their
    group, so the parents' size histograms say how many rows each class of parents has, and the released pairs how
    the attribute is spread among them; the targets of all parent attributes are averaged.
    """
    if "rowleaf" not in options:
        found = []
        for (r, a), sizes in rel.sizes.items():
            pair = _joint(rel, (parent, a), (role, attr)) if r == role else None
            if pair is not None:
                x = pair[0]
                given = np.where(x.sum(axis=1, keepdims=True) > 0, conditional(x), normalised(rel.one[role, attr]))
                found.append(leaf_target(sizes, rel.reps[role], given, n))
        if found:
            return averaged_targets(found, n)
    return row_target(rel.one[role, attr].tolist(), n)


def repaired(df: DataFrame, key: str, rel: Release, role: str, parent: str, options: Options, n: int, seed: int | str) -> DataFrame:
    """df whose one-way histograms of the role equal their targets; df has the support of every drawn code."""
    for a in rel.schema.roles[role].attrs:
        name = column(role, a)
        target = dict(enumerate(target_of(rel, role, a, parent, options, n)))
        df = cut(repair(df, key, name, target, F.col(SUPPORT + name), seed))
    return df


#: Tuples of known codes that the driver holds while it fits a leaf attribute; more stay where they are.
TUPLES = 200_000


class Occupied:
    """The tuples of known codes that occur, and how many rows have each, for fitting one leaf attribute.

    Up to TUPLES of them are summed on the driver, which saves a job for each step; more stay where they are, and what
    comes to the driver are sums by one known attribute's codes and the leaf's. The sums are the same.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str], codes: int):
        self.columns, self.codes = list(columns), codes
        self.tuples = cut(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")))
        held = self.tuples.agg(F.count(F.lit(1)), F.sum("n")).first()
        self.rows = held[1] or 0
        self.local = self.tuples.select(*columns, "n").toArrow().to_batches() if held[0] <= TUPLES else None

    def margin(self, base: np.ndarray, factors: Mapping[str, np.ndarray], by: str | None) -> np.ndarray:
        """Expected rows by the codes of `by` and of the leaf, under weights base times the factors."""
        columns, codes, rows = self.columns, self.codes, 1 if by is None else len(factors[by])

        def summed(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros((rows, codes))
            for b in batches:
                known = {c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(columns)}
                x = np.tile(base, (b.num_rows, 1)) * b.column(len(columns)).to_numpy()[:, None]
                for c, f in factors.items():
                    x *= f[known[c]]
                at = known[by] if by else np.zeros(b.num_rows, np.int64)
                for v in range(codes):
                    out[:, v] += np.bincount(at, x[:, v], minlength=rows)
            return out

        if self.local is not None:
            return summed(self.local)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = summed(batches)
            at, code = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(code), pa.array(out[at, code])], names=["x", "v", "m"])

        found = self.tuples.select(*columns, "n").mapInArrow(run, "x long, v long, m double")
        out = np.zeros((rows, codes))
        for x, v, m in found.groupBy("x", "v").agg(F.sum("m")).collect():
            out[x, v] = m
        return out


def fitted_factors(
    seen: Occupied, base: np.ndarray, targets: Mapping[str, np.ndarray], sweeps: int = 25, tolerance: float = 1e-4
) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Iterative proportional fitting in product form: base and factors at which every margin equals its target.

    Each step multiplies one factor by target over margin; rows of tuples that occur keep their numbers by the
    targets' own sums, and margins without mass stay as they are.
    """
    base = np.asarray(base, float).copy()
    whole = base * 0 + np.mean([t.sum(axis=0) for t in targets.values()], axis=0) if targets else base
    factors = {c: np.ones(t.shape) for c, t in targets.items()}
    for _ in range(sweeps):
        worst = 0.0
        for c, t in targets.items():
            have = seen.margin(base, factors, c)
            step = np.divide(t, have, out=np.ones_like(have), where=have > 0)
            factors[c] = factors[c] * step
            worst = max(worst, float(np.abs(step - 1).max(initial=0)))
        have = seen.margin(base, factors, None)[0]
        base = base * np.divide(whole, have, out=np.ones_like(have), where=have > 0)
        if worst < tolerance:
            break
    return base, factors


def fitted_leaf(df: DataFrame, key: str, rel: Release, roles: list[str], seed: int | str, support: bool) -> DataFrame:
    """Leaf attributes by IPF over the occupied tuples of known attributes, drawn from the fitted product form."""
    leaf = roles[-1]
    known = [(r, a) for r in roles[:-1] for a in rel.schema.roles[r].attrs]
    drawn = []
    for a in rel.schema.roles[leaf].attrs:
        base = normalised(rel.one[leaf, a])
        pairs = [(k, x[0]) for k in known if (x := _joint(rel, k, (leaf, a))) is not None]
        columns = [column(*k) for k, _ in pairs]
        seen = Occupied(df, columns, len(base))
        targets = {column(*k): seen.rows * normalised(x) for k, x in pairs}
        base, factors = fitted_factors(seen, base, targets)
        drawn.append(Drawn(column(leaf, a), base, factors))
    return draw_all(df, key, drawn, seed, SUPPORT if support else None)


def _rows(rel: Release, role: str) -> int:
    """The released total of a role, or else the rounded mean of its one-way sums."""
    sums = [rel.one[role, a].sum() for a in rel.schema.roles[role].attrs]
    return rel.totals.get(role) or int(round(float(np.mean(sums))))


def _table(df: DataFrame, rel: Release, role: str, *keys: str) -> DataFrame:
    return df.select(*keys, *(F.col(column(role, a)).alias(a) for a in rel.schema.roles[role].attrs))


def synthesize_chain(spark: SparkSession, rel: Release, options: Options | None = None, seed: int = 0) -> dict[str, DataFrame]:
    """Tables of all roles, from the top down, with the schema's column names and keys from 0 without gaps.

    Sizes of the first level may be 0, others are at least 1.
    """
    options = options or Options()
    purpose = f"synthesis {seed}"
    roles = list(rel.schema.roles)
    top = rel.schema.roles[roles[0]]
    n = _rows(rel, roles[0])
    df = spark.range(n).withColumnRenamed("id", top.key)
    df = cut(add_attributes(df, top.key, rel, roles[0], [], options, purpose, n))
    out = {roles[0]: _table(df, rel, roles[0], top.key)}
    known = [(roles[0], a) for a in top.attrs]
    for level, (up, down) in enumerate(zip(roles, roles[1:], strict=False)):
        p, c = rel.schema.roles[up], rel.schema.roles[down]
        fk = c.parents[up]
        df = add_sizes(df, p.key, rel, down, up, options, purpose, 0 if level == 0 and len(roles) > 2 else 1)
        df = children(df, p.key, "size", fk, c.key, [column(*k) for k in known], dense=True)
        last = down == roles[-1]
        mend = last and "repair" in options
        if last and "ipf" in options:
            df = fitted_leaf(cut(df), c.key, rel, roles, purpose, mend)
        else:
            df = add_attributes(df, c.key, rel, down, known, options, purpose, rel.totals.get(down), mend)
        df = cut(df)
        if mend:
            df = repaired(df, c.key, rel, down, up, options, df.count(), purpose)
        known += [(down, a) for a in c.attrs]
        out[down] = _table(df, rel, down, c.key, fk)
    return out


def synthesize_star(spark: SparkSession, rel: Release, options: Options | None = None, seed: int = 0) -> dict[str, DataFrame]:
    """root1, child and root2; a child's second key is that of a root2 row with the attributes drawn for it.

    Where no root2 row has just those attributes, the child's key is of any root2 row.
    """
    options = options or Options()
    purpose = f"synthesis {seed}"
    r1, r2, ch = (rel.schema.roles[r] for r in rel.schema.roles)
    n = {r.name: _rows(rel, r.name) for r in (r1, r2)}
    one, two = (
        cut(add_attributes(spark.range(n[r.name]).withColumnRenamed("id", r.key), r.key, rel, r.name, [], options, purpose, n[r.name]))
        for r in (r1, r2)
    )
    known = [(r1.name, a) for a in r1.attrs]
    sized = add_sizes(one, r1.key, rel, ch.name, r1.name, options, purpose, 1)
    fk1, fk2 = ch.parents[r1.name], ch.parents[r2.name]
    df = children(sized, r1.key, "size", fk1, ch.key, [column(*k) for k in known], dense=True)
    drawn = []
    for a in r2.attrs:
        lifts = {column(*k): x for k in known if (x := pair_lift(rel, k, (r2.name, a))) is not None}
        drawn.append(Drawn(column(r2.name, a), rel.one[r2.name, a], lifts))
        known.append((r2.name, a))
    df = draw_all(df, ch.key, drawn, f"{purpose} of children")
    drawn, cells = [], {}
    for a in ch.attrs:
        triple = next(((k, x) for k, x in rel.joint.items() if len(k) == 3 and k[2] == (ch.name, a)), None)
        if triple is not None:
            # The triple's own conditional, with the pairs' product where a cell has no mass.
            (ka, kb, _), x = triple
            flat = x.reshape(-1, x.shape[2])
            fall = np.stack([
                normalised(rel.one[ch.name, a]) * _row(rel, ka, (ch.name, a), i) * _row(rel, kb, (ch.name, a), j)
                for i in range(x.shape[0]) for j in range(x.shape[1])
            ])
            cond = np.where(flat.sum(axis=1, keepdims=True) > 0, conditional(flat), fall)
            cells[f"__cell_{a}"] = F.col(column(*ka)) * x.shape[1] + F.col(column(*kb))
            drawn.append(Drawn(column(ch.name, a), np.ones(x.shape[2]), {f"__cell_{a}": cond}))
        else:
            lifts = {column(*k): x for k in known if (x := pair_lift(rel, k, (ch.name, a))) is not None}
            drawn.append(Drawn(column(ch.name, a), rel.one[ch.name, a], lifts))
        known.append((ch.name, a))
    mend = "repair" in options
    df = cut(draw_all(df.withColumns(cells) if cells else df, ch.key, drawn, purpose, SUPPORT if mend else None).drop(*cells))
    if mend:
        df = repaired(df, ch.key, rel, ch.name, r1.name, options, df.count(), purpose)
    mark = F.concat_ws(",", *(F.col(column(r2.name, a)) for a in r2.attrs))
    keyed = two.withColumn("__mark", mark)
    hit = random_member(df.withColumn("__mark", mark), ch.key, "__mark", keyed, r2.key, "__two", purpose)
    anyone = F.pmod(bits(purpose, "any", F.col(ch.key)), F.lit(max(1, n[r2.name])))
    hit = hit.withColumn(fk2, F.coalesce("__two", anyone))
    return {
        r1.name: _table(one, rel, r1.name, r1.key),
        r2.name: _table(two, rel, r2.name, r2.key),
        ch.name: _table(hit, rel, ch.name, ch.key, fk1, fk2),
    }


def _row(rel: Release, known: tuple[str, str], new: tuple[str, str], code: int) -> np.ndarray:
    x = pair_lift(rel, known, new)
    return np.ones(rel.schema.size(*new)) if x is None else x[code]
