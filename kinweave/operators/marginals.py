"""Weighted low-order marginals over joined tables, compiled to grouping sets.

Every marginal groups some columns of one wide view and sums a weight. The view is first summed to its distinct
tuples of codes, then all marginals come from that by one pass of grouping sets; so the raw rows are read once and
the Expand runs on tuples, not on rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.functions.noise import gaussian

#: Decimals that sums of weights are rounded to wherever they are shown, as the order of addition is not fixed.
DECIMALS = 6


@dataclass(frozen=True)
class Marginal:
    """A released object: its name and the view columns it groups by, one to three."""

    name: str
    columns: tuple[str, ...]

    def __post_init__(self):
        if not 1 <= len(self.columns) <= 3:
            raise ValueError(f"{self.name} must have one to three columns")


def marginals(view: DataFrame, wanted: Sequence[Marginal], weight: str | None = None) -> DataFrame:
    """query_name, c0, c1, c2, value: every marginal's cells that occur; unused code columns are null."""
    columns = list(dict.fromkeys(c for m in wanted for c in m.columns))
    total = F.count(F.lit(1)).cast("double") if weight is None else F.sum(weight)
    tuples = view.groupBy(*columns).agg(total.alias("__w"))
    sets = list(dict.fromkeys(m.columns for m in wanted))
    at = {c: i for i, c in enumerate(columns)}
    # grouping_id has a 1 for each column that a set leaves out, the first column being the highest bit.
    ids = {s: sum(1 << (len(columns) - 1 - at[c]) for c in columns if c not in s) for s in sets}
    grouped = tuples.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
        F.sum("__w").alias("value"), F.grouping_id(*columns).alias("__g")
    )
    named = F.array(
        *(
            F.struct(
                F.lit(m.name).alias("query_name"),
                F.lit(ids[m.columns]).cast("long").alias("g"),
                *(
                    (
                        F.col(m.columns[i]).cast("int") if i < len(m.columns) else F.lit(None).cast("int")
                    ).alias(f"c{i}") for i in range(3)
                ),
            )
            for m in wanted
        )
    )
    mine = F.filter(named, lambda x: x["g"] == F.col("__g"))
    out = grouped.select(F.explode(mine).alias("m"), "value")
    return out.select("m.query_name", "m.c0", "m.c1", "m.c2", "value")


def domain_grid(view_sizes: Mapping[str, int], wanted: Sequence[Marginal], spark) -> DataFrame:
    """Every cell of every marginal's domain, occupied or not; its size is bounded by the domains alone."""
    parts = []
    for m in wanted:
        cells = spark.range(1).select(F.lit(m.name).alias("query_name"))
        for i in range(3):
            if i < len(m.columns):
                codes = F.sequence(F.lit(0), F.lit(view_sizes[m.columns[i]] - 1))
                cells = cells.withColumn(f"c{i}", F.explode(codes))
            else:
                cells = cells.withColumn(f"c{i}", F.lit(None).cast("int"))
        parts.append(cells)
    return reduce(DataFrame.unionByName, parts)


def on_grid(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """The grid with the cells' values, 0 where there are none."""
    a, b = grid.alias("a"), cells.alias("b")
    names = ("query_name", "c0", "c1", "c2")
    same = reduce(Column.__and__, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names))
    return a.join(b, same, "left").select(
        *(F.col(f"a.{c}") for c in names),
        F.coalesce("b.value", F.lit(0.0)).alias("value"),
    )


def cell_key(seed: int) -> Column:
    return F.concat_ws(
        "|",
        F.lit(str(seed)),
        "query_name",
        *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in ("c0", "c1", "c2")),
    )


def released(dense: DataFrame, sigma: float | Mapping[str, float], seed: int) -> DataFrame:
    """Cells with Gaussian noise, clipped at 0. `dense` must hold every cell of the domain, zeros included."""
    if isinstance(sigma, Mapping):
        scale = F.create_map(*(F.lit(x) for kv in sigma.items() for x in kv))[F.col("query_name")]
    else:
        scale = F.lit(float(sigma))
    noisy = F.col("value") + scale * gaussian(cell_key(seed))
    return dense.withColumn("value", F.greatest(noisy, F.lit(0.0)))


def within_pairs(df: DataFrame, group: str, order: str, a: str, b: str, most: int = 20) -> DataFrame:
    """c0, c1, value over pairs of members of one group, the first before the second by order.

    The first `most` pairs of a group count, each with weight 1 / min(s (s - 1), most), s the group's size. Only
    the members that those pairs can have are held: pairs with the first member come first, then with the second.
    """
    own = Window.partitionBy(group).orderBy(order)
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("s")).filter("s > 1")
    # Pairs in order of the first member need no more than most + 1 members of a group.
    members = df.select(group, order, a, b).withColumn("r", F.row_number().over(own)).filter(F.col("r") <= most + 1)
    left = members.select(group, F.col(a).alias("c0"), F.col("r").alias("i"))
    right = members.select(F.col(group).alias("__g"), F.col(b).alias("c1"), F.col("r").alias("j"))
    pairs = left.join(right, (F.col(group) == F.col("__g")) & (F.col("i") < F.col("j"))).join(sizes, group)
    # A pair's place: all pairs of the first members before it, then its own.
    i, j, s = F.col("i"), F.col("j"), F.col("s")
    place = (i - 1) * s - F.floor((i - 1) * i / 2) + (j - i)
    weight = F.lit(1.0) / F.least(s * (s - 1), F.lit(most))
    return pairs.filter(place <= most).groupBy("c0", "c1").agg(F.sum(weight).alias("value"))


def registry_chain2(parent: str, p_attrs: Sequence[str], child: str, c_attrs: Sequence[str], pairs: Sequence[tuple[str, str]]) -> dict[str, list[Marginal]]:
    """Released objects of parent <- child, by the table they are counted over."""
    p, c = (lambda a: f"{parent}__{a}"), (lambda a: f"{child}__{a}")
    return {
        "parent": [
            *(Marginal(f"P_{a}", (p(a),)) for a in p_attrs),
            *(Marginal(f"PP_{a}_{b}", (p(a), p(b))) for a, b in pairs),
        ],
        "child": [
            *(Marginal(f"C_{b}", (c(b),)) for b in c_attrs),
            *(Marginal(f"PC_{a}_{b}", (p(a), c(b))) for a in p_attrs for b in c_attrs),
        ],
    }


def registry_chain3(
    roles: tuple[str, str, str], top: Sequence[str], mid: Sequence[str], bot: Sequence[str], cross: bool = True
) -> dict[str, list[Marginal]]:
    """Released objects of top <- mid <- bot, by the table they are counted over."""
    t, m, b = (lambda a, r=r: f"{r}__{a}" for r in roles)
    return {
        "top": [
            *(Marginal(f"T_{a}", (t(a),)) for a in top),
            *(Marginal(f"TT_{a}_{c}", (t(a), t(c))) for i, a in enumerate(top) for c in top[i + 1 :]),
        ],
        "mid": [
            *(Marginal(f"M_{a}", (m(a),)) for a in mid),
            *(Marginal(f"TM_{a}_{c}", (t(a), m(c))) for a in top for c in mid),
        ],
        "bot": [
            *(Marginal(f"B_{a}", (b(a),)) for a in bot),
            *(Marginal(f"MB_{a}_{c}", (m(a), b(c))) for a in mid for c in bot),
        ],
        "cross": [Marginal(f"TB_{a}_{c}", (t(a), b(c))) for a in top for c in bot] if cross else [],
    }


def registry_star(
    roles: tuple[str, str, str], r1: Sequence[str], r2: Sequence[str], child: Sequence[str], pairs: Sequence[tuple[str, str]]
) -> dict[str, list[Marginal]]:
    """Released objects of root1 <- child -> root2, by the table they are counted over."""
    x, c, y = (lambda a, r=r: f"{r}__{a}" for r in roles)
    return {
        "r1": [Marginal(f"P1_{a}", (x(a),)) for a in r1],
        "r2": [Marginal(f"P2_{a}", (y(a),)) for a in r2],
        "child": [
            *(Marginal(f"XP_{a}_{b}", (x(a), y(b))) for a, b in pairs),
            *(Marginal(f"C_{k}", (c(k),)) for k in child),
            *(Marginal(f"P1C_{a}_{k}", (x(a), c(k))) for a in r1 for k in child),
            *(Marginal(f"P2C_{b}_{k}", (y(b), c(k))) for b in r2 for k in child),
            *(Marginal(f"XPC_{a}_{b}_{k}", (x(a), y(b), c(k))) for a, b in pairs for k in child),
        ],
    }
