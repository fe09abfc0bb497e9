"""Sampling of rows: draws by inverse distribution functions, alone or given other columns, and child rows.

Draws depend on a row's key and a purpose alone (see functions.noise), so retries and partitionings don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from kinweave.functions.noise import bits, uniform
from kinweave.operators.calibrate import normalised
from kinweave.operators.views import ranked, running

#: Rows whose attributes are drawn at once.
ROWS_AT_ONCE = 4096


@dataclass(frozen=True)
class Drawn:
    """An attribute to draw: its column, its weights, and lifts by condition column (rows by the condition's codes)."""

    out: str
    base: np.ndarray
    lifts: Mapping[str, np.ndarray] = field(default_factory=dict)

    def codes(self, u: np.ndarray, conditions: Mapping[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(code, its probability) for every row."""
        p = np.tile(normalised(self.base), (len(u), 1))
        for c, x in self.lifts.items():
            p *= np.asarray(x, float)[conditions[c]]
        total = p.sum(axis=1, keepdims=True)
        p = np.where(total > 0, p / np.where(total > 0, total, 1), 1 / p.shape[1])
        code = (np.cumsum(p, axis=1)[:, :-1] <= u[:, None]).sum(axis=1)
        return code, p[np.arange(len(u)), code]


def draw_all(df: DataFrame, key: str, drawn: Sequence[Drawn], seed: int | str, support: str | None = None) -> DataFrame:
    """df with all the attributes, each drawn given its conditions, which may be attributes drawn before it.

    One pass over df in Arrow batches, whatever the number of attributes and conditions. With `support`, column
    support + name has the probability that the drawn code had.
    """
    if not drawn:
        return df
    us = {d.out: f"__u{i}" for i, d in enumerate(drawn)}
    kept = list(df.columns)
    made = [StructField(d.out, IntegerType()) for d in drawn]
    made += [StructField(support + d.out, DoubleType()) for d in drawn] if support else []
    schema = StructType([*df.schema.fields, *made])
    reads = [c for c in dict.fromkeys(c for d in drawn for c in d.lifts) if c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                known = {c: batch.column(kept.index(c)).to_numpy(zero_copy_only=False) for c in reads}
                likely = {}
                for i, d in enumerate(drawn):
                    known[d.out], likely[d.out] = d.codes(batch.column(len(kept) + i).to_numpy(), known)
                arrays = [*(batch.column(i) for i in range(len(kept))), *(pa.array(known[d.out], pa.int32()) for d in drawn)]
                arrays += [pa.array(likely[d.out]) for d in drawn] if support else []
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select("*", *(uniform(seed, d.out, F.col(key)).alias(us[d.out]) for d in drawn)).mapInArrow(run, schema)


def draw(df: DataFrame, key: str, out: str, base: np.ndarray, lifts: Mapping[str, np.ndarray], seed: int | str) -> DataFrame:
    """df with a code drawn from base, or from base times the lifts of its condition columns."""
    return draw_all(df, key, [Drawn(out, base, lifts)], seed)


#: Children that one step of `children` makes of a parent.
CHUNK = 1 << 16


def children(
    parents: DataFrame, key: str, size: str, fk: str, pk: str, keep: Sequence[str] = (), dense: bool = False
) -> DataFrame:
    """`size` rows for each parent: pk, numbered from 0 without gaps in the order of the parents' keys, fk, keep.

    A parent of many children is dealt in lots over the tasks. `dense` says that the parents' keys have few gaps.
    """
    rows = parents.filter(F.col(size) > 0).select(
        F.col(key).alias(fk), *(c for c in keep if c != fk), F.col(size).cast("long").alias("__n")
    )
    cell = F.expr(f"`{fk}` div {CHUNK}") if dense else None
    placed = running(rows, [fk], "__n", "__base", cell=cell)
    lots = placed.withColumn("__lot", F.explode(F.sequence(F.lit(0), F.expr(f"(__n - 1) div {CHUNK}"))))
    lots = lots.repartition(F.col(fk), F.col("__lot"))
    first = F.col("__lot") * CHUNK
    last = F.least(first + CHUNK, F.col("__n")) - 1
    return lots.withColumn("__i", F.explode(F.sequence(first, last))).select(
        (F.col("__base") + F.col("__i")).alias(pk), fk, *keep
    )


def linked(children_: DataFrame, key: str, weighted: DataFrame, parent: str, weight: str, fk: str, seed: int) -> DataFrame:
    """children with a parent drawn in proportion to weight.

    The parents' running weights, in the order of their keys, cut [0, 1) into intervals, and a child takes the one
    its uniform falls into. Both sides are cut at the bounds of equal ranges of [0, 1), of which there is one for
    every 16 parents, so the match is an equality of range numbers with a comparison among few, and no task holds
    all parents.
    """
    placed = running(weighted.filter(F.col(weight) > 0).select(parent, weight), [parent], weight, "__before", "__all")
    ranges = max(64, placed.count() // 16)
    lo = F.col("__before") / F.col("__all")
    hi = (F.col("__before") + F.col(weight)) / F.col("__all")
    placed = placed.select(
        F.col(parent).alias(fk), lo.alias("__lo"), hi.alias("__hi"),
        F.explode(
            F.sequence(F.floor(lo * ranges), F.least(F.floor(hi * ranges), F.lit(ranges - 1))),
        ).alias("__b"),
    )
    u = uniform(seed, "link", F.col(key))
    drawn = children_.withColumn("__u", u).withColumn("__b", F.floor(u * ranges))
    hit = drawn.join(placed, "__b").filter((F.col("__u") >= F.col("__lo")) & (F.col("__u") < F.col("__hi")))
    return hit.drop("__u", "__b", "__lo", "__hi")


def random_member(df: DataFrame, key: str, group: str, members: DataFrame, member: str, out: str, seed: int) -> DataFrame:
    """df with a member of its group, each as likely as the others; groups without members give null."""
    numbered = ranked(members.select(group, member), [group], [member], "__r")
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    drawn = df.join(sizes, group, "left").withColumn("__r", F.pmod(bits(seed, out, F.col(key)), F.col("__n")))
    numbered = numbered.withColumnsRenamed({group: "__g", member: out, "__r": "__q"})
    hit = drawn.join(numbered, (drawn[group] == numbered["__g"]) & (drawn["__r"] == numbered["__q"]), "left")
    return hit.drop("__g", "__q", "__r", "__n")


def bootstrap(df: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """replicate and the columns of df: every replicate draws as many rows as df has, with replacement."""
    numbered = ranked(df, [], [key], "__r")
    n = numbered.count()
    slots = df.sparkSession.range(replicates * n).select(
        F.expr(f"id div {max(n, 1)}").alias("replicate"), (F.col("id") % max(n, 1)).alias("__s")
    )
    drawn = slots.withColumn("__r", F.pmod(bits(seed, "boot", F.col("replicate"), F.col("__s")), F.lit(max(n, 1))))
    return drawn.join(numbered, "__r").drop("__r", "__s")
