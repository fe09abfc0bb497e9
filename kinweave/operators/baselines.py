"""Baselines: independent tables linked by noisy group sizes, and synthesis of the denormalised table."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.accountant import delta_of, gamma
from kinweave.functions.noise import gaussian, gaussian_value
from kinweave.operators.calibrate import normalised
from kinweave.operators.sampling import draw, linked
from kinweave.operators.sizes import group_sizes
from kinweave.operators.views import column, renormalise, view
from kinweave.schema import Schema

#: A synthesizer of one table: (spark, table, sizes by attribute, epsilon, rows, seed) -> table with key `id`.
TableSynthesizer = Callable[[SparkSession, DataFrame, Mapping[str, int], float, int, int], DataFrame]


def independent_marginals(
    spark: SparkSession, table: DataFrame, sizes: Mapping[str, int], epsilon: float, rows: int, seed: int, delta: float | None = None
) -> DataFrame:
    """Every attribute drawn from its own noisy histogram, alone."""
    scale = np.sqrt(2.0 * max(1, len(sizes))) / gamma(epsilon, delta or delta_of(max(2, table.count())))
    out = spark.range(rows)
    for a, n in sizes.items():
        counts = np.zeros(n)
        for code, k in table.groupBy(a).agg(F.count(F.lit(1))).collect():
            counts[code] = k
        noise = np.array([gaussian_value(seed, "marginal", a, code) for code in range(n)])
        out = draw(out, "id", a, normalised(np.maximum(counts + scale * noise, 0)), {}, seed)
    return out


def noisy_size_shares(child: DataFrame, fk: str, epsilon: float, seed: int, cap: int, delta: float) -> DataFrame:
    """size, share: the noisy histogram of group sizes, capped, noise drawn for every size from 1 to cap."""
    spark = child.sparkSession
    found = group_sizes(child, fk).groupBy(
        F.least("n", F.lit(cap)).alias("size"),
    ).agg(F.count(F.lit(1)).alias("groups"))
    grid = spark.range(1, cap + 1).withColumnRenamed("id", "size")
    noise = gaussian(seed, "relink", F.col("size")) / F.lit(gamma(epsilon, delta))
    return grid.join(found, "size", "left").select(
        "size",
        F.greatest(F.coalesce("groups", F.lit(0)) + noise, F.lit(0.0)).alias("share"),
    )


def relink(children: DataFrame, key: str, parents: DataFrame, pk: str, shares: DataFrame, fk: str, seed: int) -> DataFrame:
    """children with parents drawn so that group sizes follow the shares: parents weigh by a size drawn for each."""
    table = np.array([[r["size"], r["share"]] for r in shares.orderBy("size").collect()])
    weighted = draw(parents.select(pk), pk, "__b", normalised(table[:, 1]), {}, seed)
    weight = F.element_at(F.array(*(F.lit(float(s)) for s in table[:, 0])), F.col("__b") + 1)
    return linked(children, key, weighted.withColumn("__w", weight), pk, "__w", fk, seed)


def per_table(
    spark: SparkSession, schema: Schema, tables: Mapping[str, DataFrame], epsilon: float, seed: int, make: TableSynthesizer = independent_marginals, share: float = 0.1,
) -> dict[str, DataFrame]:
    """Each table synthesized by itself, then linked; each foreign key costs `share` of the budget."""
    links = [(r, up, fk) for r, role in schema.roles.items() for up, fk in role.parents.items()]
    each = epsilon * (1 - share * len(links)) / len(schema.roles)
    out: dict[str, DataFrame] = {}
    for i, (r, role) in enumerate(schema.roles.items()):
        made = make(spark, tables[r], role.sizes, each, tables[r].count(), seed + i)
        out[r] = made.withColumnRenamed("id", role.key)
    for r, up, fk in links:
        n = max(2, tables[r].count())
        cap = group_sizes(tables[r], fk).agg(F.max("n")).first()[0] or 1
        shares = noisy_size_shares(tables[r], fk, share * epsilon, seed, cap, delta_of(n))
        out[r] = relink(out[r], schema.roles[r].key, out[up], schema.roles[up].key, shares, fk, seed)
    return out


def denormalised(
    spark: SparkSession, schema: Schema, tables: Mapping[str, DataFrame], epsilon: float, seed: int, make: TableSynthesizer = independent_marginals,
) -> dict[str, DataFrame]:
    """The leaf's full view synthesized as one table, then split again by distinct attribute signatures."""
    leaf = list(schema.roles)[-1]
    pairs = [(r, a) for r, role in schema.roles.items() for a in role.attrs]
    wide = view(schema, tables, leaf, pairs)
    sizes = {column(r, a): schema.size(r, a) for r, a in pairs}
    made = make(spark, wide, sizes, epsilon, wide.count(), seed)
    groups = {r: [column(r, a) for a in role.attrs] for r, role in schema.roles.items() if r != leaf}
    return renormalise(made, groups, [column(leaf, a) for a in schema.roles[leaf].attrs])
