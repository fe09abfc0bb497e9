"""Joins along foreign keys: denormalised views, closures, orphans, re-normalisation.

Views join only the roles that are asked for, so a query of one table reads no parent. Parents are joined by
equality and Spark chooses the strategy by size; nothing is broadcast by hand.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.schema import POLICIES, Schema
from kinweave.scratch import cut


def column(role: str, attr: str) -> str:
    """The name of a role's attribute in a view."""
    return f"{role}__{attr}"


def join_parent(
    child: DataFrame, fk: str, parent: DataFrame, pk: str, policy: str = "drop", flag: str | None = None
) -> DataFrame:
    """child with the columns of its parent rows; `flag` names a column that marks orphans.

    drop: orphans go. first and last: they get the parent of the least or greatest key. zero: their parent's
    columns are 0 where numeric, null else. error: they raise when rows are read.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    found = parent.withColumn("__hit", F.lit(True))
    if policy == "drop":
        out = child.join(parent, child[fk] == parent[pk])
        return out.withColumn(flag, F.lit(False)) if flag else out
    out = child.join(found, child[fk] == found[pk], "left")
    orphan = F.col("__hit").isNull()
    if policy == "error":
        out = out.withColumn(
            "__hit", F.when(
                orphan,
                F.raise_error(F.concat(F.lit(f"{fk} finds no parent: "), child[fk].cast("string"))),
            ).otherwise(F.col("__hit"))
        ).filter("__hit")
    elif policy == "zero":
        fills = {
            c: F.when(orphan, F.lit(0)).otherwise(F.col(c)).cast(t) for c, t in parent.dtypes if t not in (
                "string",
                "date",
                "timestamp",
                "boolean",
            )
        }
        out = out.withColumns(fills)
    else:
        # One row: the parent of the extreme key, found by an aggregate and joined to all.
        order = F.min_by if policy == "first" else F.max_by
        row = parent.agg(order(F.struct(*parent.columns), F.col(pk)).alias("__p"))
        out = out.join(row, F.lit(True), "left")
        out = out.withColumns(
            {c: F.when(orphan, F.col(f"__p.{c}")).otherwise(F.col(c)) for c in parent.columns},
        ).drop("__p")
    out = out.withColumn(flag, orphan) if flag else out
    return out.drop("__hit")


def view(
    schema: Schema,
    tables: Mapping[str, DataFrame],
    start: str,
    wanted: Iterable[tuple[str, str]],
    policy: str = "drop",
    extra: Sequence[str] = (),
) -> DataFrame:
    """One row for each row of `start` (fewer where orphans go), with role__attr columns of the wanted pairs.

    `extra` columns of `start` keep their names.
    """
    wanted = list(dict.fromkeys(wanted))
    paths = [schema.path(start, r) for r, _ in wanted]
    hops = dict.fromkeys((a, b) for p in paths for a, b in zip(p, p[1:], strict=False))
    # Only keys that lead on and wanted attributes are read from each table.
    needed: dict[str, dict[str, Column]] = {}
    for role in dict.fromkeys([start, *(b for _, b in hops)]):
        r = schema.roles[role]
        cols = {column(role, a): F.col(a) for q, a in wanted if q == role}
        cols |= {f"__fk_{role}_{up}": F.col(r.parents[up]) for a, up in hops if a == role}
        if role != start:
            cols[f"__pk_{role}"] = F.col(r.key)
        needed[role] = cols
    first = needed[start] | {c: F.col(c) for c in extra}
    out = tables[start].select(*(c.alias(n) for n, c in first.items()))
    for a, b in hops:
        parent = tables[b].select(*(c.alias(n) for n, c in needed[b].items()))
        out = join_parent(out, f"__fk_{a}_{b}", parent, f"__pk_{b}", policy)
    return out.select(*extra, *(column(r, a) for r, a in wanted))


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows of child whose key finds no parent; null keys are orphans."""
    return child.join(parent.select(F.col(pk).alias("__pk")), F.col(fk) == F.col("__pk"), "left_anti")


def closure(schema: Schema, tables: Mapping[str, DataFrame], kept: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables cut down so that every child's parents and every parent's children are among `kept`.

    Children lose rows whose parent was dropped, from parents down; then parents without kept descent stay, as
    they do in a subset by a root, unless they are named in `kept` themselves.
    """
    out = dict(tables) | dict(kept)
    for name, role in schema.roles.items():
        for up, fk in role.parents.items():
            key = out[up].select(F.col(schema.roles[up].key).alias("__pk"))
            out[name] = out[name].join(key, F.col(fk) == F.col("__pk"), "left_semi")
    return out


#: Low bits of the numbers that `monotonically_increasing_id` gives, which count a partition's rows.
ROW_BITS = 33


def dense_keys(df: DataFrame, order: Sequence[str], key: str = "key") -> DataFrame:
    """df with `key` numbered from 0 in the given order."""
    return ranked(df, [], order, key)


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], out: str) -> DataFrame:
    """df with `out`, the row's number from 0 within its group in the given order.

    Rows are dealt by ranges of group and order, as many as the session has shuffle partitions, sorted and counted
    within each, and the counts of the ranges before are added. So no task holds a group, however large, if the order
    tells its rows apart, and rows are sorted once.
    """
    by = [*group, *order]
    at = F.monotonically_increasing_id()  # the partition's number in the high bits, the row's in its low ROW_BITS
    dealt = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", at))
    dealt = dealt.withColumns({"__part": F.shiftright("__at", ROW_BITS), "__row": F.col("__at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))})
    sums = dealt.groupBy(*group, "__part").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = before.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__base")
    sums = sums.select(*group, "__part", base)
    same = F.lit(True)
    for c in [*group, "__part"]:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    # Without groups there is one row for each range, of which there are as many as shuffle partitions.
    right = (sums if group else F.broadcast(sums)).alias("r")
    kept = [F.col(f"l.{c}") for c in df.columns if c != out]
    return dealt.alias("l").join(right, same).select(*kept, (F.col("r.__base") + F.col("l.__row")).alias(out))


def running(
    df: DataFrame, order: Sequence[str | Column], value: str, out: str, total: str | None = None, cell: Column | None = None
) -> DataFrame:
    """df with `out`, the sum of `value` over the rows before it in the given order, dealt like `ranked`.

    `total` names a further column with the sum over all rows. `cell`, a number that rises with the order and deals the
    rows evenly, saves finding ranges.
    """
    if cell is None:
        dealt = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    else:
        dealt = df.withColumn("__part", cell)
    sums = dealt.groupBy("__part").agg(F.sum(value).alias("__m"))
    whole = Window.partitionBy(F.lit(0))
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    more = [F.sum("__m").over(whole).alias(total)] if total else []
    sums = sums.select("__part", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__sum"), *more)
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("__within", F.coalesce(F.sum(value).over(own), F.lit(0))).join(sums, "__part")
    return placed.withColumn(out, F.col("__sum") + F.col("__within")).drop("__sum", "__within", "__part")


def number_within(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], out: str, cell: str) -> DataFrame:
    """Numbers from 0 in the order within each group, for rows whose column `cell` rises with the order."""
    sums = df.groupBy(*group, cell).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = before.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, cell, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy(*group, cell).orderBy(*order)
    numbered = df.withColumn("__row", F.row_number().over(own) - 1).alias("l")
    right = sums.alias("r")
    same = F.lit(True)
    for c in [*group, cell]:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    number = (F.col("r.__base") + F.col("l.__row")).cast("long").alias(out)
    kept = [F.col(f"l.{c}") for c in df.columns if c not in (cell, out)]
    return numbered.join(right, same).select(*kept, number)


def denormalise_signature(wide: DataFrame, columns: Sequence[str], key: str = "signature") -> DataFrame:
    """Distinct value tuples of the columns with dense ids in their order, and how many rows have each."""
    tuples = wide.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows"))
    return dense_keys(tuples, list(columns), key)


def renormalise(wide: DataFrame, groups: Mapping[str, Sequence[str]], leaf: Sequence[str]) -> dict[str, DataFrame]:
    """Split a denormalised table into parents by distinct signature, and leaves that point at the last of them.

    groups: parent role to its columns, from the top down; a role's signature holds those of the roles above it.
    """
    out: dict[str, DataFrame] = {}
    above: list[str] = []
    current = wide
    for role, columns in groups.items():
        own = [*above, *columns]
        ids = denormalise_signature(current, own, f"{role}_key").drop("n_rows")
        current = current.join(ids, own)
        upper = [f"{r}_key" for r in out][-1:]
        out[role] = (
            current.select(f"{role}_key", *upper, *columns).distinct() if upper else ids.select(f"{role}_key", *columns)
        )
        above = own
    last = f"{list(groups)[-1]}_key"
    out["leaf"] = current.select(last, *leaf)
    return out


def slots(parents: DataFrame, key: str, children: DataFrame, fk: str, order: Sequence[str], n: int) -> DataFrame:
    """One row for each parent and slot from 0 to n - 1 with the child in it, and `present` 0 or 1.

    Children take slots in the given order; those beyond n have none.
    """
    placed = ranked(children, [fk], order, "slot").withColumn("slot", F.col("slot").cast("int")).filter(F.col("slot") < n)
    grid = parents.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    placed = placed.withColumnsRenamed({fk: "__fk", "slot": "__slot"})
    return (
        grid.join(placed, (grid[key] == placed["__fk"]) & (grid["slot"] == placed["__slot"]), "left")
        .withColumn("present", F.col("__fk").isNotNull().cast("int"))
        .drop("__fk", "__slot")
    )


def bucketed(df: DataFrame, group: Sequence[str], order: Sequence[str], capacity: int, out: str = "bucket") -> DataFrame:
    """df with the number of its bucket, each bucket of a group holding at most `capacity` rows in order."""
    return ranked(df, group, order, "__at").withColumn(
        out, F.floor(F.col("__at") / capacity).cast("long")
    ).drop("__at")
