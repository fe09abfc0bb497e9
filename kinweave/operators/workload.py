"""Count queries over foreign-key joins: generation, batch answering, relative errors.

A query counts rows of one role under a conjunction of attribute-in-set conditions on roles above it. A batch is
answered from the tuples of codes that occur: queries over the same roles share one join, its rows are summed to the
distinct tuples of the attributes that these queries use, and one pass over the tuples sums for all of them at once.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.views import column, view
from kinweave.schema import Schema

#: Queries of each class, seed, and the count from which an answer is large.
PER_CLASS, SEED, LARGE = 150, 123, 50


@dataclass(frozen=True)
class CountQuery:
    """Class, counted role, and (role, attribute, codes) conditions."""

    cls: str
    qid: int
    role: str
    conditions: tuple[tuple[str, str, tuple[int, ...]], ...]


def some_codes(r: random.Random, size: int, most: int = 4) -> tuple[int, ...]:
    """A set of 1 to min(most, size) - 1 codes, sorted; sizes below 2 have none."""
    if size < 2:
        raise ValueError("a domain of one code can't be queried")
    return tuple(sorted(r.sample(range(size), r.randint(1, max(1, min(most, size) - 1)))))


def generate(
    schema: Schema,
    classes: Mapping[str, tuple[str, Sequence[str]]],
    per_class: int = PER_CLASS,
    seed: int = SEED,
    most: int = 4,
    most_attrs: int = 1,
) -> list[CountQuery]:
    """`per_class` queries of each class; a class names the counted role and the roles that get conditions.

    Each of these roles gets conditions on 1 to `most_attrs` of its attributes, of up to `most` - 1 codes each.
    """
    r, out = random.Random(seed), []
    for cls, (counted, roles) in classes.items():
        for qid in range(per_class):
            conditions = []
            for role in roles:
                usable = [a for a, n in schema.roles[role].sizes.items() if n >= 2]
                for attr in sorted(r.sample(usable, r.randint(1, min(most_attrs, len(usable))))):
                    conditions.append((role, attr, some_codes(r, schema.size(role, attr), most)))
            out.append(CountQuery(cls, qid, counted, tuple(conditions)))
    return out


def chain_classes(top: str, mid: str, bot: str) -> dict[str, tuple[str, list[str]]]:
    return {
        "0hop_top": (top, [top]), "0hop_bot": (bot, [bot]), "1hop_topmid": (mid, [top, mid]),
        "1hop_midbot": (bot, [mid, bot]), "2hop_topbot": (bot, [top, bot]),
    }


def star_classes(r1: str, child: str, r2: str) -> dict[str, tuple[str, list[str]]]:
    return {
        "0hop_r1": (r1, [r1]), "0hop_r2": (r2, [r2]), "0hop_c": (child, [child]), "1hop_r1c": (child, [r1, child]),
        "1hop_r2c": (child, [r2, child]), "cross_r1r2": (child, [r1, r2]),
    }


def deep_classes(geo: str, top: str, mid: str, bot: str) -> dict[str, tuple[str, list[str]]]:
    """Classes of a chain of four roles."""
    return {
        "0hop_top": (top, [top]), "0hop_bot": (bot, [bot]), "1hop_topmid": (mid, [top, mid]),
        "1hop_midbot": (bot, [mid, bot]), "2hop_topbot": (bot, [top, bot]), "2hop_geomid": (mid, [geo, mid]),
        "3hop": (bot, [geo, bot]), "3hop_all": (bot, [geo, mid, bot]),
    }


def condition(query: CountQuery) -> Column:
    parts = [F.col(column(r, a)).isin(*codes) if codes else F.lit(False) for r, a, codes in query.conditions]
    return reduce(Column.__and__, parts, F.lit(True))


def count_one(schema: Schema, tables: Mapping[str, DataFrame], query: CountQuery, policy: str = "drop") -> DataFrame:
    """One row, column answer; joins only the roles that the query names, filters what they scan."""
    wanted = [(r, a) for r, a, _ in query.conditions]
    return view(
        schema,
        tables,
        query.role,
        wanted,
        policy,
    ).filter(condition(query)).agg(F.count(F.lit(1)).alias("answer"))


def answer(schema: Schema, tables: Mapping[str, DataFrame], queries: Iterable[CountQuery], policy: str = "drop") -> DataFrame:
    """cls, qid, answer of every query."""
    by_view: dict[tuple, list[CountQuery]] = {}
    for q in queries:
        # Queries over the same roles share a view; one more role would cost the others a join.
        by_view.setdefault((q.role, tuple(sorted({r for r, _, _ in q.conditions}))), []).append(q)
    spark = next(iter(tables.values())).sparkSession
    # Every query is there with 0, whatever rows its view has.
    parts = [spark.createDataFrame([(q.cls, q.qid, 0) for mine in by_view.values() for q in mine], ANSWER)]
    for (role, _), mine in by_view.items():
        wanted = sorted({(r, a) for q in mine for r, a, _ in q.conditions})
        names = [column(r, a) for r, a in wanted]
        cube = view(schema, tables, role, wanted, policy).groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
        parts.append(cube.select(*names, "__n").mapInArrow(_summed(mine, names), ANSWER))
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("cls", "qid").agg(F.sum("answer").alias("answer"))


#: What one task found of every query.
ANSWER = "cls string, qid int, answer long"


def _summed(queries: Sequence[CountQuery], names: Sequence[str]):
    """A function over batches of tuples and their counts that sums the counts for every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(queries), np.int64)
        for batch in batches:
            # A null code satisfies no condition, as codes are never negative.
            codes = {c: batch.column(i).cast(pa.int64()).fill_null(-1).to_numpy() for i, c in enumerate(names)}
            n = batch.column(len(names)).to_numpy(zero_copy_only=False)
            masks: dict[tuple, np.ndarray] = {}
            for k, q in enumerate(queries):
                hit = n
                for r, a, some in q.conditions:
                    key = (column(r, a), some)
                    if key not in masks:
                        masks[key] = np.isin(codes[key[0]], some)
                    hit = hit * masks[key]
                sums[k] += hit.sum()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([q.cls for q in queries], pa.string()),
                pa.array([q.qid for q in queries], pa.int32()),
                pa.array(sums),
            ],
            names=["cls", "qid", "answer"],
        )

    return run


def fixed_values(
    schema: Schema, upper: str, lower: str, per_class: int = PER_CLASS, seed: int = SEED, above: int = 12, below: int = 10, most: int = 3
) -> list[CountQuery]:
    """Queries of the classes 2hop, 1hop (the lower role alone) and 0hop (the upper role alone).

    Each side has one or two attributes and for each 1 to `most` values out of the first `above` or `below` ones,
    whatever the domain is.
    """
    r, out = random.Random(seed), []

    def side(role: str, values: int) -> list[tuple]:
        attrs = list(schema.roles[role].attrs)
        chosen = sorted(r.sample(attrs, r.randint(1, min(2, len(attrs)))))
        return [(role, a, tuple(sorted(r.sample(range(values), r.randint(1, most))))) for a in chosen]

    for qid in range(per_class):
        high, low = side(upper, above), side(lower, below)
        out.append(CountQuery("2hop", qid, lower, (*high, *low)))
        out.append(CountQuery("1hop", qid, lower, tuple(low)))
        out.append(CountQuery("0hop", qid, upper, tuple(high)))
    return out


def qualifying(children: DataFrame, fk: str, parents: DataFrame, pk: str, keep: Column) -> DataFrame:
    """The children of the parents that qualify; parents are only a filter, so no column of theirs is carried."""
    return children.join(parents.filter(keep).select(F.col(pk).alias("__pk")), F.col(fk) == F.col("__pk"), "left_semi")


def relative_errors(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """cls, qid, real, synthetic, re = |synthetic - real| / max(real, 1)."""
    a = real.withColumnRenamed("answer", "real")
    b = synthetic.withColumnRenamed("answer", "synthetic")
    gap = F.abs(F.col("synthetic") - F.col("real")) / F.greatest(F.col("real"), F.lit(1))
    return a.join(b, ["cls", "qid"]).withColumn("re", gap)


def error_medians(errors: DataFrame, large: int = LARGE) -> DataFrame:
    """cls, n, n_large, median_re, median_re_large."""
    big = F.col("real") >= large
    return errors.groupBy("cls").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(big).alias("n_large"),
        F.median("re").alias("median_re"),
        F.median(F.when(big, F.col("re"))).alias("median_re_large"),
    )


def sql_of(query: CountQuery, source: str) -> str:
    """The query as SQL over a view named `source` with role__attr columns."""
    tests = [f"{column(r, a)} IN ({','.join(map(str, codes))})" for r, a, codes in query.conditions] or ["TRUE"]
    return f"SELECT '{query.cls}' AS cls, {query.qid} AS qid, count(*) AS answer FROM {source} WHERE {' AND '.join(tests)}"
