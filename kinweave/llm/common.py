"""What the operators of this subpackage share: table access, scratch tables and gapless ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from kinweave.scratch import cut, free

__all__ = ["add_columns", "count_of", "cut", "free", "gapless", "table"]

#: Rows that a function of `add_columns` gets at once at most.
ROWS_AT_ONCE = 512
#: Equal rows that `gapless` numbers in one place.
EQUAL_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder; the path may be one that only Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add_columns(df: DataFrame, inputs: Sequence[str], fields: str, f: Callable[..., Sequence[list]]) -> DataFrame:
    """df with the columns that f computes; fields is their schema in DDL.

    f gets one list for each input column, of at most ROWS_AT_ONCE rows, and returns a list for each field.
    All columns of df pass through as Arrow data, untouched; one named like a field is replaced.
    """
    new = StructType.fromDDL(fields)
    kept = [c for c in df.columns if c not in new.names]
    both = list(dict.fromkeys([*kept, *inputs]))
    schema = StructType([*(df.schema[c] for c in kept), *new.fields])
    kinds = [to_arrow_type(x.dataType) for x in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                made = f(*(part.column(both.index(c)).to_pylist() for c in inputs))
                arrays = [pa.array(x, k) for x, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(both.index(c)) for c in kept), *arrays], names=schema.names
                )
        pa.default_memory_pool().release_unused()  # the worker lives on, and other tasks need the memory

    return df.select(*both).mapInArrow(run, schema)


def gapless(
    df: DataFrame, group: Sequence[str], key: Sequence[str], out: str, cells: Column | int = 64
) -> DataFrame:
    """Number the rows of each group from 0 without gaps, as column `out` (long).

    df must consist of the columns `group` and `key` alone. Equal rows are counted before any shuffle, dealt in
    lots of EQUAL_ROWS, and numbered by `explode`; a group is dealt over `cells` cells by a hash of its key and
    lot, each counted and numbered apart. So no task holds more than one cell of distinct rows, however large a
    group or a set of equal rows is. Nulls are values like any other. Numbers depend on the rows alone, not on
    their order.
    """
    group, key = list(group), list(key)
    n_cells = F.lit(cells) if isinstance(cells, int) else cells
    rows = df.groupBy(*group, *key).agg(F.count(F.lit(1)).alias("__all"))
    rows = rows.withColumn("__lot", F.explode(F.sequence(F.lit(0), F.expr(f"(__all - 1) div {EQUAL_ROWS}")))).select(
        *group,
        *key,
        "__lot",
        F.least(F.lit(EQUAL_ROWS), F.col("__all") - F.col("__lot") * EQUAL_ROWS).cast("long").alias("__n"),
        F.pmod(F.xxhash64(*group, *key, "__lot"), n_cells.cast("long")).alias("__cell"),
    )
    sums = rows.groupBy(*group, "__cell").agg(F.sum("__n").alias("__m"))
    before = Window.partitionBy(*group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "__cell", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__base"))
    within = (
        Window.partitionBy(*group, "__cell").orderBy(*key, "__lot").rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.withColumn("__before", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    left, right = rows.alias("l"), sums.alias("r")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "__cell"]]
    on = same[0]
    for x in same[1:]:
        on = on & x
    first = F.col("r.__base") + F.col("l.__before")
    return left.join(right, on).select(
        *(F.col(f"l.{c}") for c in [*group, *key]),
        F.explode(F.sequence(first, first + F.col("l.__n") - 1)).alias(out),
    )


def count_of(kind: str, spans: str = "spans") -> Column:
    """How many structs of an array have this kind, as long."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
