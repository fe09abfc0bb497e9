"""Scans: delimited files of several dialects, JSON archives, JDBC tables, domain files.

All are Spark readers with a schema given beforehand, so files are read in parallel, columns are pruned and
filters reach the scan; nothing is inferred.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinweave.schema import Role, Schema


def read_csv(spark: SparkSession, path: str, schema: str | StructType, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """A headed CSV file with the columns of the schema, cut to `columns` in their order."""
    df = spark.read.options(header=True, **options).schema(schema).csv(path)
    return df.select(*columns) if columns else df


def read_coded(spark: SparkSession, path: str, role: Role, fmt: str = "csv") -> DataFrame:
    """A role's table of keys and integer codes: key, foreign keys, attributes, whatever order the file has.

    The file's header decides where a column stands, so foreign keys may come last.
    """
    if fmt == "parquet":
        raw = spark.read.parquet(path)
    else:
        raw = spark.read.options(header=True).csv(path)
    keys = [role.key, *role.parents.values()]
    return raw.select(
        *(F.col(c).cast("long").alias(c) for c in keys),
        *(F.col(a).cast("int").alias(a) for a in role.attrs),
    )


def read_tables(spark: SparkSession, folder: str, schema: Schema, files: Mapping[str, str], fmt: str = "csv") -> dict[str, DataFrame]:
    """Every role's table; files name them by role."""
    return {r: read_coded(spark, f"{folder}/{files[r]}", role, fmt) for r, role in schema.roles.items()}


def read_domain(spark: SparkSession, path: str) -> dict[str, int]:
    """Sizes by attribute from a JSON file {attribute: {"size": n}}, read through Spark from any store."""
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return {a: int(v["size"]) for a, v in json.loads(text).items()}


def read_tbl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A headless file of fields that end in |; fields beyond the schema are left out."""
    return spark.read.options(sep="|", mode="PERMISSIVE", enforceSchema=True).schema(schema).csv(path)


def read_double_colon(spark: SparkSession, path: str, schema: str | StructType, encoding: str = "ISO-8859-1") -> DataFrame:
    """A headless file with :: between fields."""
    return spark.read.options(sep="::", encoding=encoding).schema(schema).csv(path)


def read_tsv(spark: SparkSession, path: str, columns: Mapping[str, str], nulls: Sequence[str] = ("\\N", "", "NA")) -> DataFrame:
    """A headed TSV file without quoting; columns name what is read and the type of each.

    The null tokens, and what can't be cast, become null.
    """
    raw = spark.read.options(header=True, sep="\t", quote="", escape="").csv(path)

    def value(name: str, kind: str):
        text = F.when(~F.col(name).isin(*nulls), F.col(name))
        return (text if kind == "string" else text.try_cast(kind)).alias(name)

    return raw.select(*(value(n, k) for n, k in columns.items()))


def read_commented(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A headed TSV file whose lines that begin with # are comments."""
    return spark.read.options(header=True, sep="\t", comment="#").schema(schema).csv(path)


def read_archive(spark: SparkSession, pattern: str, schema: str | StructType, unwanted: Sequence[str] = ("._", "_sub", "_xhoff")) -> DataFrame:
    """Records of the JSON files of a pattern with their `file`; files named in an unwanted way and broken ones go.

    A name is unwanted if it begins with an entry that begins with a dot, or holds one of the others.
    """
    whole = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kept = StructType([*whole.fields]).add("_corrupt_record", "string")
    df = spark.read.options(
        multiLine=True,
        mode="PERMISSIVE",
        columnNameOfCorruptRecord="_corrupt_record",
    ).schema(kept).json(pattern)
    df = df.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    for u in unwanted:
        df = df.filter(~(F.col("file").startswith(u) if u.startswith(".") else F.col("file").contains(u)))
    return df.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_arms(spark: SparkSession, base: str, reported: str, schema: str | StructType, key: Sequence[str]) -> DataFrame:
    """Records of two archives, the reported ones in place of those with their key in the base."""
    a, b = (read_archive(spark, p, schema) for p in (base, reported))
    return a.join(b, list(key), "left_anti").unionByName(b)


def read_jdbc(spark: SparkSession, url: str, table: str, fetch: int = 5000, **options) -> DataFrame:
    """A table of a database, fetched in lots by one task."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=fetch, **options).load()


def key_ranges(spark: SparkSession, url: str, table: str, column: str, step: int = 200_000, most: int = 1000, **options) -> tuple[int, int, int]:
    """(lowest, highest, step) of ranges that hold all keys of a table; the step is widened if they would be over `most`.

    Keys are whole numbers. A table without any has a highest below its lowest, so no range.
    """
    bounds = f"(SELECT min({column}) AS lowest, max({column}) AS highest FROM {table}) bounds"
    lowest, highest = read_jdbc(spark, url, bounds, **options).first()
    if lowest is None:
        return 0, -1, step
    return int(lowest), int(highest), max(step, -(-(int(highest) - int(lowest) + 1) // most))


def read_jdbc_ranges(
    spark: SparkSession, url: str, table: str, column: str, lowest: int, highest: int, step: int = 200_000, fetch: int = 5000, **options
) -> DataFrame:
    """A table of a database in ranges of a key, one task each; a range that fails is tried again as its task is.

    Rows without a key are a range of their own. `key_ranges` gives bounds that leave out no row.
    """
    return spark.read.jdbc(
        url, table, predicates=[*range_predicates(column, lowest, highest, step), f"{column} IS NULL"],
        properties={"fetchsize": str(fetch)} | {k: str(v) for k, v in options.items()},
    )


def read_jdbc_resumed(
    spark: SparkSession, url: str, table: str, column: str, lowest: int, highest: int, folder: str, step: int = 200_000,
    tries: int = 3, **options,
) -> DataFrame:
    """A table of a database, kept in `folder` range by range; ranges that are there already are not read again.

    Each missing range is a job of its own, tried `tries` times beside Spark's own repeats of its task. A range counts
    as there when its folder was written whole. Rows without a key are a range of their own. The folder may hold ranges
    of other bounds or steps; they are not returned.
    """
    places = _places(column, lowest, highest, step, folder)
    for predicate, place in _missing(spark, places):
        error = None
        for _ in range(tries):
            try:
                df = spark.read.jdbc(url, table, predicates=[predicate], properties={k: str(v) for k, v in options.items()})
                df.write.mode("overwrite").parquet(place)
                break
            except Exception as e:  # the next try, or the caller, decides
                error = e
        else:
            raise RuntimeError(f"{predicate} of {table} could not be read") from error
    return spark.read.parquet(*(place for _, place in places))


def _places(column: str, lowest: int, highest: int, step: int, folder: str) -> list[tuple[str, str]]:
    """(condition, folder) of every range; folders are named by what they hold."""
    names = [f"{a}_to_{min(a + step - 1, highest)}" for a in range(lowest, highest + 1, step)]
    conditions = range_predicates(column, lowest, highest, step)
    return [(p, f"{folder}/range={n}") for p, n in zip([*conditions, f"{column} IS NULL"], [*names, "none"], strict=True)]


def _missing(spark: SparkSession, places: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(condition, folder) of the ranges that are not there."""
    context = spark.sparkContext
    out = []
    for predicate, place in places:
        mark = context._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
        if not mark.getFileSystem(context._jsc.hadoopConfiguration()).exists(mark):
            out.append((predicate, place))
    return out


def range_predicates(column: str, lowest: int, highest: int, step: int) -> list[str]:
    """Conditions that cut lowest to highest into ranges of `step` keys."""
    return [f"{column} BETWEEN {a} AND {min(a + step - 1, highest)}" for a in range(lowest, highest + 1, step)]
