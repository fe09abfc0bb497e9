"""Sinks: coded and decoded tables, result records, planted copies, summaries."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.schema import Schema


def write_tables(tables: Mapping[str, DataFrame], folder: str, schema: Schema, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Every role's table as key, attributes, foreign keys; one folder of part files each."""
    for r, role in schema.roles.items():
        df = tables[r].select(role.key, *role.attrs, *role.parents.values())
        w = df.write.mode(mode)
        (w.option("header", True).csv if fmt == "csv" else w.parquet)(f"{folder}/{r}")


def write_domain(spark: SparkSession, sizes: Mapping[str, int], path: str, mode: str = "overwrite") -> None:
    """Domain sizes in the form that `readers.read_domain` takes."""
    text = json.dumps({a: {"size": int(n)} for a, n in sizes.items()})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(path)


def record_name(method: str, mode: str, epsilon: float, seed: int, arm: str = "") -> str:
    """The name of a result record; an arm keeps it apart from the default one."""
    return f"{method}_{mode}_eps{epsilon:.2f}_seed{seed}" + (f"_{arm}" if arm else "")


def write_record(record: DataFrame, folder: str, name: str) -> None:
    """One record as JSON; a record of that name is never replaced."""
    record.coalesce(1).write.mode("errorifexists").json(f"{folder}/{name}")


def write_summary(df: DataFrame, path: str, order: Sequence[str], mode: str = "errorifexists") -> None:
    """A small result as one headed TSV file, in order."""
    df.orderBy(*order).coalesce(1).write.mode(mode).options(header=True, sep="\t").csv(path)


def write_text(spark: SparkSession, text: str, path: str, overwrite: bool = False) -> None:
    """A small text as one file, in any store that Spark writes to."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(context._jsc.hadoopConfiguration()).create(place, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_processed(
    spark: SparkSession, tables: Mapping[str, DataFrame], folder: str, schema: Schema, rules: Mapping[str, str], counts: Mapping[str, int]
) -> None:
    """A processed database: a CSV folder and a domain file for each role, what was done (spec) and what was seen (report).

    rules say how each attribute was coded; counts are numbers of rows in and out, orphans and the like.
    """
    write_tables(tables, folder, schema, "csv")
    for r, role in schema.roles.items():
        write_text(spark, json.dumps({a: {"size": n} for a, n in role.sizes.items()}), f"{folder}/{r}_domain.json")
    spec = {r: {"key": x.key, "parents": dict(x.parents), "attributes": list(x.attrs)} for r, x in schema.roles.items()}
    write_text(spark, json.dumps({"tables": spec, "rules": dict(rules)}), f"{folder}/spec.json")
    write_text(spark, json.dumps({k: int(v) for k, v in counts.items()}), f"{folder}/report.json")


def write_planted(tables: Mapping[str, DataFrame], child: str, planted: DataFrame, audit: DataFrame, folder: str, schema: Schema) -> None:
    """A planted database: parents as they were, the child rewritten, and the audit beside them."""
    write_tables({**tables, child: planted}, folder, schema, "csv")
    audit.coalesce(1).write.mode("errorifexists").json(f"{folder}/audit")


def release_record(rel, spark: SparkSession, errors: DataFrame) -> DataFrame:
    """One row: the scales and caps of a release as maps, and median errors by class."""
    hyper = spark.createDataFrame([(dict(rel.sigma), dict(rel.taus))], "sigma map<string,double>, tau map<string,int>")
    medians = errors.agg(F.map_from_entries(F.collect_list(F.struct("cls", "median_re"))).alias("re_median"))
    return hyper.join(medians, F.lit(True))
