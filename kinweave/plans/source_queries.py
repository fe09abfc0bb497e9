"""Registered queries that write a dialect to the shared folder and read it back: scans, archives and sinks."""

from __future__ import annotations

import atexit
import contextlib
import json
import os
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import plant as PL
from kinweave.plans import fixtures as X
from kinweave.plans.registry import raw, register
from kinweave.schema import Role, Schema
from kinweave.scratch import shared_folder
from kinweave.sources import readers as R
from kinweave.sources import writers as K


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/sources-{uuid.uuid4().hex}"


# Scans --------------------------------------------------------------------------------------------------------


@register("src_csv", "SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders")
def src_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A headed CSV file, three of its columns in another order."""
    path = _place(spark)
    raw(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").write.option("header", True).csv(path)
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"
    return R.read_csv(spark, path, schema, ["o_orderstatus", "o_orderkey", "o_totalprice"])


@register("src_coded", X.with_sql("SELECT okey, ckey, STATUS, YEAR, MONTH, PRIORITY FROM orders_"))
def src_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A role's table whose foreign key comes last and whose attributes stand in another order."""
    path = _place(spark)
    X.orders(spark, sf_dir).select("okey", "PRIORITY", "MONTH", "YEAR", "STATUS", "ckey").write.option("header", True).csv(path)
    return R.read_coded(spark, path, X.MID)


@register(
    "src_tables",
    X.with_sql(" UNION ALL ".join(
        f"SELECT '{r}' AS role, count(*) AS n, CAST(sum({role.key}) AS BIGINT) AS keys, CAST(sum({next(iter(role.sizes))}) AS BIGINT) AS codes FROM {r}_" for r, role in X.STAR.roles.items() if r != "lineitem"
    )),
)
def src_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database written as CSV folders and read by its schema."""
    schema = Schema.of(X.PART, X.STAR_ORDERS)
    path = _place(spark)
    K.write_tables(X.tables(spark, sf_dir, schema), path, schema, "csv")
    out = None
    for r, df in R.read_tables(spark, path, schema, {r: r for r in schema.roles}).items():
        role = schema.roles[r]
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(role.key).alias("keys"), F.sum(role.attrs[0]).alias("codes")).select(F.lit(r).alias("role"), "n", "keys", "codes")
        out = row if out is None else out.unionByName(row)
    return out


@register("src_domain", "SELECT attr, size FROM (VALUES " + ", ".join(f"('{a}', {n})" for a, n in X.MID.sizes.items()) + ") v(attr, size)")
def src_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain sizes through their JSON file."""
    path = _place(spark)
    K.write_domain(spark, X.MID.sizes, path)
    return spark.createDataFrame(list(R.read_domain(spark, path).items()), "attr string, size int")


@register("src_tbl", "SELECT p_partkey, p_type, p_size FROM part")
def src_tbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A headless file of fields that end in |, its first three columns."""
    path = _place(spark)
    p = raw(spark, sf_dir, "part")
    p.select(F.concat(F.concat_ws("|", "p_partkey", "p_type", "p_size", F.lit("rest"), F.lit("more")), F.lit("|"))).write.text(path)
    return R.read_tbl(spark, path, "p_partkey long, p_type string, p_size int")


@register("src_double_colon", "SELECT p_partkey, p_type || 'é' AS name, p_size FROM part")
def src_double_colon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A headless Latin-1 file with :: between fields."""
    path = _place(spark)
    p = raw(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", F.lit("é")), "p_size")
    p.write.options(sep="::", encoding="ISO-8859-1").csv(path)
    return R.read_double_colon(spark, path, "p_partkey long, name string, p_size int")


@register(
    "src_tsv",
    "SELECT event_id, CASE WHEN event_id % 4 NOT IN (0, 1, 2) THEN event_type END AS event_type, CASE WHEN event_id % 5 <> 0 THEN user_id END AS user_id FROM events",
)
def src_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A headed TSV file without quoting, with three null tokens and numbers that can't be read."""
    path = _place(spark)
    k = F.col("event_id") % 4
    kind = F.when(k == 0, F.lit("\\N")).when(k == 1, F.lit("NA")).when(k == 2, F.lit("")).otherwise(F.col("event_type"))
    user = F.when(F.col("event_id") % 5 == 0, F.lit('"odd')).otherwise(F.col("user_id").cast("string"))
    e = raw(spark, sf_dir, "events").select("event_id", kind.alias("event_type"), user.alias("user_id"), F.lit("x").alias("unread"))
    e.write.options(header=True, sep="\t", quote="", escape="", emptyValue="").csv(path)
    return R.read_tsv(spark, path, {"event_id": "long", "event_type": "string", "user_id": "long"})


@register("src_filtered", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def src_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large CSV file read in parallel with a filter that the scan applies."""
    path = _place(spark)
    raw(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag", "l_tax").write.option("header", True).csv(path)
    df = R.read_csv(spark, path, "l_orderkey long, l_quantity double, l_returnflag string, l_tax double")
    return df.filter("l_quantity > 45 AND l_returnflag = 'R'").select("l_orderkey", "l_quantity")


@register("src_commented", "SELECT CAST(n_nationkey AS INTEGER) AS k, n_name AS v FROM nation")
def src_commented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A headed TSV file with comments before the header and between rows."""
    path = f"{_place(spark)}/notes.tsv"
    rows = raw(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()
    lines = ["# first note", "k\tv", *(f"{r[0]}\t{r[1]}" + ("\n# note" if r[0] % 7 == 0 else "") for r in rows)]
    K.write_text(spark, "\n".join(lines) + "\n", path)
    return R.read_commented(spark, path, "k int, v string")


_RECORD = "method string, eps double, seed int, re double"


def _archive(spark: SparkSession, sf_dir: str) -> str:
    """One record a file for every nation, and files that an archive scan must pass over."""
    folder = _place(spark)
    for key, name in raw(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():
        record = {"method": name, "eps": 0.5 * (key % 3), "seed": key, "re": key / 4}
        K.write_text(spark, json.dumps(record, indent=1), f"{folder}/{K.record_name('m', 'natural', 0.5 * (key % 3), key)}.json")
    for name in ("._m.json", "m_sub3.json", "m_xhoff.json"):
        K.write_text(spark, json.dumps({"method": "unwanted", "eps": 1.0, "seed": 99, "re": 0.0}), f"{folder}/{name}")
    K.write_text(spark, '{"method": "broken", "eps":', f"{folder}/m_broken.json")
    return folder


@register("src_archive", "SELECT n_name AS method, 0.5 * (n_nationkey % 3) AS eps, CAST(n_nationkey AS INTEGER) AS seed, n_nationkey / 4.0 AS re FROM nation")
def src_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of JSON files, without those that are named in an unwanted way or can't be read."""
    return R.read_archive(spark, f"{_archive(spark, sf_dir)}/*.json", _RECORD).drop("file")


@register(
    "src_arms",
    "SELECT n_name AS method, 0.5 * (n_nationkey % 3) AS eps, CAST(n_nationkey AS INTEGER) AS seed, CASE WHEN n_nationkey % 2 = 0 THEN 100.0 + n_nationkey ELSE n_nationkey / 4.0 END AS re FROM nation",
)
def src_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive in which the reported arm's records stand for the released ones of the same cell."""
    base, arm = _archive(spark, sf_dir), _place(spark)
    n = raw(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0")
    for key, name in n.select("n_nationkey", "n_name").collect():
        record = {"method": name, "eps": 0.5 * (key % 3), "seed": key, "re": 100.0 + key}
        K.write_text(spark, json.dumps(record), f"{arm}/{K.record_name('m', 'natural', 0.5 * (key % 3), key, 'arm')}.json")
    return R.read_arms(spark, f"{base}/*.json", f"{arm}/*.json", _RECORD, ["method", "eps", "seed"]).drop("file")


@register("src_jdbc", "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name FROM nation")
def src_jdbc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database's table read whole by one task."""
    url = _database(spark, sf_dir)
    return _named(R.read_jdbc(spark, url, "NATION", driver=_DRIVER))


@register("src_jdbc_ranges", "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name FROM nation")
def src_jdbc_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table in ranges of its key, kept range by range; a second reading finds the first ranges there."""
    url, folder = _database(spark, sf_dir), _place(spark)
    lowest, highest, step = R.key_ranges(spark, url, "NATION", "K", 4, 16, driver=_DRIVER)
    R.read_jdbc_resumed(spark, url, "NATION", "K", lowest, min(lowest + 3 * step - 1, highest), folder, step, driver=_DRIVER)
    return _named(R.read_jdbc_resumed(spark, url, "NATION", "K", lowest, highest, folder, step, driver=_DRIVER))


@register("src_jdbc_parallel", "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name FROM nation")
def src_jdbc_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table in ranges of its key, a task each, in one job."""
    url = _database(spark, sf_dir)
    lowest, highest, step = R.key_ranges(spark, url, "NATION", "K", 7, 32, driver=_DRIVER)
    return _named(R.read_jdbc_ranges(spark, url, "NATION", "K", lowest, highest, step, driver=_DRIVER))


_DRIVER = "org.apache.derby.jdbc.EmbeddedDriver"


def _database(spark: SparkSession, sf_dir: str) -> str:
    """The URL of a Derby database with the table NATION, which every executor can open.

    Derby lets one process open a database, but any number of them one that is packed into an archive. It is made on
    the driver and packed into the shared folder; where that isn't mounted as files, Spark hands the archive to the
    executors, which have it on their class path.
    """
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    place = jvm.org.apache.hadoop.fs.Path(_place(spark))
    mounted = place.getFileSystem(context._jsc.hadoopConfiguration()).getScheme() == "file"
    folder = place.toUri().getPath() if mounted else tempfile.mkdtemp(prefix="kinweave-")
    os.makedirs(folder, exist_ok=True)
    name = f"db{uuid.uuid4().hex}"
    driver, none = jvm.org.apache.derby.jdbc.EmbeddedDriver(), jvm.java.util.Properties()
    session = driver.connect(f"jdbc:derby:{folder}/{name};create=true", none)
    try:
        session.setAutoCommit(False)
        session.createStatement().execute("CREATE TABLE NATION (K INTEGER, NAME VARCHAR(32672))")
        put = session.prepareStatement("INSERT INTO NATION VALUES (?, ?)")
        for row in raw(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int"), "n_name").toLocalIterator():
            for k, value in enumerate(row, 1):
                put.setObject(k, value)
            put.executeUpdate()
        session.commit()
    finally:
        session.close()
        with contextlib.suppress(Py4JJavaError):  # Derby says by an exception that the database is closed
            driver.connect(f"jdbc:derby:{folder}/{name};shutdown=true", none)
    archive = shutil.make_archive(f"{folder}/{name}", "zip", folder, name)
    shutil.rmtree(f"{folder}/{name}")
    if mounted:
        return f"jdbc:derby:jar:({archive}){name}"
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sql(f"ADD JAR '{archive}'")
    return f"jdbc:derby:classpath:{name}"


def _named(df: DataFrame) -> DataFrame:
    return df.select(F.col("K").alias("n_nationkey"), F.col("NAME").alias("n_name"))


# Sinks --------------------------------------------------------------------------------------------------------


@register("snk_parquet", X.with_sql("SELECT STATUS, YEAR, count(*) AS n FROM orders_ GROUP BY ALL"))
def snk_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as Parquet folders, in the schema's columns."""
    path, schema = _place(spark), Schema.of(X.STAR_ORDERS)
    K.write_tables(X.tables(spark, sf_dir, schema), path, schema)
    back = R.read_tables(spark, path, schema, {"orders": "orders"}, "parquet")["orders"]
    return back.groupBy("STATUS", "YEAR").agg(F.count(F.lit(1)).alias("n"))


@register("snk_record", "SELECT 'm_natural_eps0.80_seed7_arm' AS name, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM orders")
def snk_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result record as JSON under its name."""
    path, name = _place(spark), K.record_name("m", "natural", 0.8, 7, "arm")
    record = raw(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean"))
    K.write_record(record, path, name)
    back = spark.read.schema("n long, mean double").json(f"{path}/{name}")
    return back.select(F.lit(name).alias("name"), "n", "mean")


@register(
    "snk_processed",
    X.with_sql(
        """SELECT 'orders' AS part, 'rows' AS name, count(*) AS n FROM orders_ UNION ALL SELECT 'report', 'orphans', 0
         UNION ALL SELECT 'report', 'orders', count(*) FROM orders_ UNION ALL SELECT 'spec', 'tables', 2 UNION ALL SELECT 'spec', 'rules', 1 UNION ALL SELECT 'domain', a, n FROM (VALUES """
        + ", ".join(f"('{a}', {n})" for a, n in X.MID.sizes.items())
        + ") v(a, n)"
    ),
)
def snk_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A processed database with domain, spec and report files, read back."""
    schema, path = Schema.chain(X.TOP, X.MID), _place(spark)
    tables = X.tables(spark, sf_dir, schema)
    K.write_processed(spark, tables, path, schema, {"orders.YEAR": "year - 1995"}, {"orphans": 0, "orders": tables["orders"].count()})

    def document(name: str) -> dict:
        return json.loads(spark.read.text(f"{path}/{name}", wholetext=True).first()[0])

    spec, report = document("spec.json"), document("report.json")
    rows = [("orders", "rows", R.read_coded(spark, f"{path}/orders", X.MID).count()), ("spec", "tables", len(spec["tables"])), ("spec", "rules", len(spec["rules"]))]
    rows += [("report", k, v) for k, v in report.items()]
    rows += [("domain", a, n) for a, n in R.read_domain(spark, f"{path}/orders_domain.json").items()]
    return spark.createDataFrame(rows, "part string, name string, n long")


@register("snk_summary", X.with_sql("SELECT SEGMENT, count(*) AS n, round(avg(ACCTBIN), 6) AS mean FROM customer_ GROUP BY 1"))
def snk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small result as one headed TSV file in order, read by the reader of commented files."""
    path = _place(spark)
    found = X.customer(spark, sf_dir).groupBy("SEGMENT").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ACCTBIN"), 6).alias("mean"))
    K.write_summary(found, path, ["SEGMENT"])
    return R.read_commented(spark, path, "SEGMENT int, n long, mean double")


_PLANTED = Schema.chain(Role("customer", "ckey", {"SEGMENT": 5}), Role("orders", "okey", {"STATUS": 3, "OLD": 2, "BIT": 2}, {"customer": "ckey"}))


@register(
    "snk_planted",
    X.with_sql(
        """SELECT 'customer' AS part, SEGMENT AS code, count(*) AS n, 0 AS ones FROM customer_ GROUP BY ALL
         UNION ALL SELECT 'orders', STATUS, count(*), CAST(sum(CAST(YEAR >= 3 AS INTEGER)) AS BIGINT) FROM orders_ GROUP BY ALL
         UNION ALL SELECT 'audit', STATUS, count(*), CAST(sum(CAST(YEAR >= 3 AS INTEGER)) AS BIGINT) FROM orders_ GROUP BY ALL"""
    ),
)
def snk_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A planted database: parents as they were, the child rewritten with its counts kept, the audit beside them."""
    c, path = X.customer(spark, sf_dir), _place(spark)
    o = X.orders(spark, sf_dir).select("okey", "ckey", "STATUS", (F.col("YEAR") >= 3).cast("int").alias("OLD"), (F.col("PRIORITY") >= 2).cast("int").alias("u"))
    wide = o.join(c.select("ckey", (F.col("SEGMENT") >= 2).cast("int").alias("x1"), (F.col("ACCTBIN") >= 11).cast("int").alias("x2")), "ckey")
    planted = PL.plant_chain(wide, "okey", "OLD", "u", "x1", "x2", ["STATUS"], "xor", 0.7, 3, "BIT")
    audit = PL.audit(planted, "OLD", "BIT", ["STATUS"])
    K.write_planted({"customer": c, "orders": o}, "orders", planted, audit, path, _PLANTED)
    back = R.read_tables(spark, path, _PLANTED, {r: r for r in _PLANTED.roles})
    parts = [
        back["customer"].groupBy(F.col("SEGMENT").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("ones")).withColumn("part", F.lit("customer")),
        back["orders"].groupBy(F.col("STATUS").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.sum("BIT").alias("ones")).withColumn("part", F.lit("orders")),
        spark.read.schema("STATUS int, n long, ones_new long").json(f"{path}/audit").select(F.col("STATUS").alias("code"), "n", F.col("ones_new").alias("ones"), F.lit("audit").alias("part")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("part", "code", "n", "ones")
