"""The data folder's tables as coded roles: a chain of customers, orders and lineitems, and stars around lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.encode import divided, passed, value_list
from kinweave.operators.views import ranked
from kinweave.schema import Role, Schema

#: Fixed value lists of the coded attributes.
STATUSES = ("O", "F", "P")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
FLAGS = ("A", "N", "R")
LINE_STATUSES = ("F", "O")
DISCOUNT_EDGES = (0.02, 0.05, 0.08)
#: The columns of a lineitem, in the order that keys follow.
LINE_ORDER = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)

REGION = Role("region", "rkey", {"RNAME": 5})
NATION = Role("nation", "nkey", {"NCODE": 25}, {"region": "rkey"})
TOP = Role("customer", "ckey", {"NATION": 25, "SEGMENT": 5, "ACCTBIN": 22})
GEO_TOP = Role("customer", "ckey", {"NATION": 25, "SEGMENT": 5, "ACCTBIN": 22}, {"nation": "nkey"})
MID = Role("orders", "okey", {"STATUS": 3, "YEAR": 7, "MONTH": 12, "PRIORITY": 5}, {"customer": "ckey"})
BOT = Role("lineitem", "lkey", {"QBIN": 6, "DBIN": 4, "RFLAG": 3, "LSTATUS": 2}, {"orders": "okey"})
CHAIN = Schema.chain(TOP, MID, BOT)
DEEP = Schema.of(REGION, NATION, GEO_TOP, MID, BOT)
PART = Role("part", "pkey", {"PTYPE": 6, "PSIZEBIN": 5})
STAR_ORDERS = Role("orders", "okey", {"YEAR": 7, "PRIORITY": 5, "STATUS": 3})
STAR_CHILD = Role("lineitem", "lkey", {"QBIN": 6, "RFLAG": 3}, {"part": "pkey", "orders": "okey"})
STAR = Schema.star(PART, STAR_CHILD, STAR_ORDERS)
SUPPLIER = Role("supplier", "skey", {"SNATION": 25})
STAR_B_CHILD = Role("lineitem", "lkey", {"DBIN": 4, "LSTATUS": 2}, {"supplier": "skey", "part": "pkey"})
STAR_B = Schema.star(SUPPLIER, STAR_B_CHILD, PART)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("long").alias("rkey"), value_list(F.col("r_name"), REGIONS).alias("RNAME")
    )


def nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("nkey"), F.col("n_regionkey").cast("long").alias("rkey"), F.col("n_nationkey").alias("NCODE")
    )


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.least(F.greatest(F.col("c_acctbal"), F.lit(-1000.0)), F.lit(9999.99))
    return _read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ckey"),
        F.col("c_nationkey").cast("long").alias("nkey"),
        F.col("c_nationkey").alias("NATION"),
        value_list(F.col("c_mktsegment"), SEGMENTS).alias("SEGMENT"),
        divided(balance, 500.0, 0, 21, 1000.0).alias("ACCTBIN"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("okey"),
        F.col("o_custkey").alias("ckey"),
        value_list(F.col("o_orderstatus"), STATUSES).alias("STATUS"),
        (F.year("o_orderdate") - 1995).alias("YEAR"),
        (F.month("o_orderdate") - 1).alias("MONTH"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("PRIORITY"),
    )


def lineitem(spark: SparkSession, sf_dir: str, keyed: bool = False) -> DataFrame:
    """Coded lineitems; lkey, the row's place in the order of all columns, only where asked for, and else 0.

    Equal rows take neighbouring places, which of them which makes no difference.
    """
    raw = _read(spark, sf_dir, "lineitem")
    raw = ranked(raw, [], LINE_ORDER, "lkey") if keyed else raw.withColumn("lkey", F.lit(0).cast("long"))
    return raw.select(
        "lkey",
        F.col("l_orderkey").alias("okey"),
        F.col("l_partkey").alias("pkey"),
        F.col("l_suppkey").alias("skey"),
        divided(F.col("l_quantity"), 10.0, 0, 5).alias("QBIN"),
        passed(F.col("l_discount"), DISCOUNT_EDGES).alias("DBIN"),
        value_list(F.col("l_returnflag"), FLAGS).alias("RFLAG"),
        value_list(F.col("l_linestatus"), LINE_STATUSES).alias("LSTATUS"),
    )


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pkey"),
        value_list(F.col("p_type"), TYPES).alias("PTYPE"),
        divided(F.col("p_size") - 1, 10.0, 0, 4).alias("PSIZEBIN"),
    )


def supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("skey"),
        F.col("s_nationkey").alias("SNATION"),
    )


def tables(spark: SparkSession, sf_dir: str, schema: Schema, keyed: bool = False) -> dict[str, DataFrame]:
    """The schema's roles over a data folder."""
    makers = {"region": region, "nation": nation, "customer": customer, "orders": orders, "part": part, "supplier": supplier}
    return {r: lineitem(spark, sf_dir, keyed) if r == "lineitem" else makers[r](spark, sf_dir) for r in schema.roles}


#: The coded roles as DuckDB views for the oracle queries, in the same names and codes.
SQL = f"""
 region_ AS (SELECT CAST(r_regionkey AS BIGINT) AS rkey, CAST(dense_rank() OVER (ORDER BY r_name) - 1 AS INTEGER) AS RNAME FROM region),
 nation_ AS (SELECT CAST(n_nationkey AS BIGINT) AS nkey, CAST(n_regionkey AS BIGINT) AS rkey, n_nationkey AS NCODE FROM nation),
 customer_ AS (
  SELECT c_custkey AS ckey, CAST(c_nationkey AS BIGINT) AS nkey, c_nationkey AS NATION,
   CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS SEGMENT,
   CAST(least(greatest(floor((least(greatest(c_acctbal, -1000.0::DOUBLE), 9999.99::DOUBLE) + 1000.0::DOUBLE) / 500.0::DOUBLE), 0), 21) AS INTEGER) AS ACCTBIN
  FROM customer),
 orders_ AS (
  SELECT o_orderkey AS okey, o_custkey AS ckey,
   CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS STATUS,
   CAST(year(o_orderdate) - 1995 AS INTEGER) AS YEAR, CAST(month(o_orderdate) - 1 AS INTEGER) AS MONTH,
   CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS PRIORITY
  FROM orders),
 lineitem_ AS (
  SELECT row_number() OVER (ORDER BY {", ".join(LINE_ORDER)}) - 1 AS lkey, l_orderkey AS okey, l_partkey AS pkey, l_suppkey AS skey,
   CAST(least(greatest(floor(l_quantity / 10.0::DOUBLE), 0), 5) AS INTEGER) AS QBIN,
   CAST(l_discount >= 0.02::DOUBLE AS INTEGER) + CAST(l_discount >= 0.05::DOUBLE AS INTEGER) + CAST(l_discount >= 0.08::DOUBLE AS INTEGER) AS DBIN,
   CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS RFLAG,
   CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS LSTATUS
  FROM lineitem),
 part_ AS (
  SELECT p_partkey AS pkey, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS PTYPE,
   CAST(least(greatest(floor((p_size - 1) / 10.0::DOUBLE), 0), 4) AS INTEGER) AS PSIZEBIN
  FROM part),
 supplier_ AS (SELECT s_suppkey AS skey, s_nationkey AS SNATION FROM supplier)
"""


def with_sql(body: str, more: str = "") -> str:
    """An oracle query over the coded views; `more` are further WITH entries."""
    return "WITH" + SQL + ("," + more if more else "") + body


def wide_sql(schema: Schema, start: str) -> str:
    """SELECT of a schema's view from `start`, every reachable role joined, with role__attr columns."""
    reached, hops, todo = [start], [], [start]
    while todo:
        r = todo.pop(0)
        for up, fk in schema.roles[r].parents.items():
            if up not in reached:
                reached.append(up)
                todo.append(up)
                hops.append((r, up, fk, schema.roles[up].key))
    columns = ", ".join(f"{r}_.{a} AS {r}__{a}" for r in reached for a in schema.roles[r].attrs)
    joins = "".join(f" JOIN {up}_ ON {r}_.{fk} = {up}_.{pk}" for r, up, fk, pk in hops)
    return f"SELECT {columns} FROM {start}_{joins}"
