"""Registered queries over a data folder, each with DuckDB SQL of the same result where SQL can express it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.functions import encode as E
from kinweave.functions.accountant import geometric_bins, hybrid_bins
from kinweave.functions.noise import bits, bits_sql, gaussian_sql
from kinweave.operators import calibrate as C
from kinweave.operators import encode as fit
from kinweave.operators import marginals as M
from kinweave.operators import metrics as MX
from kinweave.operators import plant as PL
from kinweave.operators import sampling as SA
from kinweave.operators import sizes as S
from kinweave.operators import views as V
from kinweave.operators import workload as W
from kinweave.plans import fixtures as X
from kinweave.plans.registry import ORACLES, QUERIES, register
from kinweave.plans.registry import raw as _raw
from kinweave.streaming.incremental import windowed_marginal as windowed

#: Caps of group sizes in the registered queries.
TAU_ORDERS, TAU_LINES = 15, 8


def rounded(column: str, digits: int = M.DECIMALS):
    return F.round(column, digits).alias(column)


# Encoders -----------------------------------------------------------------------------------------------------

register("enc_top", X.with_sql("SELECT ckey, NATION, SEGMENT, ACCTBIN FROM customer_"))(
    lambda s, d: X.customer(s, d).drop("nkey")
)
register("enc_mid", X.with_sql("SELECT * FROM orders_"))(X.orders)
register("enc_bot", X.with_sql("SELECT * EXCLUDE (lkey) FROM lineitem_"))(lambda s, d: X.lineitem(s, d).drop("lkey"))
register("enc_star_r1", X.with_sql("SELECT * FROM part_"))(X.part)
register("enc_star_r2", X.with_sql("SELECT okey, YEAR, PRIORITY, STATUS FROM orders_"))(
    lambda s, d: X.orders(s, d).select("okey", "YEAR", "PRIORITY", "STATUS")
)
register("enc_star_c", X.with_sql("SELECT pkey, okey, QBIN, RFLAG FROM lineitem_"))(
    lambda s, d: X.lineitem(s, d).select("pkey", "okey", "QBIN", "RFLAG")
)


@register("enc_sorted", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderdate) - 1 AS INTEGER) AS code FROM orders")
def enc_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each order's date among the dates that occur."""
    return fit.encode_sorted(_raw(spark, sf_dir, "orders"), "o_orderdate", "code").select("o_orderkey", "code")


@register(
    "enc_top_k_other",
    """WITH n AS (SELECT c_nationkey AS v, count(*) AS n FROM customer GROUP BY 1),
     r AS (SELECT v, n, row_number() OVER (ORDER BY n DESC, v) - 1 AS r FROM n)
     SELECT v AS c_nationkey, CAST(least(r, 15) AS INTEGER) AS code, n FROM r""",
)
def enc_top_k_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.top_values(_raw(spark, sf_dir, "customer"), "c_nationkey", 16)


@register(
    "enc_top_k_rows",
    """WITH n AS (SELECT c_nationkey AS v, count(*) AS n FROM customer GROUP BY 1),
     r AS (SELECT v, row_number() OVER (ORDER BY n DESC, v) - 1 AS r FROM n)
     SELECT c_custkey, CAST(least(r, 15) AS INTEGER) AS code FROM customer JOIN r ON c_nationkey = v""",
)
def enc_top_k_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.encode_top(_raw(spark, sf_dir, "customer"), "c_nationkey", "code", 16).select("c_custkey", "code")


@register(
    "enc_median_split",
    "SELECT o_orderkey, CAST(o_totalprice > (SELECT median(o_totalprice) FROM orders) AS INTEGER) AS code FROM orders",
)
def enc_median_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.median_split(_raw(spark, sf_dir, "orders"), "o_totalprice", "code").select("o_orderkey", "code")


def _quantile_sql(op: str, n: int) -> str:
    cuts = " + ".join(f"CAST(o_totalprice {op} q[{k}] AS INTEGER)" for k in range(1, n))
    shares = ", ".join(repr(k / n) for k in range(1, n))
    return f"WITH c AS (SELECT quantile_cont(o_totalprice, [{shares}]) AS q FROM orders) SELECT o_orderkey, {cuts} AS code FROM orders, c"


register("enc_quantile_left", _quantile_sql(">", 10))(
    lambda s, d: fit.quantile_bins(_raw(s, d, "orders"), "o_totalprice", "code", 10, False).select("o_orderkey", "code")
)
register("enc_quantile_right", _quantile_sql(">=", 3))(
    lambda s, d: fit.quantile_bins(_raw(s, d, "orders"), "o_totalprice", "code", 3, True).select("o_orderkey", "code")
)


@register(
    "enc_case_bins",
    "SELECT p_partkey, CASE WHEN p_size >= 40 THEN 3 WHEN p_size >= 20 THEN 2 WHEN p_size >= 10 THEN 1 ELSE 0 END AS code FROM part",
)
def enc_case_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("p_size")
    return _raw(spark, sf_dir, "part").select(
        "p_partkey",
        E.cases([(x >= 10, 1), (x >= 20, 2), (x >= 40, 3)], 0).alias("code"),
    )


@register(
    "enc_date_parts",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m,
     CAST(date_trunc('month', o_orderdate) AS DATE) AS first_day FROM orders""",
)
def enc_date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, m = F.year("o_orderdate"), F.month("o_orderdate")
    return _raw(spark, sf_dir, "orders").select(
        "o_orderkey",
        y.alias("y"),
        m.alias("m"),
        E.first_of_month(y - 1995, m - 1, 1995).alias("first_day"),
    )


@register(
    "enc_na_bin",
    """SELECT e.event_id, CASE e.event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS code FROM events e""",
)
def enc_na_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir, "events").select(
        "event_id",
        E.value_list(F.col("event_type"), ["click", "view"]).alias("code"),
    )


@register(
    "enc_lookup",
    "SELECT p_partkey, CASE least(greatest(p_size // 10, 0), 3) WHEN 0 THEN 7 WHEN 1 THEN 5 WHEN 2 THEN 3 ELSE 1 END AS code FROM part",
)
def enc_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir, "part").select(
        "p_partkey",
        E.looked_up(F.floor(F.col("p_size") / 10), [7, 5, 3, 1]).alias("code"),
    )


@register(
    "enc_cap_shift",
    "SELECT l_orderkey, l_linenumber, CAST(least(greatest(l_linenumber, 1), 4) - 1 AS INTEGER) AS code FROM lineitem",
)
def enc_cap_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        E.capped_from_one(F.col("l_linenumber"), 4).alias("code"),
    )


@register(
    "enc_flat_index",
    X.with_sql("SELECT okey, CAST(((STATUS * 7 + YEAR) * 12 + MONTH) * 5 + PRIORITY AS BIGINT) AS cell FROM orders_"),
)
def enc_flat_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = X.MID.attrs
    return X.orders(spark, sf_dir).select(
        "okey",
        E.flat_index([F.col(c) for c in a], [X.MID.sizes[c] for c in a]).alias("cell"),
    )


@register(
    "enc_decode",
    """SELECT o_orderkey, o_orderstatus AS status, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders""",
)
def enc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.orders(spark, sf_dir)
    return o.select(
        F.col("okey").alias("o_orderkey"),
        E.labelled(F.col("STATUS"), X.STATUSES).alias("status"),
        E.first_of_month(F.col("YEAR"), F.col("MONTH"), 1995).alias("month"),
    )


@register(
    "enc_list_parts",
    "SELECT p_partkey, string_split(p_name, ' ')[1] AS first_word, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n_words FROM part",
)
def enc_list_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("p_name")
    return _raw(spark, sf_dir, "part").select(
        "p_partkey",
        E.first_part(x, " ").alias("first_word"),
        F.size(E.delimited(x, " ")).alias("n_words"),
    )


@register("enc_dense_key", "SELECT c_custkey, row_number() OVER (ORDER BY c_name) - 1 AS dense FROM customer")
def enc_dense_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.dense_keys(
        _raw(spark, sf_dir, "customer").select("c_custkey", "c_name"),
        ["c_name"],
        "dense",
    ).select("c_custkey", "dense")


# Views and joins ----------------------------------------------------------------------------------------------

_CHAIN_WIDE = "w AS (" + X.wide_sql(X.CHAIN, "lineitem") + ")"
_STAR_WIDE = "w AS (" + X.wide_sql(X.STAR, "lineitem") + ")"
_DEEP_WIDE = "w AS (" + X.wide_sql(X.DEEP, "lineitem") + ")"


@register(
    "view_chain_counts",
    X.with_sql(
        "SELECT customer__SEGMENT, orders__YEAR, lineitem__QBIN, count(*) AS n FROM w GROUP BY ALL",
        _CHAIN_WIDE,
    ),
)
def view_chain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.tables(spark, sf_dir, X.CHAIN)
    wide = V.view(X.CHAIN, t, "lineitem", [("customer", "SEGMENT"), ("orders", "YEAR"), ("lineitem", "QBIN")])
    return wide.groupBy(*wide.columns).agg(F.count(F.lit(1)).alias("n"))


@register(
    "view_star_counts",
    X.with_sql("SELECT part__PTYPE, orders__PRIORITY, lineitem__RFLAG, count(*) AS n FROM w GROUP BY ALL", _STAR_WIDE),
)
def view_star_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.tables(spark, sf_dir, X.STAR)
    wide = V.view(X.STAR, t, "lineitem", [("part", "PTYPE"), ("orders", "PRIORITY"), ("lineitem", "RFLAG")])
    return wide.groupBy(*wide.columns).agg(F.count(F.lit(1)).alias("n"))


@register(
    "view_star_b_counts",
    X.with_sql(
        "SELECT supplier__SNATION, part__PSIZEBIN, lineitem__DBIN, count(*) AS n FROM w GROUP BY ALL",
        "w AS (" + X.wide_sql(X.STAR_B, "lineitem") + ")",
    ),
)
def view_star_b_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.tables(spark, sf_dir, X.STAR_B)
    wide = V.view(X.STAR_B, t, "lineitem", [("supplier", "SNATION"), ("part", "PSIZEBIN"), ("lineitem", "DBIN")])
    return wide.groupBy(*wide.columns).agg(F.count(F.lit(1)).alias("n"))


@register(
    "orphans_anti",
    "SELECT c_custkey AS ckey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)",
)
def orphans_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.orphans(X.customer(spark, sf_dir), "ckey", _raw(spark, sf_dir, "events"), "user_id").select("ckey")


@register(
    "orphan_policy_first",
    """SELECT e.event_id, coalesce(c.c_nationkey, (SELECT c_nationkey FROM customer ORDER BY c_custkey LIMIT 1)) AS c_nationkey,
     c.c_custkey IS NULL AS orphan FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey""",
)
def orphan_policy_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _raw(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    e = _raw(spark, sf_dir, "events").select("event_id", "user_id")
    return V.join_parent(e, "user_id", c, "c_custkey", "first", "orphan").select("event_id", "c_nationkey", "orphan")


@register(
    "fk_closure_semi",
    """WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey < 5), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c))
     SELECT (SELECT count(*) FROM c) AS n_top, (SELECT count(*) FROM o) AS n_mid, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (FROM o)) AS n_bot""",
)
def fk_closure_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.tables(spark, sf_dir, X.CHAIN)
    kept = V.closure(X.CHAIN, t, {"customer": t["customer"].filter("NATION < 5")})
    n = [
        kept[r].agg(F.count(F.lit(1)).alias(name)) for r,
        name in (("customer", "n_top"), ("orders", "n_mid"), ("lineitem", "n_bot"))
    ]
    return n[0].join(n[1], F.lit(True)).join(n[2], F.lit(True))


_SHARE = f"cast('0x' || substr(md5('3|share|' || pkey), 1, 13) as bigint) < {int(0.25 * (1 << 52))}"


@register(
    "star_subset",
    X.with_sql(
        " SELECT (SELECT count(*) FROM p) AS n_part, (SELECT count(*) FROM l) AS n_line, (SELECT count(*) FROM o) AS n_order, (SELECT max(r) FROM p) AS last_part",
        f"""p AS (SELECT *, row_number() OVER (ORDER BY pkey) - 1 AS r FROM part_ WHERE {_SHARE}), l AS (SELECT * FROM lineitem_ WHERE pkey IN (SELECT pkey FROM p)),
     o AS (SELECT * FROM orders_ WHERE okey IN (SELECT okey FROM l))""",
    ),
)
def star_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fit.subset_by_root(X.STAR, X.tables(spark, sf_dir, X.STAR, keyed=True), "part", 0.25, 3, redense=True)
    counts = [
        t[r].agg(F.count(F.lit(1)).alias(n)) for r,
        n in (("part", "n_part"), ("lineitem", "n_line"), ("orders", "n_order"))
    ]
    last = t["lineitem"].agg(F.max("pkey").alias("last_line")).join(
        t["part"].agg(F.max("pkey").alias("last_part")),
        F.lit(True),
    )
    out = reduce(lambda a, b: a.join(b, F.lit(True)), [*counts, last])
    return out.select("n_part", "n_line", "n_order", "last_part")


@register(
    "common_keys",
    "SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
)
def common_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _raw(spark, sf_dir, "orders")
    return fit.common_keys([o.filter(F.col("o_orderstatus") == s) for s in X.STATUSES], ["o_custkey"])


@register(
    "denorm_signature",
    X.with_sql(
        "SELECT row_number() OVER (ORDER BY customer__SEGMENT, orders__STATUS, orders__YEAR) - 1 AS signature, customer__SEGMENT, orders__STATUS, orders__YEAR, count(*) AS n_rows FROM w GROUP BY 2, 3, 4",
        _CHAIN_WIDE,
    ),
)
def denorm_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.tables(spark, sf_dir, X.CHAIN)
    cols = [("customer", "SEGMENT"), ("orders", "STATUS"), ("orders", "YEAR")]
    wide = V.view(X.CHAIN, t, "lineitem", cols)
    return V.denormalise_signature(wide, [V.column(*c) for c in cols])


@register(
    "slot_padding",
    """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS slot FROM orders)
     SELECT c_custkey, s.slot, o_orderkey, CAST(o_orderkey IS NOT NULL AS INTEGER) AS present
     FROM customer CROSS JOIN (SELECT CAST(unnest(range(5)) AS INTEGER) AS slot) s LEFT JOIN o ON o_custkey = c_custkey AND o.slot = s.slot""",
)
def slot_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _raw(spark, sf_dir, "customer").select("c_custkey"), _raw(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return V.slots(c, "c_custkey", o, "o_custkey", ["o_orderkey"], 5)


@register(
    "bucket_split",
    "SELECT c_custkey, CAST((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 4 AS BIGINT) AS bucket FROM customer",
)
def bucket_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bucketed(
        _raw(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"),
        ["c_nationkey"],
        ["c_custkey"],
        4,
    ).select("c_custkey", "bucket")


# Count queries ------------------------------------------------------------------------------------------------

#: One query of each class, as fixed examples; the batches below hold generated workloads.
_EXAMPLES = {
    "q_0hop_top": (X.CHAIN, _CHAIN_WIDE, "customer", [("customer", "NATION", (1, 2, 7))]),
    "q_0hop_bot": (X.CHAIN, _CHAIN_WIDE, "lineitem", [("lineitem", "QBIN", (0, 3))]),
    "q_1hop_topmid": (X.CHAIN, _CHAIN_WIDE, "orders", [("customer", "SEGMENT", (1, 3)), ("orders", "YEAR", (0, 2, 5))]),
    "q_1hop_midbot": (X.CHAIN, _CHAIN_WIDE, "lineitem", [("orders", "PRIORITY", (0, 1)), ("lineitem", "DBIN", (2,))]),
    "q_2hop_topbot": (
        X.CHAIN,
        _CHAIN_WIDE,
        "lineitem",
        [("customer", "NATION", (3, 9, 11)), ("lineitem", "RFLAG", (2,))],
    ),
    "q_0hop_r1": (X.STAR, _STAR_WIDE, "part", [("part", "PTYPE", (0, 4))]),
    "q_0hop_r2": (X.STAR, _STAR_WIDE, "orders", [("orders", "STATUS", (1,))]),
    "q_0hop_c": (X.STAR, _STAR_WIDE, "lineitem", [("lineitem", "RFLAG", (0, 1))]),
    "q_1hop_r1c": (X.STAR, _STAR_WIDE, "lineitem", [("part", "PSIZEBIN", (1, 2)), ("lineitem", "QBIN", (4, 5))]),
    "q_1hop_r2c": (X.STAR, _STAR_WIDE, "lineitem", [("orders", "YEAR", (3, 4)), ("lineitem", "RFLAG", (1,))]),
    "q_cross_r1r2": (X.STAR, _STAR_WIDE, "lineitem", [("part", "PTYPE", (1, 2, 3)), ("orders", "PRIORITY", (4,))]),
    "q_3hop": (X.DEEP, _DEEP_WIDE, "lineitem", [("nation", "NCODE", (0, 4, 8, 12)), ("lineitem", "QBIN", (1,))]),
    "q_3hop_disc": (X.DEEP, _DEEP_WIDE, "lineitem", [("region", "RNAME", (1, 2)), ("lineitem", "DBIN", (0, 3))]),
    "q_2hop_cn": (X.DEEP, _DEEP_WIDE, "orders", [("nation", "NCODE", (5, 6)), ("orders", "YEAR", (1, 2, 3))]),
    "q_2hop_seg": (
        X.DEEP,
        _DEEP_WIDE,
        "lineitem",
        [("customer", "SEGMENT", (0, 2)), ("orders", "STATUS", (0,)), ("lineitem", "LSTATUS", (1,))],
    ),
}


def _example(name: str, schema, role: str, conditions: list) -> None:
    query = W.CountQuery(name, 0, role, tuple(conditions))
    wide = "w AS (" + X.wide_sql(schema, role) + ")"
    sql = X.with_sql(f"SELECT answer FROM ({W.sql_of(query, 'w')})", wide)
    register(name, sql)(lambda s, d: W.count_one(schema, X.tables(s, d, schema), query))


for _name, (_schema, _, _role, _conditions) in _EXAMPLES.items():
    _example(_name, _schema, _role, _conditions)


def batch(schema, classes: dict, per_class: int) -> list[W.CountQuery]:
    return W.generate(schema, classes, per_class)


def _batch_sql(schema, queries: list[W.CountQuery]) -> str:
    roles = dict.fromkeys(q.role for q in queries)
    views = ", ".join(f"w_{r} AS (" + X.wide_sql(schema, r) + ")" for r in roles)
    return X.with_sql(" UNION ALL ".join(W.sql_of(q, f"w_{q.role}") for q in queries), views)


_CHAIN_BATCH = batch(X.CHAIN, W.chain_classes("customer", "orders", "lineitem"), W.PER_CLASS)
_STAR_BATCH = batch(X.STAR, W.star_classes("part", "lineitem", "orders"), W.PER_CLASS)
_DEEP_BATCH = batch(X.DEEP, W.deep_classes("nation", "customer", "orders", "lineitem"), W.PER_CLASS)
register("q_batch_chain", _batch_sql(X.CHAIN, _CHAIN_BATCH))(
    lambda s,
    d: W.answer(X.CHAIN, X.tables(s, d, X.CHAIN), _CHAIN_BATCH),
)
register("q_batch_star", _batch_sql(X.STAR, _STAR_BATCH))(
    lambda s,
    d: W.answer(X.STAR, X.tables(s, d, X.STAR), _STAR_BATCH),
)
register("q_batch_deep", _batch_sql(X.DEEP, _DEEP_BATCH))(
    lambda s,
    d: W.answer(X.DEEP, X.tables(s, d, X.DEEP), _DEEP_BATCH),
)

_WIDE_BATCH = W.generate(
    X.CHAIN,
    {"2hop": ("lineitem", ["customer", "lineitem"]), "1hop": ("lineitem", ["orders", "lineitem"]), "0hop": ("orders", ["orders"])},
    20,
    7,
    10,
    2,
)
register("q_batch_two_attrs", _batch_sql(X.CHAIN, _WIDE_BATCH))(
    lambda s,
    d: W.answer(X.CHAIN, X.tables(s, d, X.CHAIN), _WIDE_BATCH),
)

#: A stand-in for a synthetic database: the orders whose key's hash falls into the first half.
_HALF_SQL = f"cast('0x' || substr(md5('half|' || CAST(okey AS VARCHAR)), 1, 13) as bigint) < {1 << 51}"


def _half(o: DataFrame) -> DataFrame:
    return o.filter(bits("half", F.col("okey")) < F.lit(1 << 51))


def _errors_sql(body: str) -> str:
    roles = dict.fromkeys(q.role for q in _CHAIN_BATCH)
    real = ", ".join(f"w_{r} AS (" + X.wide_sql(X.CHAIN, r) + ")" for r in roles)
    half = f"half_ AS (SELECT * FROM orders_ WHERE {_HALF_SQL}), " + ", ".join(
        f"v_{r} AS (" + X.wide_sql(X.CHAIN, r).replace(
            "FROM orders_",
            "FROM half_ orders_",
        ).replace("JOIN orders_", "JOIN half_ orders_") + ")" for r in roles
    )
    a = " UNION ALL ".join(W.sql_of(q, f"w_{q.role}") for q in _CHAIN_BATCH)
    b = " UNION ALL ".join(W.sql_of(q, f"v_{q.role}") for q in _CHAIN_BATCH)
    e = f"""e AS (SELECT a.cls, a.qid, a.answer AS real, b.answer AS synthetic,
      round(abs(b.answer - a.answer) / greatest(a.answer, 1), 9) AS re FROM ({a}) a JOIN ({b}) b USING (cls, qid))"""
    return X.with_sql(body, ", ".join([real, half, e]))


@register("re_rows", _errors_sql("SELECT * FROM e"))
def re_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.tables(spark, sf_dir, X.CHAIN)
    fake = V.closure(X.CHAIN, t, {"orders": _half(t["orders"])})
    errors = W.relative_errors(W.answer(X.CHAIN, t, _CHAIN_BATCH), W.answer(X.CHAIN, fake, _CHAIN_BATCH))
    return errors.withColumn("re", F.round("re", 9))


@register(
    "re_by_class",
    _errors_sql(
        "SELECT cls, count(*) AS n, count(*) FILTER (real >= 50) AS n_large, round(median(re), 9) AS median_re, round(median(re) FILTER (real >= 50), 9) AS median_re_large FROM e GROUP BY cls",
    ),
)
def re_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = W.error_medians(re_rows(spark, sf_dir))
    return m.select("cls", "n", "n_large", rounded("median_re", 9), rounded("median_re_large", 9))


# Sizes --------------------------------------------------------------------------------------------------------

_ORDER_SIZES = "s AS (SELECT c_custkey, c_nationkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)"
_LINE_SIZES = "s AS (SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"


@register(
    "size_hist_capped",
    f"WITH {_LINE_SIZES} SELECT CAST(least(n, 8) AS INTEGER) AS size, count(*) AS groups FROM s WHERE n > 0 GROUP BY 1",
)
def size_hist_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.size_histogram(X.orders(spark, sf_dir), "okey", X.lineitem(spark, sf_dir), "okey", tau=TAU_LINES)


@register(
    "size_hist_zero_bin",
    f"WITH {_LINE_SIZES} SELECT CAST(least(n, 8) AS INTEGER) AS size, count(*) AS groups FROM s GROUP BY 1",
)
def size_hist_zero_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.size_histogram(
        X.orders(spark, sf_dir),
        "okey",
        X.lineitem(spark, sf_dir),
        "okey",
        tau=TAU_LINES,
        zeros=True,
    )


@register(
    "size_by_attr",
    f"WITH {_ORDER_SIZES} SELECT c_nationkey AS NATION, CAST(least(n, 15) AS INTEGER) AS size, count(*) AS groups FROM s GROUP BY ALL",
)
def size_by_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.size_histogram(
        X.customer(spark, sf_dir),
        "ckey",
        X.orders(spark, sf_dir),
        "ckey",
        "NATION",
        TAU_ORDERS,
        zeros=True,
    )


@register(
    "size_tau_p95",
    """SELECT 'orders' AS level, CAST(floor(least(greatest(quantile_cont(n, 0.95), 12), 1024)) AS INTEGER) AS tau FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)
     UNION ALL SELECT 'lineitem', CAST(floor(least(greatest(quantile_cont(n, 0.95), 12), 1024)) AS INTEGER) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)
     UNION ALL SELECT 'part', CAST(floor(least(greatest(quantile_cont(n, 0.95), 12), 1024)) AS INTEGER) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)""",
)
def size_tau_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(level: str, df: DataFrame, fk: str) -> DataFrame:
        p = F.percentile("n", F.lit(0.95))
        tau = F.floor(F.least(F.greatest(p, F.lit(12.0)), F.lit(1024.0))).cast("int")
        return S.group_sizes(df, fk).agg(tau.alias("tau")).select(F.lit(level).alias("level"), "tau")

    li = X.lineitem(spark, sf_dir)
    return one(
        "orders",
        X.orders(spark, sf_dir),
        "ckey",
    ).union(one("lineitem", li, "okey")).union(one("part", li, "pkey"))


_GEO, _ = geometric_bins(60, 12)
_HYBRID, _ = hybrid_bins(6, 60, 8)


def _bins_sql(edges: list[int]) -> str:
    passed = " + ".join(f"CAST(n >= {e} AS INTEGER)" for e in edges)
    return f"WITH s AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT greatest({passed} - 1, 0) AS size, count(*) AS groups FROM s GROUP BY 1"


register("size_bins_geo", _bins_sql(_GEO))(
    lambda s,
    d: S.size_histogram(X.part(s, d), "pkey", X.lineitem(s, d), "pkey", edges=_GEO),
)
register("size_bins_hybrid", _bins_sql(_HYBRID))(
    lambda s,
    d: S.size_histogram(X.part(s, d), "pkey", X.lineitem(s, d), "pkey", edges=_HYBRID),
)


@register(
    "size_mean",
    "SELECT round(avg(n), 6) AS mean_size, max(n) AS max_size, median(n) AS median_size FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)",
)
def size_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = S.group_sizes(X.orders(spark, sf_dir), "ckey")
    return g.agg(
        F.round(F.avg("n"), 6).alias("mean_size"),
        F.max("n").alias("max_size"),
        F.median("n").alias("median_size"),
    )


@register(
    "truncated_groups",
    "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 5",
)
def truncated_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _raw(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return S.truncated(o, "o_custkey", ["o_orderkey"], 5).select("o_orderkey")


@register(
    "gini",
    "SELECT round((2 * sum(i * n) - (count(*) + 1) * sum(n)) / (count(*) * sum(n)), 9) AS gini FROM (SELECT n, row_number() OVER (ORDER BY n) AS i FROM (SELECT count(*) AS n FROM events GROUP BY user_id))",
)
def gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.gini(S.group_sizes(_raw(spark, sf_dir, "events"), "user_id")).select(F.round("gini", 9).alias("gini"))


_TV = "b AS (SELECT coalesce(x.b, y.b) AS b, coalesce(x.n, 0) / (SELECT sum(n) FROM x) AS p, coalesce(y.n, 0) / (SELECT sum(n) FROM y) AS q FROM x FULL JOIN y ON x.b = y.b) SELECT round(0.5 * sum(abs(p - q)), 9) AS tv FROM b"


@register(
    "tv_size",
    X.with_sql(
        "",
        f"""s1 AS (SELECT count(*) AS n FROM orders_ GROUP BY ckey), s2 AS (SELECT count(*) AS n FROM orders_ WHERE {_HALF_SQL} GROUP BY ckey),
     x AS (SELECT least(n, 16) AS b, count(*) AS n FROM s1 GROUP BY 1), y AS (SELECT least(n, 16) AS b, count(*) AS n FROM s2 GROUP BY 1), """ + _TV,
    ),
)
def tv_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.orders(spark, sf_dir)
    return S.size_tv(S.group_sizes(o, "ckey"), S.group_sizes(_half(o), "ckey"), 15).select(F.round("tv", 9).alias("tv"))


@register(
    "tv_size_merged",
    X.with_sql(
        "",
        f"""s1 AS (SELECT count(okey) AS n FROM customer_ c LEFT JOIN orders_ o ON c.ckey = o.ckey GROUP BY c.ckey),
     h AS (SELECT * FROM orders_ WHERE {_HALF_SQL}), s2 AS (SELECT count(okey) AS n FROM customer_ c LEFT JOIN h o ON c.ckey = o.ckey GROUP BY c.ckey),
     x AS (SELECT least(n, 20) AS b, count(*) AS n FROM s1 GROUP BY 1), y AS (SELECT least(n, 20) AS b, count(*) AS n FROM s2 GROUP BY 1), """ + _TV,
    ),
)
def tv_size_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = X.customer(spark, sf_dir), X.orders(spark, sf_dir)
    a, b = (S.all_sizes(c, "ckey", x, "ckey") for x in (o, _half(o)))
    return S.merged_size_tv(a, b).select(F.round("tv", 9).alias("tv"))


# Marginals ----------------------------------------------------------------------------------------------------

_W2 = "z2 AS (SELECT okey, 1.0::DOUBLE / least(count(*), 8) AS w2 FROM lineitem_ GROUP BY okey)"
_W1 = "z1 AS (SELECT ckey, 1.0::DOUBLE / least(count(*), 15) AS w1 FROM orders_ GROUP BY ckey)"
_JOINED = "w AS (SELECT *, w1 * w2 AS w12 FROM lineitem_ l JOIN z2 USING (okey) JOIN orders_ o USING (okey) JOIN z1 USING (ckey) JOIN customer_ c USING (ckey))"
_MID_JOINED = "w AS (SELECT * FROM orders_ o JOIN z1 USING (ckey) JOIN customer_ c USING (ckey))"


def _cells(df: DataFrame, *names: str) -> DataFrame:
    """One marginal's cells under the attributes' names."""
    return df.select(
        *(F.col(f"c{i}").alias(n) for i, n in enumerate(names)),
        F.round("value", M.DECIMALS).alias("value"),
    )


def weighted(spark: SparkSession, sf_dir: str, both: bool = False, rows: bool = False) -> dict[str, DataFrame]:
    """The chain's tables with weights w on lineitem (w2, or w1 w2) and w on orders (w1)."""
    t = X.tables(spark, sf_dir, X.CHAIN)
    t["orders"] = S.with_weights(t["orders"], "ckey", TAU_ORDERS)
    t["lineitem"] = S.with_weights(t["lineitem"], "okey", TAU_LINES, per_row=rows)
    if both:
        up = t["orders"].select(F.col("okey").alias("__o"), F.col("w").alias("__w"))
        li = t["lineitem"].join(up, F.col("okey") == F.col("__o"))
        t["lineitem"] = li.withColumn("w", F.col("w") * F.col("__w")).drop("__o", "__w")
    return t


def marginal(name: str, role: str, columns: tuple[tuple[str, str], ...], weight: bool, sql: str, schema=X.CHAIN, **how) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = weighted(spark, sf_dir, **how) if schema is X.CHAIN else star_weighted(spark, sf_dir)
        wide = V.view(schema, t, role, columns, extra=["w"] if weight else [])
        m = M.Marginal(name, tuple(V.column(*c) for c in columns))
        return _cells(M.marginals(wide, [m], "w" if weight else None), *(a for _, a in columns))

    register(name, sql)(run)


def _m_sql(attrs: str, weight: str, more: str, source: str = "w") -> str:
    return X.with_sql(
        f"SELECT {attrs}, round(sum({weight}), 6) AS value FROM {source} GROUP BY ALL",
        more,
    ) if more else X.with_sql(f"SELECT {attrs}, round(sum({weight}), 6) AS value FROM {source} GROUP BY ALL")


_C, _O, _L = "customer", "orders", "lineitem"
marginal("m_top1", _C, ((_C, "NATION"),), False, _m_sql("NATION", "1.0::DOUBLE", "", "customer_"))
marginal(
    "m_top2",
    _C,
    ((_C, "NATION"), (_C, "SEGMENT")),
    False,
    _m_sql("NATION, SEGMENT", "1.0::DOUBLE", "", "customer_"),
)
marginal("m_mid1_w", _O, ((_O, "YEAR"),), True, _m_sql("YEAR", "w1", f"{_W1}, {_MID_JOINED}"))
marginal("m_tm_w", _O, ((_C, "SEGMENT"), (_O, "YEAR")), True, _m_sql("SEGMENT, YEAR", "w1", f"{_W1}, {_MID_JOINED}"))
marginal("m_bot1_w", _L, ((_L, "QBIN"),), True, _m_sql("QBIN", "w2", f"{_W1}, {_W2}, {_JOINED}"))
marginal("m_mb_w", _L, ((_O, "STATUS"), (_L, "QBIN")), True, _m_sql("STATUS, QBIN", "w2", f"{_W1}, {_W2}, {_JOINED}"))
marginal(
    "m_tb_inner",
    _L,
    ((_C, "NATION"), (_L, "QBIN")),
    True,
    _m_sql("NATION, QBIN", "w2", f"{_W1}, {_W2}, {_JOINED}"),
)
marginal(
    "m_tb_both",
    _L,
    ((_C, "NATION"), (_L, "QBIN")),
    True,
    _m_sql("NATION, QBIN", "w12", f"{_W1}, {_W2}, {_JOINED}"),
    both=True,
)
marginal(
    "m_rowleaf",
    _L,
    ((_O, "STATUS"), (_L, "RFLAG")),
    True,
    _m_sql("STATUS, RFLAG", "1.0::DOUBLE", f"{_W1}, {_W2}, {_JOINED}"),
    rows=True,
)

_STAR_W = "zs AS (SELECT pkey, 1.0::DOUBLE / least(count(*), 38) AS w FROM lineitem_ GROUP BY pkey), w AS (SELECT * FROM lineitem_ l JOIN zs USING (pkey) JOIN part_ p USING (pkey) JOIN orders_ o USING (okey))"


def star_weighted(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = X.tables(spark, sf_dir, X.STAR)
    return t | {"lineitem": S.with_weights(t["lineitem"], "pkey", 38)}


_P = "part"
marginal("m_xp", _L, ((_P, "PTYPE"), (_O, "YEAR")), True, _m_sql("PTYPE, YEAR", "w", _STAR_W), X.STAR)
marginal(
    "m_xpc",
    _L,
    ((_P, "PTYPE"), (_O, "YEAR"), (_L, "RFLAG")),
    True,
    _m_sql("PTYPE, YEAR, RFLAG", "w", _STAR_W),
    X.STAR,
)
marginal("m_p1c", _L, ((_P, "PSIZEBIN"), (_L, "QBIN")), True, _m_sql("PSIZEBIN, QBIN", "w", _STAR_W), X.STAR)
marginal("m_p2c", _L, ((_O, "PRIORITY"), (_L, "QBIN")), True, _m_sql("PRIORITY, QBIN", "w", _STAR_W), X.STAR)


@register(
    "m_pairs_within",
    """WITH m AS (SELECT o_custkey AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS s,
       CAST(year(o_orderdate) - 1995 AS INTEGER) AS a, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS b FROM orders),
     p AS (SELECT x.g, x.a AS c0, y.b AS c1, x.s, row_number() OVER (PARTITION BY x.g ORDER BY x.r, y.r) AS k FROM m x JOIN m y ON x.g = y.g AND x.r < y.r)
     SELECT c0, c1, round(sum(1.0::DOUBLE / least(s * (s - 1), 20)), 6) AS value FROM p WHERE k <= 20 GROUP BY ALL""",
)
def m_pairs_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.within_pairs(X.orders(spark, sf_dir), "ckey", "okey", "YEAR", "STATUS")
    return out.select("c0", "c1", rounded("value"))


_SETS = [
    M.Marginal(
        "SEGMENT",
        ("customer__SEGMENT",),
    ), M.Marginal("YEAR", ("orders__YEAR",)), M.Marginal("QBIN", ("lineitem__QBIN",)),
    M.Marginal("SEGMENT_QBIN", ("customer__SEGMENT", "lineitem__QBIN")), M.Marginal(
        "SEGMENT_YEAR_QBIN",
        ("customer__SEGMENT", "orders__YEAR", "lineitem__QBIN"),
    ),
]


@register(
    "m_grouping_sets",
    X.with_sql(
        " UNION ALL ".join(
            f"SELECT '{m.name}' AS query_name, " + ", ".join(
                (m.columns[i] if i < len(m.columns) else "CAST(NULL AS INTEGER)") + f" AS c{i}" for i in range(3)
            ) + ", CAST(count(*) AS DOUBLE) AS value FROM w GROUP BY ALL"
            for m in _SETS
        ),
        _CHAIN_WIDE,
    ),
)
def m_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.tables(spark, sf_dir, X.CHAIN)
    wide = V.view(X.CHAIN, t, "lineitem", [("customer", "SEGMENT"), ("orders", "YEAR"), ("lineitem", "QBIN")])
    return M.marginals(wide, _SETS)


_TB = M.Marginal("TB_NATION_QBIN", ("customer__NATION", "lineitem__QBIN"))


def _tb(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = weighted(spark, sf_dir)
    wide = V.view(X.CHAIN, t, "lineitem", [("customer", "NATION"), ("lineitem", "QBIN")], extra=["w"])
    grid = M.domain_grid({"customer__NATION": 25, "lineitem__QBIN": 6}, [_TB], spark)
    return M.on_grid(M.marginals(wide, [_TB], "w"), grid)


_TB_SQL = f"""{_W1}, {_W2}, {_JOINED}, o AS (SELECT NATION AS c0, QBIN AS c1, sum(w2) AS value FROM w GROUP BY ALL),
 g AS (SELECT CAST(a.range AS INTEGER) AS c0, CAST(b.range AS INTEGER) AS c1 FROM range(25) a CROSS JOIN range(6) b),
 t AS (SELECT c0, c1, coalesce(value, 0.0) AS value FROM g LEFT JOIN o USING (c0, c1))"""
_NOISE = gaussian_sql("'0|TB_NATION_QBIN|' || c0 || '|' || c1 || '|~'")


@register(
    "noisy_tb",
    X.with_sql(f"SELECT c0, c1, round(greatest(value + 3.5 * {_NOISE}, 0.0), 6) AS value FROM t", _TB_SQL),
)
def noisy_tb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.released(_tb(spark, sf_dir), 3.5, 0).select("c0", "c1", rounded("value"))


#: Weights are whole multiples of 1 / UNIT, the least common multiple of 1 to TAU_LINES; counted in that unit, sums are
#: exact in any order, and what is computed from them is the same to the last bit.
UNIT = 840
_TB_MARGINS = (
    _TB_SQL
    + f""", u AS (SELECT c0, c1, round(value * {UNIT}) AS value FROM t), a AS (SELECT c0, sum(value) AS a FROM u GROUP BY c0),
 b AS (SELECT c1, sum(value) AS b FROM u GROUP BY c1), n AS (SELECT sum(value) AS n FROM u),
 j AS (SELECT u.*, a, b, n FROM u JOIN a USING (c0) JOIN b USING (c1), n)"""
)


def _with_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _tb(spark, sf_dir).withColumn("value", F.round(F.col("value") * UNIT))
    sums = [cells.groupBy(c).agg(F.sum("value").alias(n)) for c, n in (("c0", "a"), ("c1", "b"))]
    total = cells.agg(F.sum("value").alias("n"))
    return cells.join(sums[0], "c0").join(sums[1], "c1").join(total, F.lit(True))


def from_margins(name: str, out: str, expression: str) -> None:
    """A query of one expression over value, a, b and n, in double arithmetic that Spark and DuckDB share."""
    sql = X.with_sql(f"SELECT c0, c1, round({expression}, 6) AS {out} FROM j", _TB_MARGINS)
    register(name, sql)(lambda s, d: _with_margins(s, d).selectExpr("c0", "c1", f"round({expression}, 6) AS {out}"))


from_margins("lift_tb", "lift", "(value / 840e0 + 1e-6 / 150e0) / (a / n * b / n + 1e-6)")
from_margins("cond_norm", "p", "CASE WHEN a > 0 THEN value / a ELSE 0e0 END")
from_margins("snr_shrink", "lift", "1e0 + (value * n / (a * b) - 1e0) * least(greatest(value / 840e0 / 17.5e0, 0e0), 1e0)")
from_margins(
    "shrink_joint",
    "value",
    "(least(value / 5880e0, 1e0) * value + (1e0 - least(value / 5880e0, 1e0)) * a * b / n) / 840e0",
)


@register(
    "debias",
    f"WITH {_ORDER_SIZES}, h AS (SELECT least(n, 15) AS size, count(*) AS groups FROM s GROUP BY 1) SELECT CAST(size AS INTEGER) AS size, round(greatest(groups - 0.39894::DOUBLE * 4, 0), 6) AS groups FROM h",
)
def debias(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = S.size_histogram(X.customer(spark, sf_dir), "ckey", X.orders(spark, sf_dir), "ckey", tau=TAU_ORDERS, zeros=True)
    return h.select("size", F.round(F.greatest(F.col("groups") - 0.39894 * 4, F.lit(0.0)), 6).alias("groups"))


# Effects, associations, quotas, records -----------------------------------------------------------------------


@register(
    "effect_delta",
    X.with_sql(
        "SELECT round(avg(lineitem__LSTATUS) FILTER (customer__SEGMENT >= 2) - avg(lineitem__LSTATUS) FILTER (customer__SEGMENT < 2), 9) AS delta FROM w",
        _CHAIN_WIDE,
    ),
)
def effect_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = V.view(
        X.CHAIN,
        X.tables(spark, sf_dir, X.CHAIN),
        "lineitem",
        [("customer", "SEGMENT"), ("lineitem", "LSTATUS")],
    )
    return MX.delta(
        wide,
        F.col("lineitem__LSTATUS"),
        (F.col("customer__SEGMENT") >= 2).cast("int"),
    ).select(F.round("delta", 9).alias("delta"))


_FOUR = "avg(lineitem__LSTATUS) FILTER (customer__SEGMENT {a} 2 AND orders__YEAR {b} 3)"


@register(
    "effect_contrast",
    X.with_sql(
        f"SELECT round({_FOUR.format(a='>=', b='>=')} - {_FOUR.format(a='>=', b='<')} - {_FOUR.format(a='<', b='>=')} + {_FOUR.format(a='<', b='<')}, 9) AS contrast FROM w",
        _CHAIN_WIDE,
    ),
)
def effect_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = V.view(
        X.CHAIN,
        X.tables(spark, sf_dir, X.CHAIN),
        "lineitem",
        [("customer", "SEGMENT"), ("orders", "YEAR"), ("lineitem", "LSTATUS")],
    )
    a, b = ((F.col(c) >= n).cast("int") for c, n in (("customer__SEGMENT", 2), ("orders__YEAR", 3)))
    return MX.contrast(wide, F.col("lineitem__LSTATUS"), a, b).select(F.round("contrast", 9).alias("contrast"))


@register(
    "effect_phi",
    X.with_sql(
        "SELECT round(avg(CAST(lineitem__LSTATUS = xor(xor(CAST(lineitem__RFLAG >= 1 AS INTEGER), CAST(customer__SEGMENT >= 2 AS INTEGER)), CAST(customer__ACCTBIN >= 11 AS INTEGER)) AS INTEGER)), 9) AS phi FROM w",
        _CHAIN_WIDE,
    ),
)
def effect_phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = V.view(
        X.CHAIN,
        X.tables(spark, sf_dir, X.CHAIN),
        "lineitem",
        [("customer", "SEGMENT"), ("customer", "ACCTBIN"), ("lineitem", "RFLAG"), ("lineitem", "LSTATUS")],
    )
    u, a, b = (
        (F.col(c) >= n).cast("int") for c,
        n in (("lineitem__RFLAG", 1), ("customer__SEGMENT", 2), ("customer__ACCTBIN", 11))
    )
    return MX.fidelity(wide, F.col("lineitem__LSTATUS"), E.rule("xor", u, a, b)).select(F.round("phi", 9).alias("phi"))


@register(
    "tv_assoc",
    X.with_sql(
        """ SELECT round(0.5 * sum(abs(coalesce(n, 0) / nx - ny / nn)), 9) AS tv FROM x CROSS JOIN y CROSS JOIN t LEFT JOIN c ON c.a = x.a AND c.b = y.b""",
        _CHAIN_WIDE + """, c AS (SELECT customer__NATION AS a, orders__YEAR AS b, count(*)::DOUBLE AS n FROM w GROUP BY ALL), x AS (SELECT a, sum(n) AS nx FROM c GROUP BY a),
     y AS (SELECT b, sum(n) AS ny FROM c GROUP BY b), t AS (SELECT sum(n) AS nn FROM c)""",
    ),
)
def tv_assoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = V.view(X.CHAIN, X.tables(spark, sf_dir, X.CHAIN), "lineitem", [("customer", "NATION"), ("orders", "YEAR")])
    return MX.association_tv(wide, "customer__NATION", "orders__YEAR").select(F.round("tv", 9).alias("tv"))


@register(
    "tv_to_mean",
    X.with_sql(
        " SELECT round(avg(t), 9) AS tv FROM (SELECT a, 0.5 * sum(abs(p - m)) AS t FROM (SELECT *, avg(p) OVER (PARTITION BY b) AS m FROM p) GROUP BY a)",
        """c AS (SELECT NATION AS a, SEGMENT AS b, count(*)::DOUBLE AS n FROM customer_ GROUP BY ALL),
     g AS (SELECT * FROM (SELECT DISTINCT a FROM c) CROSS JOIN (SELECT DISTINCT b FROM c)),
     f AS (SELECT g.a, g.b, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.a = c.a AND g.b = c.b), p AS (SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS p FROM f)""",
    ),
)
def tv_to_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MX.association_to_mean(X.customer(spark, sf_dir), "NATION", "SEGMENT").select(F.round("tv", 9).alias("tv"))


@register(
    "pair_tv",
    X.with_sql(
        "",
        f"x AS (SELECT STATUS * 100 + YEAR AS b, count(*) AS n FROM orders_ GROUP BY 1), y AS (SELECT STATUS * 100 + YEAR AS b, count(*) AS n FROM orders_ WHERE {_HALF_SQL} GROUP BY 1), " + _TV,
    ),
)
def pair_tv(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.orders(spark, sf_dir)
    return MX.pair_tv(o, _half(o), ["STATUS", "YEAR"]).select(F.round("tv", 9).alias("tv"))


@register(
    "crosstab_shares",
    "WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) SELECT c_nationkey, c_mktsegment, round(n / sum(n) OVER (PARTITION BY c_nationkey), 9) AS share FROM n",
)
def crosstab_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.crosstab_shares(
        _raw(spark, sf_dir, "customer"),
        "c_nationkey",
        "c_mktsegment",
    ).withColumn("share", F.round("share", 9))


@register(
    "cue_share",
    "SELECT round(avg(CAST(l_returnflag = 'R' AS INTEGER)), 9) AS share, count(*) AS n FROM lineitem WHERE l_quantity >= 25",
)
def cue_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fit.gather_ratio(_raw(spark, sf_dir, "lineitem"), F.col("l_returnflag") == "R", F.col("l_quantity") >= 25)
    return out.select(F.round("share", 9).alias("share"), "n")


@register(
    "big_group_gap",
    X.with_sql(
        "SELECT round(max(s) - min(s), 9) AS gap FROM g",
        "s AS (SELECT okey, count(*) AS n FROM lineitem_ GROUP BY okey), g AS (SELECT STATUS, avg(CAST(n >= 6 AS INTEGER)) AS s FROM orders_ JOIN s USING (okey) GROUP BY STATUS)",
    ),
)
def big_group_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = S.all_sizes(X.orders(spark, sf_dir), "okey", X.lineitem(spark, sf_dir), "okey", ["STATUS"]).filter("n > 0")
    return MX.big_group_share_gap(sizes, "STATUS", 6).select(F.round("gap", 9).alias("gap"))


@register(
    "topn_remainder",
    """WITH n AS (SELECT c_mktsegment AS seg, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY ALL),
     x AS (SELECT *, n / sum(n) OVER (PARTITION BY seg) * 100.0::DOUBLE AS e FROM n),
     f AS (SELECT *, floor(e) AS fl, row_number() OVER (PARTITION BY seg ORDER BY round(e - floor(e), 9) DESC, nation) AS r FROM x)
     SELECT seg, nation, CAST(fl + CAST(r <= round(100 - sum(fl) OVER (PARTITION BY seg)) AS INTEGER) AS BIGINT) AS quota FROM f""",
)
def topn_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _raw(spark, sf_dir, "customer").groupBy(
        F.col("c_mktsegment").alias("seg"),
        F.col("c_nationkey").alias("nation"),
    ).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("seg")
    cells = n.withColumn("share", F.col("n") / F.sum("n").over(own))
    return C.remainder_ranks(cells, ["seg"], "share", F.lit(100.0), ["nation"]).select("seg", "nation", "quota")


@register(
    "quota_draw_hist",
    "SELECT CAST(range AS INTEGER) AS code, CASE range WHEN 0 THEN n - 2 * (n // 4) ELSE n // 4 END AS n FROM range(3), (SELECT count(*) AS n FROM customer)",
)
def quota_draw_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _raw(spark, sf_dir, "customer").select("c_custkey")
    n = c.count()
    q = n // 4
    drawn = C.quota_draw(c, "c_custkey", "code", [n - 2 * q, q, q], 7)
    return drawn.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@register(
    "quota_1d",
    """WITH s AS (SELECT c_custkey AS k, c_nationkey AS v, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL)
     SELECT v, CAST(2 * sum(n) AS BIGINT) AS total, count(*) AS parents FROM s GROUP BY v""",
)
def quota_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.all_sizes(X.customer(spark, sf_dir), "ckey", X.orders(spark, sf_dir), "ckey", ["NATION"]).filter("n > 0")
    goal = 2 * F.sum("n").over(Window.partitionBy("NATION"))
    out = C.rescale_groups(rows.withColumn("goal", goal), ["NATION"], "ckey", "n", F.col("goal"), 1, "m")
    return out.groupBy(F.col("NATION").alias("v")).agg(F.sum("m").alias("total"), F.count(F.lit(1)).alias("parents"))


@register(
    "dedup_preference",
    """SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CAST(value > 5 AS INTEGER) DESC, event_type, event_id) AS r FROM events) WHERE r = 1""",
)
def dedup_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MX.preferred(
        _raw(spark, sf_dir, "events"),
        ["user_id"],
        F.col("value") > 5,
        "event_type",
        ["event_id"],
    ).select("event_id", "user_id", "event_type")


@register(
    "replace_by_key",
    """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
     UNION ALL SELECT o_orderkey, 'X' FROM orders WHERE o_orderstatus = 'P'""",
)
def replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _raw(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return MX.replaced(o, o.filter("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])


@register(
    "missing_cells",
    "SELECT n_nationkey AS NATION, CAST(range AS INTEGER) AS ACCTBIN FROM nation, range(22) EXCEPT (" + X.with_sql(
        "SELECT NATION, ACCTBIN FROM customer_",
    ) + ")",
)
def missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _raw(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("NATION"),
        F.explode(F.sequence(F.lit(0), F.lit(21))).alias("ACCTBIN"),
    )
    return MX.missing_cells(grid, X.customer(spark, sf_dir), ["NATION", "ACCTBIN"])


@register(
    "stratified_medians",
    """WITH k AS (SELECT l_returnflag AS cls, l_linestatus AS ds, l_linenumber AS seed, avg(l_discount) AS v FROM lineitem GROUP BY ALL),
     s AS (SELECT cls, ds, median(v) AS v FROM k GROUP BY ALL) SELECT cls, round(median(v), 9) AS value FROM s GROUP BY cls""",
)
def stratified_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _raw(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("cls"),
        F.col("l_linestatus").alias("ds"),
        F.col("l_linenumber").alias("seed"),
        F.col("l_discount").alias("value"),
    )
    return MX.stratified(li, "ds", "seed", "cls", "value").select("cls", F.round("value", 9).alias("value"))


@register(
    "strength_range",
    "SELECT o_orderstatus, o_orderpriority, min(o_totalprice) AS lowest, max(o_totalprice) AS highest FROM orders GROUP BY ALL",
)
def strength_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MX.strength_range(_raw(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice")


@register(
    "reused_plants",
    """WITH p AS (SELECT l_returnflag AS cell, l_linestatus AS seed, list_sort(list(l_linenumber)) AS v FROM lineitem GROUP BY ALL)
     SELECT cell, count(*) > count(DISTINCT v) AS reused FROM p GROUP BY cell""",
)
def reused_plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _raw(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("cell"),
        F.col("l_linestatus").alias("seed"),
        "l_linenumber",
    )
    return MX.reused(li, ["cell"], "seed", "l_linenumber")


@register(
    "holm",
    """WITH p AS (SELECT c_nationkey AS k, count(*) / 5000.0::DOUBLE AS p FROM customer GROUP BY 1), r AS (SELECT k, p, row_number() OVER (ORDER BY p, k) AS r, count(*) OVER () AS m FROM p)
     SELECT k, round(max(least(1.0, (m - r + 1) * p)) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM r""",
)
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-down adjustment of a few p-values; an ordered window over as many rows as there are tests."""
    p = _raw(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(
        (F.count(F.lit(1)) / 5000.0).alias("p"),
    )
    order = Window.partitionBy(F.lit(0)).orderBy("p", "k")
    r = p.withColumn("r", F.row_number().over(order)).withColumn(
        "m",
        F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))),
    )
    step = F.least(F.lit(1.0), (F.col("m") - F.col("r") + 1) * F.col("p"))
    return r.select(
        "k",
        F.round(F.max(step).over(order.rowsBetween(Window.unboundedPreceding, 0)), 9).alias("adjusted"),
    )


_BOOT = "cast('0x' || substr(md5('3|boot|' || i || '|' || j), 1, 13) as bigint)"


@register(
    "bootstrap_ci",
    f"""WITH v AS (SELECT c_nationkey AS k, avg(c_acctbal) AS v FROM customer GROUP BY 1), n AS (SELECT k, v, row_number() OVER (ORDER BY k) - 1 AS r, count(*) OVER () AS m FROM v),
     s AS (SELECT i.range AS i, j.range AS j, {_BOOT.replace("i ||", "i.range ||").replace("|| j)", "|| j.range)")} AS h FROM range(2000) i CROSS JOIN range((SELECT count(*) FROM v)) j),
     d AS (SELECT i, median(v) AS x FROM s JOIN n ON s.h % n.m = n.r GROUP BY i) SELECT round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM d""",
)
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _raw(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("v"))
    x = SA.bootstrap(v, "k", 2000, 3).groupBy("replicate").agg(F.median("v").alias("x"))
    return x.agg(
        F.round(F.percentile("x", F.lit(0.025)), 6).alias("low"),
        F.round(F.percentile("x", F.lit(0.975)), 6).alias("high"),
    )


@register(
    "sample_exact",
    f"SELECT c_custkey FROM customer ORDER BY cast('0x' || substr(md5('5|sample|' || c_custkey), 1, 13) as bigint), c_custkey LIMIT 100",
)
def sample_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.sample_exact(_raw(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 100, 5)


def planted_sql(rows: str, strength: float = 0.8, seed: int = 1) -> str:
    """WITH entries up to `done`, the rows with `planted`, for rows of lkey, m, old, u, x1 and x2 under the rule xor."""
    return f"""w AS ({rows}),
     b AS (SELECT *, CASE WHEN {bits_sql(f"'{seed}|plant|' || lkey")} < {int(strength * (1 << 52))} THEN (u + x1 + x2) % 2 ELSE old END AS p FROM w),
     k AS (SELECT m, u, sum(p) - sum(old) AS d FROM b GROUP BY ALL),
     off AS (SELECT b.*, d, CAST(d <> 0 AND p = CAST(d > 0 AS INTEGER) AS INTEGER) AS c FROM b JOIN k USING (m, u)),
     ranks AS (SELECT *, row_number() OVER (PARTITION BY m, u, c ORDER BY {bits_sql(f"'{seed}|swap planted|' || lkey")}, lkey) - 1 AS r FROM off),
     done AS (SELECT *, CASE WHEN c = 1 AND r < abs(d) THEN 1 - p ELSE p END AS planted FROM ranks)"""


@register(
    "plant_chain_audit",
    X.with_sql(
        "SELECT orders__STATUS, CAST(lineitem__RFLAG >= 1 AS INTEGER) AS u, count(*) AS n, CAST(sum(lineitem__LSTATUS) AS BIGINT) AS ones_old, CAST(sum(lineitem__LSTATUS) AS BIGINT) AS ones_new FROM w GROUP BY ALL",
        _CHAIN_WIDE,
    ),
)
def plant_chain_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planting keeps every class's count of ones: the audit's old and new counts agree."""
    return PL.audit(planted(spark, sf_dir), "old", "planted", ["orders__STATUS", "u"]).drop("changed")


def planted(spark: SparkSession, sf_dir: str, strength: float = 0.8, seed: int = 1) -> DataFrame:
    cols = [
        ("customer", "SEGMENT"),
        ("customer", "ACCTBIN"),
        ("orders", "STATUS"),
        ("lineitem", "RFLAG"),
        ("lineitem", "LSTATUS"),
    ]
    wide = V.view(X.CHAIN, X.tables(spark, sf_dir, X.CHAIN, keyed=True), "lineitem", cols, extra=["lkey"])
    wide = wide.select(
        "lkey", "orders__STATUS", F.col("lineitem__LSTATUS").alias("old"), (F.col("lineitem__RFLAG") >= 1).cast("int").alias("u"),
        (F.col("customer__SEGMENT") >= 2).cast("int").alias("x1"), (
            F.col("customer__ACCTBIN") >= 11
        ).cast("int").alias("x2"),
    )
    return PL.plant_chain(wide, "lkey", "old", "u", "x1", "x2", ["orders__STATUS"], "xor", strength, seed)


@register(
    "plant_chain",
    X.with_sql(
        f"""SELECT avg(CAST(old = (u + x1 + x2) % 2 AS INTEGER)) AS before, avg(CAST(planted = (u + x1 + x2) % 2 AS INTEGER)) AS after FROM done""",
        planted_sql(
            """SELECT lkey, STATUS AS m, LSTATUS AS old, CAST(RFLAG >= 1 AS INTEGER) AS u, CAST(SEGMENT >= 2 AS INTEGER) AS x1,
             CAST(ACCTBIN >= 11 AS INTEGER) AS x2 FROM lineitem_ JOIN orders_ USING (okey) JOIN customer_ USING (ckey)"""
        ),
    ),
)
def plant_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule fidelity before and after planting."""
    df = planted(spark, sf_dir)
    expected = E.rule("xor", F.col("u"), F.col("x1"), F.col("x2"))
    return df.agg(
        F.avg((F.col("old") == expected).cast("int")).alias("before"),
        F.avg((F.col("planted") == expected).cast("int")).alias("after"),
    )


@register(
    "plant_star",
    X.with_sql(
        """SELECT x1, x2, count(*) AS n, CAST(sum(old) AS BIGINT) AS ones_old, CAST(sum(CASE WHEN c = 1 AND r < abs(d) THEN 1 - p ELSE p END) AS BIGINT) AS ones_new,
         CAST(sum(CAST(old <> CASE WHEN c = 1 AND r < abs(d) THEN 1 - p ELSE p END AS INTEGER)) AS BIGINT) AS changed FROM ranks GROUP BY ALL""",
        f"""w AS (SELECT lkey, CAST(QBIN >= 3 AS INTEGER) AS old, CAST(RFLAG >= 1 AS INTEGER) AS u, CAST(PSIZEBIN >= 2 AS INTEGER) AS x1,
          CAST(orders_.PRIORITY >= 2 AS INTEGER) AS x2 FROM lineitem_ JOIN orders_ USING (okey) JOIN part_ USING (pkey)),
         b AS (SELECT *, CASE WHEN {bits_sql("'1|plant|' || lkey")} < {int(0.8 * (1 << 52))} THEN (u + x1 + x2) % 2 ELSE old END AS p FROM w),
         cells AS (SELECT x1, x2, CASE WHEN x1 = x2 THEN 1 ELSE -1 END AS s, count(*) AS n, sum(p) AS ones, sum(old) AS old FROM b GROUP BY ALL),
         t AS (SELECT least(greatest(round_even(sum(s * (ones - old)) / 4.0, 0), max(CASE WHEN s > 0 THEN -old ELSE old - n END)), min(CASE WHEN s > 0 THEN n - old ELSE old END)) AS t FROM cells),
         moves AS (SELECT x1, x2, CAST(ones - (old + s * t) AS BIGINT) AS d FROM cells, t),
         off AS (SELECT b.*, d, CAST(d <> 0 AND p = CAST(d > 0 AS INTEGER) AS INTEGER) AS c FROM b JOIN moves USING (x1, x2)),
         ranks AS (SELECT *, row_number() OVER (PARTITION BY x1, x2, c ORDER BY {bits_sql("'1|cells planted|' || lkey")}, lkey) - 1 AS r FROM off)""",
    ),
)
def plant_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of ones by the two roots' bits, before and after planting in a star."""
    cols = [("part", "PSIZEBIN"), ("orders", "PRIORITY"), ("lineitem", "RFLAG"), ("lineitem", "QBIN")]
    wide = V.view(X.STAR, X.tables(spark, sf_dir, X.STAR, keyed=True), "lineitem", cols, extra=["lkey"])
    wide = wide.select(
        "lkey", (F.col("lineitem__QBIN") >= 3).cast("int").alias("old"), (F.col("lineitem__RFLAG") >= 1).cast("int").alias("u"),
        (F.col("part__PSIZEBIN") >= 2).cast("int").alias("x1"), (
            F.col("orders__PRIORITY") >= 2
        ).cast("int").alias("x2"),
    )
    return PL.audit(PL.plant_star(wide, "lkey", "old", "u", "x1", "x2", "xor", 0.8, 1), "old", "planted", ["x1", "x2"])


@register(
    "windowed_marginal",
    "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
)
def windowed_marginal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(_raw(spark, sf_dir, "events"), "ts", ["event_type"])


# The other modules register their own queries.
from kinweave.plans import source_queries, stat_queries, synthesis_queries  # noqa: E402, F401
