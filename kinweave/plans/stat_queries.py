"""Registered queries of encoders, filters, joins, registries, the accountant, options and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import accountant as A
from kinweave.functions import encode as E
from kinweave.functions import options as O
from kinweave.functions import stats
from kinweave.functions.noise import bits_sql, uniform, uniform_sql
from kinweave.operators import encode as fit
from kinweave.operators import marginals as M
from kinweave.operators import metrics as MX
from kinweave.operators import sizes as S
from kinweave.operators import views as V
from kinweave.operators import workload as W
from kinweave.plans import fixtures as X
from kinweave.plans.registry import raw, register
from kinweave.schema import RAILS

# Encoders -----------------------------------------------------------------------------------------------------


@register("bin_ordered", X.with_sql("SELECT okey, CAST(YEAR > (SELECT median(YEAR) FROM orders_) AS INTEGER) AS bit FROM orders_"))
def bin_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year in two halves, fitted on the orders and applied to them."""
    o = X.orders(spark, sf_dir)
    return o.select("okey", fit.fit_binariser(o, "YEAR", 7, True)(F.col("YEAR")).alias("bit"))


@register(
    "bin_categories",
    X.with_sql(
        """SELECT okey, CAST(PRIORITY IN (SELECT PRIORITY FROM c WHERE r = 1 OR before < 0.45 * whole) AS INTEGER) AS bit FROM orders_""",
        """n AS (SELECT PRIORITY, count(*) AS n FROM orders_ GROUP BY 1),
         c AS (SELECT PRIORITY, row_number() OVER (ORDER BY n DESC, PRIORITY) AS r, sum(n) OVER (ORDER BY n DESC, PRIORITY) - n AS before, sum(n) OVER () AS whole FROM n)""",
    ),
)
def bin_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities in two sets, the first taking the most frequent ones up to about half of the rows."""
    o = X.orders(spark, sf_dir)
    return o.select("okey", fit.fit_binariser(o, "PRIORITY", 5, False)(F.col("PRIORITY")).alias("bit"))


@register(
    "bin_rebalanced",
    X.with_sql(
        """SELECT okey, CAST(CASE WHEN r <= flips AND bit = v THEN 1 - bit ELSE bit END AS INTEGER) AS bit FROM k""",
        f"""b AS (SELECT okey, CAST(STATUS = 2 AS INTEGER) AS bit FROM orders_), t AS (SELECT count(*) AS n, sum(bit) AS ones FROM b),
         f AS (SELECT CASE WHEN ones / n BETWEEN 0.35 AND 0.65 THEN 0 ELSE floor(abs(0.5 - ones / n) * n) END AS flips, CAST(ones / n > 0.65 AS INTEGER) AS v FROM t),
         k AS (SELECT okey, bit, flips, v, row_number() OVER (PARTITION BY bit ORDER BY {bits_sql("'2|flip|' || okey")}, okey) AS r FROM b, f)""",
    ),
)
def bin_rebalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rare bit flipped on the rows of least hash until its share is a half."""
    o = X.orders(spark, sf_dir).select("okey", (F.col("STATUS") == 2).cast("int").alias("bit"))
    return fit.rebalanced(o, "bit", "okey", 2)


@register(
    "size_represented",
    X.with_sql(
        "SELECT ckey, CAST(CASE WHEN n >= 20 THEN 30 WHEN n >= 9 THEN 13 WHEN n >= 4 THEN 6 WHEN n >= 2 THEN 2 ELSE 1 END AS INTEGER) AS n FROM (SELECT ckey, count(*) AS n FROM orders_ GROUP BY 1)"
    ),
)
def size_represented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of orders by bins, and back to the size that stands for a bin."""
    n = S.group_sizes(X.orders(spark, sf_dir), "ckey")
    code = E.size_bin(F.col("n"), [1, 2, 4, 9, 20])
    return n.select("ckey", E.bin_size(code, [1, 2, 6, 13, 30]).cast("int").alias("n"))


@register(
    "decode_spread",
    X.with_sql(f"""SELECT okey, PRIORITY * 100.0::DOUBLE + 100.0::DOUBLE * {uniform_sql("'7|spread|' || okey")} AS value FROM orders_"""),
)
def decode_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number inside each code's bin, at a share of its width that the key decides."""
    lows = [100.0 * k for k in range(5)]
    u = uniform(7, "spread", F.col("okey"))
    return X.orders(spark, sf_dir).select("okey", E.spread_in_bin(F.col("PRIORITY"), lows, [x + 100 for x in lows], u).alias("value"))


_CAP = "(SELECT count(*) FROM lineitem_) // 10"


@register(
    "sample_capped",
    X.with_sql(
        f"""SELECT CAST(CASE WHEN t1 <= cap THEN n1 WHEN t2 <= cap THEN n2 ELSE n3 END AS BIGINT) AS n, CASE WHEN t1 <= cap THEN t1 WHEN t2 <= cap THEN t2 ELSE (SELECT coalesce(sum(c), 0) FROM o WHERE r <= n3) END AS total FROM s3""",
        f"""o AS (SELECT okey, row_number() OVER (ORDER BY {bits_sql("'8|sample|' || okey")}, okey) AS r, (SELECT count(*) FROM lineitem_ l WHERE l.okey = orders_.okey) AS c FROM orders_),
         s1 AS (SELECT {_CAP} AS cap, (SELECT count(*) FROM orders_) // 3 AS n1), s1t AS (SELECT *, (SELECT coalesce(sum(c), 0) FROM o WHERE r <= n1) AS t1 FROM s1),
         s2 AS (SELECT *, greatest(1, floor(n1 * cap / t1 * 0.97::DOUBLE)) AS n2 FROM s1t), s2t AS (SELECT *, (SELECT coalesce(sum(c), 0) FROM o WHERE r <= n2) AS t2 FROM s2),
         s3 AS (SELECT *, greatest(1, floor(n2 * cap / t2 * 0.97::DOUBLE)) AS n3 FROM s2t)""",
    ),
)
def sample_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the orders, made fewer until their lineitems are at most a tenth of all; numbers of both."""
    o, li = X.orders(spark, sf_dir), X.lineitem(spark, sf_dir)
    rows, _, total = fit.sample_counted(o.select("okey"), "okey", o.count() // 3, 8, lambda r: li.join(r, "okey", "left_semi"), li.count() // 10)
    return spark.createDataFrame([(rows.count(), total)], "n long, total long")


@register(
    "rule_expression",
    X.with_sql(
        "SELECT STATUS, count(*) AS n, CAST(sum((STATUS + CAST(YEAR >= 3 AS INTEGER) * 2 + CAST(MONTH < 6 AS INTEGER)) % 3) AS BIGINT) AS value FROM orders_ GROUP BY 1"
    ),
)
def rule_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule given as an expression over three columns."""
    value = E.rule("(u + x1 * 2 + x2) % 3", F.col("STATUS"), (F.col("YEAR") >= 3), (F.col("MONTH") < 6))
    return X.orders(spark, sf_dir).withColumn("v", value).groupBy("STATUS").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("value"))


# Filters and joins --------------------------------------------------------------------------------------------

_RECORDS = """records AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'natural' WHEN 1 THEN 'plant' ELSE 'other' END AS mode,
 (o_orderkey % 7) / 10.0::DOUBLE + CASE WHEN o_orderkey % 5 = 0 THEN 1e-11::DOUBLE WHEN o_orderkey % 5 = 1 THEN 1e-6::DOUBLE ELSE 0 END AS eps,
 CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 13 END AS metric, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 17 END AS re FROM orders)"""


@register(
    "record_filters",
    f"""WITH {_RECORDS} SELECT id, g.eps AS key_eps, re IS NULL AS degraded FROM records r JOIN (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.4::DOUBLE)) g(eps) ON abs(r.eps - g.eps) < 1e-9
     WHERE mode IN ('natural', 'plant') AND metric IS NOT NULL""",
)
def record_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two modes on a grid of budgets, with a tolerance, without those that lack a metric."""
    k = F.col("o_orderkey")
    off = F.when(k % 5 == 0, F.lit(1e-11)).when(k % 5 == 1, F.lit(1e-6)).otherwise(F.lit(0.0))
    records = raw(spark, sf_dir, "orders").select(
        k.alias("id"),
        F.when(k % 3 == 0, "natural").when(k % 3 == 1, "plant").otherwise("other").alias("mode"),
        ((k % 7) / 10.0 + off).alias("eps"),
        F.when(k % 11 != 0, k % 13).alias("metric"),
        F.when(k % 4 != 0, k % 17).alias("re"),
    )
    kept = MX.usable_records(records, ["natural", "plant"], [0.1, 0.2, 0.4], needed=["metric"], may_lack="re")
    return kept.select("id", "key_eps", "degraded")


@register("range_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12.5 AND l_discount < 0.03")
def range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of two columns, which reach the scan."""
    li = raw(spark, sf_dir, "lineitem")
    return li.filter(F.col("l_quantity").between(10, 12.5) & (F.col("l_discount") < 0.03)).select("l_orderkey", "l_linenumber", "l_quantity")


@register(
    "semi_join",
    X.with_sql("SELECT RFLAG, count(*) AS n FROM lineitem_ WHERE okey IN (SELECT okey FROM orders_ WHERE STATUS = 1 AND YEAR >= 2) GROUP BY 1"),
)
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems of the qualifying orders; of the orders nothing but their keys is carried."""
    keep = (F.col("STATUS") == 1) & (F.col("YEAR") >= 2)
    kept = W.qualifying(X.lineitem(spark, sf_dir), "okey", X.orders(spark, sf_dir), "okey", keep)
    return kept.groupBy("RFLAG").agg(F.count(F.lit(1)).alias("n"))


@register("asserted_join", X.with_sql("SELECT SEGMENT, STATUS, count(*) AS n FROM orders_ JOIN customer_ USING (ckey) GROUP BY ALL"))
def asserted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers, where an order without one would be an error."""
    o, c = X.orders(spark, sf_dir), X.customer(spark, sf_dir).withColumnRenamed("ckey", "pk")
    return V.join_parent(o, "ckey", c, "pk", "error").groupBy("SEGMENT", "STATUS").agg(F.count(F.lit(1)).alias("n"))


_FIXED = W.fixed_values(X.CHAIN, "orders", "lineitem", 40, 5)
register(
    "fixed_value_batch",
    X.with_sql(
        " UNION ALL ".join(W.sql_of(q, f"v_{q.role}") for q in _FIXED),
        ", ".join(f"v_{r} AS ({X.wide_sql(X.CHAIN, r)})" for r in ("orders", "lineitem")),
    ),
)(lambda s, d: W.answer(X.CHAIN, X.tables(s, d, X.CHAIN), _FIXED))


# Registries ---------------------------------------------------------------------------------------------------


def _objects(view: DataFrame, own: list[M.Marginal], weight: str | None) -> DataFrame:
    return M.marginals(view, own, weight).withColumn("value", F.round("value", 6))


def _sizes(spark: SparkSession, parent: DataFrame, pk: str, child: DataFrame, fk: str, attrs, tau: int, prefix: str) -> DataFrame:
    """SZ objects: groups by a parent attribute and their capped size."""
    rows = S.all_sizes(parent, pk, child, fk, attrs).filter("n > 0").withColumn("__size", S.capped(F.col("n"), tau))
    return _objects(rows, [M.Marginal(f"{prefix}_{a}", (a, "__size")) for a in attrs], None)


def _marginal_sql(m: M.Marginal, source: str, weight: str) -> str:
    codes = [*m.columns, "CAST(NULL AS INTEGER)", "CAST(NULL AS INTEGER)"][:3]
    names = ", ".join(f"{c} AS c{i}" for i, c in enumerate(codes))
    return f"SELECT '{m.name}' AS query_name, {names}, round(CAST({weight} AS DOUBLE), 6) AS value FROM {source} GROUP BY {', '.join(m.columns)}"


def _sizes_sql(prefix: str, parent: str, pk: str, child: str, fk: str, attrs, tau: int) -> list[str]:
    return [
        f"SELECT '{prefix}_{a}' AS query_name, {a} AS c0, CAST(least(n, {tau}) AS INTEGER) AS c1, CAST(NULL AS INTEGER) AS c2, CAST(count(*) AS DOUBLE) AS value FROM "
        f"(SELECT {parent}_.*, n FROM {parent}_ JOIN (SELECT {fk}, count(*) AS n FROM {child}_ GROUP BY 1) g ON {parent}_.{pk} = g.{fk}) GROUP BY ALL" for a in attrs
    ]


_CHAIN2 = M.registry_chain2("orders", ["STATUS", "YEAR", "PRIORITY"], "lineitem", ["QBIN", "RFLAG"], [("STATUS", "YEAR")])
_CHAIN3 = M.registry_chain3(("customer", "orders", "lineitem"), ["SEGMENT", "ACCTBIN"], ["STATUS", "PRIORITY"], ["QBIN", "RFLAG"])
_STAR = M.registry_star(("part", "lineitem", "orders"), ["PTYPE", "PSIZEBIN"], ["PRIORITY", "STATUS"], ["QBIN"], [("PTYPE", "STATUS")])
#: Caps of the registered objects.
_T1, _T2 = 15, 8


def _weighted(table: str, fk: str, tau: int) -> str:
    return f"(SELECT t.*, 1.0 / least(count(*) OVER (PARTITION BY {fk}), {tau}) AS w FROM {table}_ t)"


@register(
    "registry_chain2",
    X.with_sql(
        " UNION ALL ".join([
            *(_marginal_sql(m, "p", "count(*)") for m in _CHAIN2["parent"]), *(_marginal_sql(m, "c", "sum(w)") for m in _CHAIN2["child"]),
            *_sizes_sql("SZ", "orders", "okey", "lineitem", "okey", ["STATUS", "YEAR"], _T2),
            "SELECT 'CC_QBIN_RFLAG', q.range, r.range, NULL, 0.0 FROM range(6) q, range(3) r",
        ]),
        f"""p AS (SELECT STATUS AS orders__STATUS, YEAR AS orders__YEAR, PRIORITY AS orders__PRIORITY FROM orders_),
         c AS (SELECT STATUS AS orders__STATUS, YEAR AS orders__YEAR, PRIORITY AS orders__PRIORITY, QBIN AS lineitem__QBIN, RFLAG AS lineitem__RFLAG, w FROM {_weighted("lineitem", "okey", _T2)} JOIN orders_ USING (okey))""",
    ),
)
def registry_chain2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All objects of the two-level chain: one-way, pairs, sizes, and zeros for pairs of child attributes."""
    t = X.tables(spark, sf_dir, X.CHAIN)
    li = S.with_weights(t["lineitem"], "okey", _T2)
    ups = [("orders", a) for a in ("STATUS", "YEAR", "PRIORITY")]
    parent = V.view(X.CHAIN, t, "orders", ups)
    child = V.view(X.CHAIN, t | {"lineitem": li}, "lineitem", [*ups, ("lineitem", "QBIN"), ("lineitem", "RFLAG")], extra=["w"])
    out = _objects(parent, _CHAIN2["parent"], None).unionByName(_objects(child, _CHAIN2["child"], "w"))
    out = out.unionByName(_sizes(spark, t["orders"], "okey", t["lineitem"], "okey", ["STATUS", "YEAR"], _T2, "SZ"))
    return out.unionByName(M.domain_grid({"QBIN": 6, "RFLAG": 3}, [M.Marginal("CC_QBIN_RFLAG", ("QBIN", "RFLAG"))], spark).withColumn("value", F.lit(0.0)))


@register(
    "registry_chain3",
    X.with_sql(
        " UNION ALL ".join([
            *(_marginal_sql(m, "t", "count(*)") for m in _CHAIN3["top"]), *(_marginal_sql(m, "m", "sum(w)") for m in _CHAIN3["mid"]),
            *(_marginal_sql(m, "b", "sum(w)") for m in [*_CHAIN3["bot"], *_CHAIN3["cross"]]),
            *_sizes_sql("SZ1", "customer", "ckey", "orders", "ckey", ["SEGMENT"], _T1),
            *_sizes_sql("SZ2", "orders", "okey", "lineitem", "okey", ["STATUS", "PRIORITY"], _T2),
        ]),
        f"""t AS (SELECT SEGMENT AS customer__SEGMENT, ACCTBIN AS customer__ACCTBIN FROM customer_),
         m AS (SELECT SEGMENT AS customer__SEGMENT, ACCTBIN AS customer__ACCTBIN, STATUS AS orders__STATUS, PRIORITY AS orders__PRIORITY, w FROM {_weighted("orders", "ckey", _T1)} JOIN customer_ USING (ckey)),
         b AS (SELECT SEGMENT AS customer__SEGMENT, ACCTBIN AS customer__ACCTBIN, STATUS AS orders__STATUS, PRIORITY AS orders__PRIORITY, QBIN AS lineitem__QBIN, RFLAG AS lineitem__RFLAG, w
          FROM {_weighted("lineitem", "okey", _T2)} JOIN orders_ USING (okey) JOIN customer_ USING (ckey))""",
    ),
)
def registry_chain3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All objects of the three-level chain, cross-hop pairs and sizes of both levels included."""
    t = X.tables(spark, sf_dir, X.CHAIN)
    o, li = S.with_weights(t["orders"], "ckey", _T1), S.with_weights(t["lineitem"], "okey", _T2)
    top = [("customer", a) for a in ("SEGMENT", "ACCTBIN")]
    mid, bot = [("orders", a) for a in ("STATUS", "PRIORITY")], [("lineitem", a) for a in ("QBIN", "RFLAG")]
    out = _objects(V.view(X.CHAIN, t, "customer", top), _CHAIN3["top"], None)
    out = out.unionByName(_objects(V.view(X.CHAIN, t | {"orders": o}, "orders", [*top, *mid], extra=["w"]), _CHAIN3["mid"], "w"))
    low = V.view(X.CHAIN, t | {"lineitem": li}, "lineitem", [*top, *mid, *bot], extra=["w"])
    out = out.unionByName(_objects(low, [*_CHAIN3["bot"], *_CHAIN3["cross"]], "w"))
    out = out.unionByName(_sizes(spark, t["customer"], "ckey", t["orders"], "ckey", ["SEGMENT"], _T1, "SZ1"))
    return out.unionByName(_sizes(spark, t["orders"], "okey", t["lineitem"], "okey", ["STATUS", "PRIORITY"], _T2, "SZ2"))


@register(
    "registry_star",
    X.with_sql(
        " UNION ALL ".join([
            *(_marginal_sql(m, "r1", "count(*)") for m in _STAR["r1"]), *(_marginal_sql(m, "r2", "count(*)") for m in _STAR["r2"]),
            *(_marginal_sql(m, "c", "sum(w)") for m in _STAR["child"]), *_sizes_sql("SZ", "part", "pkey", "lineitem", "pkey", ["PTYPE"], _T1),
        ]),
        f"""r1 AS (SELECT PTYPE AS part__PTYPE, PSIZEBIN AS part__PSIZEBIN FROM part_), r2 AS (SELECT PRIORITY AS orders__PRIORITY, STATUS AS orders__STATUS FROM orders_),
         c AS (SELECT PTYPE AS part__PTYPE, PSIZEBIN AS part__PSIZEBIN, PRIORITY AS orders__PRIORITY, STATUS AS orders__STATUS, QBIN AS lineitem__QBIN, w FROM {_weighted("lineitem", "pkey", _T1)}
          JOIN orders_ USING (okey) JOIN part_ USING (pkey))""",
    ),
)
def registry_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All objects of the star: roots, pairs and triples across the child, and sizes of the first root's groups."""
    t = X.tables(spark, sf_dir, X.STAR)
    li = S.with_weights(t["lineitem"], "pkey", _T1)
    r1, r2 = [("part", a) for a in ("PTYPE", "PSIZEBIN")], [("orders", a) for a in ("PRIORITY", "STATUS")]
    out = _objects(V.view(X.STAR, t, "part", r1), _STAR["r1"], None).unionByName(_objects(V.view(X.STAR, t, "orders", r2), _STAR["r2"], None))
    child = V.view(X.STAR, t | {"lineitem": li}, "lineitem", [*r1, *r2, ("lineitem", "QBIN")], extra=["w"])
    out = out.unionByName(_objects(child, _STAR["child"], "w"))
    return out.unionByName(_sizes(spark, t["part"], "pkey", t["lineitem"], "pkey", ["PTYPE"], _T1, "SZ"))


# Accountant and options ---------------------------------------------------------------------------------------

#: Published values: gamma by epsilon at delta = 1 / 1,056,320, and the scale of each of 33 and of 45 queries.
_GOLDEN = (
    (0.1, 0.027449986646, 295.9578272037, 345.6042839916),
    (0.2, 0.052494913973, 154.7585811609, 180.7190880505),
    (0.4, 0.100443091981, 80.8820023800, 94.4498301818),
    (0.8, 0.191854400441, 42.3448114088, 49.4480864588),
    (1.6, 0.364498910983, 22.2882377967, 26.0270543880),
    (3.2, 0.684894830442, 11.8617312375, 13.8515178664),
)
_LEAVES = 1_056_320


@register(
    "accountant_equal",
    "SELECT epsilon, gamma, sigma33, sigma45 FROM (VALUES "
    + ", ".join(f"({e}::DOUBLE, {round(g, 9)}::DOUBLE, {round(a, 6)}::DOUBLE, {round(b, 6)}::DOUBLE)" for e, g, a, b in _GOLDEN)
    + ") v(epsilon, gamma, sigma33, sigma45)",
)
def accountant_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gamma and the scales of equal shares, against published values."""
    d = A.delta_of(_LEAVES)
    rows = [(e, round(A.gamma(e, d), 9), round(A.equal_sigma(e, d, 33), 6), round(A.equal_sigma(e, d, 45), 6)) for e, *_ in _GOLDEN]
    return spark.createDataFrame(rows, "epsilon double, gamma double, sigma33 double, sigma45 double")


_WEIGHTS = (("a", 1.0, 1.0), ("b", 0.25, 1.0), ("c", 8.0, 2.0), ("d", 2.0, 2.0**0.5))


@register(
    "accountant_weighted",
    f"""WITH q(name, w, s) AS (VALUES {", ".join(f"('{n}', {w}::DOUBLE, {s!r}::DOUBLE)" for n, w, s in _WEIGHTS)}), g AS (SELECT unnest([{", ".join(repr(g) for _, g, *_ in _GOLDEN)}]) AS g)
     SELECT round(g, 9) AS gamma, name, round(s * sqrt(2.0 * sum(w * s * s) OVER (PARTITION BY g) / (g * g * w * s * s)), 5) AS sigma FROM q, g""",
)
def accountant_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scales for shares of the squared budget in proportion to weight times squared sensitivity."""
    d, rows = A.delta_of(_LEAVES), []
    for e, *_ in _GOLDEN:
        found = A.weighted_sigmas(e, d, {n: s for n, _, s in _WEIGHTS}, {n: w for n, w, _ in _WEIGHTS})
        rows += [(round(A.gamma(e, d), 9), n, round(x, 5)) for n, x in found.items()]
    return spark.createDataFrame(rows, "gamma double, name string, sigma double")


_NAMES = ("a.X", "a.Y", "b.Z", "a.X*b.Z", "a.Y*b.Z", "SZ.b.X")


@register(
    "accountant_split",
    f"""WITH g AS (SELECT unnest([{", ".join(repr(g) for _, g, *_ in _GOLDEN)}]) AS g), q AS (SELECT unnest({list(_NAMES)!r}) AS name),
     w AS (SELECT g, name, CASE WHEN name LIKE '%*%' OR name LIKE 'SZ%' THEN 3.0 ELSE 1.0 END AS w FROM q, g)
     SELECT round(g, 9) AS gamma, name, round(sqrt(2.0 * sum(w) OVER (PARTITION BY g) / (g * g * w)), 5) AS sigma, TRUE AS spent_whole FROM w""",
)
def accountant_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-way objects against joint ones at weights 1 and 3; the sum of 1 / sigma^2 is gamma^2 / 2."""
    d, rows = A.delta_of(_LEAVES), []
    one = [n for n in _NAMES if O.is_one_way(n)]
    for e, *_ in _GOLDEN:
        g = A.gamma(e, d)
        found = A.split_sigmas(e, d, one, [n for n in _NAMES if n not in one], 1.0, 3.0)
        whole = abs(sum(1 / x**2 for x in found.values()) - g * g / 2) < 1e-9
        rows += [(round(g, 9), n, round(x, 5), whole) for n, x in found.items()]
    return spark.createDataFrame(rows, "gamma double, name string, sigma double, spent_whole boolean")


@register(
    "leaf_delta",
    "SELECT 1.0 / count(*) AS delta, CAST(least(greatest(trunc(quantile_cont(n, 0.95)), 12), 1024) AS INTEGER) AS tau FROM (SELECT l_orderkey, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey) AS r FROM lineitem), (SELECT 1) WHERE r >= 1 HAVING TRUE".replace(
        "trunc(quantile_cont(n, 0.95))", "trunc(quantile_cont(n, 0.95) FILTER (r = 1))"
    ),
)
def leaf_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failure probability of a release, one over the leaves, and the cap of a group's size."""
    li = X.lineitem(spark, sf_dir)
    return spark.createDataFrame([(A.delta_of(li.count()), S.tau(li, "okey"))], "delta double, tau int")


#: Texts of options, the rail they are read for, and what comes of them; None where they are refused.
_TEXTS = (
    ("", "chain3", "off"),
    ("off", "star", "off"),
    ("pubn,bins:7", "chain2", "pubn,bins:7"),
    ("tailbins", "chain3", "tailbins:8"),
    ("budget:1:4,shrink", "star", "budget:1:4,shrink:5"),
    ("repair", "chain2", None),
    ("budget", "chain3", None),
    ("bins,tailbins", "chain3", None),
    ("totals,pubn", "chain2", None),
    ("szthresh:0.5:2", "chain2", None),
    ("nothing", "chain2", None),
    ("totals", "star", None),
    ("all", "chain2", "pubn,tailbins:8,szsens,szthresh:0.39894,exactmarg,growcap"),
)


@register("token_texts", "SELECT text, rail, reading FROM (VALUES " + ", ".join(f"('{t}', '{r}', {'NULL' if v is None else repr(v)})" for t, r, v in _TEXTS) + ") v(text, rail, reading)")
def token_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the option language makes of texts on each rail; refused ones give null."""
    rows = []
    for text, rail, _ in _TEXTS:
        try:
            rows.append((text, rail, str(O.parse(text, rail))))
        except ValueError:
            rows.append((text, rail, None))
    return spark.createDataFrame(rows, "text string, rail string, reading string")


@register(
    "cross_hop_settings",
    """SELECT name, weight, cell, ancestor FROM (VALUES ('inner', 'inner', TRUE, TRUE), ('Double', 'both', TRUE, TRUE), ('none', 'off', TRUE, TRUE),
     ('both:noguard', 'both', FALSE, FALSE), ('child:cell', 'inner', TRUE, FALSE), ('product:ancestor', 'both', FALSE, TRUE), ('outer', NULL, NULL, NULL)) v(name, weight, cell, ancestor)""",
)
def cross_hop_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and aliases of cross-hop settings; unknown ones give nulls."""
    rows = []
    for name in ("inner", "Double", "none", "both:noguard", "child:cell", "product:ancestor", "outer"):
        try:
            x = O.cross_hop(name)
            rows.append((name, x.weight, x.guard_cell, x.guard_ancestor))
        except ValueError:
            rows.append((name, None, None, None))
    return spark.createDataFrame(rows, "name string, weight string, cell boolean, ancestor boolean")


register("rails", "SELECT rail, token FROM (VALUES " + ", ".join(
    f"('{r}', '{t}')" for r, ts in {
        "chain2": "totals pubn bins tailbins rowleaf szsens szthresh exactmarg growcap",
        "chain3": "totals pubn bins tailbins rowleaf szsens szthresh exactmarg growcap ipf ratiotop repair szquota",
        "star": "pubn bins tailbins rowleaf szsens szthresh exactmarg growcap repair szquota budget shrink",
    }.items() for t in ts.split()
) + ") v(rail, token)")(
    lambda s, d: s.createDataFrame([(r, t) for r, ts in RAILS.items() for t in ts], "rail string, token string")
)


# Statistics ---------------------------------------------------------------------------------------------------

_PAIRS = """d AS (SELECT c_nationkey % 10 AS k, avg(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END) AS x, avg(CASE WHEN c_custkey % 2 = 1 THEN c_acctbal END) AS y FROM customer GROUP BY 1),
 r AS (SELECT k, x - y AS d, row_number() OVER (ORDER BY abs(x - y)) AS r FROM d WHERE x <> y)"""


@register(
    "signed_rank",
    f"""WITH {_PAIRS}, o AS (SELECT sum(r) FILTER (d > 0) AS pos, sum(r) AS whole, count(*) AS n FROM r), z AS (SELECT n, least(coalesce(pos, 0), whole - coalesce(pos, 0)) AS least_, whole FROM o),
     m AS (SELECT range AS m FROM range((SELECT CAST(2 ** n AS BIGINT) FROM z))), w AS (SELECT m, coalesce(sum(r) FILTER ((m >> (r - 1)) & 1 = 1), 0) AS w FROM m, r GROUP BY m)
     SELECT count(*) FILTER (least(w, whole - w) <= least_) / CAST(count(*) AS DOUBLE) AS p, (SELECT n FROM z) AS n FROM w, z""",
)
def signed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wilcoxon's p of ten pairs of means, exactly."""
    c = raw(spark, sf_dir, "customer")
    even = F.col("c_custkey") % 2 == 0
    rows = c.groupBy((F.col("c_nationkey") % 10).alias("k")).agg(
        F.avg(F.when(even, F.col("c_acctbal"))).alias("x"), F.avg(F.when(~even, F.col("c_acctbal"))).alias("y")
    ).collect()
    x, y = [r["x"] for r in rows], [r["y"] for r in rows]
    return spark.createDataFrame([(stats.signed_rank(x, y), sum(a != b for a, b in zip(x, y, strict=True)))], "p double, n long")


@register(
    "paired_test",
    """WITH d AS (SELECT o_orderstatus AS k, o_orderkey % 4 AS g, o_totalprice AS v FROM orders),
     m AS (SELECT g, avg(v) FILTER (k = 'O') - avg(v) FILTER (k = 'F') AS d FROM d GROUP BY g),
     t AS (SELECT abs(avg(d)) / (stddev_samp(d) / sqrt(count(*))) / sqrt(3.0) AS q, count(*) AS n FROM m)
     SELECT round(1 - 2 / pi() * (q / (1 + q * q) + atan(q)), 7) AS p, n FROM t""",
)
def paired_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pairs are too few for ranks, so the paired t test answers; with 3 degrees its distribution is elementary."""
    o = raw(spark, sf_dir, "orders")
    price, kind = F.col("o_totalprice"), F.col("o_orderstatus")
    rows = o.groupBy((F.col("o_orderkey") % 4).alias("g")).agg(
        F.avg(F.when(kind == "O", price)).alias("x"), F.avg(F.when(kind == "F", price)).alias("y")
    ).collect()
    p = stats.paired_p([r["x"] for r in rows], [r["y"] for r in rows])
    return spark.createDataFrame([(round(p, 7), len(rows))], "p double, n long")


@register(
    "retention",
    """SELECT o_orderstatus, round(abs(s - r) / abs(r), 9) AS error FROM (SELECT o_orderstatus, avg(o_totalprice) AS r, avg(o_totalprice) FILTER (o_orderkey % 3 = 0) AS s FROM orders GROUP BY 1)""",
)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the means of a third of the orders are from those of all."""
    o = raw(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.avg("o_totalprice").alias("real"), F.avg(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice"))).alias("synthetic")
    )
    return MX.retention_error(o).select("o_orderstatus", F.round("error", 9).alias("error"))


@register(
    "runtime_preference",
    "SELECT event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN value END, CASE WHEN event_id % 2 = 0 THEN value * 2 END) AS runtime FROM events",
)
def runtime_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first runtime field that is there; a field that no record has is passed over."""
    e = raw(spark, sf_dir, "events")
    k = F.col("event_id")
    records = e.select("event_id", F.when(k % 3 != 0, F.col("value")).alias("runtime_sec"), F.when(k % 2 == 0, F.col("value") * 2).alias("total_sec"))
    return MX.first_runtime(records, ["runtime_sec", "seconds", "total_sec"]).select("event_id", "runtime")


def _tv_sql(x: str, y: str, source: str) -> str:
    return f"""SELECT 'tv {x} {y}' AS stat, (SELECT 0.5 * sum(abs(coalesce(p, 0) - q)) FROM (SELECT DISTINCT {x} AS x FROM {source}) a CROSS JOIN
      (SELECT {y} AS y, count(*) / CAST((SELECT count(*) FROM {source}) AS DOUBLE) AS q FROM {source} GROUP BY 1) b
      LEFT JOIN (SELECT {x} AS x, {y} AS y, count(*) / CAST(sum(count(*)) OVER (PARTITION BY {x}) AS DOUBLE) AS p FROM {source} GROUP BY {x}, {y}) c USING (x, y)) AS value"""


def _stats_sql(source: str, sizes: str) -> str:
    pairs = (("SEGMENT", "YEAR"), ("NATION", "STATUS"), ("SEGMENT", "PRIORITY"))
    return " UNION ALL ".join([
        *(_tv_sql(x, y, source) for x, y in pairs),
        f"SELECT 'big groups', max(s) - min(s) FROM (SELECT SEGMENT, avg(CAST(n >= 12 AS INTEGER)) AS s FROM {sizes} GROUP BY 1)",
        f"SELECT 'mean PRIORITY', avg(PRIORITY) FROM {source}",
    ])


@register(
    "planted_ratios",
    X.with_sql(
        f"SELECT stat, round(a.value, 8) AS real, round(b.value, 8) AS synthetic, round(b.value / a.value, 6) AS ratio FROM ({_stats_sql('w', 'n')}) a JOIN ({_stats_sql('v', 'm')}) b USING (stat)",
        """w AS (SELECT * FROM orders_ JOIN customer_ USING (ckey)), n AS (SELECT c.ckey, SEGMENT, count(okey) AS n FROM customer_ c LEFT JOIN orders_ o ON c.ckey = o.ckey GROUP BY ALL),
         v AS (SELECT * FROM w WHERE okey % 3 <> 0), m AS (SELECT c.ckey, SEGMENT, count(okey) AS n FROM customer_ c LEFT JOIN (SELECT * FROM orders_ WHERE okey % 3 <> 0) o ON c.ckey = o.ckey GROUP BY ALL)""",
    ),
)
def planted_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Association distances, share of big groups and a mean, of all orders and of two thirds of them, with ratios."""
    o, c = X.orders(spark, sf_dir), X.customer(spark, sf_dir)

    def found(rows: DataFrame) -> DataFrame:
        sizes = S.all_sizes(c, "ckey", rows, "ckey", ["SEGMENT"])
        pairs = [("SEGMENT", "YEAR"), ("NATION", "STATUS"), ("SEGMENT", "PRIORITY")]
        return MX.planted_stats(rows.join(c, "ckey"), pairs, sizes, "SEGMENT", 12, "PRIORITY")

    both = MX.ratios(found(o), found(o.filter("okey % 3 <> 0")))
    return both.select("stat", F.round("real", 8).alias("real"), F.round("synthetic", 8).alias("synthetic"), F.round("ratio", 6).alias("ratio"))
