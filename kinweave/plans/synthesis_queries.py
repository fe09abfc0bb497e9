"""Registered queries of draws, links, calibration, the census benchmark and whole syntheses."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.accountant import equal_sigma, gamma
from kinweave.functions.noise import bits, bits_sql, gaussian_sql, uniform_sql
from kinweave.functions.options import parse
from kinweave.operators import baselines as BL
from kinweave.operators import calibrate as C
from kinweave.operators import census as CE
from kinweave.operators import marginals as M
from kinweave.operators import plant as PL
from kinweave.operators import sampling as SA
from kinweave.operators import sizes as S
from kinweave.operators import synth as SY
from kinweave.operators import views as V
from kinweave.operators import workload as W
from kinweave.plans import fixtures as X
from kinweave.plans.registry import register
from kinweave.plans.release import Release, release
from kinweave.schema import Role, Schema
from kinweave.scratch import shared_folder
from kinweave.sources import writers as K

# Draws and links ----------------------------------------------------------------------------------------------


def histogram(df: DataFrame, attr: str, size: int) -> np.ndarray:
    out = np.zeros(size)
    for code, n in df.groupBy(attr).agg(F.count(F.lit(1))).collect():
        out[code] = n
    return out


def crosstab(df: DataFrame, a: str, b: str, sizes: tuple[int, int]) -> np.ndarray:
    out = np.zeros(sizes)
    for x, y, n in df.groupBy(a, b).agg(F.count(F.lit(1))).collect():
        out[x, y] = n
    return out


@register(
    "draw_inverse",
    X.with_sql(
        f"""SELECT ckey, (SELECT CAST(count(*) AS INTEGER) FROM cdf WHERE c <= {uniform_sql("'3|code|' || ckey")} AND v < 24) AS code FROM customer_""",
        """h AS (SELECT range AS v, (SELECT count(*) FROM customer_ WHERE NATION = range) AS n FROM range(25)),
         p AS (SELECT v, CAST(n AS DOUBLE) / sum(n) OVER () AS p FROM h), cdf AS (SELECT v, sum(p) OVER (ORDER BY v) AS c FROM p)""",
    ),
)
def draw_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation for every customer, drawn from the histogram of nations by the inverse distribution function."""
    c = X.customer(spark, sf_dir)
    return SA.draw(c.select("ckey"), "ckey", "code", histogram(c, "NATION", 25), {}, 3)


_LIFT = """(CAST(j.n AS DOUBLE) / t.n + 1e-6 / {cells}) / ((CAST(a.n AS DOUBLE) / t.n) * (CAST(b.n AS DOUBLE) / t.n) + 1e-6)"""


def _lift_sql(name: str, x: str, sizes: tuple[int, int]) -> str:
    """WITH entries: the lift of x and QBIN over lineitems as name(x, v, l), every cell of the domains."""
    return f"""{name}_j AS (SELECT x.range AS x, v.range AS v, count(w.QBIN) AS n FROM range({sizes[0]}) x CROSS JOIN range({sizes[1]}) v
       LEFT JOIN wide w ON w.{x} = x.range AND w.QBIN = v.range GROUP BY ALL),
     {name} AS (SELECT j.x, j.v, {_LIFT.format(cells=sizes[0] * sizes[1])} AS l FROM {name}_j j JOIN (SELECT x, sum(n) AS n FROM {name}_j GROUP BY x) a USING (x)
       JOIN (SELECT v, sum(n) AS n FROM {name}_j GROUP BY v) b USING (v), (SELECT sum(n) AS n FROM {name}_j) t)"""


@register(
    "draw_given",
    X.with_sql(
        """SELECT RFLAG, STATUS, code, count(*) AS n FROM drawn GROUP BY ALL""",
        f"""wide AS (SELECT lkey, QBIN, RFLAG, STATUS FROM lineitem_ JOIN orders_ USING (okey)),
         {_lift_sql("lr", "RFLAG", (3, 6))}, {_lift_sql("ls", "STATUS", (3, 6))},
         base AS (SELECT v.range AS v, count(w.QBIN) AS n FROM range(6) v LEFT JOIN wide w ON w.QBIN = v.range GROUP BY ALL),
         weights AS (SELECT lr.x AS r, ls.x AS s, lr.v AS v, n / sum(n) OVER (PARTITION BY lr.x, ls.x) * lr.l * ls.l AS w FROM lr JOIN ls USING (v) JOIN base USING (v)),
         p AS (SELECT r, s, v, w / sum(w) OVER (PARTITION BY r, s) AS p FROM weights),
         cdf AS (SELECT r, s, v, sum(p) OVER (PARTITION BY r, s ORDER BY v) AS c FROM p),
         drawn AS (SELECT RFLAG, STATUS, (SELECT CAST(count(*) AS INTEGER) FROM cdf WHERE r = RFLAG AND s = STATUS AND v < 5
           AND c <= {uniform_sql("'4|code|' || lkey")}) AS code FROM wide)""",
    ),
)
def draw_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity bins drawn from their histogram times the lifts of the return flag and of the order's status."""
    tables = X.tables(spark, sf_dir, X.CHAIN, keyed=True)
    wide = V.view(X.CHAIN, tables, "lineitem", [("lineitem", "QBIN"), ("lineitem", "RFLAG"), ("orders", "STATUS")], extra=["lkey"])
    wide = wide.select("lkey", F.col("lineitem__QBIN").alias("QBIN"), F.col("lineitem__RFLAG").alias("RFLAG"), F.col("orders__STATUS").alias("STATUS"))
    lifts = {}
    for a in ("RFLAG", "STATUS"):
        joint = crosstab(wide, a, "QBIN", (3, 6))
        joint = joint / joint.sum()
        lifts[a] = C.lift(joint, joint.sum(axis=1), joint.sum(axis=0))
    drawn = SA.draw(wide, "lkey", "code", histogram(wide, "QBIN", 6), lifts, 4)
    return drawn.groupBy("RFLAG", "STATUS", "code").agg(F.count(F.lit(1)).alias("n"))


@register(
    "child_rows",
    X.with_sql(
        """SELECT row_number() OVER (ORDER BY ckey, i) - 1 AS child, ckey, NATION FROM (SELECT ckey, NATION, unnest(range(ACCTBIN)) AS i FROM customer_)"""
    ),
)
def child_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many children of each customer as its balance bin says, with keys from 0 without gaps."""
    return SA.children(X.customer(spark, sf_dir), "ckey", "ACCTBIN", "ckey", "child", ["NATION"])


@register(
    "link_random",
    X.with_sql(
        f"""SELECT okey, ckey FROM o JOIN p ON u >= lo AND u < hi""",
        f"""p AS (SELECT ckey, (sum(w) OVER (ORDER BY ckey) - w) / sum(w) OVER () AS lo, sum(w) OVER (ORDER BY ckey) / sum(w) OVER () AS hi
          FROM (SELECT ckey, CAST(ACCTBIN AS DOUBLE) AS w FROM customer_ WHERE ACCTBIN > 0)),
         o AS (SELECT DISTINCT okey, {uniform_sql("'5|link|' || okey")} AS u FROM orders_)""",
    ),
)
def link_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders linked to customers drawn in proportion to their balance bins."""
    o, c = X.orders(spark, sf_dir), X.customer(spark, sf_dir)
    weighted = c.select("ckey", F.col("ACCTBIN").cast("double").alias("w"))
    return SA.linked(o.select("okey"), "okey", weighted, "ckey", "w", "ckey", 5).select("okey", "ckey")


@register(
    "random_member",
    X.with_sql(
        f"""SELECT okey, m.ckey AS member FROM (SELECT okey, okey % 30 AS g, {bits_sql("'6|member|' || okey")} AS h FROM orders_) o
         LEFT JOIN (SELECT NATION, count(*) AS n FROM customer_ GROUP BY 1) s ON s.NATION = g
         LEFT JOIN (SELECT ckey, NATION, row_number() OVER (PARTITION BY NATION ORDER BY ckey) - 1 AS r FROM customer_) m ON m.NATION = g AND m.r = h % n"""
    ),
)
def random_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every order a random customer of a nation; nations that don't exist give none."""
    o = X.orders(spark, sf_dir).select("okey", (F.col("okey") % 30).alias("g"))
    members = X.customer(spark, sf_dir).select(F.col("NATION").cast("long").alias("g"), "ckey")
    return SA.random_member(o, "okey", "g", members, "ckey", "member", 6).select("okey", "member")


@register(
    "renormalised",
    X.with_sql(
        """SELECT 'top' AS part, k AS a, CAST(NULL AS BIGINT) AS b, STATUS AS c, count(*) AS n FROM (SELECT *, dense_rank() OVER (ORDER BY STATUS) - 1 AS k FROM w) GROUP BY ALL
         UNION ALL SELECT 'leaf', k, NULL, RFLAG, count(*) FROM (SELECT *, dense_rank() OVER (ORDER BY STATUS, YEAR) - 1 AS k FROM w) GROUP BY ALL
         UNION ALL SELECT DISTINCT 'mid', k, t, YEAR, 1 FROM (SELECT *, dense_rank() OVER (ORDER BY STATUS, YEAR) - 1 AS k, dense_rank() OVER (ORDER BY STATUS) - 1 AS t FROM w)""",
        "w AS (SELECT STATUS, YEAR, RFLAG FROM lineitem_ JOIN orders_ USING (okey))",
    ),
)
def renormalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A denormalised table split into parents by distinct signature, and how many leaves point at each."""
    wide = X.lineitem(spark, sf_dir).join(X.orders(spark, sf_dir), "okey").select("STATUS", "YEAR", "RFLAG")
    parts = V.renormalise(wide, {"top": ["STATUS"], "mid": ["YEAR"]}, ["RFLAG"])
    none = F.lit(None).cast("long")
    status = parts["leaf"].join(parts["mid"], "mid_key").groupBy("top_key").agg(F.count(F.lit(1)).alias("n"))
    top = parts["top"].join(status, "top_key").select(F.lit("top").alias("part"), F.col("top_key").alias("a"), none.alias("b"), F.col("STATUS").alias("c"), "n")
    mid = parts["mid"].select(F.lit("mid").alias("part"), F.col("mid_key").alias("a"), F.col("top_key").alias("b"), F.col("YEAR").alias("c"), F.lit(1).cast("long").alias("n"))
    leaf = parts["leaf"].groupBy("mid_key", "RFLAG").agg(F.count(F.lit(1)).alias("n"))
    leaf = leaf.select(F.lit("leaf").alias("part"), F.col("mid_key").alias("a"), none.alias("b"), F.col("RFLAG").alias("c"), "n")
    return top.unionByName(mid).unionByName(leaf)


@register(
    "segment_plant",
    X.with_sql(
        f"""SELECT ckey, CAST(CASE WHEN {bits_sql("'2|segment|' || ckey")} < {int(0.6 * (1 << 52))} THEN NATION % 5
         ELSE floor({uniform_sql("'2|free|' || ckey")} * 5) END AS INTEGER) AS planted FROM customer_"""
    ),
)
def segment_plant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PL.segment_plant(X.customer(spark, sf_dir), "ckey", "NATION", 5, 0.6, 2, "planted").select("ckey", "planted")


# Calibration --------------------------------------------------------------------------------------------------


@register(
    "repair",
    X.with_sql(
        "SELECT CAST(range AS INTEGER) AS STATUS, CASE range WHEN 0 THEN n - 2 * (n // 3) ELSE n // 3 END AS n FROM range(3), (SELECT count(*) AS n FROM orders_)",
    ),
)
def repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' status codes moved, least date first, until the three codes are alike in number."""
    return _repaired(spark, sf_dir).groupBy("STATUS").agg(F.count(F.lit(1)).alias("n"))


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.orders(spark, sf_dir).select("okey", "STATUS", "YEAR")
    n = o.count()
    target = {0: n - 2 * (n // 3), 1: n // 3, 2: n // 3}
    return C.repair(o, "okey", "STATUS", target, F.col("YEAR").cast("double"))


@register(
    "repair_rows",
    X.with_sql(
        """SELECT okey, CAST(CASE WHEN r < surplus THEN coalesce((SELECT min(code) FROM opened WHERE before + r < ends), STATUS) ELSE STATUS END AS INTEGER) AS STATUS FROM ranks""",
        f"""n AS (SELECT count(*) AS n FROM orders_), target AS (SELECT range AS code, CASE range WHEN 0 THEN n - 2 * (n // 3) ELSE n // 3 END AS goal FROM range(3), n),
         have AS (SELECT code, goal, (SELECT count(*) FROM orders_ WHERE STATUS = code) AS n FROM target),
         taken AS (SELECT code, n - goal AS surplus, sum(greatest(n - goal, 0)) OVER (ORDER BY code) - greatest(n - goal, 0) AS before FROM have),
         opened AS (SELECT code, sum(goal - n) OVER (ORDER BY code) AS ends FROM have WHERE goal > n),
         ranks AS (SELECT okey, STATUS, surplus, before, row_number() OVER (PARTITION BY STATUS ORDER BY YEAR, {bits_sql("'0|repair|' || okey")}, okey) - 1 AS r
          FROM orders_ JOIN taken ON code = STATUS)""",
    ),
)
def repair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which orders moved: of a code with a surplus those of the least year, ties in an order shuffled by the key."""
    return _repaired(spark, sf_dir).select("okey", "STATUS")


_SIZES = "s AS (SELECT ckey AS k, count(*) AS n FROM orders_ GROUP BY 1)"


@register(
    "rescale_total",
    X.with_sql(
        """SELECT k, CAST(1 + f + CAST(row_number() OVER (ORDER BY f - x, k) <= (SELECT max(spend) - sum(f) FROM y) AS INTEGER) AS BIGINT) AS m FROM y""",
        _SIZES
        + """, t AS (SELECT 3 * sum(n) // 2 AS goal, count(*) AS c, sum(greatest(n - 1, 0)) AS whole FROM s),
         y AS (SELECT k, goal - c AS spend, greatest(n - 1, 0) / CAST(whole AS DOUBLE) * (goal - c) AS x, floor(greatest(n - 1, 0) / CAST(whole AS DOUBLE) * (goal - c) + 1e-9) AS f FROM s, t)""",
    ),
)
def rescale_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of orders raised by half in proportion above 1, whole numbers by largest remainder."""
    rows = S.group_sizes(X.orders(spark, sf_dir), "ckey").withColumnRenamed("ckey", "k")
    goal = 3 * (rows.agg(F.sum("n")).first()[0] or 0) // 2
    return C.rescale_groups(rows, [], "k", "n", F.lit(goal), 1, "m").select("k", "m")


@register(
    "growcap_sizes",
    X.with_sql(
        """SELECT k, CAST(CASE WHEN n >= 12 THEN n + short // c + CAST(r <= short % c AS INTEGER) ELSE n END AS BIGINT) AS m FROM
         (SELECT k, n, row_number() OVER (PARTITION BY n >= 12 ORDER BY k) AS r FROM (SELECT k, least(n, 12) AS n FROM s)),
         (SELECT (SELECT sum(n) FROM s) - sum(least(n, 12)) AS short, count(*) FILTER (n >= 12) AS c FROM s)""",
        _SIZES,
    ),
)
def growcap_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped numbers of orders brought back to their total by the groups at the cap alone."""
    rows = S.group_sizes(X.orders(spark, sf_dir), "ckey").orderBy("ckey").collect()
    grown = C.grown_at_cap([min(r["n"], 12) for r in rows], sum(r["n"] for r in rows), 12, 1)
    return spark.createDataFrame([(r["ckey"], m) for r, m in zip(rows, grown, strict=True)], "k long, m long")


_REMAINDER = """SELECT code, CAST(f + CAST(row_number() OVER (ORDER BY f - x, code) <= goal - sum(f) OVER () AS INTEGER) AS BIGINT) AS n FROM
 (SELECT code, goal, w / sum(w) OVER () * goal AS x, floor(w / sum(w) OVER () * goal + 1e-9) AS f FROM weights)"""


@register(
    "leaf_target",
    X.with_sql(
        _REMAINDER,
        """parents AS (SELECT ckey, SEGMENT, (SELECT count(*) FROM orders_ o WHERE o.ckey = c.ckey) AS n FROM customer_ c),
         mass AS (SELECT SEGMENT AS a, CAST(sum(least(n, 15)) AS DOUBLE) AS m FROM parents GROUP BY 1),
         joint AS (SELECT SEGMENT AS a, PRIORITY AS code, count(*) AS j FROM orders_ JOIN customer_ USING (ckey) GROUP BY ALL),
         weights AS (SELECT code, (SELECT count(*) FROM orders_) AS goal, sum(m * (j / p)) AS w FROM joint JOIN (SELECT a, CAST(sum(j) AS DOUBLE) AS p FROM joint GROUP BY a) USING (a) JOIN mass USING (a) GROUP BY ALL)""",
    ),
)
def leaf_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target histogram of priorities: segments weighted by the orders their capped sizes stand for."""
    o, c = X.orders(spark, sf_dir), X.customer(spark, sf_dir)
    table = np.zeros((5, 16))
    for a, size, n in S.size_histogram(c, "ckey", o, "ckey", "SEGMENT", tau=15, zeros=True).collect():
        table[a, size] = n
    given = C.conditional(crosstab(o.join(c, "ckey"), "SEGMENT", "PRIORITY", (5, 5)))
    target = C.leaf_target(table, range(16), given, o.count())
    return spark.createDataFrame(list(enumerate(target)), "code int, n long")


@register(
    "row_target",
    X.with_sql(
        _REMAINDER,
        "weights AS (SELECT STATUS AS code, count(*) * 1.0::DOUBLE AS w, (SELECT count(*) FROM lineitem_) AS goal FROM orders_ GROUP BY 1)",
    ),
)
def row_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of order status scaled to the number of lineitems."""
    target = C.row_target(histogram(X.orders(spark, sf_dir), "STATUS", 3).tolist(), X.lineitem(spark, sf_dir).count())
    return spark.createDataFrame(list(enumerate(target)), "code int, n long")


def _fit_sql(axes: tuple[str, ...], targets: list[tuple[str, ...]], sweeps: int) -> str:
    """WITH entries x0, x1 and so on: cells scaled to the targets in turn; goal0 and so on have the goals as g."""
    out, k = [], 0
    names = ", ".join(axes)
    for _ in range(sweeps):
        for i, t in enumerate(targets):
            by = ", ".join(t)
            out.append(
                f"x{k + 1} AS MATERIALIZED (SELECT {names}, CASE WHEN have > 0 THEN value * (coalesce(g, 0) / have) ELSE value END AS value FROM "
                f"(SELECT *, sum(value) OVER (PARTITION BY {by}) AS have FROM x{k}) LEFT JOIN goal{i} USING ({by}))"
            )
            k += 1
    return ", ".join(out)


_HALF = f"""half_ AS (SELECT * FROM orders_ WHERE {bits_sql("'half|' || okey")} < {1 << 51})"""
_SWEEPS = 40


@register(
    "ipf_margins",
    X.with_sql(
        f"SELECT STATUS, YEAR, PRIORITY, round(value, 5) AS value FROM x{2 * _SWEEPS}",
        f"""{_HALF}, x0 AS (SELECT STATUS, YEAR, PRIORITY, CAST(count(*) AS DOUBLE) AS value FROM half_ GROUP BY ALL),
         goal0 AS (SELECT STATUS, YEAR, CAST(count(*) AS DOUBLE) AS g FROM orders_ GROUP BY ALL),
         goal1 AS (SELECT YEAR, PRIORITY, CAST(count(*) AS DOUBLE) AS g FROM orders_ GROUP BY ALL),
         {_fit_sql(("STATUS", "YEAR", "PRIORITY"), [("STATUS", "YEAR"), ("YEAR", "PRIORITY")], _SWEEPS)}""",
    ),
)
def ipf_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied cells of three attributes of half the orders fitted to two pairwise tables of all orders."""
    o = X.orders(spark, sf_dir)
    names = ["STATUS", "YEAR", "PRIORITY"]
    half = o.filter(bits("half", F.col("okey")) < F.lit(1 << 51))
    cells = {tuple(r)[:3]: float(r["n"]) for r in half.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()}
    targets = []
    for axes in ((0, 1), (1, 2)):
        own = o.groupBy(*(names[a] for a in axes)).agg(F.count(F.lit(1)).alias("n")).collect()
        targets.append((axes, {tuple(r)[:2]: float(r["n"]) for r in own}))
    fitted = C.ipf(cells, targets, _SWEEPS)
    rows = [(*map(int, k), round(v, 5)) for k, v in sorted(fitted.items())]
    return spark.createDataFrame(rows, "STATUS int, YEAR int, PRIORITY int, value double")


@register(
    "ras_kd",
    X.with_sql(
        f"SELECT NATION, SEGMENT, ACCTBIN, round(value, 5) AS value FROM x{3 * _SWEEPS}",
        f"""x0 AS (SELECT NATION, SEGMENT, ACCTBIN, CAST(sum(n) AS DOUBLE) AS value FROM customer_ JOIN (SELECT ckey, count(*) AS n FROM orders_ GROUP BY 1) USING (ckey) GROUP BY ALL),
         q0 AS (SELECT NATION, 2.0 * sum(value) AS q FROM x0 GROUP BY 1), q1 AS (SELECT SEGMENT, 2.0 * sum(value) + 7 * SEGMENT AS q FROM x0 GROUP BY 1),
         q2 AS (SELECT ACCTBIN, 2.0 * sum(value) + 3 AS q FROM x0 GROUP BY 1),
         grand AS (SELECT ((SELECT sum(q) FROM q0) + (SELECT sum(q) FROM q1) + (SELECT sum(q) FROM q2)) / 3 AS t),
         goal0 AS (SELECT NATION, q * (t / (SELECT sum(q) FROM q0)) AS g FROM q0, grand), goal1 AS (SELECT SEGMENT, q * (t / (SELECT sum(q) FROM q1)) AS g FROM q1, grand),
         goal2 AS (SELECT ACCTBIN, q * (t / (SELECT sum(q) FROM q2)) AS g FROM q2, grand),
         {_fit_sql(("NATION", "SEGMENT", "ACCTBIN"), [("NATION",), ("SEGMENT",), ("ACCTBIN",)], _SWEEPS)}""",
    ),
)
def ras_kd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by three attributes of their customers, scaled axis by axis to quotas of one grand total."""
    rows = S.all_sizes(X.customer(spark, sf_dir), "ckey", X.orders(spark, sf_dir), "ckey", ["NATION", "SEGMENT", "ACCTBIN"])
    cells = np.zeros((25, 5, 22))
    for *k, n in rows.filter("n > 0").groupBy("NATION", "SEGMENT", "ACCTBIN").agg(F.sum("n")).collect():
        cells[tuple(k)] = n
    sums = [cells.sum(axis=tuple(j for j in range(3) if j != i)) for i in range(3)]
    quotas = [2 * sums[0], np.where(sums[1] > 0, 2 * sums[1] + 7 * np.arange(5), 0), np.where(sums[2] > 0, 2 * sums[2] + 3, 0)]
    goal = C.ras(cells, quotas, _SWEEPS)
    made = [(*map(int, k), round(float(goal[tuple(k)]), 5)) for k in np.argwhere(cells > 0)]
    return spark.createDataFrame(made, "NATION int, SEGMENT int, ACCTBIN int, value double")


@register(
    "szquota_sizes",
    X.with_sql(
        """SELECT 'NATION' AS attr, NATION AS code, TRUE AS met FROM orders_ JOIN customer_ USING (ckey) GROUP BY NATION
         UNION ALL SELECT 'SEGMENT', SEGMENT, TRUE FROM orders_ JOIN customer_ USING (ckey) GROUP BY SEGMENT UNION ALL SELECT 'total', -1, TRUE"""
    ),
)
def szquota_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal sizes brought to the orders of each nation and of each segment at once, one off a cell at most."""
    tables = X.tables(spark, sf_dir, X.CHAIN)
    pairs = [(("customer", a), ("orders", "STATUS")) for a in ("NATION", "SEGMENT")]
    rel = release(X.CHAIN, tables, None, parse("rowleaf,pubn,szquota", "chain3"), 1, pairs, exclude_sizes=["ACCTBIN"])
    df = tables["customer"].select("ckey", F.col("NATION").alias("customer__NATION"), F.col("SEGMENT").alias("customer__SEGMENT"), F.lit(10).cast("long").alias("size"))
    made = SY.to_total(df, "ckey", rel, "orders", "customer", rel.totals["orders"], 0, parse("szquota", "chain3"), 1)
    o, rows = tables["orders"].join(tables["customer"], "ckey"), []
    for a, other in (("NATION", 5), ("SEGMENT", 25)):
        have = {r[0]: r[1] for r in made.groupBy(f"customer__{a}").agg(F.sum("size")).collect()}
        rows += [(a, code, abs(have[code] - n) <= other) for code, n in o.groupBy(a).agg(F.count(F.lit(1))).collect()]
    rows.append(("total", -1, made.agg(F.sum("size")).first()[0] == rel.totals["orders"]))
    return spark.createDataFrame(rows, "attr string, code int, met boolean")


@register(
    "cross_guard",
    X.with_sql(
        """SELECT x, v, round(1 + (l - 1) * least(1.0, n / 50.0) * least(1.0, m / 50.0), 6) AS value FROM lg JOIN lg_j USING (x, v) JOIN (SELECT SEGMENT AS x, CAST(count(*) AS DOUBLE) AS m FROM customer_ GROUP BY 1) USING (x)""",
        "wide AS (SELECT QBIN, SEGMENT FROM lineitem_ JOIN orders_ USING (okey) JOIN customer_ USING (ckey)), " + _lift_sql("lg", "SEGMENT", (5, 6)),
    ),
)
def cross_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifts of segment and quantity across two joins, guarded by the noise of a cell and of the segment's count."""
    tables = X.tables(spark, sf_dir, X.CHAIN)
    wide = V.view(X.CHAIN, tables, "lineitem", [("customer", "SEGMENT"), ("lineitem", "QBIN")])
    counts = crosstab(wide, "customer__SEGMENT", "lineitem__QBIN", (5, 6))
    joint = counts / counts.sum()
    table = SY.guarded(C.lift(joint, joint.sum(axis=1), joint.sum(axis=0)), counts, histogram(tables["customer"], "SEGMENT", 5), 10.0)
    return spark.createDataFrame([(x, v, round(float(table[x, v]), 6)) for x in range(5) for v in range(6)], "x int, v int, value double")


@register(
    "ratio_top",
    X.with_sql(
        """SELECT a.code, round(m * (SELECT count(*) FROM customer_) / sum(m) OVER (), 6) AS value FROM (SELECT NATION AS code, CAST(count(*) AS DOUBLE) AS m FROM orders_ JOIN customer_ USING (ckey) GROUP BY 1) a"""
    ),
)
def ratio_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top's nations estimated from the orders of each, scaled to the number of customers."""
    tables = X.tables(spark, sf_dir, X.CHAIN)
    pair = (("customer", "NATION"), ("orders", "STATUS"))
    rel = release(X.CHAIN, tables, None, parse("rowleaf,ratiotop,pubn", "chain3"), 1, [pair])
    values = SY.one_way(rel, "customer", "NATION", parse("ratiotop", "chain3"), rel.totals["customer"])
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(values) if v > 0], "code int, value double")


# Baselines ----------------------------------------------------------------------------------------------------

_GAMMA = gamma(1.0, 1e-5)


@register(
    "relink",
    X.with_sql(
        "SELECT CAST(n AS INTEGER) AS size, count(*) AS groups FROM (SELECT c.ckey, count(l.ckey) AS n FROM customer_ c LEFT JOIN links l USING (ckey) GROUP BY 1) GROUP BY 1",
        f"""g AS (SELECT least(n, 64) AS size, count(*) AS groups FROM (SELECT ckey, count(*) AS n FROM orders_ GROUP BY 1) GROUP BY 1),
         shares AS (SELECT r.range AS size, greatest(coalesce(groups, 0) + {gaussian_sql("'1|relink|' || r.range")} / {_GAMMA!r}, 0.0) AS share FROM range(1, 65) r LEFT JOIN g ON g.size = r.range),
         cdf AS (SELECT size, sum(p) OVER (ORDER BY size) AS c FROM (SELECT size, share / sum(share) OVER () AS p FROM shares)),
         weighted AS (SELECT ckey, CAST(1 + (SELECT count(*) FROM cdf WHERE size < 64 AND c <= {uniform_sql("'1|__b|' || ckey")}) AS DOUBLE) AS w FROM customer_),
         p AS (SELECT ckey, (sum(w) OVER (ORDER BY ckey) - w) / sum(w) OVER () AS lo, sum(w) OVER (ORDER BY ckey) / sum(w) OVER () AS hi FROM weighted),
         links AS (SELECT okey, p.ckey FROM (SELECT okey, {uniform_sql("'1|link|' || okey")} AS u FROM orders_) JOIN p ON u >= lo AND u < hi)""",
    ),
)
def relink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group sizes of orders linked anew to customers by a noisy size histogram."""
    o, c = X.orders(spark, sf_dir), X.customer(spark, sf_dir)
    shares = BL.noisy_size_shares(o, "ckey", 1.0, 1, 64, 1e-5)
    made = BL.relink(o.drop("ckey"), "okey", c, "ckey", shares, "ckey", 1)
    return S.size_histogram(c, "ckey", made, "ckey", zeros=True)


def _independent_sql(attr: str, size: int, scale: float) -> str:
    noise = gaussian_sql(f"'1|marginal|{attr}|' || v.range")
    return f"""SELECT '{attr}' AS attr, code, count(*) AS n FROM (SELECT (SELECT CAST(count(*) AS INTEGER) FROM
      (SELECT v, sum(p) OVER (ORDER BY v) AS c FROM (SELECT v, x / sum(x) OVER () AS p FROM (SELECT v.range AS v, greatest(coalesce(n, 0) + {scale!r} * {noise}, 0.0) AS x
       FROM range({size}) v LEFT JOIN (SELECT {attr} AS a, count(*) AS n FROM orders_ GROUP BY 1) ON a = v.range)))
      WHERE v < {size - 1} AND c <= u) AS code FROM (SELECT {uniform_sql(f"'1|{attr}|' || range")} AS u FROM range((SELECT count(*) FROM orders_)))) GROUP BY ALL"""


_SCALE = float(np.sqrt(2.0 * 4) / _GAMMA)


@register("independent_marginals", X.with_sql(" UNION ALL ".join(_independent_sql(a, n, _SCALE) for a, n in X.MID.sizes.items())))
def independent_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of orders whose attributes are each drawn from a noisy histogram of their own."""
    o = X.orders(spark, sf_dir)
    made = BL.independent_marginals(spark, o, X.MID.sizes, 1.0, o.count(), 1, 1e-5)
    parts = [made.groupBy(F.col(a).alias("code")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(a).alias("attr"), "code", "n") for a in X.MID.attrs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register(
    "baseline_independent",
    X.with_sql(" UNION ALL ".join(
        f"SELECT '{r}' AS role, '{a}' AS attr, (SELECT count(*) FROM {r}_) AS n, TRUE AS linked" for r, role in X.CHAIN.roles.items() for a in role.attrs
    )),
)
def baseline_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of rows of independent tables, and whether every child was linked to a parent that exists."""
    made = BL.per_table(spark, X.CHAIN, X.tables(spark, sf_dir, X.CHAIN), 3.2, 1)
    counts = _histograms(X.CHAIN, made).groupBy("role", "attr").agg(F.sum("n").alias("n"))
    lost = []
    for r, role in X.CHAIN.roles.items():
        n = sum(V.orphans(made[r], fk, made[up], X.CHAIN.roles[up].key).count() for up, fk in role.parents.items())
        lost.append((r, n == 0))
    return counts.join(F.broadcast(spark.createDataFrame(lost, "role string, linked boolean")), "role")


# The census benchmark -----------------------------------------------------------------------------------------

_REGIONS = 400


def _coin_sql(p: str, purpose: str, key: str) -> str:
    return f"CAST({uniform_sql(f"'0|{purpose}|' || {key}")} < {p} AS INTEGER)"


def _by_sql(bit: str, values: tuple[float, float]) -> str:
    return f"CASE WHEN {bit} = 1 THEN {values[1]}::DOUBLE ELSE {values[0]}::DOUBLE END"


CENSUS_SQL = f"""
 region_ AS (SELECT range AS r_id, {_coin_sql("0.5", "urban", "range")} AS URBAN, CAST(floor({uniform_sql("'0|band|' || range")} * 3) AS INTEGER) AS BAND FROM range(1, {_REGIONS + 1})),
 h0 AS (SELECT row_number() OVER (ORDER BY r_id, i) - 1 AS h_id, r_id, URBAN FROM (SELECT r_id, URBAN, unnest(range(CAST(2 + floor({uniform_sql("'0|households|' || r_id")} * 5) AS BIGINT))) AS i FROM region_)),
 h1 AS (SELECT *, {_coin_sql(_by_sql("URBAN", CE.OWN_BY_URBAN), "own", "h_id")} AS OWN, CAST(floor({uniform_sql("'0|size|' || h_id")} * 5) AS INTEGER) AS SIZE,
  {_coin_sql(_by_sql("URBAN", CE.TYPE_BY_URBAN), "type", "h_id")} AS z FROM h0),
 household_ AS (SELECT h_id, r_id, OWN, SIZE FROM h1),
 i0 AS (SELECT row_number() OVER (ORDER BY h_id, j) - 1 AS i_id, h_id, z FROM (SELECT h_id, z, unnest(range(SIZE + 1)) AS j FROM h1)),
 individual_ AS (SELECT i_id, h_id, CAST(floor({uniform_sql("'0|age|' || i_id")} * 8) AS INTEGER) AS AGE, {_coin_sql(_by_sql("z", CE.EMP_BY_TYPE), "emp", "i_id")} AS EMP,
  CAST(floor({uniform_sql("'0|edu|' || i_id")} * 4) AS INTEGER) AS EDU FROM i0),
 wide_i AS (SELECT i.*, OWN, SIZE, URBAN, BAND, 1.0 / count(*) OVER (PARTITION BY i.h_id) AS w FROM individual_ i JOIN household_ USING (h_id) JOIN region_ USING (r_id)),
 wide_h AS (SELECT h.*, URBAN, BAND FROM household_ h JOIN region_ USING (r_id))"""


def _family_sql(names) -> str:
    parts = []
    for n in names:
        roles, attrs = CE.REGISTRY[n]
        codes = attrs.split()
        if roles == "ii":
            a, b = codes
            parts.append(
                f"SELECT '{n}' AS query_name, l.{a} AS c0, r.{b} AS c1, CAST(NULL AS INTEGER) AS c2, round(sum(1.0 / least((l.SIZE + 1) * l.SIZE, 20)), 6) AS value "
                "FROM wide_i l JOIN wide_i r ON l.h_id = r.h_id AND l.i_id < r.i_id GROUP BY ALL"
            )
            continue
        source, value = {"r": ("region_", "count(*)"), "h": ("household_", "count(*)"), "rh": ("wide_h", "count(*)")}.get(roles, ("wide_i", "sum(w)"))
        padded = [*codes, "CAST(NULL AS INTEGER)", "CAST(NULL AS INTEGER)"][:3]
        parts.append(
            f"SELECT '{n}' AS query_name, {', '.join(f'{c} AS c{i}' for i, c in enumerate(padded))}, round(CAST({value} AS DOUBLE), 6) AS value FROM {source} GROUP BY {', '.join(codes)}"
        )
    return " UNION ALL ".join(parts)


register("census_generate", f"WITH {CENSUS_SQL} SELECT i_id, h_id, r_id, URBAN, BAND, OWN, SIZE, AGE, EMP, EDU FROM individual_ JOIN household_ USING (h_id) JOIN region_ USING (r_id)")(
    lambda s, d: (lambda t: t["individual"].join(t["household"], "h_id").join(t["region"], "r_id").select(
        "i_id", "h_id", "r_id", "URBAN", "BAND", "OWN", "SIZE", "AGE", "EMP", "EDU"
    ))(CE.generate(s, _REGIONS))
)


@register("census_family", f"WITH {CENSUS_SQL} {_family_sql(CE.REGISTRY)}")
def census_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 24 registered objects of the census."""
    return CE.family(CE.generate(spark, _REGIONS)).withColumn("value", F.round("value", 6))


_CENSUS_QUERIES = CE.workload(60)


def _census_batch_sql() -> str:
    views = {r: f"q_{r} AS (SELECT {', '.join(f'{a} AS {CE.ROLE_OF[a]}__{a}' for a in attrs)} FROM {source})" for r, attrs, source in (
        ("household", "URBAN BAND OWN SIZE".split(), "wide_h"), ("individual", "URBAN BAND OWN SIZE AGE EMP EDU".split(), "wide_i"),
    )}
    return f"WITH {CENSUS_SQL}, {', '.join(views.values())} " + " UNION ALL ".join(W.sql_of(q, f"q_{q.role}") for q in _CENSUS_QUERIES)


register("census_batch", _census_batch_sql())(lambda s, d: W.answer(CE.SCHEMA, CE.generate(s, _REGIONS), _CENSUS_QUERIES))


@register(
    "census_pooled",
    f"""WITH {CENSUS_SQL}, o AS (SELECT URBAN, OWN, EMP, sum(w) AS v FROM wide_i GROUP BY ALL), s AS (SELECT URBAN, SIZE, EMP, sum(w) AS v FROM wide_i GROUP BY ALL), m AS (SELECT URBAN, EMP, sum(w) AS v FROM wide_i GROUP BY ALL),
     p AS (SELECT o.URBAN, OWN, SIZE, o.EMP, (o.v / sum(o.v) OVER (PARTITION BY o.URBAN, OWN, SIZE)) * (s.v / sum(s.v) OVER (PARTITION BY o.URBAN, OWN, SIZE)) / greatest(m.v / sum(m.v) OVER (PARTITION BY o.URBAN, OWN, SIZE), 1e-9) AS x
      FROM o JOIN s ON o.URBAN = s.URBAN AND o.EMP = s.EMP JOIN m ON m.URBAN = o.URBAN AND m.EMP = o.EMP)
     SELECT URBAN, OWN, SIZE, EMP, round(x / sum(x) OVER (PARTITION BY URBAN, OWN, SIZE), 8) AS p FROM p""",
)
def census_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(EMP | URBAN, OWN, SIZE) pooled from the two conditionals over the one they share."""
    t = CE.dense(CE.family(CE.generate(spark, _REGIONS), CE.RELEASED))
    pooled = CE.pooled_conditional(*(CE.conditional_last(t[n]) for n in ("RHI_U_O_E", "RHI_U_S_E", "RI_URB_EMP")))
    rows = [(*map(int, k), round(float(pooled[tuple(k)]), 8)) for k in np.argwhere(pooled >= 0)]
    return spark.createDataFrame(rows, "URBAN int, OWN int, SIZE int, EMP int, p double")


@register(
    "census_recalibrated",
    f"WITH {CENSUS_SQL} SELECT URBAN, round(sum(w) FILTER (EMP = 1) / sum(w), 6) AS p FROM wide_i GROUP BY 1",
)
def census_recalibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the recalibrated P(EMP) over the individuals of each URBAN: the released share."""
    real = CE.generate(spark, _REGIONS)
    t = CE.dense(CE.family(real, CE.RELEASED))
    counts = np.zeros((2, 2, 5))
    wide = V.view(CE.SCHEMA, real, "individual", [("region", "URBAN"), ("household", "OWN"), ("household", "SIZE")])
    for u, o, s, n in wide.groupBy(*wide.columns).agg(F.count(F.lit(1))).collect():
        counts[u, o, s] = n
    table = CE.emp_table(t["RHI_U_O_E"], t["RHI_U_S_E"], t["RI_URB_EMP"], counts)
    p = (table[..., 1] * counts).sum(axis=(1, 2)) / counts.sum(axis=(1, 2))
    return spark.createDataFrame([(u, round(float(p[u]), 6)) for u in (0, 1)], "URBAN int, p double")


def _census(name: str, mixture: int) -> None:
    @register(name, f"WITH {CENSUS_SQL} SELECT (SELECT count(*) FROM region_) AS regions, (SELECT count(*) FROM household_) AS households, TRUE AS sizes_kept, TRUE AS effect_kept")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Row counts, SIZE + 1 members in every household, and the effect of URBAN on EMP within 0.15 of the real one."""
        real = CE.generate(spark, _REGIONS)
        objects = CE.released(spark, real, 3.2, 1e-4, 1)
        made = CE.synthesize(spark, objects, _REGIONS, real["household"].count(), 1, mixture)
        members = made["individual"].groupBy("h_id").agg(F.count(F.lit(1)).alias("n"))
        odd = made["household"].join(members, "h_id", "left").filter(~(F.col("n") == F.col("SIZE") + 1) | F.col("n").isNull())

        def effect(tables: dict[str, DataFrame]) -> float:
            w = V.view(CE.SCHEMA, tables, "individual", [("region", "URBAN"), ("individual", "EMP")])
            p = {r[0]: r[1] for r in w.groupBy("region__URBAN").agg(F.avg("individual__EMP")).collect()}
            return p[1] - p[0]

        row = (made["region"].count(), made["household"].count(), odd.count() == 0, abs(effect(made) - effect(real)) < 0.15)
        return spark.createDataFrame([row], "regions long, households long, sizes_kept boolean, effect_kept boolean")


_census("synth_census", 0)
_census("synth_census_mixture", 4)


# Whole syntheses ----------------------------------------------------------------------------------------------


def chain_pairs(schema) -> list[tuple[tuple[str, str], tuple[str, str]]]:
    """Pairs within the top, of adjacent levels, and of the top with every lower level."""
    roles = list(schema.roles)
    top = [(roles[0], a) for a in schema.roles[roles[0]].attrs]
    out = [(a, b) for i, a in enumerate(top) for b in top[i + 1 :]]
    for i, up in enumerate(roles):
        for down in roles[i + 1 :]:
            if i == 0 or roles.index(down) == i + 1:
                out += [((up, a), (down, b)) for a in schema.roles[up].attrs for b in schema.roles[down].attrs]
    return out


def _histograms(schema, made: dict[str, DataFrame]) -> DataFrame:
    """role, attr, code, n of every synthesized attribute."""
    out = None
    for r, role in schema.roles.items():
        at = {f"{r}__{a}": a for a in role.attrs}
        cells = M.marginals(made[r].select(*(F.col(a).alias(n) for n, a in at.items())), [M.Marginal(a, (n,)) for n, a in at.items()])
        cells = cells.select(F.lit(r).alias("role"), F.col("query_name").alias("attr"), F.col("c0").alias("code"), F.col("value").cast("long").alias("n"))
        out = cells if out is None else out.unionByName(cells)
    return out


CHAIN2 = Schema.chain(
    Role("orders", "okey", {"STATUS": 3, "YEAR": 7, "MONTH": 12, "PRIORITY": 5}),
    Role("lineitem", "lkey", {"QBIN": 6, "DBIN": 4, "RFLAG": 3, "LSTATUS": 2}, {"orders": "okey"}),
)
#: The registered syntheses' budget.
EPSILON, DELTA = 3.2, 1e-5
REPORTED = "pubn,rowleaf,szthresh,exactmarg,repair,growcap,szquota"


def star_objects() -> tuple[list, list]:
    a, b, c = ([(r, x) for x in X.STAR.roles[r].attrs] for r in ("part", "orders", "lineitem"))
    return [(a[0], b[0]), *((x, k) for x in [*a, *b] for k in c)], [(a[0], b[0], k) for k in c]


def synthesis(spark: SparkSession, sf_dir: str, schema, text: str, rail: str, pairs: list, triples=()) -> tuple[Release, dict[str, DataFrame]]:
    options = parse(text, rail)
    rel = release(schema, X.tables(spark, sf_dir, schema), EPSILON, options, 1, pairs, triples, DELTA)
    make = SY.synthesize_star if rail == "star" else SY.synthesize_chain
    return rel, make(spark, rel, options)


def _n_objects(schema, pairs: list, triples=()) -> int:
    """Objects that share the budget: one-way, pairs, triples and size histograms."""
    sizes = sum(len(schema.roles[next(iter(r.parents))].attrs) for r in schema.roles.values() if r.parents)
    return sum(len(r.attrs) for r in schema.roles.values()) + len(pairs) + len(triples) + sizes


def _noisy_sql(role: str, attr: str, size: int, sigma: float) -> str:
    """code, w: the released histogram of an attribute of rows."""
    noise = gaussian_sql(f"'1|{role}.{attr}|' || r.range || '|~|~'")
    return f"""SELECT r.range AS code, greatest(coalesce(n, 0) + {sigma!r} * {noise}, 0.0) AS w FROM range({size}) r LEFT JOIN (SELECT {attr} AS a, count(*) AS n FROM {role}_ GROUP BY 1) ON a = r.range"""


def _leaf_sql(schema, leaf: str, sigma: float) -> str:
    """role, attr, code, n: the leaf's histograms that the released ones, scaled to its public total, ask for."""
    parts = []
    for a, size in schema.roles[leaf].sizes.items():
        body = _REMAINDER.replace("FROM weights)", f"FROM (SELECT code, w, (SELECT count(*) FROM {leaf}_) AS goal FROM ({_noisy_sql(leaf, a, size, sigma)})))")
        parts.append(f"SELECT '{leaf}' AS role, '{a}' AS attr, CAST(code AS INTEGER) AS code, n FROM ({body}) WHERE n > 0")
    return " UNION ALL ".join(parts)


def _totals_sql(schema, roles: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{r}' AS role, '{a}' AS attr, CAST(NULL AS INTEGER) AS code, (SELECT count(*) FROM {r}_) AS n" for r in roles for a in schema.roles[r].attrs
    )


def _with_totals(schema, made: dict[str, DataFrame], full: str) -> DataFrame:
    """The histograms of role `full`, and the numbers of rows of the others."""
    h = _histograms(schema, made)
    rows = h.filter(F.col("role") != full).groupBy("role", "attr").agg(F.sum("n").alias("n"))
    return h.filter(F.col("role") == full).unionByName(rows.select("role", "attr", F.lit(None).cast("int").alias("code"), "n"))


def _reported(name: str, schema, rail: str, text: str, pairs: list, triples=()) -> None:
    """A synthesis whose leaf histograms are the released ones scaled to the public total, and whose totals are public."""
    roles = list(schema.roles)
    sigma = equal_sigma(EPSILON, DELTA, _n_objects(schema, pairs, triples))
    sql = X.with_sql(_leaf_sql(schema, "lineitem", sigma) + " UNION ALL " + _totals_sql(schema, [r for r in roles if r != "lineitem"]))

    @register(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _with_totals(schema, synthesis(spark, sf_dir, schema, text, rail, pairs, triples)[1], "lineitem")


_reported("synth_reported", X.CHAIN, "chain3", REPORTED, chain_pairs(X.CHAIN))
_reported("synth_reported_ipf", X.CHAIN, "chain3", REPORTED + ",ipf", chain_pairs(X.CHAIN))
_reported("synth_star_reported", X.STAR, "star", REPORTED, *star_objects())


def _with_public_totals(name: str, schema, rail: str, text: str, pairs: list, triples=()) -> None:
    """A synthesis with public totals: every table has its number of rows, and every child a parent that exists."""
    roles = list(schema.roles)
    parts = [f"SELECT '{r}' AS role, (SELECT count(*) FROM {r}_) AS n, TRUE AS linked, TRUE AS dense" for r in roles]

    @register(name, X.with_sql(" UNION ALL ".join(parts)))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made, rows = synthesis(spark, sf_dir, schema, text, rail, pairs, triples)[1], []
        for r, role in schema.roles.items():
            n, low, high, distinct = made[r].agg(F.count(F.lit(1)), F.min(role.key), F.max(role.key), F.count_distinct(role.key)).first()
            lost = sum(V.orphans(made[r], fk, made[up], schema.roles[up].key).count() for up, fk in role.parents.items())
            rows.append((r, n, lost == 0, (low, high, distinct) == (0, n - 1, n)))
        return spark.createDataFrame(rows, "role string, n long, linked boolean, dense boolean")


_with_public_totals("synth_bins", CHAIN2, "chain2", "pubn,bins:10,szsens,exactmarg", chain_pairs(CHAIN2))
_with_public_totals("synth_tailbins", CHAIN2, "chain2", "pubn,tailbins:6,szthresh:0.5,growcap", chain_pairs(CHAIN2))
_with_public_totals("synth_ratiotop", X.CHAIN, "chain3", "pubn,ratiotop,szquota,repair", chain_pairs(X.CHAIN))
_with_public_totals("synth_budget", X.STAR, "star", "pubn,budget:1:2,shrink:4,szquota", *star_objects())


def _noisy_total_sql(schema, sigma: float) -> str:
    """Totals that the budget paid for, where they are within a factor of 100 of what the histograms say."""
    return " UNION ALL ".join(
        f"SELECT '{r}' AS role, CAST(round_even((SELECT count(*) FROM {r}_) + {sigma!r} * {gaussian_sql(f"'1|total|{r}'")}, 0) AS BIGINT) AS n"
        for r in schema.roles
    )


_ONE_WAY = [f"{r}.{a}" for r, role in CHAIN2.roles.items() for a in role.attrs] + [f"SZ.lineitem.{a}" for a in CHAIN2.roles["orders"].attrs]


@register(
    "release_record",
    X.with_sql(
        "SELECT 'sigma' AS part, name, sigma AS value FROM (VALUES "
        + ", ".join(f"('{n}', {round(equal_sigma(EPSILON, DELTA, len(_ONE_WAY)), 6)}::DOUBLE)" for n in [*_ONE_WAY, "TOTALS"])
        + ") v(name, sigma) UNION ALL SELECT 'tau', 'lineitem', least(greatest(trunc(quantile_cont(n, 0.95)), 12), 1024) FROM (SELECT count(*) AS n FROM lineitem_ GROUP BY okey)"
        + " UNION ALL SELECT 're', 'all', 0.25"
    ),
)
def release_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release's scales and caps with median errors, as a record written and read back."""
    rel = release(CHAIN2, X.tables(spark, sf_dir, CHAIN2), EPSILON, parse("pubn", "chain2"), 1, (), (), DELTA)
    errors = spark.createDataFrame([("all", 0.25)], "cls string, median_re double")
    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    K.write_record(K.release_record(rel, spark, errors), path, "r")
    back = spark.read.schema("sigma map<string,double>, tau map<string,int>, re_median map<string,double>").json(f"{path}/r")
    parts = [back.select(F.lit(n).alias("part"), F.explode(c).alias("name", "value")) for n, c in (("sigma", "sigma"), ("tau", "tau"), ("re", "re_median"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("part", "name", F.round(F.col("value").cast("double"), 6).alias("value"))


@register(
    "release_totals",
    X.with_sql(_noisy_total_sql(CHAIN2, equal_sigma(EPSILON, DELTA, _n_objects(CHAIN2, []) + 2))),
)
def release_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy numbers of rows, each paid for as one object more."""
    rel = release(CHAIN2, X.tables(spark, sf_dir, CHAIN2), EPSILON, parse("totals,rowleaf", "chain2"), 1, (), (), DELTA)
    # rowleaf scales the noise of size histograms alone.
    return spark.createDataFrame(list(rel.totals.items()), "role string, n long")


@register(
    "synth_chain2",
    X.with_sql(f"SELECT role, n FROM ({_noisy_total_sql(CHAIN2, equal_sigma(EPSILON, DELTA, _n_objects(CHAIN2, chain_pairs(CHAIN2)) + 2))})"),
)
def synth_chain2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of rows of a database synthesized to noisy totals."""
    made = synthesis(spark, sf_dir, CHAIN2, "totals,szthresh", "chain2", chain_pairs(CHAIN2))[1]
    return spark.createDataFrame([(r, df.count()) for r, df in made.items()], "role string, n long")


@register("synth_chain3")
def synth_chain3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute histograms of a database synthesized from noisy marginals of the chain."""
    text = "pubn,rowleaf,szthresh,exactmarg,growcap"
    return _histograms(X.CHAIN, synthesis(spark, sf_dir, X.CHAIN, text, "chain3", chain_pairs(X.CHAIN))[1])


@register("synth_star")
def synth_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute histograms of a database synthesized from noisy marginals of the star."""
    return _histograms(X.STAR, synthesis(spark, sf_dir, X.STAR, "pubn,rowleaf,shrink", "star", *star_objects())[1])
