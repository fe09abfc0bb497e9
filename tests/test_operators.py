"""Row operators on tiny tables against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.functions.encode import rule, size_bin
from kinweave.functions.noise import bits, gaussian, uniform
from kinweave.functions.options import Options, cross_hop
from kinweave.operators import calibrate as C
from kinweave.operators import census, encode, plant, sampling, sizes, views
from kinweave.operators import synth as SY
from kinweave.operators import workload as W
from kinweave.plans.release import release
from kinweave.schema import Role, Schema
from kinweave.sources import readers, writers
from kinweave.streaming.incremental import merged, windowed_marginal

def toy(spark, n=(20, 100, 600), seed=0):
    r = random.Random(seed)
    top = [(i, r.randrange(3)) for i in range(n[0])]
    mid = [(i, r.randrange(n[0]), r.randrange(2)) for i in range(n[1])]
    bot = [(i, r.randrange(n[1]), r.randrange(4)) for i in range(n[2])]
    frames = {
        "top": spark.createDataFrame(top, "t long, TT int"),
        "mid": spark.createDataFrame(mid, "m long, t long, MM int"),
        "bot": spark.createDataFrame(bot, "b long, m long, BB int"),
    }
    return frames, top, mid, bot


SCHEMA = Schema.chain(
    Role("top", "t", {"TT": 3}),
    Role("mid", "m", {"MM": 2}, {"top": "t"}),
    Role("bot", "b", {"BB": 4}, {"mid": "m"}),
)


def test_two_hop_count_equals_nested_loops(spark):
    frames, top, mid, bot = toy(spark)
    SCHEMA.checked(frames)
    q = W.CountQuery("2hop", 0, "bot", (("top", "TT", (0, 1)), ("bot", "BB", (2,))))
    want = sum(b[2] == 2 and top[mid[b[1]][1]][1] in (0, 1) for b in bot)
    assert W.count_one(SCHEMA, frames, q).first()[0] == want
    assert W.answer(SCHEMA, frames, [q]).first()["answer"] == want
    empty = W.CountQuery("none", 1, "bot", (("bot", "BB", ()),))
    assert W.count_one(SCHEMA, frames, empty).first()[0] == 0


def test_star_count_equals_nested_loops(spark):
    r = random.Random(1)
    x, y = [r.randrange(2) for _ in range(30)], [r.randrange(3) for _ in range(25)]
    c = [(i, r.randrange(30), r.randrange(25), r.randrange(2)) for i in range(500)]
    schema = Schema.star(
        Role("r1", "k1", {"X": 2}),
        Role("c", "k", {"A": 2}, {"r1": "k1", "r2": "k2"}),
        Role("r2", "k2", {"Y": 3}),
    )
    frames = {
        "r1": spark.createDataFrame(
            list(enumerate(x)),
            "k1 long, X int",
        ), "r2": spark.createDataFrame(list(enumerate(y)), "k2 long, Y int"),
        "c": spark.createDataFrame(c, "k long, k1 long, k2 long, A int"),
    }
    q = W.CountQuery("cross", 0, "c", (("r1", "X", (1,)), ("r2", "Y", (0, 2))))
    assert W.count_one(schema, frames, q).first()[0] == sum(x[a] == 1 and y[b] in (0, 2) for _, a, b, _ in c)


def test_orphan_policies(spark):
    child = spark.createDataFrame([(1, 0), (2, 9), (3, None)], "k long, fk long")
    parent = spark.createDataFrame([(0, 5), (4, 7)], "pk long, a int")

    def codes(policy):
        return {r["k"]: r["a"] for r in views.join_parent(child, "fk", parent, "pk", policy, "orphan").collect()}

    assert codes("drop") == {1: 5} and codes("first") == {1: 5, 2: 5, 3: 5}
    assert codes("last") == {1: 5, 2: 7, 3: 7} and codes("zero") == {1: 5, 2: 0, 3: 0}
    with pytest.raises(Exception, match="finds no parent"):
        codes("error")
    with pytest.raises(ValueError):
        codes("guess")
    assert {r["k"] for r in views.orphans(child, "fk", parent, "pk").collect()} == {2, 3}


def test_rules(spark):
    bits = list(itertools.product((0, 1), repeat=3))
    df = spark.createDataFrame(bits, "u int, a int, b int")
    u, a, b = (F.col(c) for c in "uab")
    for name, f in {
        "xor": lambda u, a, b: u ^ a ^ b, "mod4": lambda u, a, b: u ^ a ^ b, "threshold": lambda u, a, b: int(u + a + b >= 2),
        "or": lambda u, a, b: u | a | b, "(u + x1 * 2) % 2": lambda u, a, b: (u + a * 2) % 2, "u & (x1 | x2)": lambda u, a, b: u & (a | b), "u + x1 >= 1": lambda u, a, b: int(u + a >= 1),
    }.items():
        got = {(r["u"], r["a"], r["b"]): r["v"] for r in df.withColumn("v", rule(name, u, a, b)).collect()}
        assert got == {k: f(*k) for k in bits}
    for bad in ("__import__('os')", "y + 1", "u x1", "(u", "", "u; x1", "x12"):
        with pytest.raises(ValueError):
            rule(bad, u, a, b)


def test_noise_depends_on_the_key_alone(spark):
    df = spark.range(5000)
    a = {r["id"]: (r["u"], r["g"]) for r in df.repartition(7).select("id", uniform(1, "p", F.col("id")).alias("u"), gaussian(1, F.col("id")).alias("g")).collect()}
    b = {r["id"]: (r["u"], r["g"]) for r in df.coalesce(1).select("id", uniform(1, "p", F.col("id")).alias("u"), gaussian(1, F.col("id")).alias("g")).collect()}
    assert a == b and 0 <= min(u for u, _ in a.values()) and max(u for u, _ in a.values()) < 1
    g = [x for _, x in a.values()]
    assert abs(sum(g) / 5000) < 0.05 and abs(sum(x * x for x in g) / 5000 - 1) < 0.08


def test_repair_gives_the_target_and_moves_least_support(spark):
    rows = [(i, 0 if i < 30 else 1) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, c int")
    out = {r["k"]: r["c"] for r in C.repair(df, "k", "c", {0: 10, 1: 22, 2: 18}, F.col("k")).collect()}
    counts = [sum(v == c for v in out.values()) for c in range(3)]
    assert counts == [10, 22, 18] and all(out[k] == 0 for k in range(20, 30)) and all(out[k] != 0 for k in range(20))
    with pytest.raises(ValueError):
        C.repair(df, "k", "c", {0: 1}, F.col("k"))


def test_quota_draw_and_linking(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    got = [
        r["n"] for r in C.quota_draw(
            df,
            "k",
            "c",
            [500, 300, 200],
            3,
        ).groupBy("c").agg(F.count("*").alias("n")).orderBy("c").collect()
    ]
    assert got == [500, 300, 200]
    parents = spark.createDataFrame([(i, float(i % 5)) for i in range(50)], "p long, w double")
    linked = sampling.linked(df, "k", parents, "p", "w", "fk", 1)
    rows = linked.collect()
    assert len(rows) == 1000 and all(r["fk"] % 5 for r in rows)
    heavy = sum(r["fk"] % 5 == 4 for r in rows) / 1000
    assert abs(heavy - 0.4) < 0.06


def test_planting_keeps_class_counts(spark):
    r = random.Random(2)
    rows = [(i, *(r.randrange(2) for _ in range(5))) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, old int, u int, x1 int, x2 int, m int")
    out = plant.plant_chain(df, "k", "old", "u", "x1", "x2", ["m"], "xor", 0.7, 4)
    assert all(x["ones_old"] == x["ones_new"] for x in plant.audit(out, "old", "planted", ["m", "u"]).collect())
    agree = out.agg(
        F.avg((F.col("planted") == rule("xor", F.col("u"), F.col("x1"), F.col("x2"))).cast("int")),
    ).first()[0]
    assert agree > 0.75
    star = plant.plant_star(df, "k", "old", "u", "x1", "x2", "xor", 0.7, 4)
    for by in ("x1", "x2"):
        assert all(x["ones_old"] == x["ones_new"] for x in plant.audit(star, "old", "planted", [by]).collect())
    assert plant.calibrate(lambda p, s: 2 * p, 0.8) == pytest.approx(0.4, abs=1e-3)


def test_release_without_noise_is_the_data(spark):
    frames, top, _, bot = toy(spark)
    rel = release(SCHEMA, frames, None, pairs=[(("top", "TT"), ("mid", "MM"))])
    assert rel.one["top", "TT"].tolist() == [sum(t[1] == c for t in top) for c in range(3)]
    assert rel.totals == {"top": 20, "mid": 100, "bot": 600}
    groups = len({b[1] for b in bot})
    assert abs(rel.one["bot", "BB"].sum() - groups) < 1e-6
    assert rel.sizes["mid", "TT"].sum() == 20


def test_encoders(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*"aaabbccd", None])], "k long, v string")
    assert {r["v"]: r["code"] for r in encode.top_values(df, "v", 3).collect()} == {"a": 0, "b": 1, "c": 2, "d": 2}
    assert {r["k"]: r["c"] for r in encode.encode_top(df, "v", "c", 3).collect()}[8] == 2
    assert [r["c"] for r in encode.encode_sorted(df, "v", "c").orderBy("k").collect()] == [0, 0, 0, 1, 1, 2, 2, 3, 4]
    bit = spark.createDataFrame([(i, int(i < 90)) for i in range(100)], "k long, b int")
    assert encode.rebalanced(bit, "b", "k", 1).agg(F.sum("b")).first()[0] == 50
    assert encode.sample_exact(bit, "k", 7, 1).count() == 7
    rows, grown = encode.sample_capped(bit, "k", 80, 1, lambda s: s.select(F.explode(F.array(F.lit(1), F.lit(2)))), 100)
    assert grown.count() <= 100 and rows.count() >= 40
    s = spark.createDataFrame([(0,), (1,), (4,), (99,)], "n long")
    assert [r[0] for r in s.select(size_bin(F.col("n"), [1, 2, 5])).collect()] == [0, 0, 1, 2]


def test_samples_are_filters_without_a_sort(spark, monkeypatch):
    rows = [(k,) for k in range(3000)] + [(7,)] * 500 + [(None,)] * 3
    df = spark.createDataFrame(rows, "k long").repartition(3)
    score = bits(4, "sample", F.col("k"))
    order = sorted(map(tuple, df.select(score, "k").collect()), key=lambda x: (x[0], x[1] is not None, x[1] or 0))
    at = [s for s, _ in order].index(next(s for s, k in order if k == 7))
    for last in (10_000, 1):
        monkeypatch.setattr(encode, "LAST_ROWS", last)
        for n in (0, 1, 2, 999, at, at + 1, at + 250, at + 501, 3502, 3503, 9999):
            got = encode.sample_exact(df, "k", n, 4)
            want = [k for _, k in order[:n]]
            assert sorted(map(str, (r[0] for r in got.collect()))) == sorted(map(str, want))
    assert encode.sample_exact(df.limit(0), "k", 5, 4).count() == 0
    # A limit of many rows is one task that holds them all.
    plan = encode.sample_exact(spark.range(100_000).withColumnRenamed("id", "k"), "k", 30_000, 1)._jdf.queryExecution().toString()
    assert "Limit" not in plan and "TakeOrdered" not in plan and "Sort" not in plan


def test_renormalised_tables_join_back(spark):
    r = random.Random(5)
    wide = spark.createDataFrame(
        [(r.randrange(3), r.randrange(2), r.randrange(4)) for _ in range(200)],
        "a int, b int, c int",
    )
    parts = views.renormalise(wide, {"top": ["a"], "mid": ["b"]}, ["c"])
    back = parts["leaf"].join(parts["mid"], "mid_key").join(parts["top"], "top_key").select("a", "b", "c")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, wide.collect()))


def test_gini_and_empty_tables(spark):
    df = spark.createDataFrame([(1,), (1,), (4,)], "n long")
    assert sizes.gini(df).first()[0] == pytest.approx((2 * (1 + 2 + 12) - 4 * 6) / 18)
    assert sizes.gini(df.limit(0)).first()[0] is None
    assert sizes.tau(df.withColumn("f", F.lit(1)).limit(0), "f") == 12


def test_census_generator(spark):
    t = census.generate(spark, 300, 1)
    per = t["household"].groupBy("r_id").count()
    assert per.agg(F.min("count"), F.max("count")).first() == (2, 6)
    members = t["individual"].groupBy("h_id").count().join(t["household"], "h_id")
    assert members.filter("count != SIZE + 1").count() == 0 and census.DELTA == pytest.approx(0.325)


def test_sources_and_sinks(spark, tmp_path):
    frames, *_ = toy(spark)
    writers.write_tables(frames, str(tmp_path / "db"), SCHEMA, "csv")
    back = readers.read_tables(spark, str(tmp_path / "db"), SCHEMA, {r: r for r in SCHEMA.roles})
    assert sorted(map(tuple, back["bot"].select("b", "m", "BB").collect())) == sorted(
        map(tuple, frames["bot"].select("b", "m", "BB").collect()),
    )
    writers.write_domain(spark, {"TT": 3}, str(tmp_path / "domain"))
    assert readers.read_domain(spark, str(tmp_path / "domain")) == {"TT": 3}
    (tmp_path / "a.tbl").write_text("1|x|2.5|\n2|y|3.5|\n")
    assert [
        tuple(r) for r in readers.read_tbl(spark, str(tmp_path / "a.tbl"), "k int, v string").collect()
    ] == [(1, "x"), (2, "y")]
    (tmp_path / "m.dat").write_bytes("1::Mé::3\n".encode("latin-1"))
    assert tuple(
        readers.read_double_colon(spark, str(tmp_path / "m.dat"), "k int, v string, n int").first(),
    ) == (1, "Mé", 3)
    (tmp_path / "t.tsv").write_text('k\tv\tn\n1\t\\N\t"5\n2\tNA\t7\n')
    assert [
        tuple(r) for r in readers.read_tsv(
            spark,
            str(tmp_path / "t.tsv"),
            {"k": "int", "v": "string", "n": "int"},
        ).collect()
    ] == [(1, None, None), (2, None, 7)]
    (tmp_path / "c.tsv").write_text("# note\nk\tv\n1\ta\n")
    assert readers.read_commented(spark, str(tmp_path / "c.tsv"), "k int, v string").count() == 1
    for name, text in {"a.json": '{"k": 1, "v": 2.0}', "._a.json": '{"k": 9}', "b_sub.json": '{"k": 8}', "broken.json": '{"k": '}.items():
        (tmp_path / name).write_text(text)
    assert [r["k"] for r in readers.read_archive(spark, str(tmp_path / "*.json"), "k int, v double").collect()] == [1]
    assert readers.range_predicates("id", 1, 5, 2) == ["id BETWEEN 1 AND 2", "id BETWEEN 3 AND 4", "id BETWEEN 5 AND 5"]
    record = spark.createDataFrame([(1, 0.5)], "seed int, re double")
    name = writers.record_name("m", "natural", 0.8, 42, "arm")
    writers.write_record(record, str(tmp_path), name)
    with pytest.raises(Exception, match="(?i)exist"):
        writers.write_record(record, str(tmp_path), name)


def test_stream_equals_table(spark, tmp_path):
    rows = spark.range(200).selectExpr("timestamp_seconds(id * 60) as ts", "cast(id % 3 as int) as c")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_marginal(stream, "ts", ["c"]).writeStream.outputMode("complete").format("memory").queryName("m").option(
        "checkpointLocation",
        str(tmp_path / "ck"),
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, merged(spark.table("m"), ["c"]).collect()))
    assert got == sorted((r["c"], r["count"]) for r in rows.groupBy("c").count().collect())


def test_cross_weights_of_both_levels(spark):
    frames, top, mid, bot = toy(spark)
    pair = (("top", "TT"), ("bot", "BB"))
    s1, s2 = {}, {}
    for _, t, _ in mid:
        s1[t] = s1.get(t, 0) + 1
    for _, m, _ in bot:
        s2[m] = s2.get(m, 0) + 1
    for cross in ("inner", "both"):
        rel = release(SCHEMA, frames, None, pairs=[pair], cross=cross)
        t1, t2 = rel.taus["mid"], rel.taus["bot"]
        want = [[0.0] * 4 for _ in range(3)]
        for _, m, code in bot:
            t = mid[m][1]
            w = 1 / min(s2[m], t2) * (1 / min(s1[t], t1) if cross == "both" else 1)
            want[top[t][1]][code] += w
        assert np.allclose(rel.joint[pair], want)
    with pytest.raises(ValueError):
        release(SCHEMA, frames, None, cross="outer")


def test_truncation_keeps_the_first_rows(spark):
    df = spark.createDataFrame([(i, i % 3 if i < 90 else 0) for i in range(100)], "k long, g long")
    got = sizes.truncated(df, "g", ["k"], 4)
    assert sorted(r["k"] for r in got.collect()) == list(range(12))


def test_workloads_of_several_attributes():
    schema = Schema.of(Role("r", "k", {"A": 5, "B": 7, "C": 1}))
    queries = W.generate(schema, {"c": ("r", ["r"])}, 50, most_attrs=3)
    assert {len(q.conditions) for q in queries} == {1, 2} and all(a != "C" for q in queries for _, a, _ in q.conditions)
    assert queries == W.generate(schema, {"c": ("r", ["r"])}, 50, most_attrs=3)
    with pytest.raises(ValueError):
        W.some_codes(random.Random(0), 1)


def test_child_keys_are_dense_beyond_any_packing(spark):
    base = 1 << 45
    parents = spark.createDataFrame([(base + i, [0, 3, 1, 70_000][i % 4], i) for i in range(16)], "p long, n long, a int")
    rows = sampling.children(parents, "p", "n", "fk", "k", ["a"])
    got = rows.agg(F.count("k"), F.min("k"), F.max("k"), F.count_distinct("k")).first()
    assert tuple(got) == (4 * 70_004, 0, 4 * 70_004 - 1, 4 * 70_004)
    # Keys follow the order of the parents, and a parent's children their own numbers.
    first = {r["fk"]: (r["lo"], r["n"]) for r in rows.groupBy("fk").agg(F.min("k").alias("lo"), F.count("k").alias("n")).collect()}
    at = 0
    for p, n in sorted((r["p"], r["n"]) for r in parents.collect()):
        assert first.get(p, (at, 0)) == (at, n)
        at += n


def test_ranks_and_running_sums_over_one_hot_group(spark):
    rows = [(i * 7919 % 1000, "hot" if i % 10 else None, float(i % 3)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, g string, w double")
    got = {r["k"]: r["r"] for r in views.ranked(df, ["g"], ["k"], "r").collect()}
    for g in ("hot", None):
        own = sorted(k for k, x, _ in rows if x == g)
        assert [got[k] for k in own] == list(range(len(own)))
    run = {r["k"]: (r["s"], r["t"]) for r in views.running(df, ["k"], "w", "s", "t").collect()}
    at = 0.0
    for k, _, w in sorted(rows, key=lambda x: x[0]):
        assert run[k] == (at, sum(x for *_, x in rows))
        at += w
    assert views.ranked(df.limit(0), [], ["k"], "r").count() == 0


def test_repair_takes_the_least_supported_rows_of_many_parents(spark):
    r = random.Random(6)
    rows = [(i, i // 10, r.randrange(2), r.choice([0.2, 0.5, 0.9])) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, p long, c int, s double")
    ones = sum(c for _, _, c, _ in rows)
    out = {x["k"]: x["c"] for x in C.repair(df, "k", "c", {0: 1000 - ones + 60, 1: ones - 60}, F.col("s")).collect()}
    moved = [(p, s) for k, p, c, s in rows if out[k] != c]
    assert len(moved) == 60 and sum(out.values()) == ones - 60 and {s for _, s in moved} == {0.2}
    assert len({p for p, _ in moved}) > 40
    same = C.repair(df, "k", "c", {0: 1000 - ones + 60, 1: ones - 60}, F.lit(1.0))
    tied = {x["k"]: x["c"] for x in same.collect()}
    assert len({p for k, p, c, _ in rows if tied[k] != c}) > 40


def test_surplus_at_the_cap_is_scaled(spark):
    assert C.grown_at_cap([1, 5, 5, 2], 20, 5) == [1, 9, 8, 2] and sum(C.grown_at_cap([3, 5, 5], 9, 5, 1)) == 9
    assert sum(C.grown_at_cap([1, 2, 3], 12, 9, 1)) == 12 and C.grown_at_cap([1, 2], 3, 9) == [1, 2]


def two_levels(spark, n=400, seed=9):
    """A chain whose leaf depends on its parent, released without noise, and its tables."""
    r = random.Random(seed)
    schema = Schema.chain(Role("top", "t", {"A": 3, "B": 2}), Role("bot", "leaf", {"C": 4}, {"top": "t"}))
    top = [(i, r.randrange(3), r.randrange(2)) for i in range(n)]
    bot = [(t, (a + r.choice([0, 0, 1])) % 4) for t, a, b in top for _ in range(1 + a * 3 + r.randrange(3))]
    frames = {
        "top": spark.createDataFrame(top, "t long, A int, B int"),
        "bot": spark.createDataFrame([(i, *x) for i, x in enumerate(bot)], "leaf long, t long, C int"),
    }
    pairs = [(("top", "A"), ("top", "B")), (("top", "A"), ("bot", "C")), (("top", "B"), ("bot", "C"))]
    return schema, frames, pairs, top, bot


def test_synthesis_meets_quotas_of_several_attributes_and_leaf_targets(spark):
    schema, frames, pairs, top, bot = two_levels(spark)
    chosen = Options({t: () for t in ("pubn", "rowleaf", "exactmarg", "szquota", "repair", "growcap")})
    rel = release(schema, frames, None, chosen, 1, pairs)
    made = SY.synthesize_chain(spark, rel, chosen, 3)
    wide = made["bot"].join(made["top"], "t").collect()
    assert len(wide) == len(bot) and made["top"].count() == len(top)
    real = {(a, b): 0 for a in range(3) for b in range(2)}
    for t, _ in bot:
        real[top[t][1], top[t][2]] += 1
    for at, name in ((0, "A"), (1, "B")):
        for v in range(3 - at):
            want = sum(n for k, n in real.items() if k[at] == v)
            assert abs(sum(x[name] == v for x in wide) - want) <= 4
    assert [sum(x["C"] == c for x in wide) for c in range(4)] == [sum(c == x for _, x in bot) for c in range(4)]
    # The first pair of the top is dealt by quota, so its joint counts are exact as well.
    pairs_of = [(x["A"], x["B"]) for x in made["top"].collect()]
    assert all(pairs_of.count(k) == sum(t[1:] == k for t in top) for k in real)


def test_leaf_targets_weigh_parents_by_their_sizes(spark):
    schema, frames, pairs, top, bot = two_levels(spark)
    rel = release(schema, frames, None, Options({"pubn": ()}), 1, pairs)
    target = SY.target_of(rel, "bot", "C", "top", Options({"pubn": ()}), len(bot))
    real = [sum(c == x for _, x in bot) for c in range(4)]
    flat = C.row_target(rel.one["bot", "C"].tolist(), len(bot))
    assert sum(target) == len(bot)
    assert sum(abs(a - b) for a, b in zip(target, real, strict=True)) < sum(abs(a - b) for a, b in zip(flat, real, strict=True))


def test_product_form_fits_all_pairs_wherever_tuples_are(spark, monkeypatch):
    schema, frames, pairs, top, bot = two_levels(spark)
    wide = frames["bot"].join(frames["top"], "t").select(F.col("A").alias("top__A"), F.col("B").alias("top__B"), "C")
    found = {}
    for most in (SY.TUPLES, 0):
        monkeypatch.setattr(SY, "TUPLES", most)
        seen = SY.Occupied(wide, ["top__A", "top__B"], 4)
        targets = {}
        for c, n in (("top__A", 3), ("top__B", 2)):
            targets[c] = np.zeros((n, 4))
            for x, v, k in wide.groupBy(c, "C").count().collect():
                targets[c][x, v] = k
        base, factors = SY.fitted_factors(seen, np.full(4, 0.25), targets, 50)
        for c, t in targets.items():
            assert np.allclose(seen.margin(base, factors, c), t, rtol=1e-2, atol=0.5)
        found[most] = base
    assert np.allclose(*found.values())


def test_guards_pull_noisy_lifts_to_one():
    table, counts = np.array([[2.0, 0.5], [3.0, 0.1]]), np.array([[100.0, 0.0], [25.0, 100.0]])
    got = SY.guarded(table, counts, np.array([1000.0, 25.0]), 10.0)
    assert np.allclose(got, [[2.0, 1.0], [1 + 2 * 0.5 * 0.5, 1 - 0.9 * 0.5]]) and (SY.guarded(table, counts, counts[0], 0.0) == table).all()


def test_planted_strength_is_calibrated_to_an_effect(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(i, *(r.randrange(2) for _ in range(5))) for i in range(3000)], "k long, old int, u int, x1 int, x2 int, m int").cache()

    def effect(strength, seed):
        out = plant.plant_chain(df, "k", "old", "u", "x1", "x2", ["m"], "xor", strength, seed)
        return out.agg(F.avg((F.col("planted") == rule("xor", F.col("u"), F.col("x1"), F.col("x2"))).cast("int"))).first()[0]

    found = plant.calibrate(effect, 0.8, (1, 2), 5)
    assert abs(np.mean([effect(found, s) for s in (1, 2)]) - 0.8) < 0.03


def test_scratch_is_refused_on_a_cluster_without_a_shared_folder():
    from kinweave import scratch

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError, match="share"):
        scratch.shared_folder(Session())


def test_resumed_jdbc_reading_fails_aloud(spark, tmp_path):
    with pytest.raises(RuntimeError, match="could not be read"):
        readers.read_jdbc_resumed(spark, "jdbc:derby:memory:none", "T", "K", 0, 3, str(tmp_path / "x"), 2, 1, driver="org.apache.derby.jdbc.EmbeddedDriver")


def test_resumed_jdbc_reading_returns_the_ranges_asked_for(spark, tmp_path):
    driver = spark.sparkContext._jvm.org.apache.derby.jdbc.EmbeddedDriver()
    session = driver.connect("jdbc:derby:memory:resumed;create=true", spark.sparkContext._jvm.java.util.Properties())
    session.createStatement().execute("CREATE TABLE T (K INTEGER)")
    session.createStatement().execute("INSERT INTO T VALUES (-3), (0), (1), (2), (5), (9), (NULL)")

    def read(*bounds):
        df = readers.read_jdbc_resumed(spark, "jdbc:derby:memory:resumed", "T", "K", *bounds, driver="org.apache.derby.jdbc.EmbeddedDriver")
        return sorted((r["K"] for r in df.collect()), key=str)

    assert read(0, 3, str(tmp_path), 2) == [0, 1, 2, None]
    session.createStatement().execute("DELETE FROM T WHERE K = 0")
    assert read(-3, 9, str(tmp_path), 5) == [-3, 1, 2, 5, 9, None]
    assert read(0, 3, str(tmp_path), 2) == [0, 1, 2, None]  # kept
    session.close()


def test_signed_ranks_by_enumeration():
    from itertools import product

    from kinweave.functions.stats import signed_rank

    r = random.Random(1)
    for n in (3, 7, 11):
        x, y = [r.randint(0, 6) for _ in range(n)], [r.randint(0, 6) for _ in range(n)]
        d = [a - b for a, b in zip(x, y, strict=True) if a != b]
        ranks = [sum(abs(e) < abs(f) for e in d) + (sum(abs(e) == abs(f) for e in d) + 1) / 2 for f in d]
        least = min(sum(k for k, v in zip(ranks, d, strict=True) if v > 0), sum(k for k, v in zip(ranks, d, strict=True) if v < 0))
        hits = [min(w := sum(k for k, s in zip(ranks, signs, strict=True) if s), sum(ranks) - w) <= least + 1e-9 for signs in product((0, 1), repeat=len(d))]
        assert signed_rank(x, y) == pytest.approx(sum(hits) / len(hits))
    assert 0 < signed_rank(range(25), [k + (k % 3 - 0.9) for k in range(25)]) < 1


def test_cross_hop_settings_reach_release_and_synthesis(spark):
    frames, *_ = toy(spark)
    far, near = (("top", "TT"), ("bot", "BB")), (("mid", "MM"), ("bot", "BB"))
    rel = release(SCHEMA, frames, None, pairs=[far, near], cross="none")
    assert list(rel.joint) == [near]
    rel = release(SCHEMA, frames, 1.0, pairs=[far, near], cross="double:noguard", delta=1e-4)
    free = SY.pair_lift(rel, *far)
    assert rel.cross.weight == "both" and set(rel.joint) == {far, near}
    rel.cross = cross_hop("both")
    assert np.abs(SY.pair_lift(rel, *far) - 1).max() < np.abs(free - 1).max()
