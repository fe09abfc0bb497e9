import math
import random

import numpy as np

from kinweave.llm.topk import Search, op2_top_k, statistics, top_k


def brute(rows, best=5):
    ok = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v]) for i,
        v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out, seen = set(), {}
    for i, v in sorted(ok):
        if i % 50 == 0 and i not in seen:
            seen[i] = v
    for q, v in seen.items():
        found = sorted(
            (-sum(a * b for a, b in zip(v, w, strict=True)), i) for i,
            w in ok if i != q and len(w) == len(v)
        )
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:best])}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(16)]) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(20)]
    rows += [
        (2000, None),
        (2050, [None] * 16),
        (2051, [math.nan] * 16),
        (2052, [math.inf] * 16),
        (None, rows[0][1]),
        (2100, [0.5, -0.5]),
        (2101, [0.25, 1.0]),
        (2150, []),
        (2151, []),
    ]
    frame(spark, rows).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(x) for x in op2_top_k(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute(rows)


def test_ties_repeats_and_lots(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(120)] + [(7, [2.0, 1.0])] * 2
    df = frame(spark, rows)
    want = brute(rows)
    for size in (16_000_000, 40):
        got = top_k(df, df.filter("vec_id % 50 = 0"), query_bytes=size).select("query_id", "rank", "vec_id", "score")
        assert {tuple(x) for x in got.collect()} == want


def test_an_invalid_copy_of_a_query_takes_no_result(spark, tmp_path):
    rows = [(i, [float(i % 7), 1.0]) for i in range(101)]
    rows += [(50, [None, 1.0]), (100, [-math.inf, 1.0]), (0, [math.nan, 1.0])]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(x) for x in op2_top_k(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute(rows) and {x[0] for x in got} == {0, 50, 100}


def test_queries_that_are_no_rows_bound_nothing(spark):
    df = frame(spark, [(i, [float(i), 1.0]) for i in range(1, 8)])
    queries = frame(spark, [(100 + i, [50.0 + i, 1.0]) for i in range(8)])
    got = top_k(df, queries).collect()
    assert len(got) == 40 and {x.vec_id for x in got} == {3, 4, 5, 6, 7}


def test_large_components_are_exact(spark):
    rows = [(0, [3e6, -1e6]), (1, [2e6, 5.0]), (2, [2e6, 4.0])]
    df = frame(spark, rows)
    got = top_k(df, df.filter("vec_id = 0")).collect()
    assert [x.vec_id for x in got] == [2, 1]


def test_bounds_are_never_below_products():
    g = np.random.default_rng(0)
    for n in (1, 2, 7, 64):
        q, x = g.integers(-200, 200, (20, n)), g.integers(-200, 200, (50, n))
        true = q @ x.T
        for a, b in zip(statistics(q), statistics(x), strict=True):
            allowed = (n + 8) * 2.0**-23 * np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1))
            assert (a @ b.T >= true - 1e-6 - allowed).all()


def test_scores_beyond_64_bits_are_cut_off(spark):
    rows = [(0, [3e30, -1e30]), (1, [2e30, 5.0]), (2, [2e30, 4.0]), (3, [-1e30, 0.0]), (4, [3e-1, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(x.vec_id, x.score) for x in top_k(df, df.filter("vec_id = 0")).collect()]
    most = (1 << 63) - 1
    assert got == [(1, most), (2, most), (4, most), (3, -most - 1)]


def test_bounds_drop_pairs_and_lose_none():
    g = np.random.default_rng(3)
    x = np.floor(256 * g.normal(0, 0.125, (3000, 64)))
    ids = np.arange(3000)
    s = Search(ids[:60], x[:60], 5)
    for a in range(0, 3000, 1000):
        s.meet(ids[a : a + 1000], x[a : a + 1000])
    full = x[:60] @ x.T
    full[np.arange(60), np.arange(60)] = -np.inf
    assert (s.scores == -np.sort(-full, axis=1)[:, :5]).all()
    assert s.pairs == 60 * 2999 and s.multiplied < 0.6 * s.pairs


def test_clashing_columns_are_not_read(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)]
    df = frame(spark, rows)
    more = df.selectExpr("*", "1 as id", "'v' as v", "2 as lot", "3 as score", "4 as rank", "5 as query_id")
    want = {tuple(x) for x in top_k(df, df.filter("vec_id % 50 = 0")).collect()}
    assert {tuple(x) for x in top_k(more, more.filter("vec_id % 50 = 0")).collect()} == want == brute(rows)


def test_empty(spark):
    assert top_k(frame(spark, []), frame(spark, [])).count() == 0
