"""Every registered query with SQL against DuckDB on the smallest data, and invariants of those without."""

import math
import os

import duckdb
import pytest

from kinweave.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the data folder isn't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return (a is None) == (b is None) and (
            a is None or math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1e-9)
        )
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=str)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = sorted(map(tuple, duck.sql(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall()), key=str)
    assert sorted(duck.sql(ORACLES[name]).columns) == columns
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_planting_raises_the_rule(spark):
    r = QUERIES["plant_chain"](spark, DATA).first()
    assert r["after"] > r["before"] + 0.15


def totals(rows):
    n = {}
    for r in rows:
        n[r["role"], r["attr"]] = n.get((r["role"], r["attr"]), 0) + r["n"]
    return n


def test_synthesis_keeps_public_totals_exactly(spark):
    n = totals(QUERIES["synth_chain3"](spark, DATA).collect())
    assert {r: {v for (role, _), v in n.items() if role == r} for r in ("customer", "orders", "lineitem")} == {
        "customer": {150}, "orders": {1500}, "lineitem": {6000},
    }
    n = totals(QUERIES["synth_star"](spark, DATA).collect())
    assert {v for (role, _), v in n.items() if role == "lineitem"} == {6000}
    assert {v for (role, _), v in n.items() if role == "part"} == {200}


NATIONS = {
    "copies": [(25 * j + k, f"n{k}") for j in range(60) for k in range(25)],
    "far": [(-(2**31), "least"), (-5, None), (24, ""), (25, "next"), (2**31 - 1, "most")],
    "no key": [(None, "a"), (None, None), (3, "b"), (3, "b")],
    "only no key": [(None, "a")],
    "empty": [],
}


@pytest.mark.parametrize("rows", NATIONS.values(), ids=NATIONS)
@pytest.mark.parametrize("name", ["src_jdbc", "src_jdbc_parallel", "src_jdbc_ranges"])
def test_databases_are_read_whole_whatever_their_keys(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()), key=str) == sorted(rows, key=str)
