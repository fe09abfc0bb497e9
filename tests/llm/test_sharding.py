import math
import zlib
from collections import Counter

import pytest
import xxhash
from helpers_llm import documents, save

from kinweave.llm.sharding import op3_sharding, shard_records


def test_query_over_a_hot_key_and_nulls(spark, tmp_path):
    texts = ["same"] * 40 + [None, "", "é" * 3]
    df = documents(spark, texts).unionByName(documents(spark, ["same"] * 1, 0)).unionByName(
        documents(spark, ["same"] * 30, 0).selectExpr("0L as doc_id", "text", "lang", "source", "n_chars"),
    )
    save(df, tmp_path, "documents")
    rows = op3_sharding(spark, str(tmp_path)).collect()
    assert len(rows) == df.count()
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert len({r.shard for r in rows if r.doc_id == 0}) == 1
    sizes = {r.doc_id: (r["size"], r.text_crc32) for r in rows}
    assert sizes[40] == (1, 0) and sizes[41] == (1, 0)
    assert sizes[42] == (7, zlib.crc32("ééé".encode()))


def test_weights_share_out_keys(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    got = Counter(r.shard for r in shard_records(df, ["k"], [1.0, 3.0, 0.0, 1.0]).collect())
    assert set(got) == {0, 1, 3}
    assert abs(got[1] / 20_000 - 0.6) < 0.02 and abs(got[0] / 20_000 - 0.2) < 0.02


def test_cells_keep_slots_gapless(spark):
    df = spark.range(3000).selectExpr("id % 700 as k", "cast(null as string) as p")
    rows = shard_records(df, ["k"], [1.0] * 3, payload=["p"], cell_rows=50).collect()
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_empty_and_bad_weights(spark):
    assert shard_records(spark.createDataFrame([], "k long"), ["k"], [1.0, 1.0]).count() == 0
    for weights in ([], [0.0], [1.0, -1.0]):
        with pytest.raises(ValueError):
            shard_records(spark.range(1), ["id"], weights)


def winner(doc_id, shards):
    """The shard by definition: least -ln(u), u from XXH64 of the shard's name and then of the id, seed 42."""
    best = None
    for k in range(shards):
        h = xxhash.xxh64_intdigest(f"shard {k}".encode(), 42)
        if doc_id is not None:
            h = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), h)
        score = -math.log(((h >> 11) + 0.5) / (1 << 53))
        if best is None or score < best[0]:
            best = score, k
    return best[1]


def test_query_equals_brute_force(spark, tmp_path):
    texts = [f"text {i % 37} é" * (i % 5) for i in range(300)] + [None, "", "word " * 300_000]
    docs = documents(spark, texts, -20).unionByName(documents(spark, ["b"] * 9, 2**62))
    docs = docs.unionByName(docs.limit(1).selectExpr("cast(null as long) doc_id", "'n' text", "lang", "source", "n_chars"))
    clash = docs.selectExpr("*", "'x' as shard", "'y' as slot", "1 as grown_shard", "2 as size", "3 as __n", "4 as law")
    save(clash, tmp_path, "documents")
    rows = op3_sharding(spark, str(tmp_path)).collect()
    got = Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in rows)
    want = Counter()
    for r in docs.collect():
        data = (r.text or "").encode()
        want[r.doc_id, len(data) + 1, zlib.crc32(data), "key", winner(r.doc_id, 16), winner(r.doc_id, 17)] += 1
    assert got == want
    for s in range(16):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))


def test_query_on_an_empty_table(spark, tmp_path):
    save(documents(spark, []), tmp_path, "documents")
    out = op3_sharding(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[:4] == ["doc_id", "size", "text_crc32", "law"]


def test_many_equal_rows_are_numbered_in_lots(spark):
    df = spark.range(10_000).selectExpr("cast(id < 9000 as int) as k", "'p' as p")
    rows = shard_records(df, ["k"], [1.0] * 2, payload=["p"], cell_rows=1000).collect()
    for s in (0, 1):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
