import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers_llm import documents, save
from tokenizers import Tokenizer

from kinweave.llm.packing import (
    Encoder, enumerate_patterns, fit_counts, op5_packing, pack, pack_documents, places, plan
)

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids(tokenizer, text):
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_is_the_tokenizer(tokenizer):
    r, e = random.Random(3), Encoder(PATH)
    letters = [
        *"aeéßÀİΣσ'’sdmt12²½ \n\t.,!&<|>_-",
        "́",
        "\x1c",
        "\xa0",
        "<|endoftext|>",
        "'ll",
        "'re",
        "ª",
        "µ",
        "ǅ",
        "ſ",
    ]
    texts = ["".join(r.choices(letters, k=r.randint(0, 120))) for _ in range(2000)]
    texts += ["don't we'll 's x's l'été\n漢字 ﬁ naïve", "", None, "plain words only " * 50]
    assert e.encode_all(texts) == [ids(tokenizer, t or "") for t in texts]


def checked(histogram, capacity):
    groups = plan(histogram, capacity)
    have = {}
    for g in groups:
        assert sum(n * k for n, k in g.runs) + g.room == capacity and g.room >= 0 and g.count > 0
        for n, k in g.runs:
            have[n] = have.get(n, 0) + k * g.count
    assert have == {n: k for n, k in histogram.items() if k}
    return sum(g.count for g in groups)


def test_plans_hold_the_histogram_and_are_tight():
    r = random.Random(4)
    for _ in range(200):
        checked({r.randint(1, 32): r.randint(1, 9) for _ in range(r.randint(1, 12))}, 32)
    assert checked({}, 8) == 0 and checked({8: 3, 4: 2}, 8) == 4 and checked({3000: 10}, 4096) == 10
    g = np.random.default_rng(1)
    sizes, counts = np.unique(np.clip(g.lognormal(6.3, 1.2, 50_000).astype(int), 1, 4096), return_counts=True)
    h = dict(zip(sizes.tolist(), counts.tolist(), strict=True))
    assert checked(h, 4096) <= -(-sum(k * v for k, v in h.items()) // 4096) + 2


def test_the_fit_places_most_pieces():
    g = np.random.default_rng(2)
    for n in (2_000, 200_000):
        sizes, counts = np.unique(np.clip(g.lognormal(6.3, 1.2, n).astype(int), 1, 4096), return_counts=True)
        h = dict(zip(sizes.tolist(), counts.tolist(), strict=True))
        groups = plan(h)
        assert sum(x.fitted * x.count for x in groups) >= 0.9 * n
        assert sum(x.count for x in groups) <= -(-sum(k * v for k, v in h.items()) // 4096) + 2


def test_every_length_opens_patterns():
    found = enumerate_patterns(dict.fromkeys(range(1, 4097), 1), 4096, 64)
    assert {p[0] for p in found} >= set(range(64, 4097)) and all(sum(p) <= 4096 for p in found)


def test_other_columns_may_clash(spark):
    docs = documents(spark, ["a b c", "d", None]).selectExpr(
        "*", "1 as piece", "2 as start", "3 as length", "4 as ids_crc32", "5 as sequence_id", "6 as offset", "7 as pieces"
    )
    rows = pack_documents(docs, "doc_id", PATH).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in rows) == [(0, 0, 0, 4), (1, 0, 0, 2), (2, 0, 0, 1)]
    assert len({r.sequence_id for r in rows}) == 1


def test_least_squares_fit():
    x = fit_counts([(3, 1), (2, 2), (4,)], {3: 5, 1: 5, 2: 8, 4: 7}, 500)
    assert np.allclose(x, [5, 4, 7], atol=1e-3) and (fit_counts([(1,), (1, 2)], {1: 4, 2: 0}) >= 0).all()


def test_places_are_disjoint():
    h = {5: 7, 3: 11, 1: 4}
    used = set()
    for length, rows in places(plan(h, 10)).items():
        for rank in range(h[length]):
            k = np.searchsorted(rows[:, 0], rank, side="right") - 1
            inside = rank - rows[k, 0]
            at = (rows[k, 1] + inside // rows[k, 3], rows[k, 2] + inside % rows[k, 3] * length)
            cells = {(at[0], at[1] + i) for i in range(length)}
            assert not cells & used
            used |= cells


def test_query(spark, tmp_path, tokenizer):
    texts = [
        None,
        "",
        "hello world",
        "word " * 9000,
        *(["same text"] * 30),
        *(f"text {i} " * (i % 90) for i in range(200)),
    ]
    df = documents(spark, texts).unionByName(
        documents(spark, ["same text"] * 3).selectExpr("4L doc_id", "text", "lang", "source", "n_chars"),
    )
    save(df, tmp_path, "documents")
    rows = op5_packing(spark, str(tmp_path)).collect()
    want = []
    for r in df.collect():
        data = ids(tokenizer, r.text or "") + np.array([1], "<u4").tobytes()
        want += [
            (r.doc_id, k, a // 4, len(data[a : a + 16384]) // 4, zlib.crc32(data[a : a + 16384])) for k,
            a in enumerate(range(0, len(data), 16384))
        ]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
        assert sum(own[-1]) <= 4096
    assert len(by_sequence) == -(-sum(r.length for r in rows) // 4096)


def test_empty(spark, tmp_path):
    save(documents(spark, []), tmp_path, "documents")
    assert op5_packing(spark, str(tmp_path)).count() == 0
    assert pack(spark.createDataFrame([], "k long, length long"), "k").count() == 0
