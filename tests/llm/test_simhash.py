import random
import re

import numpy as np
import xxhash
from helpers_llm import documents, save

from kinweave.llm import simhash
from kinweave.llm.simhash import (
    components, fingerprint, links, near_duplicates, op6_simhash, similar_documents, sketch, stage_near_dedup, stars, walk,
)


def by_definition(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(ids, fps, radius):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprint_is_the_definition():
    r = random.Random(1)
    for t in [
        None,
        "",
        " \t",
        "A b",
        "a\x1cb c\x0bd É",
        *(" ".join(r.choices(["Ab", "cd", "ß", "x1"], k=k)) for k in range(40)),
    ]:
        assert fingerprint(t) == by_definition(t)


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(2)
    base = [" ".join(f"w{r.randint(0, 400)}" for _ in range(200)) for _ in range(12)]
    texts = [None, "", " ", "a b", *base]
    for b in base[:6]:
        w = b.split()
        for k in range(5):
            w = [*w]
            w[r.randrange(len(w))] = f"n{k}"
            texts.append(" ".join(w))
    texts += [base[0]] * 30
    save(documents(spark, texts, 5), tmp_path, "documents")
    fps = {i + 5: by_definition(t) for i, t in enumerate(texts)}
    want = groups(list(fps), fps, 4)
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in op6_simhash(spark, str(tmp_path)).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert len(set(want.values())) < len(set(fps.values()))


def test_blocks_of_a_large_cell_lose_no_link(spark):
    r = random.Random(3)
    centre = r.getrandbits(64)
    fps = {centre}
    while len(fps) < 90:
        x = centre
        for b in r.sample(range(64), r.randint(1, 6)):
            x ^= 1 << b
        fps.add(x)
    fps |= {r.getrandbits(64) for _ in range(40)}
    signed = {f: int(np.uint64(f).view(np.int64)) for f in fps}
    nodes = spark.createDataFrame([(s, s) for s in signed.values()], "node long, fp long")
    want = groups(list(fps), {f: f for f in fps}, 4)
    for cell in (4096, 7):
        edges = links(nodes, 4, cell)
        assert all((np.uint64(np.int64(a)) ^ np.uint64(np.int64(b))).bit_count() <= 4 for a, b in edges.collect())
        roots = {x.node: x.root for x in components(edges).collect()}
        got = {f: roots.get(s, s) for f, s in signed.items()}
        pairs = [(a, b) for a in fps for b in fps]
        assert all((got[a] == got[b]) == (want[a] == want[b]) for a, b in pairs)


def test_walk_spans_and_never_lists_all_pairs():
    fp = np.zeros(300, np.uint64)
    fp[:150] = np.arange(150) % 4
    left, right = walk(fp, 4)
    assert len(left) == 299 and len(set(right)) == 299


def test_components_of_chains_stars_and_rings(spark):
    chain = [(i, i + 1) for i in range(50)]
    star = [(1000, 1001 + i) for i in range(40)]
    ring = [(2000 + i, 2000 + (i + 1) % 30) for i in range(30)]
    got = {x.node: x.root for x in components(spark.createDataFrame([*chain, *star, *ring, (7, 7)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 1000 for i in range(1000, 1041)} | {i: 2000 for i in range(2000, 2030)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_follow_similarity():
    r = random.Random(4)
    w = [f"w{r.randint(0, 10_000)}".encode() for _ in range(400)]
    near = [*w]
    for i in r.sample(range(400), 5):
        near[i] = b"n"
    other = [f"v{r.randint(0, 10_000)}".encode() for _ in range(400)]
    a, b, c = (int.from_bytes(sketch(x), "big") for x in (w, near, other))
    assert (a ^ b).bit_count() <= 18 < (a ^ c).bit_count()


def test_stage_keeps_one_of_each_group(spark):
    r = random.Random(5)
    base = [" ".join(f"w{r.randint(0, 5000)}" for _ in range(300)) for _ in range(4)]
    near = base[0].split()
    near[10] = "changed"
    texts = [*base, base[1], " ".join(near), "", None, "short text"]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.filter("doc_id = 2")).unionByName(
        docs.filter("doc_id = 3").selectExpr(
            "cast(null as long) doc_id",
            "'lonely one here' text",
            "lang",
            "source",
            "n_chars",
        ),
    )
    kept = stage_near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(x.doc_id for x in rows if x.doc_id is not None) == [0, 1, 2, 3, 6, 8]
    assert [x.text for x in rows if x.doc_id is None] == ["lonely one here"]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a and b else float(not a and not b)


def copies(r, words, edits):
    """A text and a copy with this many words changed at its end and, for longer ones, in places within."""
    w = [f"w{r.randint(0, 10**6)}" for _ in range(words)]
    c = [*w]
    for k in range(edits):
        c[-1 - k if words < 60 else r.randrange(words)] = f"n{r.randint(0, 10**6)}"
    return " ".join(w), " ".join(c)


def test_stage_finds_short_near_copies_and_nothing_below_the_rule(spark):
    r = random.Random(6)
    pairs = [copies(r, n, e) for n in (12, 30, 60, 200) for e in (1, 2, 3, 4, 6, 8) for _ in range(15)]
    like = [similarity(a, b) for a, b in pairs]
    assert sum(x >= 0.8 for x in like) > 80 and sum(0.6 < x < 0.8 for x in like) > 40
    docs = documents(spark, [t for p in pairs for t in p])
    kept = {x.doc_id for x in stage_near_dedup(spark, docs, "").select("doc_id").collect()}
    assert kept == {2 * k for k in range(len(pairs))} | {2 * k + 1 for k, x in enumerate(like) if x < 0.8}


def test_similar_documents_equal_brute_force_in_blocks_too(spark):
    r = random.Random(7)
    texts = [None, "", "a b", "A  b"]
    for n in (8, 40, 120):
        base = [f"w{r.randint(0, 10**6)}" for _ in range(n)]
        for _ in range(25):  # a chain of copies of copies and their originals
            texts.append(" ".join(base))
            base[r.randrange(n)] = f"n{r.randint(0, 10**6)}"
    ids = range(len(texts))
    root = [*ids]
    for i in ids:
        for j in ids:
            if similarity(texts[i], texts[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    assert 10 < len(set(root)) < len(texts) - 10
    for cell, set_cell in ((4096, 1 << 20), (7, 500)):
        docs = documents(spark, texts).select("doc_id", "text")
        found = similar_documents(docs, "doc_id", cell=cell, set_cell=set_cell)
        assert {x.doc_id: x.component_id for x in found.collect()} == dict(zip(ids, root, strict=True))


def set_bits(text):
    """The SimHash of the distinct five-word shingles, by definition."""
    hs = {xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in shingles(text)}
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_stage_links_fingerprints_within_the_radius(spark, monkeypatch):
    r = random.Random(8)
    pairs = [copies(r, n, e) for n in (200, 600) for e in (1, 2, 3) for _ in range(15)]
    apart = [(set_bits(a) ^ set_bits(b)).bit_count() for a, b in pairs]
    assert sum(x <= 4 for x in apart) > 20 and sum(x > 4 for x in apart) > 20
    docs = documents(spark, [t for p in pairs for t in p])
    monkeypatch.setattr(simhash, "candidates", lambda nodes, cell: nodes.selectExpr("node as a", "node as b").limit(0))
    kept = {x.doc_id for x in stage_near_dedup(spark, docs, "").select("doc_id").collect()}
    assert kept == {2 * k for k in range(len(pairs))} | {2 * k + 1 for k, x in enumerate(apart) if x > 4}


def test_candidates_have_fingerprints_that_texts_at_the_rule_have():
    sk, size = np.zeros((2, 2), np.uint64), np.array([9, 9])
    for bits, n in ((simhash.FAR, 1), (simhash.FAR + 1, 0)):
        fp = np.array([0, (1 << bits) - 1], np.uint64)
        assert len(simhash.walk_candidates(fp, sk, size)[0]) == n
    r = np.random.default_rng(9)
    for shared, a, b in ((4, 1, 0), (8, 1, 1), (12, 1, 2), (80, 10, 10), (400, 100, 0)):
        far = []
        for _ in range(500):
            h = r.integers(0, 1 << 64, shared + a + b, dtype=np.uint64)
            x, y = (simhash.set_fingerprint(part) for part in (h[: shared + a], np.delete(h, np.s_[shared : shared + a])))
            far.append((x ^ y).bit_count())
        assert max(far) <= simhash.FAR and np.mean(far) < 64 * 0.1975


def test_empty_table(spark):
    assert near_duplicates(documents(spark, []).select("doc_id", "text"), "doc_id").count() == 0
    assert similar_documents(documents(spark, []).select("doc_id", "text"), "doc_id").count() == 0


def test_clashing_columns_are_kept_or_replaced(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "x y z u v w", None])
    clash = docs.selectExpr("*", "'n' as node", "'l' as least", "'r' as root", "1 as fp", "2 as th", "3 as size", "'b' as bands")
    got = {r.doc_id: r for r in near_duplicates(clash, "doc_id").collect()}
    assert {r.node + r.least + r.bands for r in got.values()} == {"nlb"} and got[2].fp == int(
        np.array([fingerprint("x y z u v w")], np.uint64).view(np.int64)[0]
    )
    assert [got[i].component_id for i in range(4)] == [0, 0, 2, 3]
    got = {r.doc_id: r for r in similar_documents(clash, "doc_id").collect()}
    assert {(r.node, r.fp, r.th, r["size"]) for r in got.values()} == {("n", 1, 2, 3)}
    assert [got[i].component_id for i in range(4)] == [0, 0, 2, 3]
    kept = stage_near_dedup(spark, clash, "")
    assert kept.columns == clash.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


def test_stars_keep_components():
    r = random.Random(7)
    for _ in range(50):
        n = r.randint(1, 60)
        a = np.array([r.randint(-30, 30) for _ in range(n)])
        b = np.array([r.randint(-30, 30) for _ in range(n)])
        x, y = stars(a, b)
        nodes = sorted({*a.tolist(), *b.tolist()})
        root = {v: v for v in nodes}

        def find(v, root=root):
            while root[v] != v:
                v = root[v]
            return v

        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            p, q = sorted((find(p), find(q)))
            root[q] = p
        assert dict(zip(x.tolist(), y.tolist(), strict=True)) == {v: find(v) for v in nodes if find(v) != v}
