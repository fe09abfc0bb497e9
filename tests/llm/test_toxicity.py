import random
import zlib

import numpy as np
from helpers_llm import documents, save

from kinweave.llm.toxicity import Classifier, fit, mixture_share, op1_toxicity, score_toxicity, toxicity_of, word_features


def corpus(spark, n=900, seed=0):
    r = random.Random(seed)
    plain = [f"w{i}" for i in range(300)]
    texts, toxic = [], []
    for _ in range(n):
        t = r.choices(plain, k=r.randint(3, 60))
        bad = r.random() < 0.2
        if bad:
            t[r.randrange(len(t))] = r.choice(["vile", "wretch", "creepo" + r.choice("abc")])
        texts.append(" ".join(t))
        toxic.append(int(bad))
    docs = documents(spark, [*texts, None, "", "vile " * 3000])
    labels = spark.createDataFrame([(i, 1, x) for i, x in enumerate(toxic)], "doc_id long, quality int, toxic int")
    return docs, labels, toxic


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy(spark, tmp_path):
    docs, labels, toxic = corpus(spark)
    save(docs, tmp_path, "documents")
    save(labels, tmp_path, "labels")
    rows = {r.doc_id: r for r in op1_toxicity(spark, str(tmp_path)).collect()}
    assert len(rows) == 903
    test = [(toxic[i], rows[i].predicted) for i in range(900) if held_out(i)]
    assert all(rows[i].held_out == held_out(i) for i in rows)
    right = sum(a == b for a, b in test) / len(test)
    assert right > 0.95 and sum(b for a, b in test if a == 0) <= 2
    assert rows[902].predicted == 1 and 0 <= rows[900].score == rows[901].score < 0.7


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels, _ = corpus(spark, 400)
    flipped = labels.selectExpr(
        "doc_id",
        "quality",
        "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end as toxic",
    )
    a, b = ({r.doc_id: r.score for r in toxicity_of(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_no_positives_and_empty_tables(spark):
    docs, labels, _ = corpus(spark, 60)
    none = labels.selectExpr("doc_id", "quality", "0 as toxic")
    assert {r.score for r in toxicity_of(docs, none).collect()} == {0.0}
    assert {r.score for r in toxicity_of(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity_of(documents(spark, []), labels).count() == 0


def test_risk_recovers_the_prior():
    g = np.random.default_rng(0)
    p = [np.array([0]) for _ in range(200)]
    u = [np.array([0]) if g.random() < 0.2 else np.array([], int) for _ in range(800)]
    c = fit(p, u, [11], 0.2)
    assert isinstance(c, Classifier) and c.weights[11] > 3
    share = sum(1 / (1 + np.exp(-(c.bias + (len(x) and c.weights[11])))) for x in u) / len(u)
    assert abs(share - 0.2) < 0.08


def test_the_prior_comes_from_the_samples():
    g = np.random.default_rng(5)

    def positive():
        return np.flatnonzero(g.random(6) < 0.5)

    for prior in (0.05, 0.2, 0.5):
        p = [positive() for _ in range(2000)]
        u = [positive() if g.random() < prior else np.flatnonzero(g.random(6) < 0.01) for _ in range(6000)]
        assert abs(mixture_share(p, u, 6) - prior) < 0.05


def test_the_whole_query_by_brute_force(spark, tmp_path):
    docs, labels, _ = corpus(spark, 500, 3)
    save(docs, tmp_path, "documents")
    save(labels, tmp_path, "labels")
    got = {r.doc_id: r for r in op1_toxicity(spark, str(tmp_path)).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    rated = [r for r in labels.collect() if not held_out(r.doc_id)]

    def feats(i):
        return frozenset(f for w in set((texts[i] or "").split()) for f in word_features(w.encode()))

    p = {feats(r.doc_id) for r in rated if r.toxic}
    u = {feats(r.doc_id) for r in rated}
    every, used = {f for x in p | u for f in x}, []
    for f in every:
        a, b = sum(f in x for x in p), sum(f in x for x in u)
        sp, su = a / len(p), (b + 1) / (len(u) + 1)
        z = (sp - su) / np.sqrt(su * (1 - su * (len(u) / (len(u) + 1))) / len(p))
        if a >= max(2, len(p) / 400) and z > 6 and sp > 2.5 * su:
            used.append((-z, f))
    names = [f for _, f in sorted(used)]
    place = {f: k for k, f in enumerate(names)}

    def rows(side):
        held = sorted(np.array(sorted(f for f in x if f in place), np.uint32).tobytes() for x in side)
        return [np.array([place[f] for f in np.frombuffer(x, np.uint32).tolist()], np.int64) for x in held]

    model = fit(rows(p), rows(u), names)
    for i, t in texts.items():
        z = model.bias + sum(model.weights.get(f, 0) for f in feats(i))
        assert abs(got[i].score - 1 / (1 + np.exp(-z))) < 1e-6
        assert got[i].predicted == (got[i].score >= 0.7) and got[i].held_out == held_out(i)


def test_a_tie_at_the_threshold_and_clashing_columns(spark):
    f = word_features(b"bad")[0]
    c = Classifier({f: float(np.log(0.7 / 0.3))}, 0.0)
    docs = documents(spark, ["bad", "good", "bad " * 200_000, None]).selectExpr("*", "'mine' as is_p", "9 as score")
    rows = {r.doc_id: r for r in score_toxicity(docs, c).collect()}
    assert rows[0].score == rows[2].score >= 0.7 - 1e-12 and rows[1].score == rows[3].score == 0.5
    assert {r.is_p for r in rows.values()} == {"mine"}


def test_word_features_share_beginnings():
    a, b = word_features(b"creepoa"), word_features(b"creepob")
    assert a[0] != b[0] and set(a) & set(b)
