import random

import numpy as np
from helpers_llm import documents, save

from kinweave.llm.quality import Ordinal, features, fit, op9_quality, rate, stage_quality, train


def corpus(spark, n=400):
    r, texts, grades = random.Random(0), [], []
    for i in range(n):
        words = ["".join(r.choices("abcde", k=r.randint(2, 7))) for _ in range(r.randint(5, 80))]
        good = i % 4 > 0
        texts.append(
            " ".join(words) if good else " ".join(w + "&&&" for w in words) if i % 8 else " ".join([words[0]] * 50),
        )
        grades.append(int(good))
    labels = spark.createDataFrame(
        [(i, g, 0) for i, g in enumerate(grades) if i % 2 == 0 or i % 3 == 0],
        "doc_id long, quality int, toxic int",
    )
    return documents(spark, [*texts, None, ""]), labels, grades


def test_accuracy_on_unrated_rows(spark, tmp_path):
    docs, labels, grades = corpus(spark)
    save(docs, tmp_path, "documents")
    save(labels, tmp_path, "labels")
    rows = {r.doc_id: r for r in op9_quality(spark, str(tmp_path)).collect()}
    unrated = [i for i in range(400) if i % 2 and i % 3]
    assert sum(rows[i].keep == bool(grades[i]) for i in unrated) >= 0.97 * len(unrated)
    assert len(rows) == 402 and all(0 <= r.tail_probability <= 1 for r in rows.values())
    kept = stage_quality(spark, docs.selectExpr("*").unionByName(docs.filter("doc_id = 1")), str(tmp_path))
    assert kept.columns == docs.columns and kept.filter("doc_id = 1").count() == 2


def test_more_grades_are_ordered():
    r, rows, grades = random.Random(1), [], []
    for _ in range(600):
        g = r.randrange(5)
        rows.append(features(" ".join(r.choices(["good"] * g + ["bad"] * (4 - g), k=60))))
        grades.append(float(g))
    m = fit(rows, grades)
    assert m.grades == [0.0, 1.0, 2.0, 3.0, 4.0] and (np.diff(m.thresholds) > 0).all()
    got = [m.expected(m.tails(" ".join(["good"] * k + ["bad"] * (20 - k)))) for k in (0, 5, 10, 15, 20)]
    assert got == sorted(got) and got[0] < 0.7 and got[-1] > 3.3
    tails = m.tails("good bad")
    assert tails[0] == 1 and (np.diff(tails) <= 1e-12).all()


def test_degenerate_ratings(spark):
    docs, labels, _ = corpus(spark, 20)
    docs = docs.selectExpr("doc_id", "text")
    one = labels.selectExpr("doc_id", "1 as quality", "toxic")
    got = rate(docs, train(docs, one, "doc_id", "quality")).collect()
    assert {(r.expected_grade, r.keep) for r in got} == {(1.0, True)}
    none = rate(docs, train(docs, labels.limit(0), "doc_id", "quality")).collect()
    assert {(r.expected_grade, r.keep) for r in none} == {(None, True)}
    assert rate(documents(spark, []), Ordinal([0.0, 1.0], np.zeros(1), np.zeros(2 << 16))).count() == 0


def test_clashing_columns(spark, tmp_path):
    docs, labels, _ = corpus(spark, 40)
    save(labels, tmp_path, "labels")
    clash = docs.selectExpr("*", "'mine' as keep", "1 as expected_grade", "2 as quality")
    out = stage_quality(spark, clash, str(tmp_path))
    assert out.columns == clash.columns and {r.keep for r in out.collect()} == {"mine"}


def test_the_model_by_brute_force(spark):
    """Texts and grades picked by plain Python give the same thresholds and weights, however rows are dealt."""
    docs, labels, _ = corpus(spark, 120)
    twice = docs.unionByName(docs.filter("doc_id < 40").selectExpr("doc_id", "concat(text, ' other words') as text", "lang", "source", "n_chars"))
    models = [train(d, labels, "doc_id", "quality") for d in (twice, twice.repartition(7, "text"), twice.orderBy("n_chars"))]
    hashed = {(r.doc_id, r.text): r.h for r in twice.selectExpr("doc_id", "text", "xxhash64(text) as h").collect()}
    grade = {}
    for r in labels.collect():
        grade[r.doc_id] = min(grade.get(r.doc_id, 9), r.quality)
    picked = []
    for i in sorted(grade):
        own = [(h, t) for (d, t), h in hashed.items() if d == i]
        if own:
            picked.append((i, float(grade[i]), min(own)[1]))
    rows = sorted((i, g, *(x.tobytes() for x in features(t))) for i, g, t in picked)
    want = fit([(np.frombuffer(p, np.int32), np.frombuffer(v, np.float32)) for _, _, p, v in rows], [r[1] for r in rows])
    for m in models:
        assert m.grades == want.grades and (m.weights == want.weights).all() and (m.thresholds == want.thresholds).all()


def test_long_text_is_read_whole_and_a_tie_is_kept(spark):
    m = Ordinal([0.0, 1.0], np.zeros(1), np.zeros(2 << 16))
    assert {r.keep for r in rate(documents(spark, ["any", None, ""]), m).collect()} == {True}
    long = "plain words here " * 60_000
    places, values = features(long + "tail&&&")
    assert len(places) > len(features(long)[0]) and np.isfinite(values).all()
