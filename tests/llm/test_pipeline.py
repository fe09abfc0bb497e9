import random
import re

import corpus_pipeline
import public_tokenizers
from helpers_llm import documents, save
from tokenizers import Tokenizer

import __spark_entry__
from kinweave.llm.decontamination import brute_force
from kinweave.llm.quality import op9_quality

ITEM = "one two three four five six seven eight nine ten eleven twelve"


def test_pipeline(spark, tmp_path):
    r = random.Random(0)

    def text(i, n=60):
        return " ".join("".join(r.choices("abcdefgh", k=r.randint(3, 8))) for _ in range(n)) + f" end{i}"

    good = [text(i) for i in range(60)]
    texts = [
        *good,
        good[3],
        good[4] + " tail",
        text(70) + " " + ITEM,
        good[5] + " mail me@x.org",
        None,
        "",
        *(" ".join(f"{w}&&&" for w in text(i).split()) for i in range(40)),
    ]
    save(documents(spark, texts), tmp_path, "documents")
    labels = [(i, 1, 0) for i in range(60)] + [(i, 0, 0) for i in range(66, 106)]
    save(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), tmp_path, "labels")
    save(spark.createDataFrame([(1, ITEM)], "item_id long, text string"), tmp_path, "benchmark")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == documents(spark, []).columns
            out.write.parquet(f"{tmp_path}/stage{k}")
            docs = spark.read.parquet(f"{tmp_path}/stage{k}")
    last = sorted(map(tuple, out.collect()))
    assert last == sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    ids = {x[0] for x in last}
    # Copies, the contaminated text and junk are gone; a text that gained a few words is a near copy.
    assert ids >= set(range(60)) and not ids & {60, 61, 62, 63, *range(66, 106)} and len(ids & {64, 65}) <= 1
    docs_in = {x.doc_id: x.text for x in docs.collect()}
    assert all("@" not in (t or "") for t in docs_in.values())


def alike(a, b):
    """The rule of the near-duplicate stage: five-word shingles, shared of all, 0.8 or more."""

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = shingles(a), shingles(b)
    return len(a & b) >= 0.8 * len(a | b) if a and b else not a and not b


def least_of_groups(rows):
    """The least id of every group of linked texts, by comparing all pairs."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, t in rows:
        for j, u in rows:
            if i < j and alike(t, u):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in root if find(i) == i}


def test_every_stage_by_brute_force(spark, tmp_path):
    r = random.Random(3)

    def text(n):
        return " ".join("".join(r.choices("abcdefgh", k=r.randint(3, 8))) for _ in range(n))

    texts = [text(r.randint(5, 120)) for _ in range(50)]
    for k in range(12):
        w = texts[k].split()
        w[r.randrange(len(w))] = f"n{k}"
        texts.append(" ".join(w))
    texts += [texts[1], texts[2] + " " + ITEM, f"{ITEM} and more {text(30)}", text(20) + " write to a.b@c-d.org now " + text(9), None, ""]
    texts += [" ".join(f"{w}&&&" for w in text(40).split()) for _ in range(20)]
    save(documents(spark, texts), tmp_path, "documents")
    labels = [(i, 1, 0) for i in range(50)] + [(i, 0, 0) for i in range(len(texts) - 20, len(texts))]
    save(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), tmp_path, "labels")
    save(spark.createDataFrame([(1, ITEM)], "item_id long, text string"), tmp_path, "benchmark")
    docs, outs = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        save(stage(spark, docs, str(tmp_path)), tmp_path, f"stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}.parquet")
        outs.append(docs.collect())
    kept = {x.doc_id for x in op9_quality(spark, str(tmp_path)).filter("keep").collect()}
    assert {x.doc_id for x in outs[0]} == kept and len(kept) < len(texts)
    rows = [(x.doc_id, x.text) for x in outs[0]]
    assert {x.doc_id for x in outs[1]} == least_of_groups(rows) and len(outs[1]) < len(rows)
    clean = {x.doc_id for x in outs[1] if brute_force(x.text, [(1, ITEM)])[1] == 0}
    assert {x.doc_id for x in outs[2]} == clean and len(clean) < len(outs[1])
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    want = {x.doc_id: None if x.text is None else email.sub("[EMAIL]", x.text) for x in outs[2]}
    assert {x.doc_id: x.text for x in outs[3]} == want and any("[EMAIL]" in (t or "") for t in want.values())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in want.items()}
    assert {x.doc_id: x.length for x in outs[4]} == sizes and all(x.start == x.piece == 0 for x in outs[4])
    assert len({x.sequence_id for x in outs[4]}) == -(-sum(sizes.values()) // 4096)


def test_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
