import hashlib
import pickle
import random
import tracemalloc

from helpers_llm import documents, save

from kinweave.llm.decontamination import brute_force, compile_items, find_contamination, op4_decontamination, scan, words


def digest(ids):
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_search_equals_brute_force_on_few_words():
    r = random.Random(0)
    for _ in range(200):
        items = [(i, " ".join(r.choices("ab", k=r.randint(0, 8)))) for i in range(3)]
        text = " ".join(r.choices("ab", k=r.randint(0, 30)))
        hits, owners = scan(words(text), compile_items(items, 4))
        n, n_hit, n_items, sha = brute_force(text, items, 4)
        assert n == len(words(text)) and n_hit == sum(b - a for a, b in hits)
        assert n_items == len(owners) and sha == digest(map(str, owners))


def test_words():
    assert words("Ab-c É1_\tx\n") == [b"ab", b"c", "É1".encode(), b"x"]
    assert words(None) == words("") == words("-- !") == []


ITEM = "one two three four five six seven eight nine ten eleven"


def test_query(spark, tmp_path):
    texts = [f"x {ITEM.upper()}, y", "one two three", None, "", "short item here", ITEM.replace("five", "5")]
    docs = documents(spark, texts).unionByName(documents(spark, texts[:1]))
    save(docs, tmp_path, "documents")
    bench = spark.createDataFrame([(7, ITEM), (7, ITEM), (30, "item"), (4, None), (5, "")], "item_id long, text string")
    save(bench, tmp_path, "benchmark")
    rows = sorted(map(tuple, op4_decontamination(spark, str(tmp_path)).collect()))
    items = [(7, ITEM), (30, "item"), (4, None), (5, "")]
    want = []
    for i, t in [*enumerate(texts), (0, texts[0])]:
        n, hit, k, sha = brute_force(t, items)
        want.append((i, n, hit, k, sha, hit > 0))
    assert rows == sorted(want)
    assert rows[0][2] == 11 and rows[3][:2] == (2, 0)


def test_lots_give_what_one_pass_gives_and_columns_stay(spark):
    docs = documents(spark, [f"a {ITEM} b zebra", "plain"]).selectExpr("*", "1 as hits_before", "doc_id as items")
    bench = spark.createDataFrame([(1, ITEM), (2, "zebra"), (3, "b zebra")], "item_id long, text string")
    one, many, single = (find_contamination(docs, bench, pass_words=b).orderBy("doc_id").collect() for b in (1 << 20, 5, 1))
    assert one == many == single and one[0]["items"] == ["1", "2", "3"] and one[0]["hits_before"] == 1


def test_tables_stay_within_what_a_pass_is_sized_for():
    r = random.Random(1)
    vocabulary = [f"word{i}" for i in range(5000)]
    items = [(i, " ".join(r.choices(vocabulary, k=100))) for i in range(200)]
    held = pickle.dumps(compile_items(items, 10))
    tracemalloc.start()
    tables = pickle.loads(held)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert tables and size < 600 * 200 * 100


def test_very_long_text_and_repeated_items(spark):
    text = "filler words here " * 30_000 + ITEM + " end"
    docs = documents(spark, [text])
    bench = spark.createDataFrame([(1, ITEM), (2, ITEM), (2, ITEM)], "item_id long, text string")
    row = find_contamination(docs, bench).first()
    assert row["items"] == ["1", "2"] and row["hits"] == [[90_000, 90_011]] and row["n_words"] == 90_012


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(documents(spark, ["a"]), bench).first()["hits"] == []
    assert find_contamination(documents(spark, []), bench).count() == 0
