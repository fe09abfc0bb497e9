"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive benchmark words; a text is searched in one left-to-right pass for each
pattern length. A block is two consecutive words (one, for patterns of one word). The shift table says how far
the window may jump when its last block is not the end of any pattern; where the shift is 0, the bucket of that
suffix block names the patterns to test, which are compared word by word.

Defined results: null and wordless texts have no words, no hits and no items; items without words have no
window; repeated items count once by item_id (a null item_id is reported as the text "null"); an empty
benchmark hits nothing; rows with equal doc_ids are searched each for itself.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import add_columns, cut, table

#: Words of a window in the registered query.
WINDOW = 10
#: Benchmark words searched for in one pass; a larger benchmark takes several, one after the other. Tables take some
#: 500 bytes a word at most where words differ, so a task holds some 200 MB of them.
PASS_WORDS = 400_000

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of ASCII letters, digits and all characters beyond ASCII, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class WuManber:
    """Shift table and suffix buckets of the patterns of one length, in words.

    A pattern is a place in an item's words, which all tables share, not a copy of them. Patterns of one suffix
    are told apart by their first word before they are compared in full.
    """

    def __init__(self, patterns: Iterable[tuple[list[bytes], int, list[int]]], length: int):
        self.length, self.block = length, min(2, length)
        self.most = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list] = {}
        block = self.block
        for item, start, owners in patterns:
            end = start + length
            for at in range(start + block, end + 1):
                b = tuple(item[at - block : at])
                if end - at < self.shift.get(b, self.most):
                    self.shift[b] = end - at
            key = (item[start], *item[end - block : end])
            self.buckets.setdefault(key, []).append((item, start, owners))

    def find(self, text: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(index of the first word, owners) of each occurrence, from left to right."""
        n, m, shift, most, block = len(text), self.length, self.shift, self.most, self.block
        if n < m:
            return
        get, bucket, i = shift.get, self.buckets.get, m - 1
        while i < n:
            b = (text[i - 1], text[i]) if block == 2 else (text[i],)
            s = get(b, most)
            if s:
                i += s
                continue
            start = i - m + 1
            for item, at, owners in bucket((text[start], *b), ()):
                if item[at : at + m] == text[start : i + 1]:
                    yield start, owners
            i += 1


def compile_items(items: Iterable[tuple[int, str | None]], window: int) -> list[WuManber]:
    """Tables for (owner, text) items, one for each pattern length; owners are any ints."""
    known: dict[bytes, bytes] = {}
    found: dict[int, dict[tuple[bytes, ...], tuple[list[bytes], int, list[int]]]] = defaultdict(dict)
    for owner, text in items:
        w = [known.setdefault(x, x) for x in words(text)]
        size = min(window, len(w))
        for at in range(len(w) - size + 1) if w else ():
            owners = found[size].setdefault(tuple(w[at : at + size]), (w, at, []))[2]
            if not owners or owners[-1] != owner:
                owners.append(owner)
    return [WuManber(ps.values(), size) for size, ps in sorted(found.items())]


def scan(text: list[bytes], tables: list[WuManber]) -> tuple[list[list[int]], set[int]]:
    """Merged [start, end) runs of hit words, and the owners of what occurs."""
    at: list[tuple[int, int]] = []
    owners: set[int] = set()
    for t in tables:
        for start, own in t.find(text):
            at.append((start, start + t.length))
            owners.update(own)
    return merged(at), owners


def merged(at: Iterable[Iterable[int]]) -> list[list[int]]:
    """The union of [start, end) runs, in order."""
    out: list[list[int]] = []
    for start, end in sorted(map(tuple, at)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _passes(benchmark: DataFrame, item_id: str, item_text: str, pass_words: int) -> Iterator[list[tuple]]:
    """Items in lots of at most `pass_words` words (or one item); only one lot is on the driver at a time."""
    rows = benchmark.select(F.col(item_id).cast("string"), F.col(item_text)).distinct()
    lot, held = [], 0
    for r in rows.toLocalIterator():
        n = len(words(r[1]))
        if lot and held + n > pass_words:
            yield lot
            lot, held = [], 0
        lot.append(tuple(r))
        held += n
    if lot:
        yield lot


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    pass_words: int = PASS_WORDS,
) -> DataFrame:
    """docs with n_words long, hits array<array<int>> (runs of hit words), items array<string> (ids, sorted).

    Every column of docs is kept; one named like a result is replaced. The tables that tasks hold come from at
    most `pass_words` words of the benchmark. A larger one is searched for in lots: documents are written once with a
    number, each lot's finds (numbers, runs and ids of the documents that have some) are written by themselves, its
    tables leave the executors before the next lot, and all finds are joined to the documents at the end.
    """
    lots = _passes(benchmark, item_id, item_text, pass_words)
    first, second = next(lots, []), next(lots, None)
    if second is None:
        sent = _sent(docs, first, window)
        return add_columns(docs, [text], FOUND, lambda texts: _search(texts, sent.value))
    stored = cut(docs.withColumn("__number", F.monotonically_increasing_id()))
    parts = []
    for lot in chain([first, second], lots):
        sent = _sent(docs, lot, window)
        found = add_columns(stored.select("__number", text), [text], FOUND, lambda texts, sent=sent: _search(texts, sent.value))
        parts.append(cut(found.filter(F.size("hits") > 0).select("__number", "hits", "items")))
        sent.destroy()
    # A document has no more finds than lots.
    finds = reduce(DataFrame.union, parts).groupBy("__number").agg(
        F.flatten(F.collect_list("hits")).alias("__hits"), F.flatten(F.collect_list("items")).alias("__items")
    )

    def gathered(texts: list, hits: list, items: list) -> tuple[list, list, list]:
        return [len(words(t)) for t in texts], [merged(h or []) for h in hits], [sorted({*(i or [])}) for i in items]

    joined = stored.join(finds, "__number", "left")
    return add_columns(joined, [text, "__hits", "__items"], FOUND, gathered).drop("__number", "__hits", "__items")


#: What is found of a document.
FOUND = "n_words long, hits array<array<int>>, items array<string>"


def _sent(docs: DataFrame, lot: list[tuple], window: int):
    """Tables of a lot and the ids of its items, on their way to all tasks."""
    ids = ["null" if i is None else i for i, _ in lot]
    return docs.sparkSession.sparkContext.broadcast((compile_items(((k, t) for k, (_, t) in enumerate(lot)), window), ids))


def _search(texts: list, held: tuple) -> tuple[list, list, list]:
    tables, ids = held
    n, hits, items = [], [], []
    for t in texts:
        w = words(t)
        runs, owners = scan(w, tables)
        n.append(len(w))
        hits.append(runs)
        items.append(sorted({ids[o] for o in owners}))
    return n, hits, items


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination digest of every document against every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the contaminated ones; their columns are those of docs."""
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("hits") == 0).select(*docs.columns)


def brute_force(text: str | None, items: list[tuple[int, str | None]], window: int = WINDOW) -> tuple:
    """(n_words, n_hit, n_items, items_sha256) by comparing every window at every place."""
    w = words(text)
    hit, ids = set(), set()
    for item, item_text in items:
        v = words(item_text)
        size = min(window, len(v))
        for i in range(len(v) - size + 1) if v else ():
            for at in range(len(w) - size + 1):
                if w[at : at + size] == v[i : i + size]:
                    hit.update(range(at, at + size))
                    ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
