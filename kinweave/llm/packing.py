"""Best-fit packing of token sequences by non-negative least squares over length patterns.

A pattern is the lengths of some pieces that fit one sequence. Patterns are enumerated from the lengths that occur:
for each length as the longest piece, partners spread over the shorter ones, closed by what fills the sequence
best. A non-negative least squares fit of repeat counts to the length histogram says how often to use each. The
counts are rounded so that the patterns of each longest piece keep their sum, as far as pieces are left; then the
fit is repeated on what is left, some rounds. The few pieces behind are packed best fit, longest first, into what
room the patterns leave and then into new sequences, whole groups of equal pieces and equal rooms at a time. All
of this is on the histogram, whose size is bounded by the sequence length; pieces are then dealt to the planned
places by their rank among the pieces of their length.

Null texts are empty: one piece, the closing id alone. Equal rows are packed each for itself. An empty table
gives no rows. Only documents longer than a sequence are cut.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, replace
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinweave.llm.common import add_columns, cut, gapless, table

#: Tokens of a sequence, and the id that closes a document.
CAPACITY, CLOSING = 4096, 1
#: Patterns that are tried for each length as the longest piece, and the pieces of one.
EACH, PIECES = 12, 64
#: The share of a sequence that a pattern may leave, in each fit; a fit is made to what the one before has left.
WASTE = (1 / 64, 1 / 64, 1 / 16, 1 / 4)
#: Sweeps over all patterns that a fit makes.
SWEEPS = 10
#: Steps of the golden ratio spread evenly over (0, 1), however many are taken.
_GOLDEN = (5**0.5 - 1) / 2
#: Words whose ids a task remembers.
REMEMBERED = 300_000
#: Rows that a cell of the ranking aims at.
CELL_ROWS = 500


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit numbers.

    The tokenizer lower-cases, drops white space and cuts text into words before it merges, so a text's ids are
    its words' ids in order. Words of plain texts (ASCII and Latin letters, where case and composition depend on
    no context) are cut here and their ids remembered; new words are encoded by the tokenizer, many at a time,
    and told apart by the mark at a word's end. Lines with any other character go to the tokenizer whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.last[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}
        self.strange = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ɏ]|<\\|")
        letters = "a-zªµºß-öø-ɏ"
        self.word = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9²³¹¼-¾]|[^\\s0-9²³¹¼-¾{letters}]+"
        )

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _new(self, words: list[str]) -> dict[str, bytes]:
        """The ids of plain words, encoded as one text and told apart where a token ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return {w: self._whole(w) for w in words}
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return {w: data[a:b] for w, a, b in zip(words, [0, *ends], ends, strict=False)}

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Every text's ids; words that are new are encoded together."""
        out: list[list[bytes]] = [[] for _ in texts]
        plain: list[tuple[int, int, list[str]]] = []
        for i, t in enumerate(texts):
            if not t:
                continue
            # Composition and merging never cross a line end, so only lines with strange characters are set apart.
            for part in t.split("\n") if self.strange.search(t) else [t]:
                if self.strange.search(part):
                    out[i].append(self._whole(part))
                else:
                    plain.append((i, len(out[i]), self.word.findall(part.lower())))
                    out[i].append(b"")
        known = self.known
        fresh = list(set().union(*(w for _, _, w in plain)).difference(known))
        if fresh:
            known.update(self._new(fresh))
        get = known.__getitem__
        for i, k, w in plain:
            out[i][k] = b"".join(map(get, w))
        for w in fresh[: max(0, len(known) - REMEMBERED)]:
            del known[w]
        return [b"".join(x) for x in out]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(df: DataFrame, key: str, tokenizer: str, text: str = "text", capacity: int = CAPACITY, closing: int = CLOSING) -> DataFrame:
    """key, piece int, start long, length long, ids_crc32 long for every piece of every text."""

    def run(texts: list) -> tuple[list]:
        e, out = encoder(tokenizer), []
        end = np.array([closing], "<u4").tobytes()
        for ids in e.encode_all(texts):
            ids += end
            out.append(
                [
                    {"piece": k, "start": a // 4, "length": len(ids[a : a + 4 * capacity]) // 4, "ids_crc32": crc32(ids[a : a + 4 * capacity])}
                    for k, a in enumerate(range(0, len(ids), 4 * capacity))
                ]
            )
        return (out,)

    made = add_columns(
        df.select(key, text), [text], "pieces array<struct<piece:int,start:long,length:long,ids_crc32:long>>", run
    )
    return made.select(key, F.explode("pieces").alias("p")).select(key, "p.*")


def enumerate_patterns(
    histogram: dict[int, int], capacity: int, waste: int, each: int = EACH, deepest: int = PIECES
) -> list[tuple[int, ...]]:
    """Patterns, longest piece first: about `each` for every length as the longest piece, none left out.

    Partners are taken at places spread evenly over the pieces that are no longer than the first and still fit,
    the last ones as what fits best. Patterns that leave more than `waste` are dropped, but for pieces alone.
    """
    lengths = sorted(histogram)
    pieces_to = np.cumsum([histogram[x] for x in lengths]).tolist()
    found: list[tuple[int, ...]] = []
    for first in reversed(lengths):
        tried: dict[tuple[int, ...], int] = {}
        for k in range(each + 1):
            own, room, u = [first], capacity - first, (first * _GOLDEN + k / each) % 1
            while room and len(own) < deepest:
                fitting = bisect_right(lengths, min(room, first))
                if not fitting:
                    break
                at = fitting - 1
                if k < each and room > capacity // 8:
                    at = min(at, bisect_left(pieces_to, u * pieces_to[at]))
                    u = (u + _GOLDEN) % 1
                own.append(lengths[at])
                room -= lengths[at]
            tried[tuple(sorted(own, reverse=True))] = room
        found += [p for p, room in tried.items() if room <= waste or len(p) == 1]
    return found


def fit_counts(patterns: list[tuple[int, ...]], histogram: dict[int, int], sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared distance of sum(x * pattern) to the histogram.

    Coordinate descent on the normal equations; each step touches the lengths of one pattern.
    """
    left = {length: float(n) for length, n in histogram.items()}
    columns = []
    for p in patterns:
        c: dict[int, int] = defaultdict(int)
        for x in p:
            c[x] += 1
        columns.append((list(c.items()), sum(n * n for n in c.values())))
    x = [0.0] * len(patterns)
    for _ in range(sweeps):
        moved = 0.0
        for j, (column, norm) in enumerate(columns):
            step = sum(n * left[length] for length, n in column) / norm
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved += abs(step)
                for length, n in column:
                    left[length] -= n * step
        if moved < 1e-6 * max(1, sum(histogram.values())):
            break
    return np.array(x)


@dataclass
class Group:
    """Equal sequences: how many, and runs of (length, how many of it in each sequence).

    `fitted` are the pieces that each got from the least squares fit.
    """

    count: int
    runs: list[tuple[int, int]]
    room: int
    fitted: int = 0


def fit_round(left: dict[int, int], capacity: int, waste: int) -> list[Group]:
    """Sequences of the patterns that one fit to `left` uses; their pieces are taken from it."""
    patterns = enumerate_patterns({length: n for length, n in left.items() if n}, capacity, waste)
    counts = fit_counts(patterns, {length: n for length, n in left.items() if n})
    groups, carried, longest = [], 0.0, -1
    # Fractions of a count are carried to the next pattern of the same longest piece.
    for j in sorted(np.flatnonzero(counts > 1e-9).tolist(), key=lambda j: (-patterns[j][0], -counts[j], patterns[j])):
        if patterns[j][0] != longest:
            longest, carried = patterns[j][0], 0.5
        carried += counts[j]
        need = Counter(patterns[j])
        n = min([int(carried), *(left[x] // k for x, k in need.items())])
        if n > 0:
            carried -= n
            for x, k in need.items():
                left[x] -= n * k
            runs = sorted(need.items(), reverse=True)
            groups.append(Group(n, runs, capacity - sum(patterns[j]), len(patterns[j])))
    return groups


def plan(histogram: dict[int, int], capacity: int = CAPACITY, waste: Sequence[float] = WASTE) -> list[Group]:
    """Groups of sequences that hold exactly the histogram's pieces.

    After each fit what is left is packed best fit; of these plans the one of the fewest sequences is taken, the
    one of the most fits where they tie. Groups number at most the patterns used plus a few for each length: a
    length's pieces exhaust whole groups of equal room, and split or open one or two.
    """
    left = {length: n for length, n in histogram.items() if n}
    fitted: list[Group] = []
    best: list[Group] = []
    fewest = None
    for share in waste:
        if not any(left.values()):
            break
        fitted += fit_round(left, capacity, int(capacity * share))
        made = best_fit([replace(g, runs=list(g.runs)) for g in fitted], left, capacity)
        sequences = sum(g.count for g in made)
        if fewest is None or sequences <= fewest:
            best, fewest = made, sequences
    return best


def best_fit(groups: list[Group], left: dict[int, int], capacity: int) -> list[Group]:
    """groups, and the pieces left in their room or in new groups, longest first; groups is changed."""
    rooms: dict[int, list[Group]] = defaultdict(list)
    sizes: list[int] = []

    def put(g: Group) -> None:
        if g.room and not rooms[g.room]:
            insort(sizes, g.room)
        if g.room:
            rooms[g.room].append(g)

    def take(room: int) -> Group:
        g = rooms[room].pop()
        if not rooms[room]:
            sizes.pop(bisect_left(sizes, room))
        return g

    for g in groups:
        put(g)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            k = bisect_left(sizes, length)
            if k < len(sizes):
                g = take(sizes[k])
            else:
                each = capacity // length
                g = Group(max(1, n // each), [], capacity)
                groups.append(g)
            each = min(g.room // length, n)
            used = min(g.count, n // each)
            if used < g.count:
                rest = Group(g.count - used, list(g.runs), g.room, g.fitted)
                g.count = used
                groups.append(rest)
                put(rest)
            g.runs.append((length, each))
            g.room -= length * each
            n -= used * each
            put(g)
    return groups


def places(groups: list[Group]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset, how many in each sequence), by first rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for g in groups:
        offset = 0
        for length, each in g.runs:
            out[length].append((rank[length], sequence, offset, each))
            rank[length] += g.count * each
            offset += length * each
        sequence += g.count
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def pack(df: DataFrame, key: str, length: str = "length", capacity: int = CAPACITY, cell_rows: int = CELL_ROWS) -> DataFrame:
    """df with sequence_id long and offset long; df must have columns that tell its pieces, none over capacity.

    The histogram, of at most `capacity` lengths, is all that reaches the driver. A length's pieces are ranked
    in cells (see `common.gapless`), so a third of all pieces may have one length.
    """
    spark = df.sparkSession
    counts = {r[0]: r[1] for r in df.groupBy(length).agg(F.count(F.lit(1))).collect()}
    held = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    others = [c for c in df.columns if c != length]
    cells = F.lit(max(1, max(counts.values(), default=0) // cell_rows))
    ranked = gapless(df.select(length, *others), [length], others, "__rank", cells)

    def run(lengths: list, ranks: list) -> tuple[np.ndarray, np.ndarray]:
        size, rank = np.array(lengths, np.int64), np.array(ranks, np.int64)
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for x in np.unique(size).tolist():
            at = np.flatnonzero(size == x)
            rows = held.value[x]
            k = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
            inside = rank[at] - rows[k, 0]
            sequence[at] = rows[k, 1] + inside // rows[k, 3]
            offset[at] = rows[k, 2] + inside % rows[k, 3] * x
        return sequence, offset

    out = add_columns(ranked, [length, "__rank"], "sequence_id long, offset long", run)
    return out.select(*df.columns, "sequence_id", "offset")


def pack_documents(df: DataFrame, key: str, tokenizer: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset of every piece of every text."""
    return pack(cut(pieces(df, key, tokenizer, text, capacity)), key, capacity=capacity)


def op5_packing(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, "doc_id", public_tokenizers.path(tokenizer))


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs with their sequences and offsets."""
    import public_tokenizers

    return pack_documents(docs.select("doc_id", "text"), "doc_id", public_tokenizers.path("word_bpe_49k.json"))
