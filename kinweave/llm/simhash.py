"""SimHash near-duplicates with pivot distance tables.

The Hamming distances of each distinct fingerprint to a fixed set of reference fingerprints (pivots) are tabled once,
and travel with it wherever it is compared. By the triangle inequality two fingerprints within `radius` differ by at most `radius` in every
coordinate, so a larger maximum coordinate difference discards a pair unseen; survivors are verified by the exact
distance.

So that no fingerprint meets all others, pairs are sought only within cells: cut the 64 bits into `radius + 2`
parts or more; two fingerprints within `radius` agree on at least parts - radius of them, so each fingerprint is
put into one cell for each choice of that many parts and shares a cell with every partner. A cell of more than
`CELL` fingerprints is dealt over pairs of blocks, each its own bounded task; nothing is capped. Within a cell a
breadth-first walk emits a spanning forest of the links, never all pairs; its components are those of the links.

The pipeline's stage keeps one of the texts that share 0.8 or more of their shingles. Its candidates are the links of
their fingerprints, found as above; at that similarity fingerprints differ in 10 bits of 64 on average, more than cells
of equal bits can hold together, so texts with further ones are candidates if they share one of BANDS cells of least
hashes and their fingerprints and sketches are near enough. Each connected group of candidates is then walked again with
the exact similarity of the shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import add_columns, cut, free, table

#: Words of a shingle and bits that linked fingerprints may differ in, in the registered query.
SHINGLE, RADIUS = 4, 4
#: In the pipeline's stage, texts are linked whose sets of five-word shingles share LIKE[0] / LIKE[1] of their union or
#: more. A candidate pair has fingerprints within RADIUS, or the same BAND least hashes in one of BANDS cells (missed at
#: 0.8 with a chance of 6e-7), fingerprints that differ in FAR bits at most (more at 0.8 with a chance of 3e-7 where 4 of
#: 5 shingles are shared, which is the worst case, and less for longer texts) and sketches of SKETCH bits, one of each
#: least hash, that differ in SKETCH_RADIUS at most (more at 0.8 with a chance of 3e-7). The chances fall with the
#: similarity.
STAGE_SHINGLE, LIKE, BANDS, BAND, FAR, SKETCH, SKETCH_RADIUS = 5, (4, 5), 20, 3, 29, 128, 32
#: Reference fingerprints: XXH64 of their number under seed 7.
PIVOTS = np.array([xxhash.xxh64_intdigest(str(k), 7) for k in range(16)], dtype=np.uint64)
#: Fingerprints of a cell that one block of a task holds.
CELL = 4096
#: Edges that are contracted at once within a task.
LOT = 100_000
#: Cells of more than CELL fingerprints that go to all tasks, 20 bytes each; more are joined.
HOT_CELLS = 100_000
#: Shingles that one block of a task holds where sets are compared.
SET_CELL = 1 << 20
#: The SKETCH orders of hashes: h comes at (h ^ _FLIP) * _ODD.
_FLIP = np.array([xxhash.xxh64_intdigest(str(k), 11) for k in range(SKETCH)], dtype=np.uint64)
_ODD = np.array([xxhash.xxh64_intdigest(str(k), 13) | 1 for k in range(SKETCH)], dtype=np.uint64)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def _words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of characters that are no ASCII white space, as UTF-8."""
    if not text:
        return []
    return [w for w in text.encode("utf-8", "surrogatepass").translate(_LOWER).split(b" ") if w]


def _shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, as rows of bytes, most significant first; fewer words are one shingle."""
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_digest
    if n == 1:
        return np.frombuffer(digest(joined, 42), np.uint8).reshape(1, 8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    h = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)])
    return np.frombuffer(h, np.uint8).reshape(n, 8)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of all shingles, repeats included; 0 for null texts and texts without words."""
    words = _words(text)
    return _majority(_shingle_hashes(words, shingle)) if words else 0


def shingle_set(words: list[bytes], shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """The distinct shingle hashes in order; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(np.ascontiguousarray(_shingle_hashes(words, shingle)).view(">u8").astype(np.uint64))


def set_fingerprint(h: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of a set of shingle hashes; 0 for none."""
    return _majority(h.astype(">u8").view(np.uint8).reshape(-1, 8))


def least_hashes(h: np.ndarray) -> np.ndarray:
    """The least of the hashes in each of SKETCH orders; two sets share each with the chance of their similarity."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1024):
        x = (h[at : at + 1024, None] ^ _FLIP) * _ODD
        np.minimum(least, x.min(axis=0), out=least)
    return least


def _sketch_of(least: np.ndarray) -> bytes:
    return np.packbits((least * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(63)).astype(np.uint8)).tobytes()


def _bands_of(least: np.ndarray) -> np.ndarray:
    x = np.zeros(BANDS, np.uint64)
    for part in least[: BANDS * BAND].reshape(BANDS, BAND).T:
        x = ((x ^ (x >> np.uint64(31))) + part) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def sketch(words: list[bytes], shingle: int = STAGE_SHINGLE) -> bytes:
    """One bit of the least shingle hash in each of SKETCH orders."""
    return _sketch_of(least_hashes(shingle_set(words, shingle)))


def fingerprints(df: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """df without `text`, with fp long: the fingerprint's bits of the whole text as a signed number."""

    def run(texts: list) -> tuple[list]:
        fp = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
        return (fp.view(np.int64),)

    return add_columns(df, [text], "fp long", run).drop(text)


def sketched(df: DataFrame, text: str = "text") -> DataFrame:
    """df without `text`, with node long (a hash of the shingle set), fp long (its fingerprint), size int (its
    shingles), sk binary (its sketch) and bands array<long> (a hash of each band)."""

    def run(texts: list) -> tuple[list, np.ndarray, list, list, list]:
        node, fp, size, sk, bands = [], [], [], [], []
        for t in texts:
            h = shingle_set(_words(t))
            least = least_hashes(h)
            node.append(int.from_bytes(xxhash.xxh64_digest(h.tobytes(), 42), "big", signed=True))
            fp.append(set_fingerprint(h))
            size.append(len(h))
            sk.append(_sketch_of(least))
            bands.append(_bands_of(least))
        return node, np.array(fp, np.uint64).view(np.int64), size, sk, bands

    return add_columns(df, [text], "node long, fp long, size int, sk binary, bands array<long>", run).drop(text)


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Hamming distances to the pivots, one row of bytes for each fingerprint (uint64)."""
    return np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def _parts(segments: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each part."""
    ends = [round(64 * k / segments) for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _cell_keys(segments: int, radius: int) -> list[int]:
    """A mask for each choice of parts that a pair within the radius may agree on."""
    spans = [((1 << n) - 1) << a for a, n in _parts(segments)]
    return [sum(c) for c in combinations(spans, segments - radius)]


def _span(n: int, near: Callable[[int, np.ndarray], np.ndarray], inner: int | None = None) -> tuple[list, list]:
    """Edges (i, j) of a spanning forest of the graph of links among n nodes.

    near(x, free) gives the nodes of `free` that are linked with x. With `inner`, only links between the first
    `inner` and the others count. Each step takes one reached node and links it with the unreached ones.
    """
    left, right = [], []
    free = np.arange(n)
    side = np.zeros(n, bool)
    if inner is not None:
        side[inner:] = True
    while len(free):
        stack = [int(free[0])]
        free = free[1:]
        while stack and len(free):
            x = stack.pop()
            found = near(x, free if inner is None else free[side[free] != side[x]])
            if len(found):
                left += [x] * len(found)
                right += found.tolist()
                stack += found.tolist()
                free = free[~np.isin(free, found, assume_unique=True)]
    return left, right


def walk(
    fp: np.ndarray, radius: int, inner: int | None = None, pivots: np.ndarray | None = None
) -> tuple[list, list]:
    """A spanning forest of fingerprints within the radius; see _span. pivots are their rows of `pivot_table`.

    Each step discards the unreached ones whose pivot coordinates differ too much, and verifies the rest.
    """
    pivots = pivot_table(fp) if pivots is None else pivots

    def near(x: int, free: np.ndarray) -> np.ndarray:
        for c in (slice(0, 4), slice(4, 16)):
            if not len(free):
                return free
            free = free[np.abs(pivots[free, c] - pivots[x, c]).max(axis=1) <= radius]
        return free[np.bitwise_count(fp[free] ^ fp[x]) <= radius]

    return _span(len(fp), near, inner)


def _alike(sk: np.ndarray, size: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    """Links of candidates: sizes that allow the similarity, and near sketches (rows of 64-bit words)."""

    def near(x: int, free: np.ndarray) -> np.ndarray:
        low, high = np.minimum(size[free], size[x]), np.maximum(size[free], size[x])
        free = free[LIKE[1] * low >= LIKE[0] * high]
        return free[np.bitwise_count(sk[free] ^ sk[x]).sum(axis=1) <= SKETCH_RADIUS]

    return near


def walk_candidates(
    fp: np.ndarray, sk: np.ndarray, size: np.ndarray, inner: int | None = None
) -> tuple[list, list]:
    """A spanning forest of candidates, whose fingerprints differ in FAR bits at most; see _span and _alike."""
    alike = _alike(sk, size)

    def near(x: int, free: np.ndarray) -> np.ndarray:
        return alike(x, free[np.bitwise_count(fp[free] ^ fp[x]) <= FAR])

    return _span(len(size), near, inner)


def walk_sets(sets: list[np.ndarray], sk: np.ndarray, inner: int | None = None) -> tuple[list, list]:
    """A spanning forest of the non-empty sets that are similar enough; candidates are verified exactly."""
    size = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(size) - size
    known, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(known), np.int64)
    candidates = _alike(sk, size)

    def near(x: int, free: np.ndarray) -> np.ndarray:
        free = candidates(x, free)
        if not len(free):
            return free
        own = ids[starts[x] : starts[x] + size[x]]
        mark[own] = 1
        many = size[free]
        first = np.cumsum(many) - many
        at = np.repeat(starts[free] - first, many) + np.arange(int(many.sum()))
        shared = np.add.reduceat(mark[ids[at]], first)
        mark[own] = 0
        # shared / (a + b - shared) >= LIKE, in whole numbers
        return free[sum(LIKE) * shared >= LIKE[0] * (many + size[x])]

    return _span(len(size), near, inner)


def _words_of(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 64-bit words of a column of binaries without nulls, straight from Arrow's buffer, and each row's ends."""
    _, ends, data = x.buffers()
    ends = np.frombuffer(ends, np.int32)[x.offset :][: len(x) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint64, int(ends[-1] - ends[0]) // 8, int(ends[0])), (ends - ends[0]) // 8


def _forests(
    lots: DataFrame, judge: Callable[[dict[str, pa.Array]], Callable[[np.ndarray, int | None], tuple[list, list]]]
) -> DataFrame:
    """Distinct edges a long, b long of all lots: i, j, rows of b, node and what `judge` reads.

    judge takes the columns of a batch's rows and returns a walk over the rows at given places.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            i, j = (np.asarray(batch.column(c)) for c in (0, 1))
            lists = batch.column(2)
            offsets, rows = np.asarray(lists.offsets), lists.values
            own = {x.name: rows.field(k) for k, x in enumerate(rows.type)}
            b, node = (own[c].to_numpy(zero_copy_only=False) for c in ("b", "node"))
            over = judge(own)
            left, right = [], []
            for k in range(batch.num_rows):
                at = np.arange(offsets[k], offsets[k + 1])
                at = at[np.lexsort((node[at], b[at] != i[k]))]
                inner = None if i[k] == j[k] else int((b[at] == i[k]).sum())
                x, y = over(at, inner)
                left.append(node[at[x]])
                right.append(node[at[y]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).astype(np.int64)) for x in (left, right)],
                names=["a", "b"],
            )

    return lots.mapInArrow(join, "a long, b long").distinct()


def _cells(keyed: DataFrame, columns: list[str], cell: int) -> DataFrame:
    """The lots of the cells (m, k): one for each pair of blocks of `cell` nodes.

    Only cells of more than `cell` nodes are dealt over blocks; they are counted first, and go to all tasks if there are
    no more than HOT_CELLS of them. So every node is shuffled once for each of its cells, however many they hold.
    """
    hot = cut(keyed.groupBy("m", "k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell))
    held = keyed.join(F.broadcast(hot) if hot.count() <= HOT_CELLS else hot, ["m", "k"], "left")
    blocks = F.coalesce(F.ceil(F.col("n") / F.lit(cell)), F.lit(1)).cast("int")
    block = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pairs = held.withColumn("bs", blocks).withColumn("b", block).withColumn(
        "o", F.explode(F.sequence(F.lit(0), F.col("bs") - 1))
    )
    return (
        pairs.groupBy("m", "k", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
        .agg(F.collect_list(F.struct("b", *columns)).alias("rows"))
        .filter(F.size("rows") > 1)
        .select("i", "j", "rows")
    )


def links(nodes: DataFrame, radius: int = RADIUS, cell: int = CELL, segments: int | None = None) -> DataFrame:
    """Edges a long, b long between nodes that span the components of all links.

    nodes: node long (distinct) and fp long; the pivot table is made here, once for each node. The parts are the finer the more nodes there are, so that a cell of
    unrelated ones stays small.
    """
    if segments is None:
        n = nodes.count()
        segments = radius + (2 if n < 1 << 23 else 3 if n < 1 << 30 else 4)
    masks = _cell_keys(segments, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]

    def distances(fps: list) -> tuple[list]:
        return ([row.tobytes() for row in pivot_table(np.array(fps, np.int64).view(np.uint64))],)

    keyed = add_columns(nodes, ["fp"], "pivots binary", distances).select(
        "node",
        "fp",
        "pivots",
        F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed))).alias("m", "k"),
    )

    def judge(own: dict[str, pa.Array]) -> Callable[[np.ndarray, int | None], tuple[list, list]]:
        fp = own["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
        pivots = _words_of(own["pivots"])[0].view(np.int8).reshape(len(fp), -1)
        return lambda at, inner: walk(fp[at], radius, inner, pivots[at])

    return _forests(_cells(keyed, ["node", "fp", "pivots"], cell), judge)


def candidates(nodes: DataFrame, cell: int = CELL) -> DataFrame:
    """Edges a long, b long that span the connected groups of candidates within cells of least hashes.

    nodes: node, fp, size, sk, bands.
    """
    keyed = nodes.filter("size > 0").select("node", "fp", "size", "sk", F.posexplode("bands").alias("m", "k"))

    def judge(own: dict[str, pa.Array]) -> Callable[[np.ndarray, int | None], tuple[list, list]]:
        fp = own["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
        size = own["size"].to_numpy(zero_copy_only=False).astype(np.int64)
        sk = _words_of(own["sk"])[0].reshape(len(size), -1)
        return lambda at, inner: walk_candidates(fp[at], sk[at], size[at], inner)

    return _forests(_cells(keyed, ["node", "fp", "size", "sk"], cell), judge)


def similar(
    groups: DataFrame, nodes: DataFrame, texts: DataFrame, cell: int = CELL, set_cell: int = SET_CELL
) -> DataFrame:
    """Edges a long, b long that span the components of texts that are similar enough, within groups of candidates.

    groups: node, root; nodes: node, size, sk, th (the hash of one of its texts); texts: text, th. A group is
    dealt over pairs of blocks of `cell` nodes and `set_cell` shingles on average; nothing is capped.
    """
    held = groups.join(nodes.select("node", "size", "sk", "th"), "node")
    sums = held.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("m"))
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(cell)), F.ceil(F.col("m") / F.lit(set_cell))).cast("int")
    held = held.join(sums, "root").select(
        "root", "node", "sk", "th", blocks.alias("bs"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("b")
    )
    # Copies are dropped before the shuffle; no broadcast, so that the plan is one at all sizes.
    held = texts.dropDuplicates(["th"]).join(cut(held).hint("merge"), "th")

    def run(part: list) -> tuple[list]:
        return ([shingle_set(_words(t)).tobytes() for t in part],)

    made = add_columns(held, ["text"], "sh binary", run).drop("text", "th")
    lots = (
        made.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("bs") - 1)))
        .groupBy("root", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
        .agg(F.collect_list(F.struct("b", "node", "sk", "sh")).alias("rows"))
        .filter(F.size("rows") > 1)
        .select("i", "j", "rows")
    )

    def judge(own: dict[str, pa.Array]) -> Callable[[np.ndarray, int | None], tuple[list, list]]:
        h, ends = _words_of(own["sh"])
        sk = _words_of(own["sk"])[0].reshape(len(ends) - 1, -1)
        return lambda at, inner: walk_sets([h[ends[k] : ends[k + 1]] for k in at], sk[at], inner)

    return _forests(lots, judge)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node to the least node of its component, for the components of these edges alone."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = list(range(len(nodes)))
    left, right = at[: len(a)].tolist(), at[len(a) :].tolist()
    for x, y in zip(left, right, strict=True):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x < y:
            root[y] = x
        elif y < x:
            root[x] = y
    for x in range(len(root)):  # roots come before what hangs on them, as a lesser node is never hung on a greater
        root[x] = root[root[x]]
    least = np.array(root, np.int64)
    tied = np.flatnonzero(least != np.arange(len(least)))
    return nodes[tied], nodes[least[tied]]


def contracted(edges: DataFrame) -> DataFrame:
    """An edge list a, b (a > b) of the same components: each lot of LOT edges of a task becomes stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            x, y = stars(*(np.concatenate([z.column(k).to_numpy() for z in held]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(z.num_rows for z in held) >= LOT:
                yield made()
                held = []
        if held:
            yield made()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node long, root long (least node of its component, as signed numbers) of an undirected edge list.

    Edges are first contracted within lots of them, which takes long chains out. Then large-star and small-star
    rounds alternate; each is a combined minimum and a join and is written to the shared folder, where the round
    before is deleted. A star's centre may hold a third of the edges: only minima are gathered for it, and the minima
    are dealt anew for the join on it (by the key's complement, as else their own partitioning would be taken), so that
    Spark can split the centre's edges. Isolated nodes don't occur.
    """
    now = cut(contracted(edges.filter("a <> b")).distinct())
    state = None
    while True:  # each round ties nodes to lesser ones, until none is left to tie
        # Large star: every larger neighbour of a node is tied to the least of its neighbours and itself.
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select(F.bitwise_not("a").alias("c"), F.least("a", "m").alias("m"))
        larger = both.filter("b > a").select(F.bitwise_not("a").alias("c"), "b")
        large = larger.join(least, "c").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = cut(large.distinct())
        # Small star: a node and its smaller neighbours are tied to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.select(F.bitwise_not("a").alias("c"), "b").join(
            least.select(F.bitwise_not("a").alias("c"), "m"), "c"
        )
        small = (
            small.filter("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        before, now = now, cut(small)
        free(before, large)
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == state:
            break
        state = seen
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    own = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return roots.union(own.join(roots, "node", "left_anti"))


def _named(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rows without node, with root long and component_id; nodes: node and least, the least key of its rows."""
    named = nodes.join(components(edges), "node", "left").select(
        "node", "least", F.coalesce("root", "node").alias("root")
    )
    # Written, so that the join below is dealt anew on both sides and can be split where one root is large.
    least = cut(named.groupBy("root").agg(F.min("least").alias("component_id")))
    by_node = cut(named.join(least, "root").select("node", "root", "component_id"))
    return rows.join(by_node, "node").drop("node")


def _set_apart(df: DataFrame, key: str, text: str, results: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """df with names that clash with none used here, and the columns that give it its own names again.

    The text is left out of the latter, and so are columns named like a result.
    """
    apart = {c: f"__own_{i}" for i, c in enumerate(df.columns)} | {key: "__key", text: "__text"}
    back = [F.col(apart[c]).alias(c) for c in df.columns if c not in (text, *results)]
    return df.select(*(F.col(f"`{c}`").alias(n) for c, n in apart.items())), back


def near_duplicates(
    df: DataFrame,
    key: str,
    text: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    cell: int = CELL,
) -> DataFrame:
    """The columns of df but the text, with fp long, root long and component_id for every row.

    root is the least node of the component, component_id the least key. Null and wordless texts have
    fingerprint 0 and are linked like any other. Equal fingerprints are one node, so copies cost nothing beyond
    their row. Null keys take no part in the least key; a component of null keys alone has a null id. Repeated
    rows are kept. An empty table gives no rows. Columns of df named like a result are replaced.
    """
    own, back = _set_apart(df, key, text, ("fp", "root", "component_id"))
    rows = cut(fingerprints(own, "__text", shingle).withColumn("node", F.col("fp")))
    nodes = cut(rows.groupBy("node", "fp").agg(F.min("__key").alias("least")))
    return _named(rows, nodes, links(nodes.select("node", "fp"), radius, cell)).select(
        *back, "fp", "root", "component_id"
    )


def similar_documents(
    df: DataFrame, key: str, text: str = "text", cell: int = CELL, set_cell: int = SET_CELL
) -> DataFrame:
    """The columns of df but the text, with root long and component_id (see near_duplicates) for every row.

    Links are pairs of texts that share LIKE of their five-word shingles or more, by count; candidates are the links of
    their fingerprints within RADIUS, as in near_duplicates, and those of `candidates`. Equal sets of shingles are one
    node; so are all null and wordless texts, which are linked with no other.
    """
    own, back = _set_apart(df, key, text, ("root", "component_id"))
    th = F.xxhash64("__text").alias("th")
    made = cut(sketched(own.select("*", th), "__text"))
    nodes = cut(
        made.groupBy("node", "fp", "size", "sk", "bands").agg(F.min("__key").alias("least"), F.min("th").alias("th"))
    )
    near = links(nodes.filter("size > 0").select("node", "fp"), RADIUS, cell)
    groups = cut(components(near.union(candidates(nodes, cell))))
    edges = similar(groups, nodes, own.select(F.col("__text").alias("text"), th), cell, set_cell)
    named = _named(made.drop("th", "fp", "size", "sk", "bands"), nodes.select("node", "least"), edges)
    return named.select(*back, "root", "component_id")


def as_hex(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return out.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: of the least doc_id (null ones last), then of the least text hash."""
    own = F.xxhash64("text").alias("own")
    found = similar_documents(docs.select("doc_id", "text", own), "doc_id")
    first = F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "own")).alias("w")
    kept = found.groupBy("root").agg(first).select("w.doc_id", "w.own").distinct()
    left, right = docs.select("*", F.xxhash64("text").alias("__own")).alias("l"), kept.alias("r")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.__own") == F.col("r.own"))
    held = left.join(right, same, "left_semi")
    return held.dropDuplicates(["doc_id", "__own"]).select(*docs.columns)
