"""Exact top-k inner products by multi-resolution segment statistics.

Every vector is cut into segments, coarse to fine, and each segment is kept as its mean and standard deviation.
With s components in a segment, (mq - mx)^2 + (dq - dx)^2, times s and added up, is a lower bound of the squared
distance, and so s (mq mx + dq dx), added up, is an upper bound of the inner product. A pair whose bound at some
level is below the k-th best score known so far of its query is dropped; only the pairs that are left are
multiplied out, those of the best bounds first, and those behind them are judged again by what that has found.

Defined results: a vector that is null, or holds a null or a number that isn't finite, takes no part, and neither
does a row without vec_id; vectors of different lengths don't meet; a query that comes several times counts once
(its least vector that takes part), a candidate that comes several times is several candidates; rows with the query's vec_id are
the query's own. Scores are exact in 64-bit integers; a score beyond them counts as the largest or least one.
An empty table gives no rows. Columns beside the id and the vector are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.llm.common import cut, table

#: Scale of the integers, results of a query, and queries: every EVERY-th id.
SCALE, BEST, EVERY = 256, 5, 50
#: Components of a segment at each level, coarse to fine.
LEVELS = (32, 8, 4, 2)
#: Bytes of query vectors and their statistics that go to every task in one pass over the candidates.
QUERY_BYTES = 48_000_000
#: Queries and candidates compared at once.
BLOCK_QUERIES, BLOCK_CANDIDATES = 512, 2048
#: Pairs of a query multiplied out at first, while it has no k results.
FIRST_PAIRS = 32
#: A coarse level that drops less than this share of the pairs is asked only in every PROBE-th block.
IDLE, PROBE = 0.01, 16


def vectors(ids: pa.Array, lists: pa.Array, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids and floor(scale * x), whole numbers as doubles, of the vectors that take part."""
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    usable = np.flatnonzero(np.array(ids.is_valid()) & np.array(lists.is_valid()))
    if not len(usable):
        return out
    offsets = lists.offsets.to_numpy()
    values = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)
    own = np.array([x or 0 for x in ids.to_pylist()], np.int64)
    size = np.diff(offsets)
    for n in np.unique(size[usable]).tolist():
        at = usable[size[usable] == n]
        x = values[offsets[at][:, None] + np.arange(n)]
        at, x = at[np.isfinite(x).all(axis=1)], x[np.isfinite(x).all(axis=1)]
        if len(at):
            with np.errstate(over="ignore"):
                out[n] = own[at], np.nan_to_num(np.floor(scale * x))
    return out


def statistics(x: np.ndarray) -> list[np.ndarray]:
    """For each level, rows whose inner products are the bounds."""
    out, n = [], x.shape[1]
    for width in LEVELS:
        columns = []
        with np.errstate(over="ignore", invalid="ignore"):
            for a in range(0, n, width):
                seg = x[:, a : a + width]
                root = np.sqrt(seg.shape[1])
                columns += [root * seg.mean(axis=1), root * seg.std(axis=1)]
            made = np.stack(columns, axis=1) if columns else np.zeros((len(x), 1))
            out.append(made.astype(np.float32))
    return out


def _exact(most: float) -> type:
    """The type that holds sums of products up to `most` exactly."""
    return np.float64 if most < 2**53 else np.int64 if most < 2**62 else object


def products(q: np.ndarray, x: np.ndarray, largest: float) -> np.ndarray:
    """The inner product of q with each row of x, as int64, cut off at its ends; no component of x exceeds `largest`."""
    with np.errstate(over="ignore"):
        kind = _exact(float(np.abs(q).max(initial=0)) * largest * max(1, len(q)))
    if kind is object:
        ends = np.iinfo(np.int64)
        sums = [sum(int(a) * int(b) for a, b in zip(q.tolist(), row, strict=True)) for row in x.tolist()]
        return np.array([min(max(s, ends.min), ends.max) for s in sums], np.int64)
    return (x.astype(kind, copy=False) @ q.astype(kind, copy=False)).astype(np.int64)


class Search:
    """Queries of one length and the k best candidates seen of each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, best: int):
        self.ids, self.x, self.best = ids, x, best
        self.levels = statistics(x)
        self.norm = np.sqrt(np.square(x).sum(axis=1))
        self.scores = np.full((len(ids), best), np.iinfo(np.int64).min)
        self.found = np.full((len(ids), best), np.iinfo(np.int64).max)
        #: What a candidate must reach; raised by what has been found.
        self.floor = np.full(len(ids), np.iinfo(np.int64).min)
        #: Pairs met and pairs multiplied out; pairs that each level judged and dropped; blocks met.
        self.pairs = self.multiplied = self.blocks = 0
        self.judged, self.dropped = np.zeros(len(LEVELS), np.int64), np.zeros(len(LEVELS), np.int64)

    def fresh(self) -> Search:
        """A search of the same queries that has found nothing yet."""
        new = object.__new__(Search)
        new.__dict__ = self.__dict__ | {k: getattr(self, k).copy() for k in ("scores", "found", "floor", "judged", "dropped")}
        return new

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Take candidates into account."""
        with np.errstate(over="ignore", invalid="ignore"):
            levels = statistics(x)
            norm = np.sqrt(np.square(x).sum(axis=1)).max(initial=0)
            for a in range(0, len(self.ids), BLOCK_QUERIES):
                q = slice(a, a + BLOCK_QUERIES)
                # Bounds are single floats; a margin over the error of their sums keeps every pair that could tie.
                margin = 1 + (x.shape[1] + 8) * 2.0**-23 * self.norm[q] * norm
                need = (self.floor[q].astype(np.float64) - margin).astype(np.float32)
                alive = self.ids[q][:, None] != ids
                left = self.pairs_of(alive)
                self.pairs += left
                # A bound that is no number drops nothing.
                for k, (mine, theirs) in enumerate(zip(self.levels, levels, strict=True)):
                    if k + 1 < len(levels) and self.blocks % PROBE and self.dropped[k] < IDLE * self.judged[k]:
                        continue
                    bound = mine[q] @ theirs.T
                    alive &= ~(bound < need[:, None])
                    before, left = left, self.pairs_of(alive)
                    self.judged[k] += before
                    self.dropped[k] += before - left
                self.blocks += 1
                self._multiply(a, alive, bound, margin, ids, x)

    @staticmethod
    def pairs_of(alive: np.ndarray) -> int:
        return int(np.count_nonzero(alive))

    def _multiply(self, first: int, alive: np.ndarray, bound: np.ndarray, margin: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Multiply out the pairs that are left, query by query.

        While a query has no k results, its candidates come in the order of their bounds, few and then more, and
        the rest goes as soon as the next bound is below what has been found.
        """
        rows, cols, scores = [], [], []
        largest = float(np.abs(x).max(initial=0))
        for r in np.flatnonzero(alive.any(axis=1)).tolist():
            at = np.flatnonzero(alive[r])
            q = self.x[first + r]
            if self.found[first + r, -1] == np.iinfo(np.int64).max and len(at) > FIRST_PAIRS:
                at = at[np.argsort(-np.nan_to_num(bound[r, at], nan=np.inf), kind="stable")]
                done, size, held = 0, FIRST_PAIRS, []
                while done < len(at):
                    part = at[done : done + size]
                    held.append(products(q, x[part], largest))
                    done, size = done + size, 2 * size
                    known = np.concatenate(held)
                    if done < len(at) and bound[r, at[done]] < np.partition(known, -self.best)[-self.best] - margin[r]:
                        at = at[:done]
                s = np.concatenate(held)
            else:
                s = products(q, x[at], largest)
            self.multiplied += len(at)
            fine = s >= self.floor[first + r]
            rows.append(np.full(int(fine.sum()), first + r))
            cols.append(at[fine])
            scores.append(s[fine])
        if rows:
            self._keep(np.concatenate(rows), np.concatenate(scores), ids[np.concatenate(cols)])

    def _keep(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(rows):
            return
        touched = np.unique(rows)
        rows = np.concatenate((rows, np.repeat(touched, self.best)))
        scores = np.concatenate((scores, self.scores[touched].ravel()))
        ids = np.concatenate((ids, self.found[touched].ravel()))
        # ~s falls as s rises, without overflow; an empty place has the least score and the largest id.
        order = np.lexsort((ids, ~scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        first = np.searchsorted(rows, touched)
        take = first[:, None] + np.arange(self.best)
        self.scores[touched], self.found[touched] = scores[take], ids[take]
        full = self.found[touched, -1] != np.iinfo(np.int64).max
        self.floor[touched[full]] = np.maximum(self.floor[touched[full]], self.scores[touched[full], -1])

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query ids, candidate ids and scores that were found."""
        r, c = np.nonzero(self.found != np.iinfo(np.int64).max)
        return self.ids[r], self.found[r, c], self.scores[r, c]


def top_k(
    df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", best: int = BEST,
    scale: int = SCALE, query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """query_id long, rank int, vec_id long, score long: the best candidates of df for every query.

    The queries go to all tasks in lots of at most about `query_bytes`, each lot with its own pass over df; a
    task sends on no more than the best of each query among its own candidates, whatever their number. With
    several lots, each one's results are written to the shared folder and its queries leave the executors
    before the next one starts. Queries need not be rows of df.
    """
    spark = df.sparkSession
    sized = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sized = sized.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite).groupBy("id").agg(F.min("v").alias("v"))
    # A component and its statistics at all levels, and what is kept of a query beside them.
    total = sized.agg(F.sum(F.size("v") * 32 + 16 * best + 64)).first()[0] or 0
    lots = max(1, -(-total // query_bytes))
    sized = cut(sized.withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(lots)))) if lots > 1 else sized
    candidates = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    parts = []
    for lot in range(lots):
        rows = (sized.filter(F.col("lot") == lot) if lots > 1 else sized).collect()
        kind = pa.list_(pa.float64())
        held = vectors(pa.array([r["id"] for r in rows], pa.int64()), pa.array([r["v"] for r in rows], kind), scale)
        sent = spark.sparkContext.broadcast({n: Search(ids, x, best) for n, (ids, x) in held.items()})

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = {n: s.fresh() for n, s in sent.value.items()}
            for batch in batches:
                for n, (ids, x) in vectors(batch.column(0), batch.column(1), scale).items():
                    if n in own:
                        for a in range(0, len(ids), BLOCK_CANDIDATES):
                            own[n].meet(ids[a : a + BLOCK_CANDIDATES], x[a : a + BLOCK_CANDIDATES])
            for s in own.values():
                q, v, score = s.results()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q), pa.array(v), pa.array(score)],
                    names=["query_id", "vec_id", "score"],
                )

        parts.append(_ranked(candidates.mapInArrow(search, "query_id long, vec_id long, score long"), best))
        if lots > 1:
            parts[-1] = cut(parts[-1])
            sent.destroy()
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return found


def _ranked(found: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all other vectors for every vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter(F.col("vec_id") % EVERY == 0))
