"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of the rows that raters saw, whatever they said of them, is
the unlabelled side. With class prior pi and logistic loss l, the estimate of the risk of a score f is
pi E_P[l(f)] + max(0, E_U[l(-f)] - pi E_P[l(-f)]); where the second part falls below 0, the step goes against it.
The prior is estimated from the two samples alone: the mixture has at least pi times the positives' share of any set
of texts, so pi is at most the least ratio of the two shares over the sets that a score separates (`mixture_share`).

Features are the presence of words and of their beginnings, hashed to 32 bits. All that positives have far more
often than unlabelled texts are used, by a score that a few copies of one text can't reach, as texts count once.

Null and wordless texts have no features and get the score of the bias. Very long texts are read whole; a feature
counts once, however often it occurs. A score equal to the threshold counts as toxic. Without positives every score
is 0. Repeated rows are scored each for itself; an empty table gives no rows; other columns are kept, but for one
named like the score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import add_columns, cut, table
from kinweave.llm.decontamination import words

#: Rated rows that the classifier is fitted on at most, the first by a hash of their key: confirmed positives, and
#: rows taken without their rating. Not a limit on what is scored.
POSITIVES, UNLABELLED = 3000, 9000
#: The least share of the positives that must have a feature; two of them at least.
LEAST_POSITIVES = 1 / 400
#: Standard errors by which the positives' share of a feature must exceed the unlabelled one; the second where no
#: feature reaches the first.
LEAST_Z = (6, 3.5)
#: Lengths (bytes) of the beginnings that words are cut to besides the whole word.
BEGINNINGS = (4, 5, 6)
#: Words whose features a task remembers at most; then it starts over.
REMEMBERED = 500_000
THRESHOLD = 0.7


def word_features(word: bytes) -> tuple[int, ...]:
    """32-bit hashes of a word and of its beginnings."""
    return (crc32(b"w" + word), *(crc32(b"%d" % n + word[:n]) for n in BEGINNINGS if len(word) > n))


@dataclass
class Classifier:
    """Weights by feature hash, and the bias. `fit` needs numpy alone."""

    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -np.inf
    memory: dict[bytes, tuple[int, ...]] = field(default_factory=dict)

    def found(self, text: str | None) -> set[int]:
        """The classifier's features that a text has."""
        memory, out = self.memory, set()
        if len(memory) > REMEMBERED:
            memory.clear()
        for w in set(words(text)):
            f = memory.get(w)
            if f is None:
                f = memory[w] = tuple(x for x in word_features(w) if x in self.weights)
            if f:
                out.update(f)
        return out

    def score(self, text: str | None) -> float:
        if self.bias == -np.inf:
            return 0.0
        z = self.bias + sum(self.weights[x] for x in sorted(self.found(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


class Rows:
    """Texts as the places of their features, row after row."""

    def __init__(self, rows: list[np.ndarray], features: int):
        self.n, self.features = len(rows), features
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.place = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)

    def scores(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, w[self.place], minlength=self.n) + b

    def slope(self, by_score: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.place, by_score[self.row], minlength=self.features), by_score.sum())


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _descend(p: Rows, u: Rows, prior: float, non_negative: bool, steps: int, rate: float, decay: float, gamma: float):
    """(weights, bias) by Adam over all rows; without `non_negative`, of telling p from u by plain logistic loss."""
    x = np.zeros(p.features + 1)
    x[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros(len(x)), np.zeros(len(x))
    for step in range(1, steps + 1):
        zp, zu = p.scores(x[:-1], x[-1]), u.scores(x[:-1], x[-1])
        # Derivatives of the losses by the score: l(f)' = s - 1, l(-f)' = s.
        sp, su = _sigmoid(zp), _sigmoid(zu)
        dp, du = prior * (sp - 1) / max(1, p.n), su / max(1, u.n)
        if non_negative:
            gn = prior * sp / max(1, p.n)
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            dp, du = (dp - gn, du) if negative >= 0 else (gamma * gn, -gamma * du)
        grad = p.slope(dp) + u.slope(du)
        grad[:-1] += decay * x[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x[:-1], x[-1]


def mixture_share(positive: list[np.ndarray], unlabelled: list[np.ndarray], features: int, doubt: float = 1.0) -> float:
    """The share of positives in the unlabelled rows, from an order of either half that the other half teaches.

    Of the rows above each threshold, the ratio of the two shares bounds the prior from above; the threshold is
    taken whose ratio is least with both shares off by `doubt` standard errors. Where no ratio is below 1 so, the
    bound says nothing, and as many positives are supposed as there are confirmed ones.
    """
    zp, zu = [], []
    for k in (0, 1):
        own, other = ([Rows(r[side::2], features) for r in (positive, unlabelled)] for side in (k, 1 - k))
        w, b = _descend(*other, 0.5, False, 200, 0.05, 1e-3, 1.0)
        zp.append(own[0].scores(w, b))
        zu.append(own[1].scores(w, b))
    p, u = np.sort(np.concatenate(zp)), np.sort(np.concatenate(zu))
    cuts = np.unique(p)
    share_p = 1 - np.searchsorted(p, cuts) / len(p)
    share_u = 1 - np.searchsorted(u, cuts) / len(u)
    high = share_u + doubt * np.sqrt((share_u * (1 - share_u) + 1 / len(u)) / len(u))
    low = share_p - doubt * np.sqrt((share_p * (1 - share_p) + 1 / len(p)) / len(p))
    ratio = np.where(low > 0, high / np.maximum(low, 1e-9), np.inf)
    at = int(np.argmin(ratio))
    if ratio[at] >= 1:
        return min(0.5, len(p) / len(u))
    return float(np.clip(share_u[at] / share_p[at], 1 / (len(u) + 1), 0.99))


def fit(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], names: list[int], prior: float | None = None,
    steps: int = 400, rate: float = 0.05, decay: float = 2e-4, gamma: float = 1.0,
) -> Classifier:
    """Minimise the non-negative risk by Adam over all rows; rows are arrays of places in `names`.

    Without a prior, `mixture_share` estimates it.
    """
    if not positive or not unlabelled:
        return Classifier()
    if prior is None:
        prior = mixture_share(positive, unlabelled, len(names))
    p, u = Rows(positive, len(names)), Rows(unlabelled, len(names))
    w, b = _descend(p, u, prior, True, steps, rate, decay, gamma)
    keep = np.abs(w) > 1e-3
    return Classifier({names[i]: float(w[i]) for i in np.flatnonzero(keep)}, float(b))


def in_training(doc_id: Column) -> Column:
    """Whether labels of a row may be learned from: crc32 of its id as text leaves no rest of 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def _hashes(texts: DataFrame) -> DataFrame:
    """is_p and feats (32-bit hashes, little-endian) for every distinct text of the sample."""

    def run(texts: list) -> tuple[list]:
        return (
            [
                np.unique(np.array([f for w in set(words(t)) for f in word_features(w)], np.uint32)).tobytes()
                for t in texts
            ],
        )

    return add_columns(texts, ["text"], "feats binary", run).select("is_p", "feats")


def train(
    docs: DataFrame, rated: DataFrame, key: str, text: str = "text",
    most_positive: int = POSITIVES, most_unlabelled: int = UNLABELLED,
) -> Classifier:
    """A classifier from docs and `rated`: key, and is_p, whether the row is a confirmed positive.

    The positives are those of the least hashes of their keys; so is the unlabelled side among all rated rows,
    whatever their is_p.
    """
    order = F.xxhash64(key)
    p = rated.filter("is_p").select(key).distinct().orderBy(order, key).limit(most_positive)
    u = rated.select(key).distinct().orderBy(order, key).limit(most_unlabelled)
    # Both lists are of a stated length, so they may go to every task.
    p = cut(p.filter(F.col(key).isNotNull()).withColumn("is_p", F.lit(True)))
    u = cut(u.filter(F.col(key).isNotNull()).withColumn("is_p", F.lit(False)))
    picked = docs.select(key, F.col(text).alias("text")).join(F.broadcast(p.union(u)), key)
    sample = cut(_hashes(picked).groupBy("feats", "is_p").agg(F.lit(0).alias("x")).select("is_p", "feats"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for side, feats in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sides[bool(side)].update(np.frombuffer(feats, np.uint32).tolist())
        both = sorted(sides[0].keys() | sides[1].keys())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(both, pa.int64()),
                pa.array([sides[1][x] for x in both], pa.int64()),
                pa.array([sides[0][x] for x in both], pa.int64()),
            ],
            names=["f", "p", "u"],
        )

    n_p, n_u = (sample.filter(F.col("is_p") == side).count() for side in (True, False))
    if not n_p or not n_u:
        return Classifier()
    counts = sample.mapInArrow(count, "f long, p long, u long").groupBy("f").agg(
        F.sum("p").alias("p"),
        F.sum("u").alias("u"),
    )
    share_p, share_u = F.col("p") / n_p, (F.col("u") + 1) / (n_u + 1)
    z = (share_p - share_u) / F.sqrt(share_u * (1 - share_u * F.lit(n_u / (n_u + 1))) / n_p)
    best = (
        counts.filter(F.col("p") >= max(2, n_p * LEAST_POSITIVES))
        .withColumn("z", z)
        .filter((F.col("z") > LEAST_Z[1]) & (share_p > 2.5 * share_u))
        .orderBy(F.desc("z"), "f")
        .collect()
    )
    # With few positives no feature can reach the first score; then the second one does.
    best = [r for r in best if r["z"] > LEAST_Z[0]] or best
    names = [r["f"] for r in best]
    known = np.array(sorted(names), np.uint32)
    place = {f: i for i, f in enumerate(names)}

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.intersect1d(np.frombuffer(x, np.uint32), known).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["is_p", "feats"])

    rows = sample.mapInArrow(reduce, sample.schema).collect()
    sides = {True: [], False: []}
    for side, feats in sorted((r[0], bytes(r[1])) for r in rows):
        sides[side].append(np.array([place[f] for f in np.frombuffer(feats, np.uint32).tolist()], np.int64))
    return fit(sides[True], sides[False], names)


def score_toxicity(df: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """df with score double of every whole text; other columns are kept."""
    held = df.sparkSession.sparkContext.broadcast(classifier)
    return add_columns(df, [text], "score double", lambda texts: ([held.value.score(t) for t in texts],))


def toxicity_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score for docs, learned from the labels of the training side."""
    usable = labels.filter(in_training(F.col("doc_id")) & F.col("toxic").isNotNull())
    rated = usable.groupBy("doc_id").agg((F.max("toxic") == 1).alias("is_p"))
    docs = docs.select("doc_id", "text")
    classifier = train(docs, rated, "doc_id")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return score_toxicity(docs, classifier).select("doc_id", held_out.alias("held_out"), "score")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and decision of every document."""
    out = toxicity_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
