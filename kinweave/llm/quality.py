"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds t_1 < t_2 < ... cut the
score s = w.x into grades, P(grade <= k) = 1 / (1 + exp(s - t_k)). A text gets its expected grade and the
probability of a grade at or above the one that selection asks for.

Features are the tokens of a text, and apart from them the shapes of its tokens (runs of small letters, capitals,
digits and each other sign), how often tokens occur and whether one repeats the one before it, all hashed; a
feature's value is the square root of its share among the text's tokens.

Very long texts are read whole. Null and wordless texts have no features: their score is 0 and the thresholds alone decide. Grades may be any
distinct numbers; a single grade is predicted with certainty, and without ratings the expected grade is null
and everything is kept. A tail probability equal to the selection's limit is kept. Repeated rows are rated each for
itself; an empty table gives no rows; other columns are kept, but for ones named like a result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import add_columns, cut, table

#: Rated rows that the regression is fitted on at most: the first by a hash of their key.
RATED = 8000
#: Hashed features of tokens, then of shapes.
BITS = 16
#: Selection keeps a text if a grade of at least the rating's upper half is at least this likely.
KEEP = 0.5

_SHAPE = bytes(
    97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if c <= 32 else c
    for c in range(256)
)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text's features."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    all_tokens = raw.split()
    tokens = Counter(all_tokens)
    if not tokens:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    mask = (1 << BITS) - 1
    places = [crc32(t) & mask for t in tokens]
    values = np.fromiter(tokens.values(), np.float64, len(tokens))
    look = np.frombuffer(raw.translate(_SHAPE), np.uint8)
    shapes = Counter(look[np.append(True, look[1:] != look[:-1])].tobytes().split())
    for n in tokens.values():  # no shape starts with a control character
        shapes[b"\x01%d" % min(n.bit_length(), 20)] += n
    shapes[b"\x02"] = sum(map(eq, all_tokens, all_tokens[1:]))
    places += [(crc32(s) & mask) + mask + 1 for s in shapes]
    more = np.fromiter(shapes.values(), np.float64, len(shapes))
    both = np.concatenate((np.sqrt(values / values.sum()), np.sqrt(more / values.sum())))
    return np.array(places, np.int32), both.astype(np.float32)


@dataclass
class Ordinal:
    """Grades in order, thresholds between them, and the shared weights."""

    grades: list[float]
    thresholds: np.ndarray
    weights: np.ndarray

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade >= g) for every grade."""
        places, values = features(text)
        s = float(self.weights[places] @ values.astype(np.float64))
        above = 1 / (1 + np.exp(np.clip(self.thresholds - s, -50, 50)))
        return np.append(1.0, above)

    def expected(self, tails: np.ndarray) -> float:
        g = np.array(self.grades)
        return float(g[0] + np.diff(g) @ tails[1:])


def fit(
    rows: list[tuple[np.ndarray, np.ndarray]], grades: list[float], steps: int = 250, rate: float = 0.1,
    decay: float = 1e-4,
) -> Ordinal:
    """Maximum likelihood with a quadratic penalty, by Adam over all rows."""
    levels = sorted(set(grades))
    if len(levels) < 2:
        return Ordinal(levels, np.zeros(0), np.zeros(2 << BITS))
    y = np.searchsorted(levels, grades)
    n, k = len(rows), len(levels) - 1
    sizes = np.array([len(p) for p, _ in rows])
    row = np.repeat(np.arange(n), sizes)
    used, at = np.unique(np.concatenate([p for p, _ in rows]), return_inverse=True)
    x = np.concatenate([v for _, v in rows]).astype(np.float64)
    below = np.cumsum(np.bincount(y, minlength=k + 1))[:-1] / n
    first = np.log(below / (1 - below))
    # The first threshold, then the logarithms of the steps to the next ones, so that they stay ordered.
    theta = np.append(first[0], np.log(np.maximum(np.diff(first), 1e-3)))
    w = np.zeros(len(used))
    m, v = np.zeros(len(used) + k), np.zeros(len(used) + k)
    for step in range(1, steps + 1):
        t = np.cumsum(np.append(theta[0], np.exp(theta[1:])))
        s = np.bincount(row, w[at] * x, minlength=n)
        edge = np.concatenate(([-np.inf], t, [np.inf]))
        hi = 1 / (1 + np.exp(np.clip(s - edge[y + 1], -50, 50)))
        lo = 1 / (1 + np.exp(np.clip(s - edge[y], -50, 50)))
        hi, lo = np.where(y == k, 1.0, hi), np.where(y == 0, 0.0, lo)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        ds = (dhi - dlo) / n
        dt = np.bincount(y, -dhi, minlength=k + 1)[:k] + np.bincount(np.maximum(y - 1, 0), dlo, minlength=k + 1)[:k]
        dt /= n
        dtheta = np.cumsum(dt[::-1])[::-1]
        dtheta = np.append(dtheta[0], dtheta[1:] * np.exp(theta[1:]))
        grad = np.concatenate((np.bincount(at, ds[row] * x, minlength=len(used)) + decay * w, dtheta))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, theta = w - move[: len(used)], theta - move[len(used) :]
    weights = np.zeros(2 << BITS)
    weights[used] = w
    return Ordinal(levels, np.cumsum(np.append(theta[0], np.exp(theta[1:]))), weights)


def train(docs: DataFrame, ratings: DataFrame, key: str, grade: str, text: str = "text", most: int = RATED) -> Ordinal:
    """Fit on at most `most` rated keys, those of the least hashes; a key of several ratings takes the lowest."""
    picked = (
        ratings.filter(F.col(key).isNotNull() & F.col(grade).isNotNull())
        .groupBy(key)
        .agg(F.min(F.col(grade).cast("double")).alias("__grade"))
        .orderBy(F.xxhash64(key), key)
        .limit(most)
    )
    rated = docs.select(key, F.col(text).alias("__text")).join(F.broadcast(cut(picked)), key)

    def run(texts: list) -> tuple[list, list]:
        made = [features(t) for t in texts]
        return [p.tobytes() for p, _ in made], [v.tobytes() for _, v in made]

    # Of several texts of a key the one of the least hash is rated, so that the model doesn't depend on the plan.
    one = rated.groupBy(key, "__grade").agg(F.min_by("__text", F.struct(F.xxhash64("__text"), "__text")).alias("__text"))
    made = add_columns(one, ["__text"], "places binary, vals binary", run).drop("__text")
    rows = sorted((r[key], r["__grade"], bytes(r["places"]), bytes(r["vals"])) for r in made.collect())
    return fit(
        [(np.frombuffer(p, np.int32), np.frombuffer(v, np.float32)) for _, _, p, v in rows], [r[1] for r in rows]
    )


def rate(df: DataFrame, model: Ordinal, text: str = "text", least: float | None = None, keep: float = KEEP) -> DataFrame:
    """df with expected_grade double, tail_probability double and keep boolean; other columns are kept.

    `least` is the grade that the tail starts at; by default the first of the upper half of the grades.
    """
    place = (
        len(model.grades) // 2 if least is None else int(np.searchsorted(model.grades, least))
    )
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> tuple[list, list, list]:
        m = held.value
        if not m.grades:
            return [None] * len(texts), [None] * len(texts), [True] * len(texts)
        tails = [m.tails(t) for t in texts]
        likely = [float(t[place]) if place < len(t) else 0.0 for t in tails]
        return [m.expected(t) for t in tails], likely, [x >= keep for x in likely]

    return add_columns(df, [text], "expected_grade double, tail_probability double, keep boolean", run)


def quality_of(docs: DataFrame, labels: DataFrame, most: int = RATED) -> DataFrame:
    """docs with the ratings that a regression on labels.quality gives them."""
    return rate(docs, train(docs, labels, "doc_id", "quality", most=most))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, probability of a good grade and selection of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_of(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "expected_grade", "tail_probability", "keep")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that selection keeps."""
    rated = quality_of(
        docs.withColumnsRenamed({c: f"__{c}" for c in docs.columns if c not in ("doc_id", "text")}),
        table(spark, sf_dir, "labels"),
    )
    return rated.filter("keep").select(
        *(F.col(c if c in ("doc_id", "text") else f"__{c}").alias(c) for c in docs.columns),
    )
