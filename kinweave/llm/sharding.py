"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each shard scores a record by the record's key and the shard's number alone, and the record goes to the shard
of the best score; a shard more can thus only win records for itself. Everything is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import gapless, table

#: Shards of the registered query.
SHARDS = 16
#: Rows that a cell of the slot numbering aims at.
CELL_ROWS = 20_000


def _score(key: Sequence[str], shard: int, weight: float) -> Column:
    """Exponential race: -ln(u) / weight, u uniform in (0, 1) from a 64-bit hash of key and shard."""
    h = F.xxhash64(F.lit(f"shard {shard}"), *(F.col(c) for c in key))
    u = (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(float(weight))


def rendezvous(key: Sequence[str], weights: Sequence[float]) -> Column:
    """The shard (from 0) of the least score; ties go to the smaller number.

    A shard wins a share of the keys in proportion to its weight. A weight of 0 takes none; negative weights,
    or no positive one, raise ValueError. A null key is hashed like a value, so all such rows share a shard.
    """
    if any(w < 0 or w != w for w in weights) or not any(w > 0 for w in weights):
        raise ValueError("weights must not be negative, and one must be positive")
    scored = [
        F.struct(_score(key, k, w).alias("s"), F.lit(k).alias("k")) for k, w in enumerate(weights) if w > 0
    ]
    best = F.least(*scored) if len(scored) > 1 else scored[0]
    return best["k"].cast("int")


def shard_records(
    df: DataFrame,
    key: Sequence[str],
    weights: Sequence[float],
    grown: Sequence[float] | None = None,
    payload: Sequence[str] = (),
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Assign each row a shard and a place in it.

    Returns key, payload, shard int, slot long (gapless from 0 in each shard) and, if `grown` weights are
    given, grown_shard int. Columns of df beside key and payload are not carried. Rows with equal keys land in
    one shard, equal rows get different slots; an empty table gives no rows. The slot numbering deals each
    shard over cells of about `cell_rows` rows (see `common.gapless`), so no task holds a whole shard.
    """
    columns = list(dict.fromkeys([*key, *payload]))
    out = df.select(
        *columns,
        rendezvous(key, weights).alias("shard"),
        (rendezvous(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    cells = max(1, -(-df.count() // (cell_rows * sum(w > 0 for w in weights))))
    return gapless(out, ["shard"], [*columns, "grown_shard"], "slot", cells)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 15 by doc_id under the law `key`; null texts count one byte."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.encode(F.lit(""), "UTF-8"))).alias("text_crc32"),
    )
    out = shard_records(docs, ["doc_id"], [1.0] * SHARDS, [1.0] * (SHARDS + 1), ["size", "text_crc32"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
