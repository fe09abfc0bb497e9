"""Queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm.decontamination import op4_decontamination
from kinweave.llm.html import op10_html
from kinweave.llm.packing import op5_packing
from kinweave.llm.pii import op7_pii
from kinweave.llm.quality import op9_quality
from kinweave.llm.secrets import op8_secret_scan
from kinweave.llm.sharding import op3_sharding
from kinweave.llm.simhash import op6_simhash
from kinweave.llm.topk import op2_top_k
from kinweave.llm.toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_top_k,
        op3_sharding,
        op4_decontamination,
        op5_packing,
        op6_simhash,
        op7_pii,
        op8_secret_scan,
        op9_quality,
        op10_html,
    )
}

ORACLES: dict[str, str] = {
    "op2_top_k": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id,
            CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
          WHERE q.vec_id % 50 = 0
        ),
        r AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
            AS rank, vec_id, score
          FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
