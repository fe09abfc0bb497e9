"""A training-data pipeline over `documents`: rate, de-duplicate, decontaminate, sanitise, pack.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return
the columns of docs. What a stage does with nulls, empty texts, ties and repeated rows is stated where it is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm.common import cut, table
from kinweave.llm.decontamination import stage_decontaminate
from kinweave.llm.packing import stage_pack
from kinweave.llm.pii import stage_sanitise
from kinweave.llm.quality import stage_quality
from kinweave.llm.simhash import stage_near_dedup

STAGES = [
    ("quality classifier", stage_quality),
    ("SimHash near-dedup", stage_near_dedup),
    ("benchmark decontamination", stage_decontaminate),
    ("PII", stage_sanitise),
    ("best-fit packing", stage_pack),
]

#: Trained models, graph components and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, cut(docs) if k else docs, sf_dir)
    return docs
