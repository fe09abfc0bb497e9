"""Tables in the folder that all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The attribute of a frame that names its table.
_PLACE = "_kinweave_scratch"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, as the session names it.

    Where it names none, a temporary folder is set if driver and executors are one process; on a cluster it would
    be another one on each machine, so that is refused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="kinweave-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    Its lineage ends there, so a lost executor costs no earlier stage again. The files go when the JVM ends, or
    by `free`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kinweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, system = _hadoop(spark, path)
    system.deleteOnExit(place)
    read = spark.read.schema(df.schema).parquet(path)
    read.__dict__[_PLACE] = path
    return read


def free(*frames: DataFrame) -> None:
    """Delete the tables of frames that `cut` returned; nothing may read them any more."""
    for df in frames:
        path = df.__dict__.pop(_PLACE, None)
        if path is not None:
            place, system = _hadoop(df.sparkSession, path)
            system.delete(place, True)
            system.cancelDeleteOnExit(place)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())
