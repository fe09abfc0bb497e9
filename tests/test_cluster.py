"""Queries on executors that share nothing with the driver but the checkpoint folder."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest

REPO = Path(__file__).parent.parent
RUN = """
import json, sys
from pyspark.sql import SparkSession
import __spark_entry__
name, folder = sys.argv[1:]
spark = (
    SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.checkpoint.dir", f"file://{folder}/shared")
    .config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false").getOrCreate()
)
rows = __spark_entry__.queries()[name](spark, f"{folder}/data").collect()
print("ROWS" + json.dumps(sorted(map(tuple, rows), key=str)))
"""


@pytest.mark.parametrize("name", ["src_jdbc", "src_jdbc_parallel", "src_jdbc_ranges"])
def test_databases_are_seen_by_every_executor(spark, tmp_path, name):
    names = ["a 'quoted' name", "", None, *(f"n{k}" for k in range(3, 25))]
    (tmp_path / "data").mkdir()
    rows = spark.createDataFrame(list(enumerate(names)), "n_nationkey int, n_name string")
    rows.write.parquet(f"{tmp_path}/data/nation.parquet")
    (tmp_path / "home").mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():  # executors write to `work` in Spark's home
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    kept = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))}
    env = kept | {"SPARK_HOME": f"{tmp_path}/home", "PYTHONPATH": str(REPO), "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", RUN, name, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    found = [x for x in run.stdout.splitlines() if x.startswith("ROWS")]
    assert found, run.stderr[-3000:]
    assert sorted(map(tuple, json.loads(found[0][4:])), key=str) == sorted(enumerate(names), key=str)


REMOTE = RUN.replace(
    'f"file://{folder}/shared")',
    '"viewfs://store/shared").config("spark.hadoop.fs.viewfs.mounttable.store.link./shared", f"file://{folder}/shared")',
)


@pytest.mark.parametrize("name", ["src_jdbc", "src_jdbc_parallel", "src_jdbc_ranges"])
def test_databases_need_no_shared_folder_that_is_mounted(spark, tmp_path, name):
    rows = [(None, "no key"), (-5, "a 'quoted' name"), (0, ""), (24, None), (25, "next"), (1499, "last")]
    for folder in ("data", "shared", "home"):
        (tmp_path / folder).mkdir()
    spark.createDataFrame(rows, "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/data/nation.parquet")
    for p in Path(pyspark.__file__).parent.iterdir():  # executors write to `work` in Spark's home
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    kept = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))}
    env = kept | {"SPARK_HOME": f"{tmp_path}/home", "PYTHONPATH": str(REPO), "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", REMOTE, name, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    found = [x for x in run.stdout.splitlines() if x.startswith("ROWS")]
    assert found, run.stderr[-3000:]
    assert sorted(map(tuple, json.loads(found[0][4:])), key=str) == sorted(rows, key=str)
