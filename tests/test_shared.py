"""Where tables are written that all executors read."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from tidewright.shared import shared_folder

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(spark, folder, master="local[4]"):
    """What shared_folder asks of a session, with another setting and master."""
    context = SimpleNamespace(master=master, _jsc=spark.sparkContext._jsc)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: folder or default), sparkContext=context, _jvm=spark._jvm)


def test_folders(spark):
    assert shared_folder(session(spark, "/some/folder/")) == "file:///some/folder"
    assert shared_folder(session(spark, "file:/some/folder")) == "file:///some/folder"
    assert shared_folder(session(spark, "hdfs://name/folder", "yarn")) == "hdfs://name/folder"
    assert shared_folder(session(spark, "file:///mounted/by/all", "spark://host:7077")) == "file:///mounted/by/all"


def test_a_folder_of_each_machine_is_refused(spark):
    with pytest.raises(ValueError, match="with its scheme"):
        shared_folder(session(spark, "/some/folder", "spark://host:7077"))


CLUSTER = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import tidewright.shared as shared
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "512m").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", {folder!r}).getOrCreate()
print("rows", shared.written(spark.range(10, numPartitions=2)).count(), shared.shared_folder(spark))
spark.stop()
"""


def test_a_mounted_folder_without_a_scheme_serves_on_a_cluster(tmp_path):
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "PYSPARK_DRIVER"))}
    code = CLUSTER.format(root=ROOT, folder=f"{tmp_path}/shared")
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=240)
    assert f"rows 10 file://{tmp_path}/shared" in done.stdout, done.stderr[-2000:]
    assert not [f for f in os.listdir(tmp_path / "shared") if f.startswith("probe")]


def test_a_folder_that_loses_rows_is_refused(spark, tmp_path):
    """Executors that write elsewhere: of a table written there nothing is found."""
    empty = spark.range(0)
    lossy = SimpleNamespace(schema=lambda _: SimpleNamespace(parquet=lambda _: empty))
    context = SimpleNamespace(master="spark://host:7077", _jsc=spark.sparkContext._jsc, applicationId="lossy", defaultParallelism=2)
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: str(tmp_path)), sparkContext=context, _jvm=spark._jvm, range=spark.range, read=lossy)
    with pytest.raises(ValueError, match="with its scheme"):
        shared_folder(fake)
