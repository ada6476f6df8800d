"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, as a URI.

    A path without a scheme lies in Hadoop's default file system, as for Spark itself. In local mode, where driver and
    executors are one machine, a temporary folder serves if none is named. On a cluster each machine would write to a
    folder of its own and later reads would miss files, so there it is an error. A path without a scheme where the default
    file system is that of each machine may be a folder that all of them mount: a small table is written and read there
    once, and only a folder that loses rows of it is refused. With the scheme file: it is taken as it is.
    """
    base, local = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master.split("[")[0] == "local"
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif local:
            base = "file://" + tempfile.mkdtemp(prefix="tidewright-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not urlsplit(base).scheme:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        if base.startswith("file:") and not local:
            _assert_shared(spark, base)
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base.removeprefix("file:")
    return base.rstrip("/")


#: (application, folder) of the folders that were found to be shared.
_SHARED: set[tuple[str, str]] = set()


def _assert_shared(spark: SparkSession, base: str) -> None:
    """An error if what the executors write to the folder is not all there for the driver and for one another."""
    refused = f"{base} may be a folder of each machine: name the shared folder in spark.checkpoint.dir with its scheme"
    try:
        known = (spark.sparkContext.applicationId, base)
        if known in _SHARED:
            return
        tasks, probe = 2 * spark.sparkContext.defaultParallelism, f"{base.rstrip('/')}/probe-{uuid.uuid4().hex}"
        spark.range(0, tasks, 1, tasks).write.parquet(probe)
        found = spark.read.schema("id long").parquet(probe).count()
        at = spark._jvm.org.apache.hadoop.fs.Path(probe)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception as error:  # a folder that cannot be written and read is refused like one that loses rows
        raise ValueError(refused) from error
    if found != tasks:
        raise ValueError(refused)
    _SHARED.add(known)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder as Parquet and read back: the lineage is cut, and lost executors lose nothing.

    checkpoint() would carry the plan's size estimates on, which multiply in loops until planning no longer ends; a
    table read back has the size of its files.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what written() wrote for these tables. Nothing that is still to be computed may read them."""
    for table in tables:
        path = getattr(table, "_written_to", None)
        if path:
            jvm = table.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
