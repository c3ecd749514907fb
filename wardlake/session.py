"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

import pyspark
from pyspark.sql import SparkSession

# Runtime settings the library's results depend on. Broadcast joins are left to
# Spark: a side is broadcast only when its measured size is under
# spark.sql.autoBroadcastJoinThreshold, and hot keys of the other joins are
# split by the adaptive skew-join rule.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Rows dealt by partition are written without sorting them once more.
    "spark.sql.maxConcurrentOutputFileWriters": "32",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session of this machine; where no shared folder is set, one in its temporary folder."""
    builder = SparkSession.builder
    if not _preset("spark.checkpoint.dir"):
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="wardlake-"))
    spark = (
        builder.master(f"local[{cores}]")
        .appName("wardlake")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def _preset(key: str) -> str | None:
    """What a running session or the files of this installation set."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active.conf.get(key, None)
    folder = os.environ.get("SPARK_CONF_DIR") or os.path.join(os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__), "conf")
    try:
        with open(os.path.join(folder, "spark-defaults.conf")) as lines:
            pairs = [line.replace("=", " ", 1).split(None, 1) for line in lines if not line.lstrip().startswith("#")]
    except OSError:
        return None
    return next((p[1].strip() for p in pairs if len(p) == 2 and p[0] == key), None)


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="wardlake-")


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables, in the shared folder named by ``spark.checkpoint.dir``.

    Only a local master may do without one and use a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir, when the session is built, to a folder all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/wardlake"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def written(df, name: str):
    """``df`` as a table below the shared folder.

    Cuts the lineage, and since the table's size is known when a join with it is
    planned, Spark broadcasts it if it is small and shuffles if it is not.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
