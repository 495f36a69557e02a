"""Tables written between the rounds of an iterative job.

An iterative job must cut its lineage, and must survive the loss of an
executor, so every round is written to the shared folder the cluster names in
``spark.checkpoint.dir`` and read back from there. Reading a written table also
gives the planner true sizes, so it can choose joins well.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one in local mode only."""
    global _local_dir
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="postloom-")
    return _local_dir


class Scratch:
    """A fresh folder for the intermediate tables of one job."""

    def __init__(self, spark: SparkSession, job: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{job}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table. What was shuffled for it is deleted at once, not when the driver's garbage is."""
        path, conf = f"{self.root}/{name}", self.spark.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)
        return self.spark.read.schema(df.schema).parquet(path)

    def load(self, pattern: str, like: DataFrame) -> DataFrame:
        """Read every table whose name matches ``pattern``, as one."""
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{pattern}")

    def drop(self, name: str) -> None:
        """Delete a table no later round reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
