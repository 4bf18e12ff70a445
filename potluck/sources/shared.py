"""The folder that all executors share, for tables and files a query writes on its way."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local session may do without: a cluster's executors don't share a folder of one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="potluck-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            delete(spark, path)
    except Exception:  # noqa: BLE001  the session is already gone
        pass


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, removed when the interpreter ends."""
    path = f"{shared_dir(spark)}/potluck-{kind}-{uuid.uuid4().hex}"
    atexit.register(_delete_at_exit, spark, path)
    return path
