"""Where tables between stages live."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme. A plain path is on Spark's default file system, which readers outside Spark don't know."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(there).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's. Where neither is set, a local
    session gets one of its own; on a cluster no folder can be guessed, and that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            found = tempfile.mkdtemp(prefix="glossator-")
            spark.sparkContext.setCheckpointDir(found)
    return qualified(spark, found).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and cut off from its lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def open_fs(path: str):
    """(file system, path in it) of a URI, for use in tasks. Paths are qualified on the driver first (``qualified``): a
    plain one can only be a file of this machine."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


def publish(fs, part: str, path: str) -> None:
    """Gives a complete file its name. Some file systems move onto no file that is there: a task that is run again takes
    its old one away."""
    if fs.get_file_info(path).type.name != "NotFound":
        fs.delete_file(path)
    fs.move(part, path)
