"""Shared-folder locations for checkpoints and written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    The session's own ``spark.checkpoint.dir`` always wins. A folder of our own
    is made only for a local master (tests); a cluster without the setting is an
    error, because a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="keepsake-"))
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named or context.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages reread it, even after executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, label: str = "rows") -> DataFrame:
    """Written once and reread: cuts the lineage like `cut_lineage` but runs the plan once only
    (a checkpoint runs it again). Partitions are not the same afterwards."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, as Spark itself reaches it, and the path."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def discard(spark: SparkSession, path: str) -> None:
    """Remove an intermediate whose consumers are all written."""
    system, where = _hadoop(spark, path)
    system.delete(where, True)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file if no other writer has: false if it is there already."""
    system, where = _hadoop(spark, path)
    system.mkdirs(where.getParent())
    if system.exists(where):
        return False
    try:
        out = system.create(where, False)
    except Exception:  # another writer came first, or the create failed: only the former is an answer
        if system.exists(where):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def small_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """Name and text of every small file in a folder; empty if there is none."""
    system, where = _hadoop(spark, folder)
    if not system.exists(where):
        return {}
    found = {}
    for status in system.listStatus(where):
        file = status.getPath()
        if not status.isFile() or not status.getLen():  # an empty file is still being written
            continue
        stream = system.open(file)
        try:
            found[file.getName()] = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
    return found
