"""Tables in the folder that all executors share: written once, reread by any executor, deleted when no longer needed."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session without one gets a folder of its own, until it ends."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="arborquery-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(remove, spark, found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if the session is still there to do it."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session is gone: the folder's owner clears it
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, lineage cut, any executor can reread it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing will read again."""
    for table in tables:
        remove(table.sparkSession, table.written_to)


def stamp(spark: SparkSession, path: str) -> tuple:
    """What changes when a table's files do: their names, sizes and times."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    own = fs.getFileStatus(p)
    found = fs.listStatus(p) if own.isDirectory() else [own]
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found))
