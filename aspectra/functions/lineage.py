"""Cutting lineage where a loop needs it."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a session on one machine (tests) gets a temporary one; on a cluster such a folder would be no
    shared one, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='aspectra-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Of a folder on a local file system: no checksum file beside each file, which are as many files again, and a process started for each. Other stores don't read these.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**_PLAIN).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are not held any more: it does so when the driver's heap is collected, which may be long after."""
    gc.collect()
    spark._jvm.System.gc()


def dropped(*tables: DataFrame | None) -> None:
    """Deletes the files of saved tables that no plan reads any more."""
    for t in tables:
        if t is None:
            continue
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
