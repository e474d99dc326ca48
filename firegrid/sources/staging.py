"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder within ``spark.checkpoint.dir``; that folder can go as a whole when the application has ended. Where none is named, local mode takes a temporary folder and a cluster raises ValueError."""
    base, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if base:
        base = f"{base.rstrip('/')}/firegrid-{app}"
    elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="firegrid-")
        base = _OWN[app]
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back, where a plan uses it more than once: it is computed once, and a lost executor costs no recomputation of what came before."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_out(df: DataFrame) -> DataFrame:
    """The rows over all tasks, where each row is much work and the file that holds them is small."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a path by its file system, if it is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
