"""Tables between jobs: written to the folder that the driver and all executors share, and removed when nothing reads them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset, a local master (one machine) gets a
    temporary folder; on a cluster that would lose data, so it is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="inkframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a DataFrame as Parquet in the shared folder and read it back: lineage is cut, and a lost executor costs nothing already written.

    Shuffle files of the write go when it ends, since nothing reads them again. `release` removes the table itself.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/inkframe-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._inkframe_path = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Remove what `staged` wrote for these frames. Only for tables that no frame still to be run reads."""
    for df in frames:
        path = getattr(df, "_inkframe_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
