"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_fallback: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`. Only a local master (tests) may leave it unset and gets a temporary folder."""
    found = spark.conf.get(_KEY, None) or _fallback.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that every executor can reach")
        found = _fallback[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
    return found.rstrip("/")


def write(df: DataFrame, tag: str) -> str:
    """Write `df` as Parquet below the shared folder; the caller owns the returned path."""
    path = f"{shared_dir(df.sparkSession)}/tidemark-{uuid.uuid4().hex}-{tag}"
    df.write.parquet(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` and read it back: lineage ends here and a lost executor costs no recomputation.

    The files live until `clear` is called or the folder's owner removes them, since the returned frame reads them lazily.
    """
    path = write(df, tag)
    _written.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete every table that `table` wrote in this session. Frames that still read one of them fail afterwards."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, with underscores appended until no column of `df` has that name (case ignored, as Spark resolves names)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
