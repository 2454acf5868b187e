"""Folders and tables that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Tables written by saved() in this session and not deleted yet.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in a local session without one, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="loam-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    A lost executor costs only the reading tasks: nothing upstream of the table runs again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_saved_at"] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables that saved() gave and that nothing will read again; other DataFrames are left alone."""
    for table in tables:
        path = table.__dict__.get("_saved_at") if table is not None else None
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(table.sparkSession, path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """saved(make()), after which the tables that make() saved on its way are deleted."""
    before = set(_WRITTEN)
    out = saved(make(), name)
    for path in [p for p in _WRITTEN if p not in before and p != out.__dict__["_saved_at"]]:
        _WRITTEN.remove(path)
        _delete(out.sparkSession, path)
    return out


def clear(spark: SparkSession) -> None:
    """Deletes every table that this session saved; results that still read them must have been consumed."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
