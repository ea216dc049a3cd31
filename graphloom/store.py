"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where the session names none and all runs in this process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/graphloom/{spark.sparkContext.applicationId}"


#: Folders of tables that this process has written and not dropped, in order.
_WRITTEN: list[str] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are written inside are deleted at the end, but for those that the given function has written to be kept."""
    first, kept = len(_WRITTEN), set()

    def keep(df: DataFrame, name: str = "kept") -> DataFrame:
        out = materialize(df, name)
        kept.add(_WRITTEN[-1])
        return out

    yield keep
    for folder in _WRITTEN[first:]:
        if folder not in kept:
            _delete(spark, folder)
    _WRITTEN[first:] = [f for f in _WRITTEN[first:] if f in kept]


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application wrote; results that still read them are lost."""
    _delete(spark, own_dir(spark))
    _WRITTEN.clear()


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, so that a lost executor costs no recomputation
    and the next plan sees its size."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_folder"] = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table from `materialize` that nothing reads any more."""
    folder = df.__dict__.get("_folder")
    if folder in _WRITTEN:
        _delete(df.sparkSession, folder)
        _WRITTEN.remove(folder)
