"""Intermediate tables in the folder every executor can reach."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
# Folders written by this process and not yet given back, by application.
_WRITTEN: dict[str, list[str]] = {}
# Names under which bucketed tables are known to the catalog, by folder.
_TABLES: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a fresh temporary one only on local masters."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    # "local-cluster" has executors of its own and needs a shared folder too
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"set {_SETTING} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="carbonsplit-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the files.

    Readers start from the written table, so losing an executor costs a
    re-read and not the work that led up to it, and several consumers share
    one computation.  The schema is passed on, so no inference job runs.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed_table(df: DataFrame, name: str, key: str) -> DataFrame:
    """``shared_table`` in as many buckets of ``key`` as there are shuffle partitions.

    Sums by the key (and more), and joins on it with a table bucketed alike, then need
    no exchange.  Rows are moved to their bucket before writing, so each bucket is one
    file; rows without a key are one bucket.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, name)
    table = f"carbonsplit_{re.sub('[^a-z0-9]+', '_', path.rsplit('/', 1)[1].lower())}"
    rows = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
    rows.option("path", path).saveAsTable(table)
    _TABLES[path] = table
    return spark.table(table)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table, remembered for ``release_tables``."""
    path = f"{shared_folder(spark)}/carbonsplit/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written_tables(spark: SparkSession) -> list[str]:
    """Folders of the intermediate tables that this session holds."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, ()))


def release_tables(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove intermediate tables; frames that start from them must not be used any more."""
    held = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for path in list(paths):
        if path in _TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(path)}")
        drop_folder(spark, path)
        if path in held:
            held.remove(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are removed on the way out, also after an error."""
    before = set(written_tables(spark))
    try:
        yield
    finally:
        release_tables(spark, [p for p in written_tables(spark) if p not in before])


def drop_folder(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(_hadoop(spark).Path(path), True)


def swap_folder(spark: SparkSession, new: str, place: str) -> None:
    """Put the folder ``new`` at ``place``; what was there goes only when the new one is in."""
    files, path = _files(spark, place), _hadoop(spark).Path
    old = f"{place}.old-{uuid.uuid4().hex}"
    there = files.exists(path(place))
    if there and not files.rename(path(place), path(old)):
        raise OSError(f"cannot move {place}")
    if not files.rename(path(new), path(place)):
        if there:
            files.rename(path(old), path(place))
        raise OSError(f"cannot put {new} at {place}")
    if there:
        files.delete(path(old), True)


def _hadoop(spark: SparkSession):
    return spark._jvm.org.apache.hadoop.fs


def _files(spark: SparkSession, path: str):
    return _hadoop(spark).Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
