"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_folders: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset, as in local tests, a folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _at(spark: SparkSession, path: str):
    """Hadoop's path and file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _at(spark, path)
    return files.exists(at)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    at, files = _at(spark, folder)
    return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    at, files = _at(spark, path)
    files.delete(at, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Give a finished folder its name; of several writers the first wins, and another's folder is deleted."""
    at, files = _at(spark, source)
    to, _ = _at(spark, target)
    if files.exists(to) or not files.rename(at, to):
        files.delete(at, True)
        if not files.exists(to):
            raise OSError(f"cannot move {source} to {target}")


def signature(spark: SparkSession, path: str) -> str:
    """Changes when files of a table do: their names, sizes and times."""
    at, files = _at(spark, path)
    found = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in (files.listStatus(at)))
    return hashlib.sha256(repr((path, found)).encode()).hexdigest()[:24]


def _own_folder(spark: SparkSession) -> str:
    """Where this application's stashed tables lie; they go with it."""
    folder = f"{shared_folder(spark)}/engrama-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_forget, spark, folder)
    return folder


def _forget(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        delete(spark, folder)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has stashed: when every result that reads them has been written."""
    delete(spark, _own_folder(spark))


def stash(df: DataFrame) -> DataFrame:
    """The same rows read back from a table in the shared folder.

    Cuts the lineage: a lost executor costs the reader nothing but a re-read.
    The table belongs to the application and goes when that ends, or before
    that by ``drop`` or ``clear``.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._engrama_table = path
    return back


def drop(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more; what is no stashed table stays."""
    for table in tables:
        path = vars(table).pop("_engrama_table", None)
        if path:
            delete(table.sparkSession, path)


def broadcast_if(df: DataFrame, rows: int, at_most: int) -> DataFrame:
    """``df`` marked for broadcast if it has few enough rows, else as it is."""
    return F.broadcast(df) if rows <= at_most else df


#: Rows of an id and a flag that are sent to every task; beyond, they are joined by a shuffle.
FEW = 200_000


def few(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it is small, so that the larger side of a join stays where it is."""
    return broadcast_if(df, df.count(), FEW)
