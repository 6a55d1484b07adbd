"""What the operators share: a folder that all executors see, and their code on the executors."""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_shipped: set[str] = set()


class _Folders(threading.local):
    """Of each driver thread: folders written in the open scope, and those of closed ones until release()."""

    def __init__(self):
        self.held: list[str] | None = None
        self.old: list[str] = []


_folders = _Folders()


@contextlib.contextmanager
def scope():
    """Remembers the folders that stage() writes, for release()."""
    before, _folders.held = _folders.held, []
    try:
        yield
    finally:
        _folders.old.extend(_folders.held)
        _folders.held = before


def release(spark: SparkSession) -> None:
    """Deletes the folders of this thread's scopes so far; what was made from them must have been written by now."""
    while _folders.old:
        fs, path = _file_system(spark, _folders.old.pop())
        fs.delete(path, True)


def _file_system(spark: SparkSession, path: str):
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()), path


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application, wherever the driver found it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(), "packetloom_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "packetloom")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def folder(spark: SparkSession) -> str:
    """A new path in spark.checkpoint.dir.  Where that is unset, executors on other machines would not see
    what is written, so only a local master (as in tests) gets a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "packetloom-shared")
    return f"{base.rstrip('/')}/packetloom-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: its lineage ends there, and a lost executor
    costs a re-read, not a recomputation.  The folder goes when its scope is released, or else when the
    driver ends."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    if _folders.held is not None:
        _folders.held.append(path)
    df.write.parquet(path)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from `names` that no column of df has, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = "_" + name
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
