"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


#: Folders that this process has made, in order.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    A local session that names none uses a folder of this machine; on a cluster that is an
    error, for other machines could not read it.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        conf = "/tmp/checkpoints/quire"
    return conf.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a new folder in the shared one; it goes when the session's process ends, or by drop_folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _file_system(spark, path, lambda fs, p: fs.deleteOnExit(p))
    _made.append(path)
    return path


@contextmanager
def dropping(spark: SparkSession) -> Iterator[None]:
    """Drops, at its end, the folders that were made within: for steps whose result is written by then."""
    before = len(_made)
    try:
        yield
    finally:
        while len(_made) > before:
            drop_folder(spark, _made.pop())


def drop_folder(spark: SparkSession, path: str) -> None:
    _file_system(spark, path, lambda fs, p: fs.delete(p, True))


def path_exists(spark: SparkSession, path: str) -> bool:
    return _file_system(spark, path, lambda fs, p: fs.exists(p))


def state_of(spark: SparkSession, path: str) -> str:
    """A digest of a table's files, their sizes and times: another one if anything was written since."""

    def files(fs, p) -> str:
        found, each = [], fs.listFiles(p, True)
        while each.hasNext():
            f = each.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
        return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()

    return _file_system(spark, path, files, make=False)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, in order; none if there is no such folder."""
    return sorted(_file_system(spark, path, lambda fs, p: [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else [], make=False))


def read_text(spark: SparkSession, path: str) -> str:
    def read(fs, p) -> str:
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    return _file_system(spark, path, read, make=False)


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a small file with this text unless there is one; whether it did.

    The text is written beside it and given its name at once, so a reader sees all of it or
    nothing. Of several writers one succeeds, as far as the file system refuses to rename
    onto a file that exists.
    """
    jvm = spark._jvm

    def write(fs, p) -> bool:
        if fs.exists(p):
            return False
        beside = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
        stream = fs.create(beside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        names = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()) if p.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
        try:
            names.rename(beside, p, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Py4JJavaError as e:
            fs.delete(beside, False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise

    return _file_system(spark, path, write)


def _file_system(spark: SparkSession, path: str, do: Callable, make: bool = True):
    """Acts on a path through the file system that Spark uses for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if make:
        fs.mkdirs(p.getParent())
    return do(fs, p)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts lineage: a lost executor costs the tasks that ran on it, not the
    stages before. Row identifiers made before the write stay as they are.
    """
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
