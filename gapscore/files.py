"""Small files and folders on whatever file system Spark reaches."""

from __future__ import annotations

from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where = _path(spark, path)
    return _system(spark, where).exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where = _path(spark, path)
    _system(spark, where).delete(where, True)


def children(spark: SparkSession, folder: str) -> Iterator[tuple[str, str]]:
    """(name, path) of what lies in a folder; nothing if it is not there."""
    where = _path(spark, folder)
    system = _system(spark, where)
    for status in system.listStatus(where) if system.exists(where) else []:
        yield status.getPath().getName(), status.getPath().toString()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The content of a small file; None without one."""
    if not exists(spark, path):
        return None
    where = _path(spark, path)
    stream = _system(spark, where).open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> bool:
    """Write a small file whole, by one rename: readers see the old content or the new.

    Without ``replace`` a file that is there stays, and the answer is false.
    """
    target = _path(spark, path)
    system = _system(spark, target)
    target = system.makeQualified(target)
    draft = system.makeQualified(_path(spark, f"{path}.{spark._jvm.java.util.UUID.randomUUID()}.draft"))
    out = system.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE if replace else rename.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, target, options)
    except Py4JJavaError as error:
        system.delete(draft, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True
