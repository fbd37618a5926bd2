"""Small files by Hadoop paths, written so that a reader sees a whole file or none, wherever Spark can write."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def size(spark: SparkSession, path: str) -> int | None:
    """The bytes that a file has; None where there is none."""
    _, where, fs = _at(spark, path)
    return fs.getFileStatus(where).getLen() if fs.exists(where) and not fs.getFileStatus(where).isDirectory() else None


def read(spark: SparkSession, path: str) -> bytes | None:
    """The bytes of a file; None where there is none."""
    jvm, where, fs = _at(spark, path)
    if not fs.exists(where) or fs.getFileStatus(where).isDirectory():
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def write(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a file as write_parts() does."""
    write_parts(spark, path, [data])


def write_parts(spark: SparkSession, path: str, parts: Iterable[bytes]) -> None:
    """Writes a file of these parts and gives it its name, in place of one of that name, when it is whole. OSError where that fails."""
    from py4j.protocol import Py4JJavaError

    jvm, where, fs = _at(spark, path)
    temp = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}.tmp")
    try:
        stream = fs.create(temp, True)
        try:
            for part in parts:
                stream.write(bytearray(part))
        finally:
            stream.close()
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(temp), fs.makeQualified(where), options)
    except Py4JJavaError as e:
        raise OSError(f"{path}: {e.java_exception.getMessage()}") from e


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none where there is no folder."""
    jvm, where, fs = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    _, where, fs = _at(spark, path)
    fs.delete(where, True)
