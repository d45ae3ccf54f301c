"""Small files of streams, through the file system of their path: manifests, claims, results."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def located(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = located(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, none if it is not there."""
    fs, where = located(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = located(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def age_ms(spark: SparkSession, path: str) -> int:
    """Milliseconds since a file was written, by this machine's clock."""
    fs, where = located(spark, path)
    return spark.sparkContext._jvm.System.currentTimeMillis() - fs.getFileStatus(where).getModificationTime()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that must not be there yet, whole or not at all; False if another writer was first.

    The text goes to a file of its own, which then gets the name: by a rename, which HDFS refuses where the name is
    taken, or on a local disk by a hard link, as local renames replace. Stores without atomic renames do not fit.
    """
    fs, where = located(spark, path)
    draft = where.getParent().suffix(f"/.{where.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if fs.getUri().getScheme() != "file":
            return fs.rename(draft, where)
        java = spark.sparkContext._jvm.java
        try:
            java.nio.file.Files.createLink(java.io.File(where.toUri().getPath()).toPath(), java.io.File(draft.toUri().getPath()).toPath())
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        return True
    finally:
        if fs.exists(draft):
            fs.delete(draft, False)
