"""Small files on any file system that Spark reads, replaced as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """What the file says, None if it isn't there."""
    jvm, where, fs = _hadoop(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def swap_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file beside it and renames that over it: a reader finds the old text or the new one, never none."""
    jvm, where, fs = _hadoop(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs.mkdirs(where.getParent())
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    ways = spark.sparkContext._gateway.new_array(rename, 1)
    ways[0] = rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(aside), fs.makeQualified(where), ways)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it isn't there."""
    _, where, fs = _hadoop(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    _, where, fs = _hadoop(spark, path)
    fs.delete(where, True)


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, size and time of each file of a table (a file or a folder of files)."""
    _, where, fs = _hadoop(spark, path)
    if not fs.exists(where):
        return []
    found, each = [], fs.listFiles(where, True)
    while each.hasNext():
        x = each.next()
        if not x.getPath().getName().startswith(("_", ".")):
            found.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
    return sorted(found)
