"""Small files in any store that Spark reads: what a driver needs to name, find and remove tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _at(spark, path)
    return store.exists(where)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    store, where = _at(spark, folder)
    return sorted(x.getPath().getName() for x in store.listStatus(where)) if store.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    store, where = _at(spark, path)
    store.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str:
    store, where = _at(spark, path)
    stream = store.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_new_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file whole or not at all; false, and nothing is written, if there is one of that name."""
    store, where = _at(spark, path)
    if store.exists(where):
        return False
    _, started = _at(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    stream = store.create(started)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if store.rename(started, where):
        return True
    store.delete(started, False)
    return False
