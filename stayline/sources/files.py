"""Small files on the session's file system that order or complete the work of several drivers."""

from __future__ import annotations

from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import SparkSession
from py4j.protocol import Py4JJavaError


def file_system(spark: SparkSession, path: str):
    """The JVM's file system of a path, found by the settings of the session, and the path as an object."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if it is not there."""
    fs, place = file_system(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(place)) if fs.exists(place) else []


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless it exists; of several drivers one is told True."""
    fs, place = file_system(spark, path)
    try:
        out = fs.create(place, False)
    except (Py4JJavaError, PySparkException):
        if fs.exists(place):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def get(spark: SparkSession, path: str) -> str:
    """The text of a small file, empty if its writer has not finished."""
    fs, place = file_system(spark, path)
    length = fs.getFileStatus(place).getLen()
    taken = fs.open(place)
    try:
        return bytes(b & 0xFF for b in spark._jvm.org.apache.commons.io.IOUtils.toByteArray(taken)).decode() if length else ""
    finally:
        taken.close()


def age_seconds(spark: SparkSession, path: str) -> float:
    fs, place = file_system(spark, path)
    return spark._jvm.java.lang.System.currentTimeMillis() / 1000 - fs.getFileStatus(place).getModificationTime() / 1000


def remove(spark: SparkSession, path: str) -> None:
    fs, place = file_system(spark, path)
    fs.delete(place, True)
