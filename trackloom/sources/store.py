"""Small files in any store that Spark reads: a path's file system is Hadoop's, never the driver's own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Files that match a glob, in lexical order."""
    fs, p = _at(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(p) or [] if s.isFile())


def read_text(spark: SparkSession, path: str) -> str:
    """A small file whole."""
    return spark.read.text(path, wholetext=True).first()[0]


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a text file, without a byte order mark."""
    line = spark.read.text(path).first()
    return line[0].removeprefix("﻿") if line else ""


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file."""
    fs, p = _at(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
