"""Decoded inputs kept as Parquet between sessions, by what identifies the files."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .storage import children, listing

#: Part of every key; another number makes all entries misses.
VERSION = 1


def key(spark: SparkSession, path: str, settings: dict | None = None) -> str:
    """Names an input and how it is read: the path, the size and time of each of its files, and the settings."""
    what = [VERSION, path, listing(spark, path), settings or {}]
    return hashlib.sha256(json.dumps(what, sort_keys=True).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, path: str, make: Callable[[], DataFrame], settings: dict | None = None) -> DataFrame:
    """The table of ``make`` for the file at ``path``, read from ``folder`` if an entry has it.

    ``folder`` is on storage that all executors share.  An entry counts once
    Spark has marked it as whole; one that can't be read is a miss.  Writers of
    one key at the same time make an entry each.
    """
    place = f"{folder.rstrip('/')}/{key(spark, path, settings)}"
    for entry in children(spark, place, "_SUCCESS"):
        try:
            return spark.read.parquet(entry)
        except (PySparkException, Py4JJavaError):
            continue
    entry = f"{place}/{uuid.uuid4().hex}"
    make().write.parquet(entry)
    return spark.read.parquet(entry)
