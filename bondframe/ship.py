"""Hands this package to the executors, so that only the driver needs it installed."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "bondframe.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(os.path.realpath(path))
    _SHIPPED.add(sc.applicationId)


#: What empties the caches that a module keeps in a worker, by the module's name.
FORGET: dict[str, Callable[[], None]] = {}
_AT: list[str] = []


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def begin(module: str) -> None:
    """Workers outlive a stage: when another module's turn comes, the caches of the others go."""
    if _AT != [module]:
        _AT[:] = [module]
        for name, forget in FORGET.items():
            if name != module:
                forget()
        gc.collect()
        trim()


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with the package at hand in the workers; see ``begin`` for what they keep."""
    ship(df.sparkSession)
    module = run.__module__

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(module)
        yield from run(batches)
        trim()

    return df.mapInArrow(alone, schema)
