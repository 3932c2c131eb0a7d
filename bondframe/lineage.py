"""Tables in the shared folder that cut a plan's lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a session on one machine may do without that setting: it gets a
    folder of its own. On a cluster executors couldn't read each other's.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="bondframe-"))
    return _OWN[0]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back.

    The result's lineage starts at files, so a lost executor costs a reread
    and not the work before it. The table goes when the driver ends, or with
    the ``scratch`` block it was made in.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    atexit.register(drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose tables are dropped at its end, but for those given to ``keep``."""
    made: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._table)
        return df

    _OPEN.append(made)
    try:
        yield keep
    finally:
        _OPEN.pop()
        spark = SparkSession.getActiveSession()
        for path in made:
            if path in kept:
                if _OPEN:
                    _OPEN[-1].append(path)
            elif spark is not None:
                drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table of ``cut`` if the session still lives."""
    if spark.sparkContext._jsc is None:
        return
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
