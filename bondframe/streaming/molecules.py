"""Streams of molecules: the featurizer holds no state, so a stream is the same plan in append mode."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.featurize import featurize
from ..sources.molecules import SCHEMA


def read_stream(spark: SparkSession, folder: str, files_a_batch: int = 64) -> DataFrame:
    """(mol_id, smiles) of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def write_stream(stream: DataFrame, folder: str, checkpoint: str, columns: str | Iterable[str] = "default", **options) -> StreamingQuery:
    """Featurize a stream into a folder of Parquet files, each input row exactly once.

    The checkpoint makes a restart go on where it stopped; a row that fails
    keeps its place with NaN, as in a batch.
    """
    out = featurize(stream, columns, **({"standardize": "none", "wide": False} | options))
    return out.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, minutes: int = 5, late: int = 10) -> DataFrame:
    """Counts and sums of events by window and type, late rows within ``late`` minutes included.

    An extension: watermarks and windows are at hand for streams of scores.
    """
    return events.withWatermark("ts", f"{late} minutes").groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
