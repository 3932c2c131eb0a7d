"""Molecule tables: (mol_id bigint, smiles string), their sources and sinks.

Spark rows have no order: mol_id is the identity and is sorted on only where
a file must have an order.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "mol_id bigint, smiles string"


def from_list(spark: SparkSession, smiles: Iterable[str | None]) -> DataFrame:
    """A small list on the driver; mol_id is the place in it."""
    return spark.createDataFrame(list(enumerate(smiles)), SCHEMA)


def read_smi(spark: SparkSession, path: str) -> DataFrame:
    """Text with one SMILES a line, anything after white space being a comment; blank lines are dropped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.monotonically_increasing_id().alias("mol_id"), F.get(F.split(F.trim("value"), r"\s+"), F.lit(0)).alias("smiles"))


def read_parquet(spark: SparkSession, path: str, smiles: str = "smiles", key: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Only the columns asked for are read."""
    ident = F.col(key).cast("bigint") if key else F.monotonically_increasing_id()
    return spark.read.parquet(path).select(ident.alias("mol_id"), F.col(smiles).cast("string").alias("smiles"), *extra)


def read_labelled_csv(spark: SparkSession, path: str, smiles: str, label: str, encoding: str = "UTF-8") -> DataFrame:
    """(mol_id, smiles, label double) of a CSV; rows without a SMILES or with a label that is no number are dropped."""
    rows = spark.read.csv(path, header=True, encoding=encoding)
    rows = rows.select(F.monotonically_increasing_id().alias("mol_id"), F.col(f"`{smiles}`").alias("smiles"), F.expr(f"try_cast(`{label}` AS double)").alias("label"))
    return rows.dropna(subset=["smiles", "label"])


def check_rows(df: DataFrame, expected: int) -> DataFrame:
    """``df`` unchanged when it has ``expected`` rows, else an error (a footer count check)."""
    if (n := df.count()) != expected:
        raise ValueError(f"{n} rows where {expected} were expected")
    return df


def quantize(df: DataFrame, score: str, scale: int = 100) -> DataFrame:
    """``df`` with q, the score times ``scale`` as a smallint; an error where that loses anything."""
    x = F.col(score) * scale
    q = F.rint(x)
    fits = F.assert_true((F.abs(x - q) < 1e-6) & (F.abs(q) < 32768), F.lit("a score isn't a whole number of steps"))
    return df.withColumn("q", F.when(fits.isNull(), q.cast("smallint")))


def skip_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't among those done: makes a rerun of a shard loop idempotent."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def write_matrix(df: DataFrame, path: str, dtype: str = "double", partition_by: str | None = None) -> None:
    """Parquet, committed as a whole; numbers as double or float. Partitions that are written replace old ones."""
    if dtype not in ("double", "float"):
        raise ValueError("dtype must be double or float")
    out = df.select(*(F.col(f"`{c}`").cast(dtype).alias(c) if k == "double" else F.col(f"`{c}`") for c, k in df.dtypes))
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by)
    w.parquet(path)


def write_records(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)
