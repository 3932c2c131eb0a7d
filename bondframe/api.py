"""The public functions and constants under their usual names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .plans.catalog import ALL_COLUMNS, COLUMN_SETS, FAMILY_COLUMNS, FAMILY_OFFSETS, OPTIONAL_COLUMNS
from .plans.featurize import column_set, expand_fingerprint, feature_names, featurize, parse, scaffolds, without_molecules

COLUMNS = tuple(FAMILY_COLUMNS["blocks"])


def minimal_columns() -> tuple[str, ...]:
    return column_set("minimal")


def featurize_all(table: DataFrame, **options) -> DataFrame:
    """Every emitted column, the optional ones included."""
    return featurize(table, ALL_COLUMNS, **({"standardize": "none"} | options))


def featurize_blocks(table: DataFrame, **options) -> DataFrame:
    """The columns of the blocks family alone."""
    return featurize(table, COLUMNS, **({"standardize": "none"} | options))


compute = featurize_blocks

__all__ = ["ALL_COLUMNS", "COLUMNS", "COLUMN_SETS", "FAMILY_OFFSETS", "OPTIONAL_COLUMNS", "column_set", "compute", "expand_fingerprint", "feature_names", "featurize", "featurize_all", "featurize_blocks", "minimal_columns", "parse", "scaffolds", "without_molecules"]
