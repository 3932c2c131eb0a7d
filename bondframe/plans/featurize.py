"""Featurization of molecule tables."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import smiles as sm
from ..functions.scaffold import canonical_smiles, murcko, scaffold_hash
from ..functions.standardize import MODES, standardized
from ..operators.context import Context
from ..operators.families import run_family
from ..operators.fingerprint import ecfp_bits
from ..ship import map_arrow
from . import catalog
from .planner import Plan, plan

ATOM = "struct<z:int,deg:int,nh:int,fchg:int,hyb:int,arom:boolean,inring:boolean,cip:int,nring:int,tval:int,chirposs:boolean,iso:int,mass:double,chg:double>"
BOND = "struct<u:int,v:int,conj:boolean,inring:boolean,arom:boolean,kekule:int,stereo:int,bond_order:double>"
MOL = f"struct<atoms:array<{ATOM}>,bonds:array<{BOND}>,rings:array<array<int>>,chg_ok:boolean>"
ERROR = "struct<kind:string,message:string>"
ON_ERROR = ("nan", "raise", "skip")


def _as_row(mol: sm.Mol) -> dict:
    c = Context(mol)
    atoms = [
        {"z": a.z, "deg": a.deg, "nh": a.h, "fchg": a.charge, "hyb": a.hyb, "arom": a.arom, "inring": a.nring > 0, "cip": a.cip, "nring": a.nring, "tval": int(c.val[i]), "chirposs": a.pos_chiral, "iso": a.iso, "mass": float(c.weight[i]), "chg": float(a.q)}
        for i, a in enumerate(mol.atoms)
    ]
    bonds = [{"u": b.u, "v": b.v, "conj": b.conj, "inring": b.ring, "arom": b.arom, "kekule": b.order, "stereo": b.ez, "bond_order": b.value} for b in mol.bonds]
    return {"atoms": atoms, "bonds": bonds, "rings": mol.rings, "chg_ok": mol.charged}


def parse(table: DataFrame, smiles: str = "smiles") -> DataFrame:
    """``table`` with mol (a nested graph, null when the text is none) and error.

    One pass in Arrow batches, no shuffle; a text that fails costs its own
    row. The graph's atoms, bonds and rings are arrays, so that counts and
    sums over them stay native expressions.
    """
    names = table.columns
    schema = T.StructType([*table.schema.fields, *T._parse_datatype_string(f"mol {MOL}, error {ERROR}").fields])
    at = names.index(smiles)
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mols, errors = [], []
            for s in b.column(at):
                try:
                    mols.append(_as_row(sm.parse(s.as_py() or "")))
                    errors.append(None)
                except (ValueError, RecursionError) as e:
                    mols.append(None)
                    errors.append({"kind": "row", "message": str(e)[:200]})
            cols = [*b.columns, pa.array(mols, kinds.field("mol").type), pa.array(errors, kinds.field("error").type)]
            yield pa.record_batch(cols, names=[*names, "mol", "error"])

    return map_arrow(table, run, schema)


def scaffolds(table: DataFrame, smiles: str = "smiles") -> DataFrame:
    """``table`` with canonical, scaffold and scaffold_hash, null where the text is no molecule."""
    names, at = table.columns, table.columns.index(smiles)
    schema = T.StructType([*table.schema.fields, *T._parse_datatype_string("canonical string, scaffold string, scaffold_hash bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s in b.column(at):
                try:
                    mol = sm.parse(s.as_py() or "")
                    rows.append((canonical_smiles(mol), murcko(mol), scaffold_hash(mol)))
                except (ValueError, RecursionError):
                    rows.append((None, None, None))
            c, m, h = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([*b.columns, pa.array(c, pa.string()), pa.array(m, pa.string()), pa.array(h, pa.int64())], names=[*names, "canonical", "scaffold", "scaffold_hash"])

    return map_arrow(table, run, schema)


def without_molecules(table: DataFrame, excluded: DataFrame, smiles: str = "smiles") -> DataFrame:
    """``table`` without the molecules of ``excluded``, however either writes them; texts that are no molecule stay."""
    names, bad = table.columns, scaffolds(excluded.select(smiles), smiles).select(F.col("canonical").alias("_c")).filter("_c IS NOT NULL").distinct()
    found = scaffolds(table.select(*names), smiles)
    return found.join(bad, F.col("canonical") == F.col("_c"), "left_anti").select(*names)


def compute_row(text: str | None, p: Plan, standardize, radius: int | None, size: int) -> tuple[list[float], list[int], dict | None]:
    """(values, set bits, error) of one SMILES: NaN and no bits where it fails."""
    try:
        mol = standardized(text or "", standardize)
    except (ValueError, RecursionError) as e:
        return [np.nan] * len(p.columns), [], {"kind": "row", "message": str(e)[:200]}
    c, values, failed, wanted = Context(mol), {}, [], p.by_family
    with np.errstate(all="ignore"):
        for f in p.families:
            try:
                values |= {k: v for k, v in run_family(f, c, wanted[f]).items() if k in wanted[f]}
            except (ValueError, ArithmeticError, np.linalg.LinAlgError, RecursionError) as e:
                failed.append(f"{f}: {e}")
    row = [values.get(n, np.nan) for n in p.columns]
    error = {"kind": "columns", "message": "; ".join(failed)[:200]} if failed else None
    return row, ecfp_bits(mol, radius, size) if radius is not None else [], error


#: Whether the warning about an unset standardize was given; once is enough.
_WARNED: list[bool] = []
#: Arguments of old and what takes their place.
REPLACED = {"additional_descriptors": "name a set, or the columns themselves, in columns"}


def featurize(
    table: DataFrame,
    columns: str | Iterable[str] | None = "default",
    *,
    smiles: str = "smiles",
    fingerprint: bool = False,
    radius: int = 4,
    fp_size: int = 2048,
    on_error: str = "nan",
    standardize: str | Callable | None = None,
    optional: Iterable[str] | None = None,
    dtype: str = "double",
    wide: bool = True,
    **removed,
) -> DataFrame:
    """``table`` with one column for each descriptor and, if asked for, the fingerprint's set bits.

    Only the families of the wanted columns run, in one pass of Arrow
    batches without a shuffle, every molecule by itself. ``on_error``: nan
    keeps a failed row with NaN, skip drops it, raise fails. ``error`` has
    what went wrong: kind row for the text, columns for single families.
    ``wide`` False gives one array column, features, in the same order.
    """
    for name in removed:
        hint = REPLACED.get(name)
        raise TypeError(f"{name} was removed: {hint}" if hint else f"featurize() has no argument {name}")
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {', '.join(ON_ERROR)}")
    if isinstance(standardize, str) and standardize not in MODES:
        raise ValueError(f"standardize must be one of {', '.join(MODES)} or a callable")
    if dtype not in ("double", "float"):
        raise ValueError("dtype must be double or float")
    if standardize is None:
        if not _WARNED:
            warnings.warn("standardize isn't set: molecules are taken as written ('none')", stacklevel=2)
            _WARNED.append(True)
        standardize = "none"
    p = plan(columns, optional)
    names, at = table.columns, table.columns.index(smiles)
    bits = radius if fingerprint else None
    extra = T._parse_datatype_string(f"features array<double>, fp_bits array<int>, error {ERROR}").fields
    error_type = pa.struct([("kind", pa.string()), ("message", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [compute_row(s.as_py(), p, standardize, bits, fp_size) for s in b.column(at)]
            flat = np.array([r[0] for r in rows], np.float64).reshape(-1)
            offsets = pa.array(np.arange(len(rows) + 1) * len(p.columns), pa.int32())
            cols = [*b.columns, pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], error_type)]
            yield pa.record_batch(cols, names=[*names, "features", "fp_bits", "error"])

    out = map_arrow(table, run, T.StructType([*table.schema.fields, *extra]))
    if on_error == "skip":
        out = out.filter("error IS NULL OR error.kind <> 'row'")
    elif on_error == "raise":
        said = F.concat(F.lit("row "), F.col(f"`{names[0]}`").cast("string"), F.lit(": "), F.col("error.message"))
        out = out.filter(F.when(F.col("error.kind") == "row", F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))
    keep = [F.col(f"`{n}`") for n in names]
    if wide:
        keep += [F.get("features", F.lit(i)).cast(dtype).alias(n) for i, n in enumerate(p.columns)]
    else:
        keep.append(F.col("features").cast(f"array<{dtype}>").alias("features"))
    return out.select(*keep, *(["fp_bits"] if fingerprint else []), "error")


def expand_fingerprint(df: DataFrame, fp_size: int = 2048) -> DataFrame:
    """fp_bits as columns ECFP_0, ECFP_1, ... of 0 and 1: for a sink alone."""
    bit = [F.array_contains("fp_bits", i).cast("tinyint").alias(f"ECFP_{i}") for i in range(fp_size)]
    return df.select(*(c for c in df.columns if c != "fp_bits"), *bit)


def feature_names(columns: str | Iterable[str] | None = "default", fingerprint: bool = False, fp_size: int = 2048) -> list[str]:
    """The names of a featurization's columns, in order."""
    return [*plan(columns).columns, *(f"ECFP_{i}" for i in range(fp_size) if fingerprint)]


def column_set(name: str) -> tuple[str, ...]:
    """The names of a set; sets but full ones are in alphabetical order."""
    return plan(name).columns
