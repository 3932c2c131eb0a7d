"""From a request for columns to the families that must run."""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from . import catalog

#: Families whose values a family reuses (they share one context, so this is what is kept alive, not run twice).
CLOSURE = {
    "constit": ("vsa", "ringcount", "frag"), "alias": ("vsa",), "counts": ("constit", "frag", "vsa", "ringcount"),
    "estate_ext": ("estate",), "misc": ("chi", "pathcount", "topomisc", "eta"), "qed": ("vsa", "frag", "rdkcore"),
}
#: Families that walk the graph with its hydrogens as atoms.
NEEDS_HYDROGENS = ("autocorr", "constit", "spectral")


def resolve(columns: str | Iterable[str] | None) -> tuple[str, ...]:
    """Column names of a set's name or of a list, in the order asked for.

    Unknown names and sets, no name at all and None raise; a name given
    twice warns and counts once.
    """
    if columns is None:
        raise TypeError(f"columns must be a set name ({', '.join(sorted(catalog.COLUMN_SETS))}) or a list of names, not None")
    if isinstance(columns, str):
        if columns in catalog.WITHDRAWN:
            raise ValueError(f"column set {columns!r} was withdrawn; choose from {', '.join(sorted(catalog.COLUMN_SETS))}")
        if columns not in catalog.COLUMN_SETS:
            raise ValueError(f"no column set {columns!r}; choose from {', '.join(sorted(catalog.COLUMN_SETS))}")
        return catalog.COLUMN_SETS[columns]
    names = list(columns)
    if not names:
        raise ValueError("columns is empty")
    if unknown := [n for n in names if n not in catalog.FAMILY_OF or n not in catalog.ALL_COLUMNS]:
        raise ValueError(f"unknown columns: {', '.join(map(str, unknown[:10]))}")
    once = tuple(dict.fromkeys(names))
    if len(once) < len(names):
        warnings.warn("repeated column names count once", stacklevel=3)
    return once


@dataclass(frozen=True)
class Plan:
    """What a featurization runs: families in order, wanted columns, optional ones that are on."""

    columns: tuple[str, ...]
    families: tuple[str, ...]
    optional: tuple[str, ...]

    @cached_property
    def by_family(self) -> dict[str, frozenset[str]]:
        """The columns of each family that runs; optional ones that are off are left out."""
        off = set(catalog.OPTIONAL_COLUMNS) - set(self.optional)
        return {f: frozenset(n for n in self.columns if catalog.FAMILY_OF[n] == f and n not in off) for f in self.families}

    @property
    def closure(self) -> tuple[str, ...]:
        """The families whose shared quantities are needed, dependencies included."""
        need, todo = set(), list(self.families)
        while todo:
            f = todo.pop()
            if f not in need:
                need.add(f)
                todo += CLOSURE.get(f, ())
        return tuple(f for f in [*catalog.FAMILIES, "qed"] if f in need)


def plan(columns: str | Iterable[str] | None = "default", optional: Iterable[str] | None = None) -> Plan:
    """``optional`` None runs AvgIpc and qed when asked for by columns; a list limits them to it, off ones are NaN."""
    names = resolve(columns)
    if optional is None:
        on = tuple(n for n in catalog.OPTIONAL_COLUMNS if n in names)
    else:
        on = tuple(optional)
        if bad := [n for n in on if n not in catalog.OPTIONAL_COLUMNS]:
            raise ValueError(f"not optional: {', '.join(bad)}; optional columns are {', '.join(catalog.OPTIONAL_COLUMNS)}")
    wanted = {catalog.FAMILY_OF[n] for n in names if n not in catalog.OPTIONAL_COLUMNS or n in on}
    return Plan(names, tuple(f for f in [*catalog.FAMILIES, "qed"] if f in wanted), on)
