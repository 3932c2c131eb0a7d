"""Circular fingerprints (Rogers and Hahn 2010)."""

from __future__ import annotations

from ..functions import elements as el
from ..functions.smiles import Mol


def _combine(seed: int, value: int) -> int:
    """32-bit hash combination."""
    return (seed ^ (value + 0x9E3779B9 + (seed << 6 & 0xFFFFFFFF) + (seed >> 2))) & 0xFFFFFFFF


def environments(mol: Mol, radius: int, chirality: bool = False) -> list[tuple[int, int, int]]:
    """(radius, centre, code) of every different circular environment.

    An atom starts from its element, degree with hydrogens, hydrogens,
    charge, mass shift and ring flag; each layer folds in its neighbours'
    codes with the bonds, sorted. An environment whose bonds an earlier one
    already covers is left out, as are those grown from it.
    """
    codes = []
    for a in mol.atoms:
        h = a.h + sum(mol.atoms[j].z == 1 for j in a.nbrs)
        shift = int(a.iso - el.of(el.WEIGHT, a.z)) if a.iso else 0
        code = 0
        for v in (a.z, a.deg + a.h, h, a.charge, shift, *([1] if a.nring else [])):
            code = _combine(code, v & 0xFFFFFFFF)
        codes.append(code)
    out = [(0, i, c) for i, c in enumerate(codes) if mol.atoms[i].z > 1]
    covers = [frozenset() for _ in mol.atoms]
    seen: set[frozenset[int]] = set()
    dead: set[int] = set()
    for r in range(1, radius + 1):
        new, grown, found = list(codes), list(covers), []
        for i, a in enumerate(mol.atoms):
            if i in dead or not a.nbrs:
                continue
            pairs = sorted((mol.bonds[b].order if not mol.bonds[b].arom else 12, codes[j]) for j, b in zip(a.nbrs, a.bonds))
            code = _combine(r - 1, codes[i])
            for kind, c in pairs:
                code = _combine(_combine(code, kind), c)
            if chirality and a.cip and r == 1:
                code = _combine(code, a.cip + 2)
            cover = frozenset(a.bonds).union(*(covers[j] for j in a.nbrs))
            new[i], grown[i] = code, cover
            found.append((cover, code, i))
        for cover, code, i in sorted(found, key=lambda f: (sorted(f[0]), f[1])):
            if cover in seen:
                dead.add(i)
            else:
                seen.add(cover)
                if mol.atoms[i].z > 1:
                    out.append((r, i, code))
        codes, covers = new, grown
    return out


def ecfp_bits(mol: Mol, radius: int = 4, size: int = 2048, chirality: bool = True) -> list[int]:
    """The set bits, ascending."""
    return sorted({code % size for _, _, code in environments(mol, radius, chirality)})


def ecfp_counts(mol: Mol, radius: int = 2, size: int = 2048) -> dict[int, int]:
    """How many environments fall on each bit."""
    out: dict[int, int] = {}
    for _, _, code in environments(mol, radius):
        out[code % size] = out.get(code % size, 0) + 1
    return dict(sorted(out.items()))
