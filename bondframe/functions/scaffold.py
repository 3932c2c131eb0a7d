"""Canonical text and Bemis-Murcko scaffolds."""

from __future__ import annotations

import xxhash

from .smiles import Mol, _matching, ranks
from .standardize import write


def canonical_order(mol: Mol) -> list[int]:
    """Atoms by refined invariants; ties are broken one at a time and refined again.

    Atoms that still tie are told apart by no property that refinement sees,
    so any choice among them gives the same text for all but rare regular graphs.
    """
    rank = ranks(mol)
    n = len(mol.atoms)
    while len(set(rank)) < n:
        seen, tied = set(), None
        for r in sorted(rank):
            if r in seen:
                tied = r
                break
            seen.add(r)
        first = min(i for i in range(n) if rank[i] == tied)
        rank = [2 * r + (r == tied and i != first) for i, r in enumerate(rank)]
        while True:
            key = [(rank[i], tuple(sorted((rank[j], mol.bonds[b].value) for j, b in zip(a.nbrs, a.bonds)))) for i, a in enumerate(mol.atoms)]
            order = {k: r for r, k in enumerate(sorted(set(key)))}
            new = [order[k] for k in key]
            done = len(order) == len(set(rank))
            rank = new
            if done:
                break
    return sorted(range(n), key=lambda i: rank[i])


def sub_graph(mol: Mol, keep: list[int]) -> Mol:
    """The atoms in the given order and the bonds between them, sorted.

    Double bonds of aromatic rings are placed anew from the order, for any
    other choice of them is the same molecule.
    """
    place = {i: k for k, i in enumerate(keep)}
    out = Mol()
    for i in keep:
        a = mol.atoms[i]
        out.atoms.append(a.__class__(a.z, a.arom, a.charge, a.iso, a.h, True, nring=a.nring))
    for u, v, arom, order in sorted((*sorted((place[b.u], place[b.v])), b.arom, b.order) for b in mol.bonds if b.u in place and b.v in place):
        out.add_bond(u, v, order, arom)
    paired = sorted({i for b in out.bonds if b.arom and b.order == 2 for i in (b.u, b.v)})
    near = {i: sorted(out.bonds[b].other(i) for b in out.atoms[i].bonds if out.bonds[b].arom and out.bonds[b].other(i) in paired) for i in paired}
    for b in out.bonds:
        if b.arom:
            b.order = 1
    for i, j in _matching(near).items():
        out.bond(i, j).order = 2
    return out


def canonical_smiles(mol: Mol) -> str:
    """One text for a molecule however it was written (without stereo marks)."""
    return write(sub_graph(mol, canonical_order(mol)))


def murcko(mol: Mol) -> str:
    """The canonical text of rings, linkers between them and atoms double-bonded to either; empty for acyclic molecules.

    Open valences are filled with hydrogens and charges are kept.
    """
    keep = {i for r in mol.rings for i in r}
    if not keep:
        return ""
    core = set(range(len(mol.atoms)))
    while ends := {i for i in core if i not in keep and sum(j in core for j in mol.atoms[i].nbrs) <= 1}:
        core -= ends
    core |= {j for i in core for j in mol.atoms[i].nbrs if mol.bond(i, j).order == 2}
    # parts without a ring aren't scaffold
    seen, todo = set(keep & core), list(keep & core)
    for i in todo:
        for j in mol.atoms[i].nbrs:
            if j in core and j not in seen:
                seen.add(j)
                todo.append(j)
    atoms = sorted(seen)
    part = sub_graph(mol, atoms)
    for k, i in enumerate(atoms):
        lost = sum(mol.bonds[b].order for j, b in zip(mol.atoms[i].nbrs, mol.atoms[i].bonds) if j not in seen)
        part.atoms[k].h += lost
    return canonical_smiles(part)


def scaffold_hash(mol: Mol) -> int:
    """64 bits of the scaffold's text, as a signed integer; acyclic molecules share that of the empty text."""
    h = xxhash.xxh64_intdigest(murcko(mol).encode())
    return h - (1 << 64) if h >> 63 else h
