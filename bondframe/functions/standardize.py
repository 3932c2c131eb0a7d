"""Standard forms of molecules before their descriptors."""

from __future__ import annotations

from collections.abc import Callable

from .smiles import Mol, SmilesError, parse

MODES = ("none", "canonical", "cleanup")


def sub_molecule(mol: Mol, keep: list[int]) -> str:
    """SMILES of some whole parts of a molecule, atoms in their order, without stereo marks."""
    return write(mol, keep)


def write(mol: Mol, atoms: list[int] | None = None) -> str:
    """A Kekulé SMILES of the molecule (or of those parts): every atom in brackets."""
    from .elements import SYMBOLS

    inside = set(range(len(mol.atoms)) if atoms is None else atoms)
    seen: set[int] = set()
    closing: dict[tuple[int, int], int] = {}
    rings = 0
    out: list[str] = []

    def text(i: int) -> str:
        a = mol.atoms[i]
        h = "" if not a.h else "H" if a.h == 1 else f"H{a.h}"
        q = "" if not a.charge else f"{a.charge:+d}"
        return f"[{a.iso or ''}{SYMBOLS[a.z]}{h}{q}]"

    sign = {1: "-", 2: "=", 3: "#", 4: "$"}
    for root in sorted(inside):
        if root in seen:
            continue
        # find the bonds that close rings first
        order, parent, stack = [], {root: -1}, [root]
        children: dict[int, list[int]] = {}
        marks: dict[int, list[tuple[int, int]]] = {}
        visited = set()
        while stack:
            i = stack.pop()
            if i in visited:
                continue
            visited.add(i)
            order.append(i)
            if parent[i] >= 0:
                children.setdefault(parent[i], []).append(i)
            for j in mol.atoms[i].nbrs:
                if j not in visited:
                    parent[j] = i
                    stack.append(j)
        tree = {(p, c) for p, cs in children.items() for c in cs}
        for i in order:
            for j, b in zip(mol.atoms[i].nbrs, mol.atoms[i].bonds):
                if (i, j) not in tree and (j, i) not in tree and (j, i) not in closing:
                    rings += 1
                    closing[i, j] = rings
                    for x in (i, j):
                        marks.setdefault(x, []).append((rings, mol.bonds[b].order))
        seen |= visited
        if out:
            out.append(".")
        todo: list[int | str] = [root]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            if parent[x] >= 0:
                out.append(sign[mol.bond(parent[x], x).order])
            out.append(text(x))
            for k, o in marks.get(x, []):
                out.append(f"{sign[o]}%{k:02d}" if k < 100 else f"{sign[o]}%({k})")
            kids = children.get(x, [])
            todo += kids[:1]
            for c in kids[1:]:
                todo += [")", c, "("]
    return "".join(out)


def cleanup(mol: Mol) -> Mol:
    """Charge-separated forms repaired at parsing; the largest part kept; charges taken off by hydrogens."""
    parts = mol.parts()
    best = max(parts, key=lambda p: (sum(mol.atoms[i].z > 1 for i in p), sum(mol.atoms[i].z for i in p), -p[0]))
    out = parse(write(mol, best)) if len(parts) > 1 else mol
    changed = False
    for i, a in enumerate(out.atoms):
        near = any(out.atoms[j].charge for j in a.nbrs)
        if a.charge > 0 and a.h and not near:
            take = min(a.charge, a.h)
            a.charge, a.h, changed = a.charge - take, a.h - take, True
        elif a.charge < 0 and not near and a.z in (7, 8, 16):
            a.h, a.charge, changed = a.h - a.charge, 0, True
    return parse(write(out)) if changed else out


def standardized(text: str, mode: str | Callable[[Mol], Mol | None] = "none") -> Mol:
    """The molecule in a standard form; a callable that returns None fails the row."""
    mol = parse(text)
    if callable(mode):
        mol = mode(mol)
        if mol is None or not mol.atoms:
            raise SmilesError("the standardizer gave no molecule")
        return mol
    if mode == "canonical":
        # values don't depend on the order of atoms: parsing is canonical already
        return mol
    return cleanup(mol) if mode == "cleanup" else mol
