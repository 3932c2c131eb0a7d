"""Element properties. Every table is a set of fixed values that results depend on.

An element that a table lacks has no value there (NaN), and a descriptor that
weighs its atoms by that property is NaN.
"""

from __future__ import annotations

import math
from functools import cache

NAN = float("nan")

SYMBOLS = (
    "* H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr "
    "Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu "
    "Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn"
).split()
NUMBER = {s: z for z, s in enumerate(SYMBOLS)}

#: Standard atomic weights.
WEIGHT = {
    "H": 1.008, "Li": 6.941, "Be": 9.012, "B": 10.812, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998,
    "Na": 22.99, "Mg": 24.305, "Al": 26.982, "Si": 28.086, "P": 30.974, "S": 32.067, "Cl": 35.453, "K": 39.098,
    "Ca": 40.078, "Fe": 55.845, "Cu": 63.546, "Zn": 65.39, "Ge": 72.61, "As": 74.922, "Se": 78.96, "Br": 79.904,
    "Sn": 118.711, "Te": 127.6, "I": 126.904, "Pt": 195.078, "Hg": 200.59, "Pb": 207.2,
}
#: Masses of the most common isotope.
ISOTOPE = {
    "H": 1.007825032, "Li": 7.01600455, "Be": 9.0121822, "B": 11.0093054, "C": 12.0, "N": 14.003074, "O": 15.99491462,
    "F": 18.99840322, "Na": 22.98976928, "Mg": 23.9850417, "Al": 26.98153863, "Si": 27.97692653, "P": 30.97376163,
    "S": 31.972071, "Cl": 34.96885268, "K": 38.96370668, "Ca": 39.96259098, "Fe": 55.9349375, "Cu": 62.9295975,
    "Zn": 63.9291422, "Ge": 73.9211778, "As": 74.9215965, "Se": 79.9165213, "Br": 78.9183371, "Sn": 119.9021947,
    "Te": 129.9062244, "I": 126.904473, "Pt": 194.9647911, "Hg": 201.970643, "Pb": 207.9766521,
}
#: Covalent radii for surface areas.
COVALENT = {
    "H": 0.33, "Li": 1.23, "Be": 0.9, "B": 0.82, "C": 0.77, "N": 0.7, "O": 0.66, "F": 0.611, "Na": 1.54, "Mg": 1.36,
    "Al": 1.18, "Si": 0.937, "P": 0.89, "S": 1.04, "Cl": 0.997, "K": 2.03, "Ca": 1.74, "Fe": 1.17, "Cu": 1.17,
    "Zn": 1.25, "Ge": 1.188, "As": 1.2, "Se": 1.17, "Br": 1.167, "Sn": 1.385, "Te": 1.378, "I": 1.387,
}
#: Van der Waals radii; volumes follow as 4/3 pi r^3.
VDW_RADIUS = {
    "H": 1.1, "Li": 1.82, "Be": 1.53, "B": 1.92, "C": 1.7, "N": 1.55, "O": 1.52, "F": 1.47, "Na": 2.27, "Mg": 1.73,
    "Al": 1.84, "Si": 2.1, "P": 1.8, "S": 1.8, "Cl": 1.75, "K": 2.75, "Ca": 2.31, "Ge": 2.11, "As": 1.85, "Se": 1.9,
    "Br": 1.85, "Sn": 2.17, "Te": 2.06, "I": 1.98,
}
#: Bondi radii of the volume model (elements outside void it).
BONDI_RADIUS = {"H": 1.2, "B": 2.13, "C": 1.7, "N": 1.55, "O": 1.52, "F": 1.47, "Si": 2.1, "P": 1.8, "S": 1.8, "Cl": 1.75, "As": 1.85, "Se": 1.9, "Br": 1.85}
#: First ionisation potentials.
IONISATION = {
    "H": 13.598443, "Li": 5.391719, "Be": 9.3227, "B": 8.29802, "C": 11.2603, "N": 14.5341, "O": 13.61805, "F": 17.4228,
    "Na": 5.139076, "Mg": 7.646235, "Al": 5.985768, "Si": 8.15168, "P": 10.48669, "S": 10.36001, "Cl": 12.96763,
    "K": 4.3406633, "Ca": 6.11316, "Ge": 7.89943, "As": 9.7886, "Se": 9.75239, "Br": 11.8138, "Sn": 7.34392, "I": 10.45126,
}
#: Polarizabilities (1994).
POLARIZABILITY = {
    "H": 0.666793, "Li": 24.33, "Be": 5.6, "B": 3.03, "C": 1.67, "N": 1.1, "O": 0.802, "F": 0.557, "Na": 24.11,
    "Mg": 10.6, "Al": 6.8, "Si": 5.53, "P": 3.63, "S": 2.9, "Cl": 2.18, "K": 43.06, "Ca": 22.8, "Ge": 5.84, "As": 4.31,
    "Se": 3.77, "Br": 3.05, "Sn": 7.84, "I": 5.35,
}
#: Sanderson, Pauling and Allred-Rochow electronegativities.
SANDERSON = {
    "H": 2.592, "Li": 0.67, "Be": 1.81, "B": 2.275, "C": 2.746, "N": 3.194, "O": 3.654, "F": 4.0, "Na": 0.56, "Mg": 1.318,
    "Al": 1.714, "Si": 2.138, "P": 2.515, "S": 2.957, "Cl": 3.475, "K": 0.445, "Ca": 0.946, "Ge": 2.618, "As": 2.816,
    "Se": 3.014, "Br": 3.219, "Sn": 2.298, "I": 2.778,
}
PAULING = {
    "H": 2.2, "Li": 0.98, "Be": 1.57, "B": 2.04, "C": 2.55, "N": 3.04, "O": 3.44, "F": 3.98, "Na": 0.93, "Mg": 1.31,
    "Al": 1.61, "Si": 1.9, "P": 2.19, "S": 2.58, "Cl": 3.16, "K": 0.82, "Ca": 1.0, "Ge": 2.01, "As": 2.18, "Se": 2.55,
    "Br": 2.96, "Sn": 1.96, "I": 2.66,
}
ALLRED_ROCHOW = {
    "H": 2.2, "Li": 0.97, "Be": 1.47, "B": 2.01, "C": 2.5, "N": 3.07, "O": 3.5, "F": 4.1, "Na": 1.01, "Mg": 1.23,
    "Al": 1.47, "Si": 1.74, "P": 2.06, "S": 2.44, "Cl": 2.83, "K": 0.91, "Ca": 1.04, "Ge": 2.02, "As": 2.2, "Se": 2.48,
    "Br": 2.74, "Sn": 1.72, "I": 2.21,
}
#: McGowan volumes.
MCGOWAN = {
    "C": 16.35, "N": 14.39, "O": 12.43, "F": 10.48, "H": 8.71, "Si": 26.83, "P": 24.87, "S": 22.91, "Cl": 20.95,
    "B": 18.32, "Ge": 31.02, "As": 29.42, "Se": 27.81, "Br": 26.21, "Sn": 39.35, "Te": 36.14, "I": 34.53,
}
#: Orbital electronegativity a + b q + c q^2 by element and
#: hybridisation (Gasteiger and Marsili 1980).
ORBITAL = {
    ("H", 0): (7.17, 6.24, -0.56), ("C", 3): (7.98, 9.18, 1.88), ("C", 2): (8.79, 9.32, 1.51), ("C", 1): (10.39, 9.45, 0.73),
    ("N", 3): (11.54, 10.82, 1.36), ("N", 2): (12.87, 11.15, 0.85), ("N", 1): (15.68, 11.7, -0.27),
    ("O", 3): (14.18, 12.92, 1.39), ("O", 2): (17.07, 13.79, 0.47), ("F", 0): (14.66, 13.85, 2.31), ("Cl", 0): (11.0, 9.69, 1.35),
    ("Br", 0): (10.08, 8.47, 1.16), ("I", 0): (9.9, 7.96, 0.96), ("S", 3): (10.14, 9.13, 1.38), ("S", 2): (10.14, 9.13, 1.38),
    ("P", 3): (8.9, 8.24, 0.96), ("P", 2): (8.9, 8.24, 0.96), ("Si", 3): (7.3, 6.56, 0.66), ("Si", 2): (7.9, 6.94, 0.7),
    ("B", 3): (5.98, 6.82, 1.605), ("B", 2): (6.42, 6.807, 1.322),
}
#: Valences that implicit hydrogens fill up to, smallest first.
VALENCES = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5, 7), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1, 3, 5)}

_NOBLE = (2, 10, 18, 36, 54, 86)


@cache
def period(z: int) -> int:
    """The row of the periodic table."""
    return 1 + sum(z > n for n in _NOBLE)


@cache
def outer(z: int) -> int:
    """Outer electrons: those past the last noble gas, without a full d or f shell."""
    if z <= 0:
        return 0
    n = z - max([0, *(g for g in _NOBLE if g < z)])
    row = period(z)
    if row in (4, 5) and n >= 12:
        return n - 10
    if row == 6:
        return n - 24 if n >= 26 else n - 14 if n >= 18 else n
    return n


def of(table: dict[str, float], z: int) -> float:
    return table.get(SYMBOLS[z], NAN) if 0 <= z < len(SYMBOLS) else NAN


def sphere(r: float) -> float:
    return 4.0 / 3.0 * math.pi * r**3
