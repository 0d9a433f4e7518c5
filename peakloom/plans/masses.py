"""Monoisotopic masses of formulas, residues and fragment ions."""

from __future__ import annotations

import re

# Monoisotopic masses of the elements (u).
ELEMENTS = {
    "H": 1.00782503207, "C": 12.0, "N": 14.0030740048, "O": 15.99491461956, "F": 18.99840322, "Na": 22.9897692809,
    "Mg": 23.9850417, "Si": 27.9769265325, "P": 30.97376163, "S": 31.972071, "Cl": 34.96885268, "K": 38.96370668,
    "Ca": 39.96259098, "Fe": 55.9349375, "Cu": 62.9295975, "Zn": 63.9291422, "Se": 79.9165213, "Br": 78.9183371, "I": 126.904473,
}
# Compositions of the amino-acid residues.
RESIDUES = {
    "G": "C2H3NO", "A": "C3H5NO", "S": "C3H5NO2", "P": "C5H7NO", "V": "C5H9NO", "T": "C4H7NO2", "C": "C3H5NOS",
    "L": "C6H11NO", "I": "C6H11NO", "N": "C4H6N2O2", "D": "C4H5NO3", "Q": "C5H8N2O2", "K": "C6H12N2O", "E": "C5H7NO3",
    "M": "C5H9NOS", "H": "C6H7N3O", "F": "C9H9NO", "R": "C6H12N4O", "Y": "C9H9NO2", "W": "C11H10N2O",
}
PROTON = 1.00727646677


def formula_mass(formula: str) -> float:
    parts = re.findall(r"([A-Z][a-z]?)(\d*)", formula)
    if "".join(e + n for e, n in parts) != formula or any(e not in ELEMENTS for e, _ in parts):
        raise ValueError(f"unknown formula: {formula}")
    return sum(ELEMENTS[e] * int(n or 1) for e, n in parts)


def residue_mass(sequence: str) -> float:
    return sum(formula_mass(RESIDUES[r]) for r in sequence)


def ion_mz(sequence: str, charge: int = 1, ion: str = "M") -> float:
    """m/z of a peptide (M) or of its a, b, c, x, y, z ion."""
    body = residue_mass(sequence)
    water, ammonia, carbonyl = formula_mass("H2O"), formula_mass("NH3"), formula_mass("CO")
    mass = {"M": body + water, "b": body, "a": body - carbonyl, "c": body + ammonia, "y": body + water, "x": body + water + carbonyl - 2 * ELEMENTS["H"], "z": body + water - ammonia}[ion]
    return (mass + charge * PROTON) / charge
