"""The residue alphabet and lookups built from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The twenty residue letters in alphabetical order, the letter
# order of published substitution-score files, and the three-letter names.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
SCORE_FILE_ORDER = "ARNDCQEGHILKMFPSTWYV"
THREE_LETTER = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C",
    "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P",
    "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
GAP = "#"
MASK = "<mask>"


def letter_index(letter: Column) -> Column:
    """1-based place of a letter in the alphabet, 0 when it is foreign."""
    return F.coalesce(F.instr(F.lit(AMINO_ACIDS), letter), F.lit(0)) * F.when(
        F.length(letter) == 1, 1
    ).otherwise(0)


def is_letter(letter: Column) -> Column:
    return letter.isin(*AMINO_ACIDS)
