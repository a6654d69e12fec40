"""Column functions on genotype arrays, allele letters and chromosome labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC letter of each unordered pair of bases.
IUPAC = {"AA": "A", "CC": "C", "GG": "G", "TT": "T", "AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K"}
#: Numbers of the named chromosomes.
CHROMOSOMES = {"X": 23, "Y": 24, "XY": 25, "MT": 26}
MISSING = ("NA", "NaN", "N", "*", "?", "")


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def to_iupac(a: Column, b: Column) -> Column:
    """One letter for two bases in either order; null for anything else."""
    return F.try_element_at(_map(IUPAC), F.concat(F.least(a, b), F.greatest(a, b)))


def from_iupac(letter: Column) -> Column:
    """Two bases of a letter; null for an unknown one."""
    return F.try_element_at(_map({v: k for k, v in IUPAC.items()}), letter)


def chromosome(label: Column) -> Column:
    """Number of a label such as 7, chr7, Chr7, X; null if it has none."""
    bare = F.regexp_replace(label, "^[cC]hr", "")
    return F.coalesce(F.try_element_at(_map(CHROMOSOMES), F.upper(bare)), bare.try_cast("int"))


def known(g: Column) -> Column:
    return F.filter(g, lambda x: x.isNotNull() & ~F.isnan(x))


def total(g: Column) -> Column:
    return F.aggregate(known(g), F.lit(0.0), lambda s, x: s + x)


def frequency(g: Column, scale: float = 2.0) -> Column:
    """Allele frequency over the samples that have a value; null if none has."""
    n = F.size(known(g))
    return F.when(n > 0, total(g) / (F.lit(scale) * n))


def folded(frequency_: Column) -> Column:
    return F.when(frequency_ >= 0.5, 1 - frequency_).otherwise(frequency_)


def varies(g: Column) -> Column:
    """Do the known values of an array differ?"""
    return F.array_min(known(g)) < F.array_max(known(g))


def impute_mean(g: Column) -> Column:
    """Missing values replaced by the mean of the others (0 if all are missing)."""
    mean = F.coalesce(total(g) / F.nullif(F.size(known(g)), F.lit(0)), F.lit(0.0))
    return F.transform(g, lambda x: F.when(x.isNull() | F.isnan(x), mean).otherwise(x))


def import_minor_count(g: Column) -> Column:
    """Minor count at import: min of the zeros and the ones and twos, after int(x + 0.1)."""
    codes = F.transform(known(g), lambda x: F.floor(x + 0.1))
    zeros = F.size(F.filter(codes, lambda x: x == 0))
    return F.least(zeros, F.size(F.filter(codes, lambda x: (x == 1) | (x == 2)))).cast("long")


# --- packed calls: four to a byte, the first in its lowest bits ---

#: Code of a missing call.
UNKNOWN = 3


def packed(g: np.ndarray) -> np.ndarray:
    """Bytes of rows of calls (0, 1, 2, or NaN for missing), two bits a call; the last byte of a row
    is filled up with missing ones.  Other values are an error."""
    code = np.where(np.isnan(g), UNKNOWN, g)
    if not np.isin(code, (0, 1, 2, UNKNOWN)).all() or (g == UNKNOWN).any():
        raise ValueError("only the calls 0, 1, 2 and missing can be packed")
    wide = np.full((len(g), -(-g.shape[1] // 4) * 4), UNKNOWN, np.uint8)
    wide[:, : g.shape[1]] = code
    four = wide.reshape(len(g), -1, 4)
    return four[:, :, 0] | four[:, :, 1] << 2 | four[:, :, 2] << 4 | four[:, :, 3] << 6


_CALLS = np.array([[(b >> s) & 3 for s in (0, 2, 4, 6)] for b in range(256)], float)
_CALLS[_CALLS == UNKNOWN] = np.nan


def unpacked(codes: np.ndarray) -> np.ndarray:
    """Calls of rows of packed bytes (NaN: missing), with what the last byte was filled up with."""
    return _CALLS[codes].reshape(len(codes), -1)
