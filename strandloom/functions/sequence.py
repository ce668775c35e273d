"""Column functions on sequences (one text column in, one value out; null in gives null out)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the standard amino acids.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def letters(text: Column) -> Column:
    """The letters A-Z of a text alone, in upper case."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


def normal_rna(text: Column) -> Column:
    """A nucleotide text without blanks, in upper case, with U for T."""
    return F.translate(F.upper(F.regexp_replace(text, r"\s", "")), "T", "U")


def reverse_complement(rna: Column) -> Column:
    """The reverse complement; other letters than ACGUN stay as they are."""
    return F.reverse(F.translate(rna, "ACGUN", "UGCAN"))


def invalid_symbols(sequence: Column) -> Column:
    """The symbols of a sequence that are no standard amino acid, sorted; empty for a clean one."""
    odd = F.regexp_replace(F.upper(sequence), f"[{AMINO_ACIDS}]", "")
    return F.array_sort(F.array_distinct(F.filter(F.split(odd, ""), lambda x: x != "")))


def tokens(sequence: Column) -> Column:
    """The letters of a sequence as an array; empty for an empty one."""
    return F.filter(F.split(sequence, ""), lambda x: x != "")


def count_of(sequence: Column, symbols: str) -> Column:
    """How many letters of a sequence are among ``symbols``."""
    return F.length(F.regexp_replace(sequence, f"[^{symbols}]", ""))


def net_charge(sequence: Column) -> Column:
    """(K and R less D and E) per letter; null for an empty sequence."""
    return F.try_divide(count_of(sequence, "KR") - count_of(sequence, "DE"), F.length(sequence))


def hydrophobicity(sequence: Column) -> Column:
    """The part of hydrophobic letters; null for an empty sequence."""
    return F.try_divide(count_of(sequence, "AVILMFWY"), F.length(sequence))


def letter_counts(sequence: Column, symbols: str) -> Column:
    """How often each of ``symbols`` stands in a sequence, in their order."""
    each = F.array(*map(F.lit, symbols))
    return F.transform(each, lambda a: F.length(sequence) - F.length(F.replace(sequence, a)))


def entropy(sequence: Column) -> Column:
    """Shannon entropy of a sequence's letters A-Z in nats; null for an empty sequence."""
    n = F.length(sequence)
    held = F.filter(letter_counts(sequence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), lambda c: c > 0)
    return F.when(n > 0, F.aggregate(held, F.lit(0.0), lambda s, c: s - (c / n) * F.ln(c / n)))


def composition_deviation(left: Column, right: Column) -> Column:
    """Half the summed differences of the amino acids' frequencies; null if a sequence is empty."""
    terms = F.zip_with(letter_counts(left, AMINO_ACIDS), letter_counts(right, AMINO_ACIDS), lambda x, y: F.abs(x / F.length(left) - y / F.length(right)))
    return F.when((F.length(left) > 0) & (F.length(right) > 0), F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2)


def matches(left: Column, right: Column) -> Column:
    """How many places two sequences agree in; null for unequal lengths."""
    same = F.zip_with(tokens(left), tokens(right), lambda x, y: (x == y).cast("int"))
    return F.when(F.length(left) == F.length(right), F.aggregate(same, F.lit(0), lambda s, x: s + x))


def identity(left: Column, right: Column) -> Column:
    """The part of places two sequences of one length agree in; null for unequal or no length."""
    return F.when(F.length(left) > 0, matches(left, right) / F.length(left))


def aligned_identity(left: Column, right: Column) -> Column:
    """Identity over places where neither aligned row has a gap; 0 without such a place, null for unequal lengths."""
    pairs = F.filter(F.arrays_zip(tokens(left).alias("x"), tokens(right).alias("y")), lambda p: (p["x"] != "-") & (p["y"] != "-"))
    same = F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))
    return F.when(F.length(left) == F.length(right), F.coalesce(F.try_divide(same, F.size(pairs)), F.lit(0.0)))


def designed_identity(left: Column, right: Column, fixed: Column) -> Column:
    """Identity over the places (from 0) not in ``fixed``; null for unequal lengths, null ``fixed`` or no such place.

    The agreements of all places less those of the fixed ones, so the work grows with the length alone.
    """
    same = F.zip_with(tokens(left), tokens(right), lambda x, y: (x == y).cast("int"))
    held = F.filter(F.array_distinct(fixed), lambda i: (i >= 0) & (i < F.length(left)))
    marked = F.array_sort(F.transform(held, lambda i: i + 1))
    fixed_same = F.aggregate(F.transform(marked, lambda i: (F.substring(left, i, F.lit(1)) == F.substring(right, i, F.lit(1))).cast("int")), F.lit(0), lambda s, x: s + x)
    total = F.aggregate(same, F.lit(0), lambda s, x: s + x)
    return F.when((F.length(left) == F.length(right)) & (F.length(left) > 0), F.try_divide(total - fixed_same, F.length(left) - F.size(held)))


def longest_homopolymer(sequence: Column) -> Column:
    """The length of the longest run of one letter; 0 for an empty sequence."""
    runs = F.regexp_extract_all(sequence, F.lit(r"((.)\2*)"), 1)
    return F.when(sequence == "", 0).otherwise(F.array_max(F.transform(runs, F.length)))


def low_complexity_windows(sequence: Column, window: int, fraction: float) -> Column:
    """Starts (from 0) of windows in which one amino acid makes more than ``fraction``; none for shorter sequences, null for null.

    Sliding counts come from running sums, in Arrow batches; as Catalyst expressions each window would be
    searched once for every amino acid.
    """
    known = np.frombuffer(AMINO_ACIDS.encode(), np.uint8)[:, None]

    @F.pandas_udf("array<int>")
    def find(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            if text is None or len(text) < window:
                out.append(None if text is None else [])
                continue
            sums = np.cumsum(known == np.frombuffer(text.encode("latin-1", "replace"), np.uint8), axis=1, dtype=np.int32)
            counts = sums[:, window - 1 :].copy()
            counts[:, 1:] -= sums[:, :-window]
            out.append(np.flatnonzero(counts.max(axis=0) > fraction * window + 1e-9).tolist())
        return pd.Series(out, dtype=object)

    return find(sequence)


def safe_label(text: Column) -> Column:
    """A lower-case label of letters, digits and single hyphens; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(""))
