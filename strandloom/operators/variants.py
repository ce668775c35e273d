"""Mutation notations applied to sequences, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import letters
from strandloom.operators.packed import split_unquoted

# Three-letter names of the amino acids, in the order of their one-letter names.
_THREE = dict(zip("Ala Cys Asp Glu Phe Gly His Ile Lys Leu Met Asn Pro Gln Arg Ser Thr Val Trp Tyr".split(), "ACDEFGHIKLMNPQRSTVWY"))
_POINT = r"^(?:p\.)?[A-Z]\d+[A-Z]$"
# The notations of a change of one residue, a deletion and an insertion.
_NOTATIONS = {"point": r"^(?:p\.)?([A-Z][a-z]{2}|[A-Z])(\d{1,9})([A-Z][a-z]{2}|[A-Z])$", "cut": r"^(?:p\.)?del(\d{1,9})-(\d{1,9})$", "insert": r"^(?:p\.)?ins(\d{1,9})_(\d{1,9}):([A-Z]+)$"}


def point_positions(df: DataFrame, mutation: str = "mutation") -> DataFrame:
    """``df`` with ``changes`` and, for point changes alone, ``positions`` from 0 joined by commas, else null."""
    parts = split_unquoted(F.col(mutation))
    points: Column = F.transform("_parts", lambda x: (F.regexp_extract(x, r"\d+", 0).cast("int") - 1).cast("string"))
    return df.withColumn("_parts", parts).select(
        *[c for c in df.columns if c != mutation],
        F.size("_parts").alias("changes"),
        F.when((F.size("_parts") > 0) & F.forall("_parts", lambda x: x.rlike(_POINT)), F.array_join(points, ",")).alias("positions"),
    )


def _one_letter(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in _THREE.items() for x in pair])
    return F.when(F.length(name) == 1, name).otherwise(F.coalesce(F.element_at(known, name), name))


def _change(text: Column) -> Column:
    """A change as a struct: its kind, first and last place (from 1), the residue it expects and the letters it puts there."""
    group = lambda kind, i: F.regexp_extract(text, _NOTATIONS[kind], i)
    is_kind = {kind: text.rlike(pattern) for kind, pattern in _NOTATIONS.items()}
    number = lambda c: F.nullif(c, F.lit("")).cast("int")
    return F.struct(
        F.when(is_kind["point"], "point").when(is_kind["cut"], "cut").when(is_kind["insert"], "insert").alias("kind"),
        F.when(is_kind["point"], number(group("point", 2))).when(is_kind["cut"], number(group("cut", 1))).otherwise(number(group("insert", 1))).alias("start"),
        F.when(is_kind["point"], number(group("point", 2))).when(is_kind["cut"], number(group("cut", 2))).otherwise(number(group("insert", 2))).alias("end"),
        F.when(is_kind["point"], _one_letter(group("point", 1))).alias("old"),
        F.when(is_kind["point"], _one_letter(group("point", 3))).otherwise(group("insert", 3)).alias("new"),
    )


def mutated(sequence: Column, changes: Column) -> tuple[Column, Column]:
    """The sequence with an array of changes, and what is wrong with them; one of the two is null. Places count from 1.

    Changes are of one kind: points, of which the last at a place counts, deletions that do not overlap, or one insertion.
    """
    told = F.transform(changes, _change)
    size = F.length(sequence)
    count = lambda kind: F.size(F.filter(told, lambda c: c["kind"] == kind))
    cuts = F.array_sort(F.transform(told, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))))
    error = (
        F.when(sequence.isNull(), "no wild type")
        .when(F.size(changes) == 0, "no change")
        .when(F.exists(told, lambda c: c["kind"].isNull()), "unsupported notation")
        .when(F.exists(told, lambda c: (c["kind"] == "point") & ~c["start"].between(1, size)), "place outside the sequence")
        .when(F.exists(told, lambda c: (c["kind"] == "point") & (F.substring(sequence, c["start"], 1) != c["old"])), "other residue at the place")
        .when(F.exists(told, lambda c: (c["kind"] == "cut") & ~((c["start"] >= 1) & (c["start"] <= c["end"]) & (c["end"] <= size))), "deletion outside the sequence")
        .when(F.exists(told, lambda c: (c["kind"] == "insert") & ((c["end"] != c["start"] + 1) | (c["start"] > size))), "insertion between places that are no neighbours")
        .when((count("point") < F.size(told)) & (count("cut") < F.size(told)) & (count("insert") < F.size(told)) | (count("insert") > 1), "kinds of change mixed")
        .when((count("cut") > 1) & F.exists(F.sequence(F.lit(1), F.size(told) - 1), lambda i: cuts[i]["start"] <= cuts[i - 1]["end"]), "deletions overlap")
    )
    points = F.aggregate(told, sequence, lambda s, c: F.overlay(s, c["new"], c["start"], F.lit(1)))
    # From the last deletion to the first, so that places still hold.
    shorter = F.aggregate(F.reverse(cuts), sequence, lambda s, c: F.concat(F.substring(s, F.lit(1), c["start"] - 1), F.substring(s, c["end"] + 1, F.length(s))))
    longer = F.concat(F.substring(sequence, F.lit(1), told[0]["start"]), told[0]["new"], F.substring(sequence, told[0]["start"] + 1, size))
    return F.when(error.isNull(), F.when(count("point") > 0, points).when(count("cut") > 0, shorter).otherwise(longer)), error


def applied(df: DataFrame) -> DataFrame:
    """``variant_id, mutant, error, agrees``: the notation applied to the wild type.

    A null wild type or no change at all is an error. ``agrees`` compares letters with the given mutant and is
    null where either is missing.
    """
    held = df.select("variant_id", letters(F.col("wt_sequence")).alias("_wild"), split_unquoted(F.col("mutation")).alias("_parts"), letters(F.col("full_mutant_sequence")).alias("_given"))
    mutant, error = mutated(F.col("_wild"), F.col("_parts"))
    return held.select("variant_id", mutant.alias("mutant"), error.alias("error"), "_given").select("variant_id", "mutant", "error", (F.col("mutant") == F.col("_given")).alias("agrees"))
