"""Joins with gates, restored and projected sequences, numbering of residues, and checks of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequence import AMINO_ACIDS
from strandloom.operators.pairwise import aligned_pairs
from strandloom.sources.text_files import check_unique


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of annotations; fails at once if a key stands twice on the right. Null keys meet nothing."""
    return left.join(check_unique(right.dropna(subset=keys), *keys), keys, "left")


def complete_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which every left row must have a partner; the first key without one fails at once."""
    lone = left.join(right.select(*keys), keys, "left_anti").select(*keys).first()
    if lone is not None:
        raise ValueError(f"no partner for {lone.asDict()}")
    return left.join(right, keys)


def proposal_seed(block: Column, index: Column) -> Column:
    """The seed of a proposal of a block: a million apart; a negative block or number fails."""
    wrong = F.raise_error(F.lit("a negative seed block or proposal number")).cast("long")
    return F.when((block < 0) | (index < 0), wrong).otherwise(block.cast("long") + index.cast("long") * 1_000_000)


def restored(sequence: Column, source: Column, places: Column) -> Column:
    """``sequence`` with the letters of ``source`` at ``places`` (from 0); places outside either are left as they are."""
    inside = F.filter(F.coalesce(places, F.array().cast("array<int>")), lambda i: (i >= 0) & (i < F.least(F.length(sequence), F.length(source))))
    return F.aggregate(F.array_distinct(inside), sequence, lambda s, i: F.overlay(s, F.substring(source, i + 1, F.lit(1)), i + 1, F.lit(1)))


def projected(sequence: Column, places: Column) -> Column:
    """The letters of ``sequence`` at ``places`` (from 0), in order of place; places outside are left out, null gives null."""
    inside = F.array_sort(F.array_distinct(F.filter(places, lambda i: (i >= 0) & (i < F.length(sequence)))))
    return F.when(sequence.isNotNull(), F.array_join(F.transform(inside, lambda i: F.substring(sequence, i + 1, F.lit(1))), ""))


def numbered_residues(chains: DataFrame, least: float = 0.95) -> DataFrame:
    """``id, strategy, mapping``: where each residue of a chain stands in its full sequence (from 0), null where nowhere.

    ``chains`` has ``id, reference, sequence, numbers array<int>, icodes array<string>``. The author's numbers are taken if
    they are unique, without insertion codes, inside the reference, and agree with it at ``least`` of the residues;
    else the two are aligned. A null or empty side has a null mapping; lists of another length than the chain fail.
    """
    from strandloom.sources.text_files import gate

    held = gate(chains.select("id", "reference", "sequence", "numbers", "icodes"), "length(sequence) <> size(numbers) or length(sequence) <> size(icodes)", "numbers and residues of a chain do not match")
    n = F.length("sequence")
    valid = (F.size(F.array_distinct("numbers")) == n) & ~F.exists("icodes", lambda c: F.coalesce(c, F.lit("")) != "") & ~F.exists("numbers", lambda x: (x < 1) | (x > F.length("reference")))
    same = F.aggregate(F.transform("numbers", lambda x, i: (F.substring("reference", x, F.lit(1)) == F.substring("sequence", i + 1, F.lit(1))).cast("int")), F.lit(0), lambda s, x: s + x)
    marked = held.withColumn("own", F.coalesce((n > 0) & valid & (F.try_divide(same, n) >= least), F.lit(False)))
    own = marked.where("own").select("id", F.lit("validated_author_residue_number").alias("strategy"), F.transform("numbers", lambda x: x - 1).alias("mapping"))
    rest = marked.where(~F.col("own")).select("id", "sequence", "reference")
    aligned = aligned_pairs(rest, "id", "sequence", "reference").select("id", F.lit("global_sequence_alignment").alias("strategy"), F.when(F.size("mapping") > 0, F.col("mapping")).alias("mapping"))
    return own.unionByName(aligned)


def chain_slots(residues: DataFrame) -> DataFrame:
    """``chain, number, icode, slot``: residues of a chain in dense slots from 0; a number that is missing between two has an empty one.

    ``residues`` has ``chain, number, icode``; insertion codes of a number follow each other. A chain bounds a group.
    """
    ends = residues.groupBy("chain").agg(F.min("number").alias("low"), F.max("number").alias("high"))
    every = ends.select("chain", F.explode(F.sequence("low", "high")).alias("number"))
    filled = every.join(residues.select("chain", "number", F.coalesce("icode", F.lit("")).alias("icode")), ["chain", "number"], "left")
    slot = F.row_number().over(Window.partitionBy("chain").orderBy("number", "icode")) - 1
    return filled.withColumn("slot", slot).where("icode is not null")


def request_problems(requests: DataFrame) -> DataFrame:
    """``candidate_id, problems``: what is wrong with candidates, in order; those without a problem have no row.

    ``requests`` has ``candidate_id, sequence, parent_sequence, fixed_positions, is_mock, evidence_level`` with letters alone.
    Without a parent every fixed place is outside.
    """
    held = F.filter("fixed_positions", lambda i: (i >= 0) & (i < F.length("parent_sequence")))
    changed = F.exists(held, lambda i: F.substring("sequence", i + 1, F.lit(1)) != F.substring("parent_sequence", i + 1, F.lit(1)))
    problems = F.array_compact(
        F.array(
            F.when(F.coalesce("candidate_id", F.lit("")) == "", "no_id"),
            F.when(F.coalesce("sequence", F.lit("")) == "", "no_sequence").when(F.col("sequence").rlike(f"[^{AMINO_ACIDS}]"), "noncanonical_amino_acid"),
            F.when(F.coalesce(F.length("sequence") != F.length("parent_sequence"), F.lit(True)), "length_differs_from_parent"),
            F.when(F.coalesce(F.size(held) < F.size("fixed_positions"), F.lit(False)), "fixed_position_outside"),
            F.when(F.coalesce(changed, F.lit(False)), "fixed_position_changed"),
            F.when(F.col("is_mock") & (F.col("evidence_level") > 0), "mock_with_evidence"),
        )
    )
    return requests.select("candidate_id", problems.alias("problems")).where(F.size("problems") > 0)
