"""Proposals and scores from column profiles and matched random mutation; every draw is a hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.hashing import hash_fraction, hash_number
from strandloom.functions.sequence import AMINO_ACIDS, tokens
from strandloom.operators.columns import cells


def profile(rows: DataFrame) -> DataFrame:
    """``aln, column, token, f``: plain token frequencies of alignment columns, gaps left out."""
    counts = cells(rows).where("token <> '-'").groupBy("aln", "column", "token").agg(F.count("*").alias("c"))
    return counts.select("aln", "column", "token", (F.col("c") / F.sum("c").over(Window.partitionBy("aln", "column"))).alias("f"))


def profile_scores(rows: DataFrame, frequencies: DataFrame, least: float = 1e-3) -> DataFrame:
    """``aln, row_id, total, mean, perplexity`` of log-frequencies; tokens that a column lacks count as ``least``."""
    joined = cells(rows).where("token <> '-'").join(frequencies, ["aln", "column", "token"], "left")
    logs = joined.withColumn("lp", F.ln(F.greatest(F.coalesce("f", F.lit(0.0)), F.lit(least))))
    return logs.groupBy("aln", "row_id").agg(F.sum("lp").alias("total"), F.avg("lp").alias("mean"), F.exp(-F.avg("lp")).alias("perplexity"))


def profile_samples(frequencies: DataFrame, samples: int, seed: int) -> DataFrame:
    """``aln, sample, seq``: sequences drawn column by column from the frequencies, by inverse distribution in order of token."""
    upto = Window.partitionBy("aln", "column").orderBy("token")
    steps = frequencies.withColumn("top", F.sum("f").over(upto)).groupBy("aln", "column").agg(F.array_sort(F.collect_list(F.struct("top", "token"))).alias("steps"))
    each = steps.select("aln", "column", "steps", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    u = hash_fraction(F.concat_ws(":", F.lit(str(seed)), "aln", "sample", "column"))
    # Sums of floats may end just under 1; the last token takes what is left.
    drawn = each.withColumn("u", u).withColumn("token", F.coalesce(F.filter("steps", lambda s: s["top"] - 1e-12 > F.col("u"))[0]["token"], F.element_at("steps", -1)["token"]))
    return drawn.groupBy("aln", "sample").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", "token"))), lambda x: x["token"]), "").alias("seq"))


def random_mutants(df: DataFrame, key: str, sequence: str, rate: float, seed: int, fixed: str | None = None) -> DataFrame:
    """``key, mutant, changed``: each place that is not fixed is changed with chance ``rate`` to another amino acid.

    Whether and to what comes from hashes of seed, key and place. Null sequences give null mutants, empty ones
    empty. ``fixed`` names an array of places (from 0) that stay.
    """
    held = F.coalesce(F.col(fixed), F.array().cast("array<int>")) if fixed else F.array().cast("array<int>")

    def token(t: Column, i: Column) -> Column:
        place = F.concat_ws(":", F.lit(str(seed)), F.col(key), i.cast("string"))
        others = F.replace(F.lit(AMINO_ACIDS), t)
        pick = F.pmod(hash_number(F.concat(F.lit("to:"), place)), F.length(others).cast("decimal(20,0)")).cast("int")
        turn = (hash_fraction(F.concat(F.lit("if:"), place)) < rate) & ~F.array_contains(held, i)
        return F.when(turn, F.substring(others, pick + 1, F.lit(1))).otherwise(t)

    new = F.transform(tokens(F.col(sequence)), token)
    changed = F.size(F.filter(F.arrays_zip(tokens(F.col(sequence)).alias("a"), F.col("_new").alias("b")), lambda p: p["a"] != p["b"]))
    return df.withColumn("_new", new).select(key, F.array_join("_new", "").alias("mutant"), F.when(F.col(sequence).isNotNull(), changed).alias("changed"))
