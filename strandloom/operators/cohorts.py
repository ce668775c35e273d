"""Selections, paired statistics and masks over groups of records.

Groups may be of any size: what is needed of a group is aggregated, and only aggregates are sorted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from strandloom.functions.hashing import hash_number

#: Pairs up to which sign flips are counted exactly, and steps of the grid beyond.
HALVES, GRID = 40, 1 << 18


def closest_in_box(df: DataFrame, groups: list[str], key: str, value: str, low: float, high: float, target: float) -> DataFrame:
    """``df`` with ``status``: of each group the row nearest to ``target`` within [low, high] is selected, ties by key.

    The others are ``no_value``, ``outside_box`` or ``not_closest``. The pick is a map-side aggregation.
    """
    inside = F.col(value).between(low, high)
    distance = F.round(F.abs(F.col(value) - target), 9)
    picks = df.where(inside).groupBy(*groups).agg(F.min(F.struct(distance.alias("d"), F.col(key).alias("k"))).alias("_p")).select(*groups, F.col("_p.k").alias("_pick"))
    joined = df.join(picks, groups, "left")
    status = F.when(F.col(value).isNull(), "no_value").when(~inside, "outside_box").when(F.col(key) == F.col("_pick"), "selected").otherwise("not_closest")
    return joined.withColumn("status", status).drop("_pick")


def average_ranks(df: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the 0-based average rank of ``value`` in its group as ``out``; null values get none.

    Equal values are counted first; only the different values of a group are put in order.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rank = (F.coalesce(F.sum("_n").over(before), F.lit(0)) + (F.col("_n") - 1) / 2).alias(out)
    ranks = counts.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col(value).alias("_value"), rank)
    condition = F.col(value) == F.col("_value")
    for g in groups:
        condition = condition & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return df.join(ranks, condition, "left").select(*df.columns, out)


def guarded_correlation(x: str, y: str) -> Column:
    """Pearson correlation of two columns in a group; null without two rows or if one column is constant."""
    n = F.count("*")
    cov = F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.sum(y) / n
    vx, vy = F.sum(F.col(x) * F.col(x)) - F.sum(x) * F.sum(x) / n, F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y) / n
    return F.when((vx > 1e-9) & (vy > 1e-9), F.try_divide(cov, F.sqrt(F.abs(vx)) * F.sqrt(F.abs(vy))))


def rank_agreement(x: str, y: str) -> Column:
    """Correlation of two columns of ranks in a group; where one is constant, 1 if all are equal and else 0."""
    return F.when(F.count_if(F.col(x) != F.col(y)) == 0, 1.0).otherwise(F.coalesce(guarded_correlation(x, y), F.lit(0.0)))


def sign_flip_p(differences: DataFrame, groups: list[str]) -> DataFrame:
    """Two-sided sign-flip p-values of paired differences: ``groups, pairs, mean_difference, p_value``.

    ``differences`` has ``unit, d``; null differences are left out. Up to ``HALVES`` pairs all 2**n flips are counted
    exactly, by sorting the sums of two halves. Beyond that the distribution is that of differences rounded to
    ``GRID`` steps of their summed size: equal sizes are counted first, of which there can be some 700, and
    their characteristic function gives the distribution, so a group of any size stays small in its task.
    """
    held = differences.where("d is not null")
    facts = held.groupBy(*groups).agg(F.count("*").alias("pairs"), F.avg("d").alias("mean_difference"), F.sum(F.abs("d")).alias("_size"))
    keys = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]
    named = facts.select(*[F.col(g).alias(f"_{g}") for g in groups], "pairs", "_size")
    placed = held.join(named, keys)
    few = placed.where(F.col("pairs") <= HALVES).groupBy(*groups).agg(F.collect_list("d").alias("_d")).select(*groups, _flips_by_halves("_d").alias("p_value"))
    # Signed steps; a total of 0 makes every flip as extreme.
    step = F.when(F.col("_size") > 0, F.round(F.abs("d") / F.col("_size") * GRID)).otherwise(0).cast("long")
    many = placed.where(F.col("pairs") > HALVES).withColumn("_step", step).groupBy(*groups, "_step").agg(F.count("*").alias("_c"), F.sum(F.signum("d") * F.col("_step")).alias("_t"))
    far = many.groupBy(*groups).agg(F.collect_list("_step").alias("_steps"), F.collect_list("_c").alias("_counts"), F.sum("_t").alias("_sum")).select(*groups, _flips_on_a_grid("_steps", "_counts", "_sum").alias("p_value"))
    p = few.unionByName(far).select(*[F.col(g).alias(f"_{g}") for g in groups], "p_value")
    return facts.join(p, keys, "left").select(*groups, "pairs", "mean_difference", "p_value")


@F.pandas_udf(DoubleType())
def _flips_by_halves(lists: pd.Series) -> pd.Series:
    """The part of all sign flips whose sum is as far from 0 as the plain sum."""

    def sums(values: np.ndarray) -> np.ndarray:
        out = np.zeros(1)
        for v in values:
            out = np.concatenate([out + v, out - v])
        return np.sort(out)

    def p(values: list[float]) -> float:
        d = np.sort(np.asarray(values, float))
        left, right, reach = sums(d[::2]), sums(d[1::2]), abs(d.sum()) - 1e-12 * len(d)
        if reach <= 0:
            return 1.0
        near = np.searchsorted(right, reach - left, side="left") - np.searchsorted(right, -reach - left, side="right")
        return float(1 - near.sum() / (len(left) * len(right)))

    return lists.map(p)


@F.pandas_udf(DoubleType())
def _flips_on_a_grid(steps: pd.Series, counts: pd.Series, sums: pd.Series) -> pd.Series:
    """The same for whole steps, each with its count."""

    def p(step: np.ndarray, count: np.ndarray, total: float) -> float:
        step, count = np.asarray(step, np.int64), np.asarray(count, np.int64)
        size = 1 << int(2 * int((step * count).sum()) + 2).bit_length()
        turn = 2 * np.pi * np.arange(size // 2 + 1) / size
        wave = np.ones(len(turn))
        for s, c in zip(step.tolist(), count.tolist()):
            wave *= np.cos(turn * s) ** c
        chance = np.fft.irfft(wave, size)
        at = np.arange(size)
        at = np.minimum(at, size - at)
        return float(min(max(chance[at >= abs(int(round(total)))].sum(), 0.0), 1.0))

    return pd.Series([p(*x) for x in zip(steps, counts, sums)], dtype=float)


def benjamini_hochberg(tests: DataFrame, p: str, out: str) -> DataFrame:
    """``tests`` with adjusted p-values; null ones stay null. Only for tables of tests, which are results of aggregation."""
    ranked = tests.withColumn("_r", F.row_number().over(Window.orderBy(F.col(p).asc_nulls_last())))
    n = F.count(p).over(Window.partitionBy())
    raw = ranked.withColumn("_a", F.least(F.lit(1.0), F.col(p) * n / F.col("_r")))
    return raw.withColumn(out, F.when(F.col(p).isNotNull(), F.min("_a").over(Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)))).drop("_r", "_a")


def bootstrap_means(units: DataFrame, groups: list[str], replicates: int, seed: int) -> DataFrame:
    """Percentile intervals of group means: ``groups, units, mean, lower, upper``.

    ``units`` has ``unit, x``, one row per independent unit. Draw d of replicate r takes unit
    hash(seed:group:r:d) mod n in order of ``unit``, the same on any partitioning.
    """
    held = units.where("x is not null")
    numbered = held.withColumn("k", F.row_number().over(Window.partitionBy(*groups).orderBy("unit")) - 1)
    facts = held.groupBy(*groups).agg(F.count("*").alias("units"), F.avg("x").alias("mean"))
    draws = facts.select(*groups, "units", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("r")).select(*groups, "units", "r", F.explode(F.sequence(F.lit(1), F.col("units").cast("int"))).alias("i"))
    place = F.pmod(hash_number(F.concat_ws(":", F.lit(str(seed)), *groups, "r", "i")), F.col("units").cast("decimal(20,0)")).cast("int")
    means = draws.withColumn("k", place).join(numbered, [*groups, "k"]).groupBy(*groups, "r").agg(F.avg("x").alias("m"))
    bounds = means.groupBy(*groups).agg(F.percentile("m", F.lit(0.025)).alias("lower"), F.percentile("m", F.lit(0.975)).alias("upper"))
    return facts.join(bounds, groups)


def state_aggregates(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Per id over its states: weighted mean, least score and weighted population variance.

    ``scores`` has ``id, state, score``, ``weights`` has ``state, weight``; weights are normalised to 1. Ids that
    lack a state are left out.
    """
    whole = Window.partitionBy()
    share = weights.select("state", (F.col("weight") / F.sum("weight").over(whole)).alias("w"), F.count("*").over(whole).alias("_states"))
    joined = scores.join(share, "state")
    # An id has one score a state, so its list is as short as the table of weights.
    per = joined.groupBy("id").agg(F.sum(F.col("w") * F.col("score")).alias("weighted_mean"), F.min("score").alias("least"), F.collect_list(F.struct("w", "score")).alias("_l"), F.count("*").alias("_n"), F.max("_states").alias("_states"))
    spread = F.aggregate("_l", F.lit(0.0), lambda t, x: t + x["w"] * (x["score"] - F.col("weighted_mean")) * (x["score"] - F.col("weighted_mean")))
    return per.where("_n = _states").select("id", "weighted_mean", "least", spread.alias("variance"))


def mask_kinds(members: DataFrame) -> DataFrame:
    """``scaffold, position, kind`` of distinct ``scaffold, state, position``: in all states of the scaffold, or in some."""
    states = members.groupBy("scaffold").agg(F.count_distinct("state").alias("states"))
    per = members.groupBy("scaffold", "position").agg(F.count_distinct("state").alias("n"))
    return per.join(states, "scaffold").select("scaffold", "position", F.col("n").alias("in_states"), F.when(F.col("n") == F.col("states"), "intersection").otherwise("variable").alias("kind"))


def consensus(pairs: DataFrame, target: float) -> DataFrame:
    """Two designs of one parent merged: ``pair_id, sequence, agreement, matches, kept``.

    ``pairs`` has ``pair_id, parent, first, second`` of one length. Agreements stay. Where just one design
    has the parent's residue the other's is taken, and the parent's comes back at the places with the
    greatest gain in confidence until ``target`` of all places match (rounded half to even). Elsewhere
    the more confident design wins, the first on ties. Confidences are those in ``first_confidence`` and
    ``second_confidence``, one number a place; where ``pairs`` lacks these columns they are draws by hash.
    """
    given = {"first_confidence", "second_confidence"} <= set(pairs.columns)
    told = ["first_confidence", "second_confidence"] if given else []
    long = pairs.select("pair_id", F.length("parent").alias("n"), "parent", "first", "second", *told, F.explode(F.sequence(F.lit(1), F.length("parent"))).alias("i"))

    def confidence(side: str) -> Column:
        if given:
            return F.try_element_at(f"{side}_confidence", F.col("i"))
        return F.pmod(hash_number(F.concat_ws(":", F.lit(side), "pair_id", "i")), F.lit(1000).cast("decimal(20,0)")).cast("int")

    cut = lambda c: F.substring(c, F.col("i"), F.lit(1))
    cells = long.select("pair_id", "n", "i", cut("parent").alias("p"), cut("first").alias("a"), cut("second").alias("b"), confidence("first").alias("ca"), confidence("second").alias("cb"))
    same, one, two = F.col("a") == F.col("b"), F.col("a") == F.col("p"), F.col("b") == F.col("p")
    switchable = ~same & (one | two)
    base = cells.withColumn("token", F.when(same, F.col("a")).when(one, F.col("b")).when(two, F.col("a")).when(F.col("ca") >= F.col("cb"), F.col("a")).otherwise(F.col("b")))
    base = base.withColumn("gain", F.when(switchable, F.when(one, F.col("ca") - F.col("cb")).otherwise(F.col("cb") - F.col("ca"))))
    order = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.col("gain").desc_nulls_last(), "i"))
    whole = Window.partitionBy("pair_id")
    wanted = F.bround(F.col("n") * target).cast("int") - F.sum((F.col("token") == F.col("p")).cast("int")).over(whole)
    done = base.withColumn("rank", order).withColumn("wanted", wanted)
    back = F.col("gain").isNotNull() & (F.col("rank") <= F.col("wanted"))
    final = done.withColumn("back", back).withColumn("token", F.when(back, F.col("p")).otherwise(F.col("token")))
    return final.groupBy("pair_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda x: x["token"]), "").alias("sequence"),
        F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 6).alias("agreement"),
        F.sum((F.col("token") == F.col("p")).cast("int")).alias("matches"),
        F.sum(F.col("back").cast("int")).alias("kept"),
    )
