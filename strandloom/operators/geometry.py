"""Distances, contacts, chain breaks, superposition and Pareto fronts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distance(a: str, b: str) -> Column:
    """Euclidean distance of two points in struct columns with x, y and z."""
    return F.sqrt(sum(((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) ** 2 for c in "xyz"), F.lit(0.0)))


def near_points(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """``l, r, d``: points of the two tables (``id, x, y, z``) no further apart than ``radius``.

    Space is cut into cubes of ``radius``; each right point goes to the 27 cubes around its own, as far as left points
    are there, so the range join becomes an equi-join. Cubes with very many left points are salted. Points with a null
    coordinate are near to none.
    """
    from strandloom.operators.skew import spread_join
    from strandloom.session import materialize

    place = lambda shift: F.struct(*[(F.floor(F.col(c) / radius) + s).alias(c) for c, s in zip("xyz", shift)])
    held = "x is not null and y is not null and z is not null"
    at = F.struct("id", "x", "y", "z")
    l = left.where(held).select(at.alias("a"), place((0, 0, 0)).alias("cell"))
    counts = materialize(l.groupBy("cell").agg(F.count("*").alias("n")), "cell-counts")
    around = F.array(*[place((i, j, k)) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    r = right.where(held).select(at.alias("b"), F.explode(around).alias("cell")).join(counts, "cell")
    return spread_join(l, r, "cell", "n", sizes=counts).withColumn("d", distance("a", "b")).where(F.col("d") <= radius).select(F.col("a.id").alias("l"), F.col("b.id").alias("r"), "d")


def contacts(protein: DataFrame, rna: DataFrame, direct: float, shell: float) -> DataFrame:
    """Each residue of ``protein`` with its least distance to ``rna`` within ``shell`` and the chains in direct contact.

    Atoms have ``id, residue, x, y, z`` and ``id, chain, x, y, z``. Residues without an atom in reach have a null
    distance and neither contact. Direct is up to ``direct``; second shell is beyond that, up to ``shell``.
    """
    near = near_points(protein, rna, shell)
    told = near.join(protein.select(F.col("id").alias("l"), "residue"), "l").join(rna.select(F.col("id").alias("r"), "chain"), "r")
    per = told.groupBy("residue").agg(F.min("d").alias("least"), F.array_sort(F.collect_set(F.when(F.col("d") <= direct, F.col("chain")))).alias("chains"))
    every = protein.select("residue").distinct().join(per, "residue", "left")
    return every.select("residue", F.round("least", 6).alias("least_distance"), F.coalesce(F.col("least") <= direct, F.lit(False)).alias("direct"), F.coalesce((F.col("least") > direct) & (F.col("least") <= shell), F.lit(False)).alias("second_shell"), F.coalesce("chains", F.array().cast("array<string>")).alias("chains"))


def chain_breaks(residues: DataFrame, longest: float) -> DataFrame:
    """Neighbours along a chain (``chain, number, x, y, z``) further apart than ``longest``; a chain bounds a group."""
    here = F.struct("number", "x", "y", "z")
    lagged = residues.withColumn("b", here).withColumn("a", F.lag("b").over(Window.partitionBy("chain").orderBy("number")))
    return lagged.where("a is not null").withColumn("d", distance("a", "b")).where(F.col("d") > longest).select("chain", F.col("a.number").alias("before"), F.col("b.number").alias("after"), F.round("d", 6).alias("gap"))


def pareto_front(df: DataFrame, key: str, high: str, low: str) -> DataFrame:
    """Rows that no other row beats: none has ``high`` as great and ``low`` as small with one of them better.

    Of each ``high`` only the least ``low`` can stay. These are cut into ranges of ``high``; a value stays if it is under
    the least of all higher ranges, of which there is one row each, and under all higher ones in its own. Rows with a
    null or NaN value are left out; equal rows stay together.
    """
    from strandloom.session import materialize

    rows = df.select(F.col(key).alias("key"), F.col(high).cast("double").alias("high"), F.col(low).cast("double").alias("low")).where("high is not null and low is not null and not isnan(high) and not isnan(low)")
    least = rows.groupBy("high").agg(F.min("low").alias("low"))
    ranged = materialize(least.repartitionByRange(F.desc("high")).withColumn("part", F.spark_partition_id()), "pareto-ranges")
    # One row a range, so this window is as small as the number of partitions.
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bounds = ranged.groupBy("part").agg(F.min("low").alias("m")).withColumn("bound", F.min("m").over(above)).drop("m")
    before = Window.partitionBy("part").orderBy(F.desc("high")).rowsBetween(Window.unboundedPreceding, -1)
    kept = ranged.join(bounds, "part").withColumn("best", F.min("low").over(before)).where("(bound is null or low < bound) and (best is null or low < best)")
    return rows.join(kept.select("high", "low"), ["high", "low"], "left_semi").select(F.col("key").alias(key), F.col("high").alias(high), F.col("low").alias(low))


def superposed_rmsd(points: DataFrame, groups: list[str]) -> DataFrame:
    """Per group the RMSD of points ``(x, y, z)`` laid over ``(u, v, w)`` by the best rotation and shift.

    Sums of products are aggregated, so a group of any size takes one 3x3 decomposition. Groups of fewer
    than three points get null.
    """
    one, two = ("x", "y", "z"), ("u", "v", "w")
    sums = [F.sum(c).alias(f"s_{c}") for c in one + two] + [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}{b}") for a in one for b in two]
    facts = points.dropna(subset=[*one, *two]).groupBy(*groups).agg(F.count("*").alias("n"), *sums, F.sum(sum((F.col(c) ** 2 for c in one + two), F.lit(0.0))).alias("squares"))

    @F.pandas_udf("double")
    def fit(n, squares, sx, sy, sz, su, sv, sw, *products):  # type: ignore[no-untyped-def]
        import pandas as pd

        count = n.to_numpy(float)
        a, b = (np.stack([c.to_numpy(float) for c in side], 1) for side in ((sx, sy, sz), (su, sv, sw)))
        h = np.stack([c.to_numpy(float) for c in products], 1).reshape(-1, 3, 3) - a[:, :, None] * b[:, None, :] / count[:, None, None]
        left, size, right = np.linalg.svd(h)
        size[:, 2] *= np.sign(np.linalg.det(left) * np.linalg.det(right))
        spread = squares.to_numpy(float) - (a**2).sum(1) / count - (b**2).sum(1) / count
        rmsd = np.sqrt(np.maximum(spread - 2 * size.sum(1), 0) / count)
        return pd.Series(np.where(count >= 3, rmsd, np.nan))

    value = fit("n", "squares", *[f"s_{c}" for c in one + two], *[f"p_{a}{b}" for a in one for b in two])
    return facts.select(*groups, "n", F.nanvl(F.round(value, 6), F.lit(None).cast("double")).alias("rmsd"))


def exposed_parts(atoms: DataFrame, probe: float = 1.4, points: int = 100) -> DataFrame:
    """Each atom's part of its sphere that a probe can touch: ``id, exposed, area``.

    ``atoms`` has ``id, x, y, z, radius``. Neighbours come from the grid join, so an atom's list is bounded by
    how dense atoms can be; its sphere points are tested against them in Arrow batches. All atoms given
    count as neighbours, whatever their chain.
    """
    reach = atoms.agg(F.max("radius")).first()[0] or 0.0
    near = near_points(atoms, atoms, 2 * (reach + probe)).where("l <> r").select("l", "r")
    who = atoms.select(F.col("id").alias("r"), F.struct("x", "y", "z", "radius").alias("q"))
    lists = near.join(who, "r").groupBy("l").agg(F.collect_list("q").alias("others"))
    every = atoms.join(lists, F.col("id") == F.col("l"), "left").select("id", "x", "y", "z", "radius", F.coalesce("others", F.array().cast("array<struct<x:double,y:double,z:double,radius:double>>")).alias("others"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = np.arange(points) + 0.5
        polar, turn = np.arccos(1 - 2 * k / points), np.pi * (1 + 5**0.5) * k
        sphere = np.stack([np.cos(turn) * np.sin(polar), np.sin(turn) * np.sin(polar), np.cos(polar)], 1)
        for batch in batches:
            parts = []
            for x, y, z, radius, others in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
                surface = np.array([x, y, z]) + (radius + probe) * sphere
                free = np.ones(points, bool)
                for o in others:
                    free &= ((surface - (o["x"], o["y"], o["z"])) ** 2).sum(1) >= (o["radius"] + probe) ** 2
                parts.append(float(free.mean()))
            area = [4 * np.pi * (r + probe) ** 2 * p for r, p in zip(batch.column(4).to_pylist(), parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts), pa.array(area, pa.float64())], ["id", "exposed", "area"])

    kind = atoms.schema["id"].dataType.simpleString()
    return every.mapInArrow(run, f"id {kind}, exposed double, area double")
