"""Joins of rows with group facts where one group may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most keys that are salted, which bounds what is broadcast; any other key has fewer rows than each of these.
MOST_HOT = 10_000


def spread_join(rows: DataFrame, groups: DataFrame, key: str, count: str, least: int = 100_000, spread: int = 64, sizes: DataFrame | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, few rows per ``key``, hot keys salted.

    ``groups`` carries in ``count`` how many rows each key has; it should be cheap to read twice, else
    ``sizes`` is a cheap table with the same ``key`` and ``count``. A key with at least ``least`` rows is
    hot, up to the ``MOST_HOT`` largest. Without hot keys this is a plain equi-join. Hot keys are copied
    ``spread`` times on the groups' side and salted by hash on the rows' side, so no task gets a whole hot
    group; rows are marked by a broadcast of the hot keys, whose number is bounded.

    Rows with a null key find no partner and fall out, as in any inner join.
    """
    told = (groups if sizes is None else sizes).select(key, count).where(F.col(count) >= least)
    if told.isEmpty():
        return rows.join(groups, key)
    hot = F.broadcast(told.groupBy(key).agg(F.max(count).alias("_n")).orderBy(F.desc("_n")).limit(MOST_HOT).select(key, F.lit(1).alias("_hot")))
    salts = F.when(F.col("_hot") == 1, F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    copied = groups.join(hot, key, "left").select(*groups.columns, F.explode(salts).alias("_salt"))
    salt = F.when(F.col("_hot") == 1, F.pmod(F.xxhash64(*rows.columns), F.lit(spread)).cast("int")).otherwise(F.lit(0))
    marked = rows.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    return marked.join(copied, [key, "_salt"]).drop("_salt")
