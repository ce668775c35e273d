"""Deterministic draws and shards from text hashes, the same on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_number(text: Column) -> Column:
    """The first 64 bits of a text's SHA-256 as an exact unsigned number (decimal(20,0))."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_fraction(text: Column) -> Column:
    """A text's hash as a number in [0, 1)."""
    return hash_number(text).cast("double") / F.lit(2.0**64)


def shard_of(text: Column, shards: int) -> Column:
    """A text's shard, from 0."""
    return F.pmod(hash_number(text), F.lit(shards).cast("decimal(20,0)")).cast("int")


def split_of(group: Column, seed: int, train: float = 0.8, validation: float = 0.1) -> Column:
    """The split of a whole group of records: train, validation or test."""
    x = hash_fraction(F.concat(F.lit(f"{seed}:"), group))
    return F.when(x < train, "train").when(x < train + validation, "validation").otherwise("test")


def position_set_hash(positions: Column) -> Column:
    """SHA-256 of a set of positions, whatever their order; null for null."""
    return F.sha2(F.to_json(F.array_sort(F.array_distinct(positions))), 256)
