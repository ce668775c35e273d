"""Duplicates hidden by formatting (problem 4): radix partitioning on canonical bytes, then tries.

1. A record becomes canonical bytes, the same for every typography of it. Copies within an Arrow batch
   collapse at once, so a record imported very often stays small from here on.
2. Buckets are split by leading bytes: those over the capacity by twice as many, again and again,
   until each fits. Copies of one record that still overflow go to several buckets.
3. Each bucket is counted in a trie of the bytes with counters at the ends; only the ends of records
   that were spread over several buckets add up.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.skew import spread_join
from strandloom.session import materialize, read

BUCKET_BYTES = 16 << 20
_CHUNK = 32
_NOT_LETTERS = re.compile("[^A-Z]+")
_NOT_WORDS = re.compile(r"[\W_]+")


def plain(text: str) -> str:
    """A text without case, blanks and punctuation."""
    return _NOT_WORDS.sub("", text.casefold())


def content(value) -> str:
    """A JSON value as text that does not depend on typography or the order of fields."""
    if isinstance(value, str):
        return f'"{plain(value)}"'
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{content(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(content, value)) + "]"
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return json.dumps(value)


def canonical_bytes(sequence: str | None, effector: str | None, metadata: str | None) -> bytes:
    """The canonical bytes of a record; empty if its sequence has no letter. Null agrees only with null."""
    letters = _NOT_LETTERS.sub("", "".join(c for c in (sequence or "") if c.isascii()).upper())
    if not letters:
        return b""
    if metadata is None:
        told = "-"
    else:
        try:
            told = content(json.loads(metadata))
        except (ValueError, RecursionError):
            told = "?" + plain(metadata)
    return "\n".join((letters, "-" if effector is None else "=" + plain(effector), told)).encode("utf-8", "surrogatepass")


def canonical_records(df: DataFrame, key: str = "record_key") -> DataFrame:
    """``digest, canon, n, first_key, keys``: canonical bytes of the rows, copies within a batch collapsed.

    Rows whose sequence has no letter (null and empty ones among them) are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[bytes, list[str]] = {}
            for row_key, *fields in zip(*(c.to_pylist() for c in batch.columns)):
                groups.setdefault(canonical_bytes(*fields), []).append(row_key)
            groups.pop(b"", None)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([hashlib.blake2b(c, digest_size=16).digest() for c in groups], pa.binary()),
                    pa.array(list(groups), pa.binary()),
                    pa.array([len(keys) for keys in groups.values()], pa.int64()),
                    pa.array([min(keys) for keys in groups.values()], pa.string()),
                    pa.array(list(groups.values()), pa.list_(pa.string())),
                ],
                ["digest", "canon", "n", "first_key", "keys"],
            )

    picked = df.select(F.col(key).cast("string"), "protein_sequence", "effector_name", "metadata_json")
    return picked.mapInArrow(run, "digest binary, canon binary, n long, first_key string, keys array<string>")


def radix_buckets(canon: DataFrame, capacity: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """``canon`` with a binary ``bucket``: buckets that hold whole records' copies, and parts of single records' copies, if any.

    No bucket holds more than about ``capacity`` bytes. Each round counts the bytes per bucket and writes the rows
    of buckets that are too large, which the next round splits by twice as many bytes. A bucket too large that
    holds one record alone is not split by further bytes but spread by key.
    """
    rows, taken, whole, parts = canon, 1, None, None
    while True:
        rows = rows.withColumn("bucket", F.substring("canon", 1, taken))
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("_n"), F.sum(F.length("canon")).alias("_bytes"), (F.min("digest") == F.max("digest")).alias("_one"))
        sizes = materialize(sizes, "radix-sizes")
        if sizes.where(F.col("_bytes") > capacity).isEmpty():
            return rows if whole is None else whole.unionByName(rows), parts
        placed = spread_join(rows, sizes, "bucket", "_n")
        large, one = F.col("_bytes") > capacity, F.col("_one")
        fits = placed.where(~large).select(*canon.columns, "bucket")
        whole = fits if whole is None else whole.unionByName(fits)
        part = F.pmod(F.xxhash64("first_key"), F.ceil(F.col("_bytes") / capacity)).cast("string")
        single = placed.where(large & one).select(*canon.columns, F.concat("bucket", F.encode(part, "utf-8")).alias("bucket"))
        parts = single if parts is None else parts.unionByName(single)
        rows = materialize(placed.where(large & ~one).select(*canon.columns), "radix-rows")
        taken *= 2


def _count_in_trie(table: pa.Table) -> pa.Table:
    """Counts the records of one bucket in a trie; one row per end: ``digest, n, first_key``."""
    root: dict = {}
    for digest, canon, n, first in zip(*(table.column(c).to_pylist() for c in ("digest", "canon", "n", "first_key"))):
        node = root
        for i in range(0, len(canon), _CHUNK):
            step = canon[i : i + _CHUNK]
            node = node.setdefault(step, {})
        end = node.get(None)
        if end is None:
            node[None] = [digest, n, first]
        else:
            end[1] += n
            end[2] = min(end[2], first)
    ends, stack = [], [root]
    while stack:
        for step, child in stack.pop().items():
            if step is None:
                ends.append(child)
            else:
                stack.append(child)
    digest, n, first = zip(*ends) if ends else ((), (), ())
    return pa.table([pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(first, pa.string())], ["digest", "n", "first_key"])


def copy_groups(canon: DataFrame, capacity: int = BUCKET_BYTES) -> DataFrame:
    """``digest, n, keep_key``: each different record with its number of copies and its least key."""
    whole, parts = radix_buckets(canon.select("digest", "canon", "n", "first_key"), capacity)
    schema = "digest binary, n long, first_key string"
    ends = whole.groupBy("bucket").applyInArrow(_count_in_trie, schema).withColumnRenamed("first_key", "keep_key")
    if parts is None:
        return ends
    # Only the ends of records whose copies were spread over several buckets are put together.
    spread = parts.groupBy("bucket").applyInArrow(_count_in_trie, schema)
    return ends.unionByName(spread.groupBy("digest").agg(F.sum("n").alias("n"), F.min("first_key").alias("keep_key")))


def records_once(df: DataFrame, key: str = "record_key", capacity: int = BUCKET_BYTES) -> DataFrame:
    """``keep_key, copies``: one row per different record; rows without letters are left out."""
    canon = materialize(canonical_records(df, key), "canonical")
    return copy_groups(canon, capacity).select("keep_key", F.col("n").alias("copies"))


def hidden_copies(df: DataFrame, key: str = "record_key", capacity: int = BUCKET_BYTES) -> DataFrame:
    """``keep_key, copy_key``: each row that says what a row with a smaller key says, with the least such key.

    Null, empty and letterless sequences have no copies; null effector names and metadata agree only
    with null; metadata that is no JSON is compared as text.
    """
    canon = materialize(canonical_records(df, key), "canonical")
    several = materialize(copy_groups(canon, capacity).where("n > 1"), "copy-groups")
    rows = spread_join(canon.select("digest", "keys"), several, "digest", "n")
    return rows.select("keep_key", F.explode("keys").alias("copy_key")).where("copy_key <> keep_key")


def cas13(spark, directory: str) -> DataFrame:
    return read(spark, directory, "cas13_records").select("record_key", "protein_sequence", "effector_name", "metadata_json")
