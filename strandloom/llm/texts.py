"""What the sequence operators share: distinct texts with ids, and letters as numbers in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import letters
from strandloom.session import materialize, read


def distinct_texts(records: DataFrame, by: list[str], name: str) -> DataFrame:
    """``tid, letters, n`` and ``by``: each different text once, with its number of records.

    Copies collapse in the map-side aggregation, however many there are. The result is written to the
    shared folder, so the ids hold still.
    """
    grouped = records.groupBy(*by, "letters").agg(F.count("*").alias("n"))
    return materialize(grouped.select(F.monotonically_increasing_id().alias("tid"), *by, "letters", "n", F.md5("letters").alias("digest")), name)


def sequence_records(spark, directory: str, parents: bool) -> DataFrame:
    """``record_set, record_id, letters`` of cas13_records, candidates and, once per scaffold, parents.

    Rows without letters are left out, as are parents of a null scaffold.
    """
    cas13 = read(spark, directory, "cas13_records").select(F.lit("cas13_records").alias("record_set"), F.col("record_key").alias("record_id"), letters(F.col("protein_sequence")).alias("letters"))
    designs = read(spark, directory, "candidates")
    out = cas13.unionByName(designs.select(F.lit("candidates").alias("record_set"), F.col("candidate_id").alias("record_id"), letters(F.col("sequence")).alias("letters")))
    if parents:
        by_scaffold = designs.where("scaffold_id is not null").groupBy("scaffold_id", "parent_sequence").agg(F.count("*").alias("n"))
        whole = by_scaffold.groupBy("scaffold_id").agg(F.max(letters(F.col("parent_sequence"))).alias("letters"))
        out = out.unionByName(whole.select(F.lit("parents").alias("record_set"), F.col("scaffold_id").alias("record_id"), "letters"))
    return out.where("letters <> ''")


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice's texts have at most ``most`` bytes, or hold one text."""
    for batch in batches:
        offsets = offsets_of(batch.column(column))
        start = 0
        while start < len(batch):
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def offsets_of(texts: pa.Array) -> np.ndarray:
    """Byte offsets of a string array without nulls (length + 1 of them)."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def codes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All letters of a string array as 1..26 in one array, and each text's start in it (and the end)."""
    offsets = offsets_of(texts)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw - np.uint8(64), offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed_runs(codes: np.ndarray, k: int) -> np.ndarray:
    """Each run of ``k`` (at most 12) letters as one number, five bits a letter; exact, so no two collide."""
    done, width = codes.astype(np.uint64), 1
    out, covered = None, 0
    for bit in range(k.bit_length()):
        if k >> bit & 1:
            part = done[covered:]
            out = part if out is None else (out[: len(part)] << np.uint64(5 * width)) | part[: len(out)]
            covered += width
        if 2 * width <= k:
            n = len(done) - width
            done = (done[: max(n, 0)] << np.uint64(5 * width)) | done[width:]
            width *= 2
    return out[: max(len(codes) - k + 1, 0)]
