"""Filling containers of fixed capacity with texts (problem 6): best-two-fit on token counts.

Texts are counted in tokens of a public tokenizer and dealt by hash into groups of bounded size, of
which each is packed on its own; only the last container of a group can stay poorly filled. Within a
group a container is filled greedily, the largest text that fits first. Then its smallest text gives
way to two texts not yet packed, if these fit the widened gap more tightly.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import materialize, read

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces in a packing group, which bounds a packing task.
GROUP_ROWS = 20_000
#: Targets that are packed in one job; more take several.
TARGETS = 100
# Fixed value: how the tokenizer cuts a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encodings: dict[tuple[str, str], object] = {}


def encoding(vocabulary: str = VOCABULARY, pattern: str = PATTERN):
    """The tokenizer of a file of base64 tokens and ranks, once per Python worker."""
    if (vocabulary, pattern) not in _encodings:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[vocabulary, pattern] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[vocabulary, pattern]


def count_tokens(texts: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``key, n_tokens`` of whole texts; null and empty texts have 0 tokens."""

    # The file goes to every executor with the job; its folder need not exist there.
    texts.sparkSession.sparkContext.addFile(vocabulary)
    shipped = vocabulary.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(SparkFiles.get(shipped), pattern)
        for batch in batches:
            sizes = [len(tokenizer.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], ["key", "n_tokens"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(run, f"key {kind}, n_tokens int").withColumnRenamed("key", key)


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container (from 0) of each size; sizes lie in 1..capacity."""
    waiting: dict[int, list[int]] = {}
    for item in np.argsort(sizes, kind="stable")[::-1].tolist():
        waiting.setdefault(int(sizes[item]), []).append(item)
    distinct = sorted(waiting)
    placed = np.full(len(sizes), -1, np.int64)

    def take(size: int) -> int:
        stack = waiting[size]
        item = stack.pop()
        if not stack:
            del waiting[size], distinct[bisect_left(distinct, size)]
        return item

    def give_back(size: int, item: int) -> None:
        if size not in waiting:
            waiting[size] = []
            insort(distinct, size)
        waiting[size].append(item)

    container = 0
    while distinct:
        held: list[tuple[int, int]] = []
        gap = capacity
        while (i := bisect_right(distinct, gap)) > 0:
            size = distinct[i - 1]
            held.append((size, take(size)))
            gap -= size
        while gap and distinct:
            size, item = held[-1]
            pair = _tightest_pair(distinct, waiting, gap + size, size)
            if pair is None:
                break
            held.pop()
            held += sorted(((s, take(s)) for s in pair), reverse=True)
            give_back(size, item)
            held.sort(key=lambda x: -x[0])
            gap = capacity - sum(s for s, _ in held)
        for _, item in held:
            placed[item] = container
        container += 1
    return placed


def _tightest_pair(distinct: list[int], waiting: dict[int, list[int]], room: int, more_than: int) -> tuple[int, int] | None:
    """Two waiting sizes with the largest sum that is over ``more_than`` and at most ``room``."""
    sizes = np.array(distinct[: bisect_left(distinct, room)], np.int64)
    if not len(sizes):
        return None
    other = np.searchsorted(sizes, room - sizes, side="right") - 1
    for i in np.flatnonzero(other == np.arange(len(sizes))).tolist():
        other[i] -= len(waiting[distinct[i]]) < 2
    sums = np.where(other >= 0, sizes + sizes[np.maximum(other, 0)], 0)
    best = int(sums.argmax())
    return (int(sizes[best]), int(sizes[other[best]])) if sums[best] > more_than else None


def pack(counts: DataFrame, targets: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pieces of texts in containers: ``target_name, container, doc_id, piece_no, n_tokens``.

    ``counts`` has ``doc_id, n_tokens``; ``targets``, a stated list of capacities, has ``target_name, capacity_tokens``.
    A text of more tokens than a target's capacity is cut into full pieces and a rest; no other text
    is cut. Texts of 0 tokens need no room and are left out, as are targets without a positive
    capacity. A text that stands twice is laid twice. Container names hold within a target.
    """
    counts = counts.select("doc_id", "n_tokens").where("n_tokens > 0")
    chosen = targets.select("target_name", "capacity_tokens").where("capacity_tokens > 0").distinct()
    capacities = [tuple(r) for r in chosen.collect()]
    kind = counts.schema["doc_id"].dataType.simpleString()
    out = counts.sparkSession.createDataFrame([], f"target_name string, container string, doc_id {kind}, piece_no int, n_tokens int")
    for start in range(0, len(capacities), TARGETS):
        out = out.unionByName(_pack_for(counts, capacities[start : start + TARGETS], group_rows))
    return out


def _pack_for(counts: DataFrame, capacities: list[tuple[str, int]], group_rows: int) -> DataFrame:
    """The pieces of all texts in containers of some targets."""
    sums = counts.agg(*[F.sum(F.ceil(F.col("n_tokens") / c)).alias(f"p{i}") for i, (_, c) in enumerate(capacities)]).first()
    groups = [max(1, -(-int(n or 0) // group_rows)) for n in sums]
    wanted = F.array(*[F.struct(F.lit(t).cast("string").alias("target_name"), F.lit(c).cast("int").alias("capacity"), F.lit(g).alias("groups")) for (t, c), g in zip(capacities, groups)])
    pieces = counts.select("doc_id", "n_tokens", F.explode(wanted).alias("t")).select("doc_id", "n_tokens", "t.*")
    pieces = pieces.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int") - 1)).alias("piece_no"))
    pieces = pieces.select(
        "target_name",
        "capacity",
        "doc_id",
        "piece_no",
        F.least(F.col("capacity"), F.col("n_tokens") - F.col("piece_no") * F.col("capacity")).cast("int").alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "piece_no"), F.col("groups")).cast("int").alias("pack_group"),
    )

    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("n_tokens").to_numpy()
        place = best_two_fit(sizes, table.column("capacity")[0].as_py())
        group = table.column("pack_group")[0].as_py()
        return pa.table({"target_name": table.column("target_name"), "container": pa.array([f"{group}-{p}" for p in place]), "doc_id": table.column("doc_id"), "piece_no": table.column("piece_no"), "n_tokens": table.column("n_tokens")})

    kind = counts.schema["doc_id"].dataType.simpleString()
    return pieces.groupBy("target_name", "pack_group").applyInArrow(run, f"target_name string, container string, doc_id {kind}, piece_no int, n_tokens int")


def packed_documents(spark, directory: str, vocabulary: str = VOCABULARY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """All documents in the containers of each target."""
    counts = materialize(count_tokens(read(spark, directory, "documents"), "doc_id", "text", vocabulary), "token-counts")
    return pack(counts, read(spark, directory, "pack_targets"), group_rows)


def container_fill(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """Containers, tokens and the part of the room used, per target."""
    per = packed.groupBy("target_name", "container").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"))
    known = targets.select("target_name", "capacity_tokens").distinct()
    return (
        per.join(known, "target_name")
        .groupBy("target_name", "capacity_tokens")
        .agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most"))
        .withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
    )
