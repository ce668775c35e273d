"""Near-duplicate texts (problem 5): an LSH forest over sets of letter runs, then the exact similarity.

Each text's set of runs of ``shingle`` letters gets minwise hash values. Each tree of the forest is an
order of all texts by a signature of several of them, sorted over range partitions; texts that follow
each other with a long enough common prefix are candidates. How long it must be adapts to the region:
it starts at two values, and where more than ``cap`` texts share them, their region is read one value
deeper, with as many more trees as keep the chance to miss a pair at the threshold under two in ten
thousand. Regions that cross from one partition to the next are put together by counts. At the last
depth regions over the cap are compared block against block, so no pair is dropped; for classes each
of their texts is compared with its neighbours and one representative in each tree first, and then block
against block only with those texts of its regions that these links leave in another class.
Candidates are sifted by a sketch of 64 hash values and then compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.texts import codes_of, distinct_texts, mix, offsets_of, packed_runs, slices
from strandloom.operators.skew import spread_join
from strandloom.session import materialize

SHINGLE, THRESHOLD, CAP = 5, 0.6, 256
#: Values read and trees used, level by level: (1 - 0.6 ** depth) ** trees stays under 0.0002.
LEVELS = ((2, 20), (3, 40), (4, 72), (5, 116))
#: Values by which texts are sorted beyond those that a region shares; the most values of a tree.
_EXTRA, _MOST = 2, 7
#: Texts in a block where regions over the cap are compared.
_BLOCK = 1024
#: Hash values in a sketch, and how many of them may fall short of what the threshold lets expect.
_SKETCH, _SLACK = 64, 0.22


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20260731)
    return draw.integers(0, 2**32, n, np.uint32), draw.integers(0, 2**31, n, np.uint32) * np.uint32(2) + np.uint32(1)


_XOR, _TIMES = _factors(_MOST * max(t for _, t in LEVELS))


def shingle_codes(codes: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``k`` letters within each text as numbers, and where each text's begin (and the end)."""
    runs = packed_runs(codes, k)
    keep = np.ones(len(runs), bool)
    for d in range(1, k):
        at = starts[1:-1] - d
        keep[at[(at >= 0) & (at < len(runs))]] = False
    counts = np.maximum(np.diff(starts) - k + 1, 0)
    return runs[keep], np.concatenate([[0], np.cumsum(counts)])


def _minima(values: np.ndarray, starts: np.ndarray, which: list[int]) -> np.ndarray:
    """Minwise hash values, one row for each of ``which``; every text has at least one run."""
    x = values.astype(np.uint32)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return np.stack([np.minimum.reduceat((x ^ _XOR[i]) * _TIMES[i], starts[:-1]) for i in which])


def _signatures(texts: DataFrame, shingle: int, depth: int, trees: int, sketch: bool) -> DataFrame:
    """``tid, tree_set, signatures``: of each text the hash values of all trees in a row, ``depth + _EXTRA`` a tree; also ``sketch``."""
    values = depth + _EXTRA
    which = [t * _MOST + j for t in range(trees) for j in range(values)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            minima = _minima(*shingle_codes(*codes_of(batch.column(1)), shingle), which)
            n = len(batch)
            # Big-endian, so that bytes sort like the numbers.
            told = np.ascontiguousarray(minima.T).astype(">u4").tobytes()
            columns, names = [batch.column(0), batch.column(2), _fixed(told, n)], ["tid", "tree_set", "signatures"]
            if sketch:
                columns.append(_fixed(np.ascontiguousarray(((minima[:_SKETCH] >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).T).tobytes(), n))
                names.append("sketch")
            yield pa.RecordBatch.from_arrays(columns, names)

    return texts.select("tid", "letters", F.xxhash64("record_set")).mapInArrow(run, "tid long, tree_set long, signatures binary" + (", sketch binary" if sketch else ""))


def _fixed(data: bytes, rows: int) -> pa.Array:
    """``rows`` binary values of one size."""
    size = len(data) // max(rows, 1)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(0, len(data) + 1, max(size, 1), dtype=np.int32)[: rows + 1]), pa.py_buffer(data)])


def _orders(signatures: DataFrame, depth: int, trees: int) -> DataFrame:
    """``tree, signature, tid`` sorted by all three over all partitions: one sorted signature order per table and tree."""
    width = 4 * (depth + _EXTRA)
    each = signatures.select("tid", "tree_set", "signatures", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("t"))
    rows = each.select((F.col("tree_set") + F.col("t")).alias("tree"), F.substring("signatures", F.col("t") * width + 1, F.lit(width)).alias("signature"), "tid")
    return rows.repartitionByRange("tree", "signature", "tid").sortWithinPartitions("tree", "signature", "tid")


def _neighbours(orders: DataFrame, depth: int, cap: int, linked: bool) -> DataFrame:
    """``kind, a, b`` from sorted signature orders.

    Rows that follow each other with a common prefix of ``depth`` values or more make a region. Kind 0 are the
    pairs ``a < b`` of regions of at most ``cap`` texts that lie inside a partition. Kind 1 are texts ``a`` of any
    other region ``b``: what touches the edge of a partition, or is larger, is settled by counts. Where
    ``linked``, its texts are also paired with the one next to them, with which the common prefix is longest.
    """
    values = depth + _EXTRA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, tid, sig = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, values), np.uint32)
        at_edge = True  # the first region touches the edge of the partition, and so does what was handed out in parts
        for batch in chain(batches, [None]):
            if batch is not None:
                if not len(batch):
                    continue
                offsets = offsets_of(batch.column(1))
                data = np.frombuffer(batch.column(1).buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                tree = np.concatenate([tree, batch.column(0).to_numpy()])
                sig = np.concatenate([sig, np.ascontiguousarray(data).view(">u4").reshape(-1, values).astype(np.uint32)])
                tid = np.concatenate([tid, batch.column(2).to_numpy()])
            if not len(tid):
                continue
            common = np.cumprod(np.column_stack([tree[1:] == tree[:-1], sig[1:] == sig[:-1]]), axis=1).sum(axis=1) - 1
            starts = np.concatenate([[0], np.flatnonzero(common < depth) + 1])
            ends = np.append(starts[1:], len(tid))
            open_ = starts[-1]
            done = len(tid) if batch is None or len(tid) - open_ > 4 * cap else int(open_)
            inside = (ends - starts <= cap) & (ends <= done)
            if at_edge:
                inside[0] = False
            if done == len(tid):
                inside[-1] = False
            end_of, is_in = np.repeat(ends, ends - starts), np.repeat(inside, ends - starts)
            first, second, i, step = [], [], np.flatnonzero(is_in), 1
            while len(i := i[i + step < end_of[i]]):
                first.append(tid[i])
                second.append(tid[i + step])
                step += 1
            rest = np.flatnonzero(~is_in[:done])
            # A lone row at no edge has no neighbour.
            alone = np.repeat((ends - starts == 1) & ~inside, ends - starts)[rest]
            alone &= ~(((rest == 0) & at_edge) | (rest == len(tid) - 1))
            rest = rest[~alone]
            region = _region(tree[rest], sig[rest, :depth])
            if linked and len(rest) > 1:
                beside = np.flatnonzero((np.diff(rest) == 1) & (region[1:] == region[:-1]))
                first.append(tid[rest[beside]])
                second.append(tid[rest[beside + 1]])
            x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (first, second))
            kind = np.concatenate([np.zeros(len(x), np.int8), np.ones(len(rest), np.int8)])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([np.minimum(x, y), tid[rest]])), pa.array(np.concatenate([np.maximum(x, y), region]))], ["kind", "a", "b"])
            at_edge = done == len(tid) or (at_edge and done == 0)
            # What is handed out in parts keeps its last row, so that the rest of its region is known to be one.
            tree, tid, sig = tree[done:], tid[done:], sig[done:]

    return orders.mapInArrow(run, "kind byte, a long, b long")


def _region(tree: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """A number for each tree and prefix."""
    out = mix(tree.view(np.uint64))
    for j in range(prefix.shape[1]):
        out = mix(out + prefix[:, j].astype(np.uint64))
    return out.view(np.int64)


def _blocks(dense: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """Pairs of like sketches within regions of any size, block against block.

    ``dense`` has ``a, b, n, label``: text, region, its size and the text's class so far. Pairs of one class are left out.
    """
    placed = dense.withColumn("blocks", F.ceil(F.col("n") / _BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("a", "b"), F.col("blocks")).cast("int"))
    told = placed.join(sketches.select(F.col("tid").alias("a"), "sketch"), "a").select("a", "b", "label", "own", "sketch", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    sent = told.select("a", "b", "label", "own", "sketch", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own, i, tid, label = (table.column(c).to_numpy() for c in ("own", "i", "a", "label"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, _SKETCH)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == table.column("j").to_numpy())
        same = np.zeros((len(left), len(right)), np.uint8)
        for c in range(_SKETCH):
            same += sketch[left, c][:, None] == sketch[right, c]
        x, y = np.nonzero((same >= least) & (label[left][:, None] != label[right]))
        x, y = tid[left[x]], tid[right[y]]
        return pa.table({"a": x[x < y], "b": y[x < y]}) if (own == i).all() else pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return sent.groupBy("b", "i", "j").applyInArrow(compare, "a long, b long")


def candidate_pairs(texts: DataFrame, shingle: int, cap: int, threshold: float, linked: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Pairs ``a < b`` of texts that are neighbours in some sorted order, each once, the texts' sketches, and what is left.

    Regions over ``cap`` texts are read deeper in more trees; at the last depth they are compared in blocks, or,
    where ``linked``, each of their texts is paired with the region's least text and its neighbours alone, and the
    regions are given back (``a, b, n``: text, region and its size), as their other pairs are still to be compared.
    """
    sketches = materialize(_signatures(texts, shingle, *LEVELS[0], sketch=True), "neardup-signatures")
    signatures, found, left = sketches, None, None
    for level, (depth, trees) in enumerate(LEVELS):
        last = level == len(LEVELS) - 1
        near = materialize(_neighbours(_orders(signatures, depth, trees), depth, cap, linked and last), f"neardup-neighbours-{depth}")
        open_ = near.where("kind = 1").select("a", "b")
        sizes = materialize(open_.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("least")).where("n > 1"), f"neardup-regions-{depth}")
        settled = spread_join(open_, sizes, "b", "n")
        small = settled.where(F.col("n") <= cap)
        pairs = small.select("a", F.col("b").alias("r")).join(small.select(F.col("a").alias("c"), F.col("b").alias("r")), "r").where("a < c").select("a", F.col("c").alias("b"))
        pairs = near.where("kind = 0").select("a", "b").unionByName(pairs)
        found = pairs if found is None else found.unionByName(pairs)
        if sizes.where(F.col("n") > cap).isEmpty():
            break
        dense = settled.where(F.col("n") > cap)
        if last:
            dense = materialize(dense, "neardup-dense")
            left = dense.select("a", "b", "n") if linked else None
            more = dense.where("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b")) if linked else _blocks(dense.withColumn("label", F.col("a")), sketches, _least(threshold))
            found = found.unionByName(more)
            break
        deeper = texts.join(dense.select(F.col("a").alias("tid")).distinct(), "tid", "left_semi")
        signatures = materialize(_signatures(deeper, shingle, *LEVELS[level + 1], sketch=False), "neardup-signatures")
    return found.groupBy("a", "b").agg(F.count("*").alias("trees")).drop("trees"), sketches, left


def _least(threshold: float) -> int:
    """How many places of two sketches must agree for the pair to be compared exactly."""
    return int(_SKETCH * (threshold - _SLACK))


def _sift(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose sketches agree in about as many places as the threshold lets expect."""
    least = _least(threshold)
    a = sketches.select(F.col("tid").alias("a"), F.col("sketch").alias("sa"))
    b = sketches.select(F.col("tid").alias("b"), F.col("sketch").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, _SKETCH) for i in (2, 3))
            keep = pa.array((left == right).sum(axis=1) >= least)
            yield batch.select(["a", "b"]).filter(keep)

    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _exact(shingle: int, threshold: float):
    """Exact similarity of pairs of texts; of each batch those at or over the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            sets = []
            for column in (2, 3):
                values, starts = shingle_codes(*codes_of(batch.column(column)), shingle)
                sets.append([np.unique(values[s:e]) for s, e in zip(starts[:-1], starts[1:])])
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets)])
            either = np.array([len(x) + len(y) for x, y in zip(*sets)]) - both
            keep = both >= threshold * either
            out = batch.select(["a", "b"]).filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(1), pa.array(both[keep] / either[keep])], ["a", "b", "similarity"])

    return run


def near_links(texts: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, cap: int = CAP, linked: bool = False) -> DataFrame:
    """``a, b, similarity``: pairs of different texts of a table at or over the threshold, each once.

    Where ``linked``, regions over the cap at the last depth give links that hold them together, not all pairs: all
    pairs of texts that no other links hold together are compared.
    """
    from strandloom.operators.graph import components

    pairs, sketches, left = candidate_pairs(texts, shingle, cap, threshold, linked)
    a = texts.select(F.col("tid").alias("a"), F.col("letters").alias("la"))
    b = texts.select(F.col("tid").alias("b"), F.col("letters").alias("lb"))

    def compared(candidates: DataFrame) -> DataFrame:
        sifted = materialize(_sift(candidates, sketches, threshold), "neardup-sifted")
        return sifted.join(a, "a").join(b, "b").select("a", "b", "la", "lb").mapInArrow(_exact(shingle, threshold), "a long, b long, similarity double")

    links = compared(pairs)
    if left is None:
        return links
    links = materialize(links, "neardup-links")
    named = left.join(components(links.select("a", "b")).withColumnRenamed("id", "a"), "a", "left").withColumn("label", F.coalesce("label", "a"))
    named = materialize(named, "neardup-named")
    several = named.groupBy("b").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.count("*").alias("texts")).where("first <> last")
    apart = _blocks(spread_join(named, several.select("b", "texts"), "b", "texts").drop("texts"), sketches, _least(threshold))
    return links.unionByName(compared(apart.distinct()))


def texts_and_members(records: DataFrame, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Distinct texts per table that have a run of ``shingle`` letters, and the records of each."""
    records = records.select("record_set", "record_id", "letters").where(F.length("letters") >= shingle)
    texts = distinct_texts(records, ["record_set"], "neardup-texts")
    keyed = records.select("record_set", "record_id", F.md5(F.concat_ws("/", "record_set", "letters")).alias("digest"))
    groups = texts.select(F.md5(F.concat_ws("/", "record_set", "letters")).alias("digest"), "tid", "n")
    return texts, spread_join(keyed, groups, "digest", "n").select("record_set", "record_id", "tid", "n")


def near_pairs(records: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, cap: int = CAP) -> DataFrame:
    """Pairs of rows of one table with different letters and a similarity of ``threshold`` or more.

    ``records`` has ``record_set, record_id, letters``. The similarity is that of the sets of runs of
    ``shingle`` letters; texts that are null, empty or shorter than a run are in no pair. Copies are
    compared once and come out row by row. Further columns are ignored.
    """
    texts, members = texts_and_members(records, shingle)
    members = materialize(members, "neardup-members")
    links = materialize(near_links(texts, threshold, shingle, cap), "neardup-links")
    sizes = texts.select("tid", "n")
    sized = links.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").select("a", "b", "na", "nb")
    left = spread_join(members.select("record_set", F.col("record_id").alias("x"), F.col("tid").alias("a")), sized, "a", "na", sizes=sizes.toDF("a", "na"))
    both = spread_join(members.select(F.col("tid").alias("b"), F.col("record_id").alias("y")), left.select("record_set", "x", "b", "nb"), "b", "nb", sizes=sizes.toDF("b", "nb"))
    return both.select(F.col("record_set").alias("source_table"), F.least("x", "y").alias("left_key"), F.greatest("x", "y").alias("right_key"))


def near_groups(records: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, cap: int = CAP) -> DataFrame:
    """Each record with the class of near-duplicates it belongs to (the least record id in it) and the class's size.

    Classes are the connected components of the links between texts; copies are in one class. Records
    without a run of ``shingle`` letters are left out; a record like no other is a class of its own.
    """
    from strandloom.operators.graph import components

    texts, members = texts_and_members(records, shingle)
    members = materialize(members, "neardup-members")
    links = materialize(near_links(texts, threshold, shingle, cap, linked=True), "neardup-links")
    labels = components(links.select("a", "b")).withColumnRenamed("id", "tid")
    # Labels of texts first, so that a text's copies are met once.
    named = texts.select("record_set", "tid", "n").join(labels, "tid", "left").select("record_set", "tid", "n", F.coalesce("label", "tid").alias("label"))
    named = materialize(named, "neardup-labels")
    tagged = materialize(spread_join(members.select("record_set", "record_id", "tid"), named.select("tid", "label", "n"), "tid", "n").select("record_set", "record_id", "label"), "neardup-tagged")
    names = materialize(tagged.groupBy("label").agg(F.min("record_id").alias("class_id"), F.count("*").alias("class_size")), "neardup-classes")
    return spread_join(tagged, names, "label", "class_size").select(F.col("record_set").alias("source_table"), F.col("record_id").alias("record_key"), "class_id", "class_size")
