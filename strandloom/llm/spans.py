"""Long exact spans shared between records (problem 2): seed and extend on winnowed anchors.

1. Texts are collapsed to distinct ones. A text that several records have is shared as a whole.
2. Anchors are winnowed: of every ``span - k + 1`` runs of ``k`` letters in a row the smallest by hash is
   one. What two texts share over ``span`` letters picks the same anchor in both, at the same place.
3. Anchors that two texts hold are seeds. Their occurrences get the letters around them, as far as a
   stretch of ``span`` letters through the anchor can reach.
4. Occurrences of one seed are extended both ways against all others at once: every stretch through
   the anchor is compared by value, so no pairs are built.
5. Shared stretches merge to maximal runs per text and go back to the records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.texts import codes_of, distinct_texts, mix, packed_runs, slices
from strandloom.operators.skew import spread_join
from strandloom.session import materialize

SPAN, SEED = 40, 12


def _slide(x: np.ndarray, width: int, fold) -> np.ndarray:
    """``fold`` (np.minimum or np.maximum) over each ``width`` values in a row."""
    done, w = x, 1
    while 2 * w <= width:
        done = fold(done[: len(done) - w], done[w:])
        w *= 2
    rest = width - w
    return fold(done[: len(done) - rest], done[rest:]) if rest else done


def winnow(codes: np.ndarray, starts: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the anchors of all texts (``starts`` with the end as last).

    A run is an anchor if it is the smallest, ties included, of some window within its text; this
    depends on the window's letters alone.
    """
    w = span - k + 1
    if len(codes) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    runs = mix(packed_runs(codes, k))
    least = _slide(runs, w, np.minimum)
    n = len(least)
    text_end = np.repeat(starts[1:], np.diff(starts))[:n]
    least = np.where(np.arange(n) + span <= text_end, least, np.uint64(0))
    edge = np.zeros(w - 1, np.uint64)
    most = _slide(np.concatenate([edge, least, edge]), w, np.maximum)
    at = np.flatnonzero((most == runs) & (runs > 0))
    return at, runs[at]


def anchors(texts: DataFrame, span: int, k: int) -> DataFrame:
    """``h, tid, pos``: the anchors of each text, ``pos`` from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            codes, starts = codes_of(batch.column(1))
            at, value = winnow(codes, starts, k, span)
            row = np.searchsorted(starts, at, side="right") - 1
            tid = batch.column(0).to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(tid), pa.array((at - starts[row]).astype(np.int32))], ["h", "tid", "pos"])

    return texts.select("tid", "letters").mapInArrow(run, "h long, tid long, pos int")


def _extend(h: np.ndarray, tid: np.ndarray, pos: np.ndarray, around: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of ``span`` letters in ``around`` (rows of letter codes, 0 outside the text) that another text has too.

    ``around`` starts ``reach`` letters before each anchor. Gives text, first and last place of each run
    of shared stretches.
    """
    width = around.shape[1] - span + 1
    reach = width - 1
    rows = len(h)
    keys = np.zeros((rows, width), np.uint64)
    outside = np.zeros((rows, width), np.int16)
    for j in range(span):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + around[:, j : j + width]
        outside += around[:, j : j + width] == 0
    keys = mix(keys + (h.astype(np.int64).view(np.uint64) * np.uint64(0xD1342543DE82EF95))[:, None])
    shared = np.zeros((rows, width), bool)
    for j in range(width):
        inside = np.flatnonzero(outside[:, j] == 0)
        if not len(inside):
            continue
        order = inside[np.argsort(keys[inside, j], kind="stable")]
        key, who = keys[order, j], tid[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        several = np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)
        shared[order, j] = np.repeat(several, np.diff(np.append(first, len(key))))
    edged = np.zeros((rows, width + 2), np.int8)
    edged[:, 1:-1] = shared
    change = np.diff(edged, axis=1)
    row, start = np.nonzero(change == 1)
    _, end = np.nonzero(change == -1)
    first = pos[row] - reach + start
    return tid[row], first, first + (end - start) + span - 2


def _matrix(texts: pa.Array, left: np.ndarray, width: int, reach: int) -> np.ndarray:
    """Letter codes of the texts, one row each, so aligned that the anchor starts in column ``reach``."""
    codes, starts = codes_of(texts)
    out = np.zeros((len(left), width), np.uint8)
    size = np.diff(starts)
    row = np.repeat(np.arange(len(left)), size)
    out[row, np.arange(len(codes)) - np.repeat(starts[:-1], size) + np.repeat(reach - left, size)] = codes
    return out


def _extend_sorted(span: int, k: int, most: int = 100_000):
    """Extends batches of occurrences sorted by seed; a seed's occurrences are kept together."""
    reach = span - k

    def flush(parts: list[pa.RecordBatch], whole: bool) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
        table = pa.Table.from_batches(parts).combine_chunks()
        h = table.column("h").to_numpy()
        cut = len(h) if whole else int(np.searchsorted(h, h[-1], side="left"))
        if not cut:
            return None, table.to_batches()
        done = table.slice(0, cut).combine_chunks()
        pos = done.column("pos").to_numpy()
        around = _matrix(done.column("around").chunk(0), np.minimum(pos, reach), 2 * reach + k, reach)
        tid, first, last = _extend(h[:cut], done.column("tid").to_numpy(), pos, around, span)
        out = pa.RecordBatch.from_arrays([pa.array(tid), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["tid", "first", "last"])
        return out, table.slice(cut).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(map(len, held)) >= most:
                out, held = flush(held, whole=False)
                if out is not None:
                    yield out
        if held:
            out, _ = flush(held, whole=True)
            yield out

    return run


def _shared_stretches(texts: DataFrame, span: int, k: int, hot: int) -> DataFrame:
    """``tid, first, last`` (from 0, inclusive): stretches of at least ``span`` letters that another text has too."""
    reach = span - k
    every = materialize(anchors(texts, span, k), "span-anchors")
    # Counted map-side first, so that a seed of very many texts is one row a task and its occurrences can be spread.
    seeds = every.groupBy("h").agg(F.min("tid").alias("a"), F.max("tid").alias("b"), F.count("*").alias("c")).where("a <> b").select("h", "c")
    seeds = materialize(seeds, "span-seeds")
    hits = materialize(spread_join(every, seeds, "h", "c"), "seed-hits")
    around = hits.join(texts.select("tid", "letters"), "tid").select(
        "h", "c", "tid", "pos", F.substring("letters", F.greatest(F.col("pos") - reach, F.lit(0)) + 1, F.lit(k + reach) + F.least(F.col("pos"), F.lit(reach))).alias("around")
    )
    local = around.where(F.col("c") <= hot).select("h", "tid", "pos", "around").repartition("h").sortWithinPartitions("h")
    out = local.mapInArrow(_extend_sorted(span, k), "tid long, first int, last int")
    if hits.where(F.col("c") > hot).isEmpty():
        return out
    # A seed with more occurrences than a task should hold: the same comparison as an aggregation.
    left = F.least(F.col("pos"), F.lit(reach))
    places = F.sequence(F.lit(0), F.length("around") - span)
    many = around.where(F.col("c") > hot).where(F.length("around") >= span).select("tid", (F.col("pos") - left).alias("at"), "around", F.explode(places).alias("j"))
    many = many.select("tid", (F.col("at") + F.col("j")).alias("first"), F.substring("around", F.col("j") + 1, F.lit(span)).alias("stretch"))
    again = many.groupBy("stretch").agg(F.min("tid").alias("a"), F.max("tid").alias("b"), F.count("*").alias("c")).where("a <> b").select("stretch", "c")
    again = materialize(again, "span-stretches")
    several = spread_join(many, again, "stretch", "c")
    return out.unionByName(several.select("tid", "first", (F.col("first") + span - 1).alias("last")))


def _runs(stretches: DataFrame) -> DataFrame:
    """Overlapping and touching stretches of a text merged to maximal runs."""
    before = Window.partitionBy("tid").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("tid").orderBy("first", "last")
    starts = stretches.withColumn("new", F.coalesce(F.col("first") > F.max("last").over(before) + 1, F.lit(True)).cast("int"))
    return starts.withColumn("run", F.sum("new").over(upto)).groupBy("tid", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def shared_spans(records: DataFrame, span: int = SPAN, k: int = SEED, hot: int = 50_000) -> DataFrame:
    """Longest runs of letters each ``span`` of which, in a row, stand in another record as well.

    ``records`` has ``record_set, record_id, letters`` (letters A-Z only); further columns are ignored.
    Texts that are null, empty or shorter than ``span`` share nothing. Copies share their whole text.
    Repeats inside one record do not count. A row of the records that stands twice is two records.

    A seed with more than ``hot`` occurrences is extended by a distributed aggregation with the same
    result in place of one task.
    """
    records = records.select("record_set", "record_id", "letters").where(F.length("letters") >= span)
    texts = distinct_texts(records, [], "span-texts")
    keyed = records.select("record_set", "record_id", F.md5("letters").alias("digest"))
    members = spread_join(keyed, texts.select("digest", "tid", "n", F.length("letters").alias("size")), "digest", "n")
    whole = members.where("n > 1").select("record_set", "record_id", F.lit(1).alias("first_pos"), F.col("size").alias("last_pos"))
    runs = _runs(_shared_stretches(texts, span, k, hot))
    own = members.where("n = 1").join(runs, "tid").select("record_set", "record_id", (F.col("first") + 1).alias("first_pos"), (F.col("last") + 1).alias("last_pos"))
    return whole.unionByName(own)


def shared_part(records: DataFrame, span: int = SPAN, k: int = SEED) -> DataFrame:
    """Each record with its letters, how many of them are shared, and their part; records without letters are left out."""
    spans = shared_spans(records, span, k).groupBy("record_set", "record_id").agg(F.count("*").alias("spans"), F.sum(F.expr("last_pos - first_pos + 1")).alias("shared"))
    sizes = records.where("letters <> ''").select("record_set", "record_id", F.length("letters").alias("residues"))
    return sizes.join(spans, ["record_set", "record_id"], "left").select(
        "record_set",
        "record_id",
        "residues",
        F.coalesce("spans", F.lit(0)).alias("spans"),
        F.coalesce("shared", F.lit(0)).alias("shared"),
        F.round(F.coalesce("shared", F.lit(0)) / F.col("residues"), 6).alias("shared_part"),
    )
