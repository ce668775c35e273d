"""Designs measured and gated: sequence metrics in one pass, novelty reasons, recovery, eligibility for alignments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import AMINO_ACIDS, invalid_symbols

_AMINO = np.frombuffer(AMINO_ACIDS.encode(), np.uint8)
_METRICS = (
    ("residues", pa.int32()),
    ("same", pa.int32()),
    ("parent_identity", pa.float64()),
    ("designed_identity", pa.float64()),
    ("entropy", pa.float64()),
    ("designed_entropy", pa.float64()),
    ("homopolymer", pa.int32()),
    ("windows", pa.int32()),
    ("new_windows", pa.int32()),
    ("composition_deviation", pa.float64()),
    ("net_charge", pa.float64()),
    ("hydrophobicity", pa.float64()),
)


def _entropy(codes: np.ndarray) -> float | None:
    if not len(codes):
        return None
    f = np.bincount(codes)
    f = f[f > 0] / len(codes)
    return abs(float(-(f * np.log(f)).sum()))


def _windows(codes: np.ndarray, window: int, fraction: float) -> set[int]:
    if len(codes) < window:
        return set()
    sums = np.cumsum(_AMINO[:, None] == codes, axis=1, dtype=np.int32)
    counts = sums[:, window - 1 :].copy()
    counts[:, 1:] -= sums[:, :-window]
    return set(np.flatnonzero(counts.max(axis=0) > fraction * window + 1e-9).tolist())


def _measure(s: str, p: str | None, fixed: list[int] | None, window: int, fraction: float) -> tuple:
    a = np.frombuffer(s.encode("latin-1", "replace"), np.uint8)
    b = None if p is None else np.frombuffer(p.encode("latin-1", "replace"), np.uint8)
    n = len(a)
    alike = a == b if b is not None and len(b) == n else None
    free = np.ones(n, bool)
    if fixed is not None:
        held = np.array([i for i in fixed if i is not None and 0 <= i < n], np.int64)
        free[held] = False
    designed = bool(n) and fixed is not None and free.any()
    runs = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if n else np.zeros(0, np.int64)
    low = _windows(a, window, fraction)
    counts = lambda x: (x[:, None] == _AMINO).sum(axis=0) / len(x)
    return (
        n,
        None if alike is None else int(alike.sum()),
        None if alike is None or not n else float(alike.mean()),
        float(alike[free].mean()) if alike is not None and designed else None,
        _entropy(a),
        _entropy(a[free]) if designed else None,
        int(np.diff(np.append(runs, n)).max()) if n else 0,
        len(low),
        None if b is None else len(low - _windows(b, window, fraction)),
        float(np.abs(counts(a) - counts(b)).sum() / 2) if n and b is not None and len(b) else None,
        float((np.isin(a, _KR).sum() - np.isin(a, _DE).sum()) / n) if n else None,
        float(np.isin(a, _APOLAR).sum() / n) if n else None,
    )


_KR, _DE, _APOLAR = (np.frombuffer(x, np.uint8) for x in (b"KR", b"DE", b"AVILMFWY"))


def design_metrics(df: DataFrame, key: str, sequence: str, parent: str, fixed: str, window: int = 12, fraction: float = 1 / 3) -> DataFrame:
    """One row of metrics a design: ``key`` and the columns of ``_METRICS``, all from one pass over its letters.

    Identities are null for unequal or no length, the designed ones also without a list of fixed places (from 0) or
    where it holds all. ``windows`` count stretches in which one residue makes more than ``fraction``, ``new_windows``
    those that the parent lacks. A null sequence has nulls throughout. Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(None,) * len(_METRICS) if s is None else _measure(s, p, f, window, fraction) for s, p, f in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
            columns = list(zip(*rows)) or [()] * len(_METRICS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, kind) for c, (_, kind) in zip(columns, _METRICS)]], ["key", *[n for n, _ in _METRICS]])

    kind = df.schema[key].dataType.simpleString()
    schema = ", ".join([f"key {kind}", *[f"{n} {'int' if k == pa.int32() else 'double'}" for n, k in _METRICS]])
    return df.select(F.col(key), F.col(sequence), F.col(parent), F.col(fixed).cast("array<int>")).mapInArrow(run, schema).withColumnRenamed("key", key)


def novelty_gate(metrics: DataFrame, hits: DataFrame, key: str, parent: float = 0.8, atlas: float = 0.8, run: int = 4, windows: int = 0, entropy: float = 2.0) -> DataFrame:
    """``metrics`` with the best hit of each design, the ordered reasons why it fails, and whether it passes.

    ``metrics`` has the columns of ``design_metrics`` and ``fixed_position_violations``; ``hits`` has ``key, target,
    identity, coverage``. The best hit is the one of the greatest identity, then coverage, then the smallest target. What
    cannot be measured fails, as does a design without a hit.
    """
    best = hits.where(F.col("identity").isNotNull()).groupBy(key).agg(F.min(F.struct((-F.col("identity")).alias("i"), (-F.col("coverage")).alias("c"), "target")).alias("_b"))
    told = metrics.join(best, key, "left").withColumn("atlas_identity", -F.col("_b.i")).withColumn("atlas_hit", F.col("_b.target")).drop("_b")
    gates: list[Column] = [
        F.when(F.coalesce(F.col("fixed_position_violations"), F.lit(1)) != 0, "fixed_position_violation"),
        F.when(F.col("parent_identity").isNull(), "no_parent_identity").when(F.col("parent_identity") > parent, "parent_identity_above_threshold"),
        F.when(F.col("atlas_identity").isNull(), "no_atlas_hit_at_required_query_coverage").when(F.col("atlas_identity") > atlas, "atlas_identity_above_threshold"),
        F.when(F.coalesce(F.col("homopolymer"), F.lit(run + 1)) > run, "homopolymer_above_threshold"),
        F.when(F.coalesce(F.col("windows"), F.lit(windows + 1)) > windows, "low_complexity_windows_above_threshold"),
        F.when(F.coalesce(F.col("designed_entropy"), F.lit(-1.0)) < entropy, "designed_entropy_below_threshold"),
    ]
    return told.withColumn("failures", F.array_compact(F.array(*gates))).withColumn("passes", F.size("failures") == 0)


def native_recovery(designs: DataFrame, regions: DataFrame) -> DataFrame:
    """``candidate_id, region, places, recovery``: the part of each region's places at which a design has its parent's residue.

    ``designs`` has ``candidate_id, scaffold_id, s, p, fixed_positions``; ``regions`` has ``scaffold_id, region, places
    array<int>`` from 0. Regions ``overall`` and ``designed`` (all places not fixed) come with each design. Places outside
    the sequence are left out; a region without places has a null recovery. Designs of another length than their
    parent are left out.
    """
    fitting = designs.where((F.length("s") == F.length("p")) & (F.length("p") > 0))
    lists = regions.groupBy("scaffold_id").agg(F.collect_list(F.struct("region", "places")).alias("regions"))
    joined = fitting.join(lists, "scaffold_id", "left").select("candidate_id", "s", "p", "fixed_positions", F.coalesce("regions", F.array().cast("array<struct<region:string,places:array<int>>>")).alias("regions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, s, p, fixed, told in zip(*(c.to_pylist() for c in batch.columns)):
                alike = np.frombuffer(s.encode("latin-1", "replace"), np.uint8) == np.frombuffer(p.encode("latin-1", "replace"), np.uint8)
                n = len(alike)
                free = np.setdiff1d(np.arange(n), np.array([i for i in fixed or () if i is not None], np.int64))
                for name, places in [("overall", np.arange(n)), ("designed", free), *((r["region"], np.unique(np.array([i for i in r["places"] or () if i is not None and 0 <= i < n], np.int64))) for r in told)]:
                    out.append((key, name, len(places), float(alike[places].mean()) if len(places) else None))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (batch.schema.field(0).type, pa.string(), pa.int32(), pa.float64()))], ["candidate_id", "region", "places", "recovery"])

    kind = designs.schema["candidate_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"candidate_id {kind}, region string, places int, recovery double")


def fixed_violations(designs: DataFrame) -> DataFrame:
    """``candidate_id, fixed, violations``: fixed places at which a design lacks its parent's residue; places outside count as such."""
    each = designs.select("candidate_id", "s", "p", F.explode(F.array_distinct("fixed_positions")).alias("i")).where("i is not null")
    kept = (F.col("i") >= 0) & (F.col("i") < F.length("p")) & (F.substring("s", F.col("i") + 1, F.lit(1)) == F.substring("p", F.col("i") + 1, F.lit(1)))
    return each.groupBy("candidate_id").agg(F.count("*").alias("fixed"), F.count_if(~F.coalesce(kept, F.lit(False))).alias("violations"))


def eligibility(unique: DataFrame, mapping: DataFrame, least: int = 700, most: int | None = 1600) -> DataFrame:
    """Sequences with the first reason that keeps them out of alignments, or null: ``sequence_sha256, representative, subtypes, residues, invalid_symbols, reason``.

    ``unique`` has ``sequence_sha256, protein_sequence, subtypes, nonconflicting_record_count, complete_record_count``,
    ``mapping`` has ``sequence_sha256, representative_sha256``. Only subtypes VI-* count; sequences without one are left
    out, unless they lack a cluster. Mapping rows that stand twice count once.
    """
    clusters = mapping.groupBy("sequence_sha256").agg(F.min("representative_sha256").alias("representative"))
    told = unique.join(clusters, "sequence_sha256", "left").withColumn("seq", F.upper(F.coalesce("protein_sequence", F.lit(""))))
    told = told.withColumn("subtypes", F.filter("subtypes", lambda x: F.upper(x).startswith("VI-"))).withColumn("residues", F.length("seq"))
    above = (F.col("residues") > most) if most is not None else F.lit(False)
    reason = (
        F.when(F.col("representative").isNull(), "missing_cluster_mapping")
        .when(F.col("nonconflicting_record_count") < 1, "only_subtype_conflicting_records")
        .when(F.col("complete_record_count") < 1, "no_explicitly_complete_record")
        .when(F.col("residues") < least, "below_minimum_protein_length")
        .when(above, "above_maximum_protein_length")
        .when(F.size(invalid_symbols(F.col("seq"))) > 0, "noncanonical_amino_acid")
    )
    held = told.where(F.col("representative").isNull() | (F.size("subtypes") > 0))
    return held.select("sequence_sha256", "representative", "subtypes", "residues", F.array_join(invalid_symbols(F.col("seq")), "").alias("invalid_symbols"), reason.alias("reason"))


def alignment_members(eligible: DataFrame) -> DataFrame:
    """``subtype, representative, sequence_sha256, residues``: of each subtype and cluster the longest sequence, ties by hash."""
    each = eligible.where("reason is null").select(F.explode("subtypes").alias("subtype"), "representative", F.struct((-F.col("residues")).alias("short"), "sequence_sha256").alias("s"))
    return each.groupBy("subtype", "representative").agg(F.min("s").alias("s")).select("subtype", "representative", "s.sequence_sha256", (-F.col("s.short")).alias("residues"))
