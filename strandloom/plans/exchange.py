"""Queries through files and streams: what is written and read again must be what was there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandloom import sinks
from strandloom.functions import hashing
from strandloom.functions import sequence as S
from strandloom.plans.catalog import Catalog
from strandloom.session import read, shared_dir
from strandloom.sources import json_array, text_files
from strandloom.streaming import events as streams

catalog = Catalog()
query = catalog.query


def _place(spark, name):
    return f"{shared_dir(spark)}/strandloom/{name}-{uuid.uuid4().hex}"


@query("SELECT record_key AS id, upper(regexp_replace(protein_sequence, '[^A-Za-z]', '', 'g')) AS seq FROM cas13_records WHERE regexp_matches(protein_sequence, '[A-Za-z]')")
def fasta_exchange(spark, directory):
    """Sequences written to FASTA files and read again."""
    rows = read(spark, directory, "cas13_records").select(F.col("record_key").alias("id"), S.letters(F.col("protein_sequence")).alias("seq")).where("seq <> ''")
    sinks.write_fasta(rows, path := _place(spark, "fasta"))
    return text_files.read_fasta(spark, path)


@query("SELECT candidate_id, scaffold_id, seed, sequence FROM candidates")
def json_array_exchange(spark, directory):
    """Designs written as JSON arrays and read again in byte ranges."""
    rows = read(spark, directory, "candidates").select("candidate_id", "scaffold_id", "seed", "sequence")
    sinks.write_json_arrays(rows, path := _place(spark, "arrays"))
    files = [r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").collect()]
    back = json_array.read_json_array(spark, [f.replace("file:/", "file:///", 1) if f.startswith("file:/") and not f.startswith("file:///") else f for f in files])
    v = F.try_parse_json("raw_json")
    return back.where("error is null").select(*[F.try_variant_get(v, f"$.{c}", k).alias(c) for c, k in (("candidate_id", "string"), ("scaffold_id", "string"), ("seed", "long"), ("sequence", "string"))])


@query("SELECT candidate_id, method, seed, CAST(CAST('0x' || sha256(candidate_id)[1:16] AS UBIGINT) % 8 AS INTEGER) AS shard FROM candidates WHERE method IS NOT NULL")
def sharded_exchange(spark, directory):
    """Designs written as JSON lines by method and shard and read again."""
    rows = read(spark, directory, "candidates").where("method is not null").select("candidate_id", "method", "seed", hashing.shard_of(F.col("candidate_id"), 8).alias("shard"))
    sinks.write_sharded_json(rows, path := _place(spark, "shards"), ["method", "shard"], 8)
    return spark.read.schema("candidate_id string, seed long, method string, shard int").json(path)


@query("SELECT DISTINCT scaffold_id AS representative, candidate_id AS member FROM candidates WHERE scaffold_id IS NOT NULL")
def cluster_table_exchange(spark, directory):
    """Cluster tables written as TSV and read again."""
    rows = read(spark, directory, "candidates").where("scaffold_id is not null").select(F.col("scaffold_id").alias("representative"), F.col("candidate_id").alias("member")).distinct()
    rows.write.csv(path := _place(spark, "clusters"), sep="\t")
    return text_files.read_cluster_tsv(spark, path)


@query(
    """
SELECT query, target, fident FROM (
  SELECT operon_id AS query, sequence_sha256 AS target, round(score / 10000, 6) AS fident, row_number() OVER (PARTITION BY operon_id ORDER BY round(score / 10000, 6) DESC, sequence_sha256) AS k FROM cas_effectors
  WHERE operon_id IS NOT NULL AND sequence_sha256 IS NOT NULL AND score BETWEEN 0 AND 10000 QUALIFY k = 1)
"""
)
def hit_table_exchange(spark, directory):
    """Similarity hits written as TSV, read again, and the best of each query; ties go to the smallest target."""
    score = F.round(F.col("score") / 10000, 6)
    hits = read(spark, directory, "cas_effectors").where("operon_id is not null and sequence_sha256 is not null and score between 0 and 10000")
    rows = hits.select(F.col("operon_id").alias("query"), F.col("sequence_sha256").alias("target"), score.alias("fident"), F.lit(1).alias("alnlen"), F.lit(1.0).alias("qcov"), F.lit(1.0).alias("tcov"), F.lit(0.0).alias("evalue"), F.lit(1.0).alias("bits"))
    rows.write.csv(path := _place(spark, "hits"), sep="\t")
    return text_files.best_hits(text_files.read_hits(spark, path)).select("query", "target", "fident")


@query("SELECT count(*) AS rows, count(DISTINCT record_key) AS keys, min(record_key) AS first_key FROM cas13_records")
def staged_exchange(spark, directory):
    """Records written by staging and renaming, and counted there."""
    sinks.staged_parquet(read(spark, directory, "cas13_records").select("record_key", "subtype"), path := _place(spark, "staged"))
    return spark.read.parquet(path).agg(F.count("*").alias("rows"), F.count_distinct("record_key").alias("keys"), F.min("record_key").alias("first_key"))


@query()
def file_checksums(spark, directory):
    """SHA-256 of the files that a sharded table was written to."""
    sinks.write_sharded_json(read(spark, directory, "candidates").select("candidate_id", "method"), path := _place(spark, "summed"), ["method"])
    return sinks.checksums(spark, path).select(F.regexp_extract("path", r"method=([^/]*)", 1).alias("method"), "length", "sha256")


_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@query(
    """
WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(*) AS events FROM events GROUP BY ALL)
SELECT * FROM w WHERE window_start + INTERVAL 6 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 2 HOUR
"""
)
def streamed_windows(spark, directory):
    """Six-hour windows of events as a stream emits them, two hours late at most."""
    source = streams.landing(spark, f"{directory}/events.parquet*", _EVENTS).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counted = streams.window_counts(source, "ts", ["event_type"], "6 hours", "2 hours")
    return streams.run_available(counted, "windows").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def streamed_first_sightings(spark, directory):
    """Users and event types as a stream first sees them."""
    source = streams.landing(spark, f"{directory}/events.parquet*", _EVENTS)
    return streams.run_available(streams.first_sightings(source, ["user_id", "event_type"]), "sightings")


QUERIES, SQL = catalog.queries, catalog.sql
