"""Queries over operons, effectors, arrays and Cas13 records."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.functions import hashing
from strandloom.functions import sequence as S
from strandloom.operators import records as R
from strandloom.operators.skew import spread_join
from strandloom.plans.catalog import Catalog
from strandloom.session import materialize, read, shared_dir

catalog = Catalog()
query = catalog.query
SEED = 20260731

_GOOD = """
WITH raw AS (
  SELECT record_index, raw_json, CASE WHEN json_valid(raw_json) THEN json(raw_json) END AS v FROM operon_raw
), marked AS (
  SELECT record_index, v, trim(json_extract_string(v, '$.operon_id')) AS operon_id,
    CASE WHEN raw_json IS NULL THEN 'null_text' WHEN v IS NULL THEN 'malformed_json' WHEN json_type(v) <> 'OBJECT' THEN 'not_an_object'
         WHEN coalesce(trim(json_extract_string(v, '$.operon_id')), '') = '' THEN 'missing_operon_id'
         WHEN coalesce(json_type(v, '$.summary'), 'NULL') NOT IN ('OBJECT', 'NULL') OR coalesce(json_type(v, '$.metadata'), 'NULL') NOT IN ('OBJECT', 'NULL') THEN 'invalid_field'
         WHEN len(list_filter(list_concat(json_extract_string(v, '$.cas[*].evalue'), json_extract_string(v, '$.cas[*].score'), json_extract_string(v, '$.cas[*].length')), lambda x: regexp_matches(x, '\\S') AND TRY_CAST(x AS DOUBLE) IS NULL)) > 0 THEN 'invalid_number' END AS error_type
  FROM raw
), good AS (SELECT record_index, v, operon_id, trim(coalesce(json_extract_string(v, '$.summary.subtype'), '')) AS subtype FROM marked WHERE error_type IS NULL
), lists AS (
  SELECT *, CASE json_type(v, '$.cas') WHEN 'ARRAY' THEN json_extract(v, '$.cas[*]') WHEN 'OBJECT' THEN [json_extract(v, '$.cas')] ELSE [] END AS cas,
    CASE json_type(v, '$.crispr') WHEN 'ARRAY' THEN json_extract(v, '$.crispr[*]') WHEN 'OBJECT' THEN [json_extract(v, '$.crispr')] ELSE [] END AS crispr FROM good
), cas_rows AS (
  SELECT record_index, operon_id, subtype, v, i - 1 AS cas_index, c FROM (SELECT *, unnest(cas) AS c, generate_subscripts(cas, 1) AS i FROM lists) WHERE json_type(c) = 'OBJECT'
), array_rows AS (
  SELECT record_index, operon_id, i - 1 AS array_index, c FROM (SELECT *, unnest(crispr) AS c, generate_subscripts(crispr, 1) AS i FROM lists) WHERE json_type(c) = 'OBJECT'
)
"""


def _good(spark, directory):
    return R.parsed(read(spark, directory, "operon_raw")).where("error_type is null")


@query(
    _GOOD
    + """
, cas_facts AS (
  SELECT record_index, count(*) AS n_cas,
    bool_or(regexp_matches(lower(concat_ws(' ', json_extract_string(c, '$.gene_name'), json_extract_string(c, '$.hmm_name'), json_extract_string(c, '$.annotation'))), 'cas13|c2c2') AND (regexp_matches(upper(coalesce(json_extract_string(c, '$.hmm_name'), '')), 'CAS[-_]VI[-_][A-Z]') OR regexp_matches(upper(coalesce(nullif(json_extract_string(c, '$.gene_name'), ''), json_extract_string(c, '$.annotation'), '')), '\\bCAS13[A-J](?:\\b|[^A-Z])'))) AS infers
  FROM cas_rows GROUP BY 1
), array_facts AS (
  SELECT record_index, count(*) AS n_crispr, sum(CASE WHEN json_type(c, '$.crispr_spacers') = 'ARRAY' THEN json_array_length(c, '$.crispr_spacers') ELSE 0 END) AS n_spacers FROM array_rows GROUP BY 1
)
SELECT record_index, operon_id, subtype, upper(subtype) = 'VI' OR starts_with(upper(subtype), 'VI-') OR (subtype = '' AND coalesce(infers, false)) AS is_type_vi,
  json_extract_string(v, '$.metadata.source_db') AS source, json_extract_string(v, '$.metadata.taxonomy') AS taxonomy,
  json_extract_string(v, '$.metadata.biome') AS biome, json_extract_string(v, '$.metadata.assembly_type') AS assembly_type,
  coalesce(n_cas, 0) AS n_cas, coalesce(n_crispr, 0) AS n_crispr, CAST(coalesce(n_spacers, 0) AS BIGINT) AS n_spacers,
  len(list_filter(['contig', 'contig_id', 'start', 'end', 'strand', 'genes', 'genomic_context'], lambda k: list_contains(json_keys(v), k))) > 0 AS genomic_context_available
FROM good LEFT JOIN cas_facts USING (record_index) LEFT JOIN array_facts USING (record_index)
"""
)
def operon_rows(spark, directory):
    """Normalised operons of the nested texts."""
    return R.operon_rows(_good(spark, directory)).drop("metadata_json", "crispr_arrays_json", "cas_annotations_json", "genomic_context_json")


@query()
def operon_json(spark, directory):
    """The JSON parts of normalised operons, with sorted keys and without proteins."""
    return R.operon_rows(_good(spark, directory)).select("record_index", "metadata_json", "crispr_arrays_json", "cas_annotations_json", "genomic_context_json")


@query(_GOOD + "SELECT record_index, operon_id, error_type FROM marked WHERE error_type IS NOT NULL")
def operon_failures(spark, directory):
    """Texts that give no operon, with the reason."""
    return R.parsed(read(spark, directory, "operon_raw")).where("error_type is not null").select("record_index", "operon_id", "error_type")


@query(
    _GOOD
    + """
, e AS (SELECT *, upper(regexp_replace(coalesce(json_extract_string(c, '$.protein'), ''), '\\s', '', 'g')) AS s FROM cas_rows)
SELECT record_index, operon_id, cas_index, subtype,
  coalesce(nullif(json_extract_string(c, '$.gene_name'), ''), nullif(json_extract_string(c, '$.hmm_name'), ''), 'unknown') AS gene_name,
  json_extract_string(c, '$.hmm_name') AS hmm_name, s AS protein_sequence, sha256(s) AS sequence_sha256, length(s) AS protein_length,
  TRY_CAST(json_extract_string(c, '$.evalue') AS DOUBLE) AS evalue, TRY_CAST(json_extract_string(c, '$.score') AS DOUBLE) AS score,
  json_extract_string(c, '$.truncated') AS truncated, json_extract_string(v, '$.metadata.source_db') AS source, json_extract_string(v, '$.metadata.taxonomy') AS taxonomy
FROM e WHERE s <> ''
"""
)
def operon_effectors(spark, directory):
    """Effectors of the nested texts, one row each."""
    return R.cas_effectors(R.effector_rows(_good(spark, directory)))


@query(
    _GOOD
    + """
, a AS (
  SELECT *, lower(trim(coalesce(nullif(json_extract_string(c, '$.orientation'), ''), 'unknown'))) AS said, trim(coalesce(json_extract_string(c, '$.orientation_source'), '')) AS given,
    replace(upper(regexp_replace(coalesce(json_extract_string(c, '$.crispr_repeat'), ''), '\\s', '', 'g')), 'T', 'U') AS raw,
    CASE WHEN json_type(c, '$.crispr_spacers') = 'ARRAY' THEN json_extract(c, '$.crispr_spacers[*]') ELSE [] END AS list FROM array_rows
), b AS (
  SELECT *, CASE WHEN said IN ('forward', 'reverse', 'recovered') THEN said ELSE 'unknown' END AS orientation,
    list_transform(list, lambda x: replace(upper(regexp_replace(coalesce(CASE WHEN json_type(x) = 'OBJECT' THEN json_extract_string(x, '$.seq') ELSE x ->> '$' END, ''), '\\s', '', 'g')), 'T', 'U')) AS spacers_raw FROM a
)
SELECT record_index, operon_id, array_index, raw AS direct_repeat_raw,
  CASE WHEN orientation = 'reverse' THEN reverse(translate(raw, 'ACGUN', 'UGCAN')) ELSE raw END AS direct_repeat,
  CASE WHEN orientation = 'reverse' THEN list_transform(spacers_raw, lambda x: reverse(translate(x, 'ACGUN', 'UGCAN'))) ELSE spacers_raw END AS spacers,
  len(spacers_raw) AS spacer_count, orientation,
  CASE WHEN given <> '' THEN given WHEN orientation = 'unknown' THEN 'not_provided_by_atlas_v1.0' ELSE 'declared_in_source_record' END AS orientation_source
FROM b
"""
)
def operon_arrays(spark, directory):
    """Repeat arrays of the nested texts, oriented."""
    return R.array_rows(_good(spark, directory))


@query(
    _GOOD
    + """
SELECT (SELECT count(*) FROM marked) AS texts, (SELECT count(*) FROM good) AS operons,
  (SELECT count(*) FROM good WHERE starts_with(subtype, 'VI')) AS type_vi,
  (SELECT count(*) FROM cas_rows WHERE regexp_matches(lower(concat_ws(' ', json_extract_string(c, '$.gene_name'), json_extract_string(c, '$.hmm_name'), json_extract_string(c, '$.annotation'))), 'cas13|c2c2')) AS cas13_effectors
"""
)
def atlas_inspection(spark, directory):
    """Texts, operons, type VI operons and Cas13 effectors, counted in one pass."""
    parsed = R.parsed(read(spark, directory, "operon_raw"))
    cas13 = F.size(F.filter(R._children("$.cas"), lambda c: R.is_cas13(*R._named(c))))
    per = parsed.select("error_type", F.trim(F.coalesce(R._text("$.summary.subtype"), F.lit(""))).alias("subtype"), F.when(F.col("error_type").isNull(), cas13).otherwise(0).alias("n"))
    good = F.col("error_type").isNull()
    return per.agg(F.count("*").alias("texts"), F.count_if(good).alias("operons"), F.count_if(good & F.col("subtype").startswith("VI")).alias("type_vi"), F.sum("n").alias("cas13_effectors"))


_RESOLVE = r"""
resolved AS (
  SELECT *, CASE WHEN raw LIKE 'VI-%' THEN raw ELSE coalesce(inferred, raw) END AS resolved_subtype,
    CASE WHEN raw LIKE 'VI-%' THEN CASE WHEN clash THEN 'atlas_summary_conflict' ELSE 'atlas_summary' END
         WHEN raw IN ('VI', '') THEN CASE WHEN inferred IS NOT NULL THEN src ELSE 'atlas_summary_unresolved' END
         WHEN inferred IS NOT NULL THEN src || '_summary_conflict' ELSE 'atlas_summary_non_type_vi' END AS resolved_source,
    CASE WHEN raw LIKE 'VI-%' THEN clash ELSE raw NOT IN ('VI', '') END AS resolved_conflict
  FROM (
    SELECT *, coalesce('VI-' || hl, 'VI-' || nl) AS inferred, CASE WHEN hl IS NOT NULL THEN 'cas_hmm_explicit' WHEN nl IS NOT NULL THEN 'effector_name_nomenclature' ELSE 'atlas_summary' END AS src,
      coalesce(coalesce('VI-' || hl, 'VI-' || nl) <> raw AND NOT starts_with(raw, coalesce('VI-' || hl, 'VI-' || nl)), false) AS clash
    FROM (
      SELECT *, upper(trim(coalesce(subtype, ''))) AS raw, nullif(regexp_extract(upper(hmm_name), 'CAS[-_]VI[-_]([A-Z][A-Z0-9]*)', 1), '') AS hl,
        nullif(regexp_extract(upper(gene_name), '\bCAS13([A-J])(?:\b|[^A-Z])', 1), '') AS nl
      FROM effectors WHERE regexp_matches(lower(concat_ws(' ', gene_name, hmm_name)), 'cas13|c2c2')))
)
"""
_EFFECTORS = "WITH effectors AS (SELECT DISTINCT operon_id, subtype, gene_name, hmm_name, sequence_sha256, evalue, score, truncated, source, annotated_at FROM cas_effectors), "


_NESTED = (
    _GOOD
    + r"""
, effectors AS (
  SELECT record_index, operon_id, cas_index, subtype, c, coalesce(nullif(json_extract_string(c, '$.gene_name'), ''), json_extract_string(c, '$.annotation')) AS gene_name, json_extract_string(c, '$.hmm_name') AS hmm_name,
    upper(regexp_replace(coalesce(json_extract_string(c, '$.protein'), ''), '\s', '', 'g')) AS protein_sequence,
    coalesce(nullif(json_extract_string(c, '$.gene_name'), ''), nullif(json_extract_string(c, '$.hmm_name'), ''), 'Cas13') AS effector_name, concat_ws(' ', json_extract_string(c, '$.gene_name'), json_extract_string(c, '$.annotation')) AS told
  FROM cas_rows
), """.replace("\\\\", "\\")
    + _RESOLVE.replace("concat_ws(' ', gene_name, hmm_name)", "concat_ws(' ', told, hmm_name)")
    + """
, records AS (
  SELECT record_index, operon_id, cas_index, resolved_subtype AS subtype, subtype AS subtype_raw, resolved_source AS subtype_source, resolved_conflict AS subtype_conflict, effector_name, hmm_name, protein_sequence,
    sha256(protein_sequence) AS sequence_sha256, length(protein_sequence) AS protein_length, TRY_CAST(json_extract_string(c, '$.length') AS BIGINT) AS source_length_field, TRY_CAST(json_extract_string(c, '$.evalue') AS DOUBLE) AS evalue,
    TRY_CAST(json_extract_string(c, '$.score') AS DOUBLE) AS score, json_extract_string(c, '$.truncated') AS truncated
  FROM resolved WHERE protein_sequence <> ''
)"""
)
_PAIRED = (
    _NESTED
    + r"""
, a AS (
  SELECT record_index, array_index, lower(trim(coalesce(nullif(json_extract_string(c, '$.orientation'), ''), 'unknown'))) AS said, trim(coalesce(json_extract_string(c, '$.orientation_source'), '')) AS given,
    replace(upper(regexp_replace(coalesce(json_extract_string(c, '$.crispr_repeat'), ''), '\s', '', 'g')), 'T', 'U') AS raw FROM array_rows
), b AS (SELECT *, CASE WHEN said IN ('forward', 'reverse', 'recovered') THEN said ELSE 'unknown' END AS orientation, count(*) OVER (PARTITION BY record_index) AS n, row_number() OVER (PARTITION BY record_index ORDER BY array_index) AS k FROM a)
, f AS (SELECT *, count(*) OVER (PARTITION BY record_index) AS n, row_number() OVER (PARTITION BY record_index ORDER BY cas_index) AS k FROM records)
, paired AS (
  SELECT f.record_index, f.operon_id, f.subtype, subtype_raw, subtype_source, subtype_conflict, effector_name, protein_sequence, coalesce(CASE WHEN b.orientation = 'reverse' THEN reverse(translate(raw, 'ACGUN', 'UGCAN')) ELSE raw END, '') AS direct_repeat,
    coalesce(raw, '') AS direct_repeat_raw, coalesce(b.orientation, 'unknown') AS orientation, f.n AS effectors, coalesce(b.n, 0) AS arrays,
    CASE WHEN b.record_index IS NULL THEN 'array_not_available' WHEN given <> '' THEN given WHEN b.orientation = 'unknown' THEN 'not_provided_by_atlas_v1.0' ELSE 'declared_in_source_record' END AS orientation_source
  FROM f LEFT JOIN b ON b.record_index = f.record_index AND b.k = 1 WHERE f.k = 1
), told AS (
  SELECT *, concat_ws(';', CASE WHEN effectors <> 1 THEN 'effector_count=' || effectors END, CASE WHEN arrays <> 1 THEN 'array_count=' || arrays END, CASE WHEN direct_repeat = '' THEN 'empty_direct_repeat' END,
    CASE WHEN NOT starts_with(upper(subtype), 'VI-') THEN 'ambiguous_subtype' END, CASE WHEN subtype_conflict THEN 'subtype_conflict_with_operon_summary' END, CASE WHEN orientation = 'unknown' THEN 'orientation_not_recovered' END) AS why FROM paired
), pairs AS (SELECT * EXCLUDE (why, effectors, arrays), CASE WHEN why = '' THEN 'high' ELSE 'ambiguous' END AS pairing_confidence, nullif(why, '') AS ambiguity_reason FROM told)""".replace("\\\\", "\\")
)


@query(_NESTED + " SELECT * FROM records")
def operon_cas13(spark, directory):
    """Cas13 records of the nested texts with their subtype resolved."""
    return R.cas13_records(R.effector_rows(_good(spark, directory))).drop("source", "taxonomy", "metadata_json")


@query(_PAIRED + " SELECT * FROM pairs")
def operon_pairs(spark, directory):
    """Cas13 effectors of the nested texts paired with their operon's first repeat."""
    good = _good(spark, directory)
    return R.operon_pairs(R.cas13_records(R.effector_rows(good)), R.array_rows(good)).drop("spacers")


@query(
    _PAIRED
    + """
, cf AS (SELECT record_index, bool_or(regexp_matches(lower(concat_ws(' ', told, hmm_name)), 'cas13|c2c2') AND (regexp_matches(upper(coalesce(hmm_name, '')), 'CAS[-_]VI[-_][A-Z]') OR regexp_matches(upper(coalesce(gene_name, '')), '\\bCAS13[A-J](?:\\b|[^A-Z])'))) AS infers FROM effectors GROUP BY 1)
, ops AS (SELECT subtype, upper(subtype) = 'VI' OR starts_with(upper(subtype), 'VI-') OR (subtype = '' AND coalesce(infers, false)) AS vi FROM good LEFT JOIN cf USING (record_index))
, u AS (SELECT sequence_sha256, count(*) FILTER (NOT subtype_conflict) AS nc, count(*) FILTER (truncated = '00') AS ok FROM records GROUP BY 1)
SELECT 'texts' AS stage, CAST(NULL AS VARCHAR) AS subtype, count(*) AS count FROM marked UNION ALL SELECT 'atlas_operons', NULL, count(*) FROM good UNION ALL SELECT 'type_vi_operons', NULL, count(*) FILTER (vi) FROM ops
UNION ALL SELECT 'cas_effectors', NULL, count(*) FROM effectors WHERE protein_sequence <> '' UNION ALL SELECT 'cas13_records', NULL, count(*) FROM records UNION ALL SELECT 'crispr_arrays', NULL, count(*) FROM array_rows
UNION ALL SELECT 'cas13_direct_repeat_pairs', NULL, count(*) FROM pairs WHERE pairing_confidence = 'high' UNION ALL SELECT 'ambiguous_pairs', NULL, count(*) FROM pairs WHERE pairing_confidence = 'ambiguous'
UNION ALL SELECT 'processing_failures', NULL, count(*) FROM marked WHERE error_type IS NOT NULL UNION ALL SELECT 'cas13_exact_unique', NULL, count(*) FROM u
UNION ALL SELECT 'conflicts', NULL, count(*) FROM records WHERE subtype_conflict UNION ALL SELECT 'complete_records', NULL, count(*) FROM records WHERE truncated = '00'
UNION ALL SELECT 'eligible_exact_unique', NULL, count(*) FROM u WHERE nc > 0 AND ok > 0
UNION ALL SELECT 'operon_subtypes', subtype, count(*) FROM good GROUP BY subtype UNION ALL SELECT 'record_subtypes', subtype, count(*) FROM records GROUP BY subtype
"""
)
def atlas_build(spark, directory):
    """The nine normalised tables written from the nested texts, and the funnel of what went where."""
    return R.build_atlas(read(spark, directory, "operon_raw"), f"{shared_dir(spark)}/strandloom/atlas-{uuid.uuid4().hex}")


def _cas13_effectors(spark, directory):
    """Cas13 effectors with their subtype resolved; rows delivered twice count once."""
    keep = ["operon_id", "subtype", "gene_name", "hmm_name", "sequence_sha256", "evalue", "score", "truncated", "source", "annotated_at"]
    once = read(spark, directory, "cas_effectors").where(R.is_cas13(F.col("gene_name"), F.col("hmm_name"))).select(*keep).distinct()
    return once.withColumn("r", R.resolve_subtype(F.col("subtype"), F.col("gene_name"), F.col("hmm_name")))


@query(_EFFECTORS + _RESOLVE + "SELECT resolved_subtype AS subtype, resolved_source AS subtype_source, resolved_conflict AS subtype_conflict, gene_name, count(*) AS effectors FROM resolved GROUP BY ALL")
def cas13_subtypes(spark, directory):
    """Resolved subtypes of Cas13 effectors, where they come from and how often they clash."""
    return _cas13_effectors(spark, directory).groupBy("r.subtype", "r.subtype_source", "r.subtype_conflict", "gene_name").agg(F.count("*").alias("effectors"))


@query(
    _EFFECTORS
    + _RESOLVE
    + """
, firsts AS (
  SELECT operon_id, resolved_subtype AS subtype, resolved_conflict AS clash, gene_name, sequence_sha256, count(*) OVER (PARTITION BY operon_id) AS n,
    row_number() OVER (PARTITION BY operon_id ORDER BY sequence_sha256 NULLS FIRST, gene_name NULLS FIRST, resolved_subtype NULLS FIRST, resolved_conflict NULLS FIRST) AS k
  FROM resolved WHERE operon_id IS NOT NULL
), arrays AS (
  SELECT operon_id, direct_repeat, orientation, count(*) OVER (PARTITION BY operon_id) AS n, row_number() OVER (PARTITION BY operon_id ORDER BY array_index) AS k
  FROM (SELECT DISTINCT operon_id, array_index, direct_repeat, orientation FROM crispr_arrays)
), pairs AS (
  SELECT f.operon_id, f.subtype, f.gene_name AS effector_name, f.sequence_sha256, coalesce(a.direct_repeat, '') AS direct_repeat, coalesce(a.orientation, 'unknown') AS orientation,
    concat_ws(';', CASE WHEN f.n <> 1 THEN 'effector_count=' || f.n END, CASE WHEN coalesce(a.n, 0) <> 1 THEN 'array_count=' || coalesce(a.n, 0) END,
      CASE WHEN coalesce(a.direct_repeat, '') = '' THEN 'empty_direct_repeat' END, CASE WHEN NOT starts_with(coalesce(upper(f.subtype), ''), 'VI-') THEN 'ambiguous_subtype' END,
      CASE WHEN f.clash THEN 'subtype_conflict_with_operon_summary' END, CASE WHEN coalesce(a.orientation, 'unknown') = 'unknown' THEN 'orientation_not_recovered' END) AS why
  FROM firsts f LEFT JOIN arrays a ON a.operon_id = f.operon_id AND a.k = 1 WHERE f.k = 1
)
SELECT operon_id, subtype, effector_name, sequence_sha256, direct_repeat, orientation, CASE WHEN why = '' THEN 'high' ELSE 'ambiguous' END AS pairing_confidence, nullif(why, '') AS ambiguity_reason FROM pairs
"""
)
def repeat_pairs(spark, directory):
    """Cas13 effectors paired with their operon's repeat, and why a pair is unsure."""
    named = F.struct(F.col("sequence_sha256"), F.col("gene_name"), F.col("r.subtype"), F.col("r.subtype_conflict"))
    effectors = _cas13_effectors(spark, directory).where("operon_id is not null").select("operon_id", named.alias("ordinal"), "r.subtype", "r.subtype_conflict", F.col("gene_name").alias("effector_name"), "sequence_sha256")
    arrays = read(spark, directory, "crispr_arrays").select("operon_id", "array_index", "direct_repeat", "orientation").distinct()
    return R.pair_repeats(effectors, arrays)


@query(
    """
WITH r AS (SELECT *, CASE WHEN isnan(score) THEN NULL ELSE score END AS s, CASE WHEN isnan(evalue) THEN NULL ELSE evalue END AS e FROM cas13_records WHERE sequence_sha256 IS NOT NULL)
SELECT sequence_sha256, min(operon_id) AS representative_operon_id, count(*) AS record_count, count(*) FILTER (NOT subtype_conflict) AS nonconflicting_record_count,
  count(*) FILTER (truncated = '00') AS complete_record_count, min(e) AS minimum_evalue, max(s) AS maximum_score,
  coalesce(list_sort(list_distinct(list(truncated) FILTER (truncated IS NOT NULL))), []) AS truncated_flags, coalesce(list_sort(list_distinct(list(subtype) FILTER (subtype IS NOT NULL))), []) AS subtypes
FROM r GROUP BY 1
"""
)
def exact_unique(spark, directory):
    """One row per sequence hash of the Cas13 records."""
    return R.exact_unique(read(spark, directory, "cas13_records"))


@query("SELECT sequence_sha256, operon_id, count(*) AS records FROM cas13_records WHERE sequence_sha256 IS NOT NULL AND operon_id IS NOT NULL GROUP BY ALL")
def hash_operons(spark, directory):
    """Every operon that a sequence hash stands in: the link table beside ``exact_unique``, one row a link."""
    return R.hash_operons(read(spark, directory, "cas13_records"))


@query("SELECT count(*) AS records, count(DISTINCT sequence_sha256) AS hashes, count(DISTINCT CASE WHEN NOT subtype_conflict AND truncated = '00' THEN sequence_sha256 END) AS complete_hashes FROM cas13_records")
def complete_hash_count(spark, directory):
    """Distinct sequence hashes, and those of complete records without conflict."""
    good = (~F.col("subtype_conflict")) & (F.col("truncated") == "00")
    return read(spark, directory, "cas13_records").agg(F.count("*").alias("records"), F.count_distinct("sequence_sha256").alias("hashes"), F.count_distinct(F.when(good, F.col("sequence_sha256"))).alias("complete_hashes"))


@query("SELECT subtype, subtype_source, count(*) AS records, count(DISTINCT sequence_sha256) AS hashes, count(*) FILTER (subtype_conflict) AS conflicts FROM cas13_records GROUP BY ALL")
def subtype_counts(spark, directory):
    """Records, hashes and conflicts per subtype."""
    return read(spark, directory, "cas13_records").groupBy("subtype", "subtype_source").agg(F.count("*").alias("records"), F.count_distinct("sequence_sha256").alias("hashes"), F.count_if("subtype_conflict").alias("conflicts"))


_SPLIT = f"""
WITH x AS (SELECT DISTINCT operon_id, split_part(taxonomy, ';', 3) AS cluster FROM cas13_records WHERE taxonomy IS NOT NULL AND operon_id IS NOT NULL),
h AS (SELECT *, CAST('0x' || sha256('{SEED}:' || cluster)[1:16] AS UBIGINT)::DOUBLE / 18446744073709551616.0 AS f FROM x),
s AS (SELECT operon_id, cluster, CASE WHEN f < 0.8 THEN 'train' WHEN f < 0.8 + 0.1 THEN 'validation' ELSE 'test' END AS split FROM h)
"""


def _splits(spark, directory):
    rows = read(spark, directory, "cas13_records").where("taxonomy is not null and operon_id is not null").select("operon_id", F.split_part("taxonomy", F.lit(";"), F.lit(3)).alias("cluster")).distinct()
    return rows.withColumn("split", hashing.split_of(F.col("cluster"), SEED))


@query(_SPLIT + "SELECT operon_id, cluster, split FROM s")
def cluster_split(spark, directory):
    """Train, validation and test by whole taxonomic clusters."""
    return _splits(spark, directory)


@query(
    f"""
WITH m AS (SELECT operon_id, min(split_part(taxonomy, ';', 3)) AS cluster FROM cas13_records WHERE taxonomy IS NOT NULL AND operon_id IS NOT NULL GROUP BY 1),
h AS (SELECT *, CAST('0x' || sha256('{SEED}:' || operon_id)[1:16] AS UBIGINT)::DOUBLE / 18446744073709551616.0 AS f FROM m), s AS (SELECT *, CASE WHEN f < 0.8 THEN 'train' WHEN f < 0.8 + 0.1 THEN 'validation' ELSE 'test' END AS split FROM h)
SELECT cluster, count(DISTINCT split) AS splits, count(*) AS members FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1
"""
)
def leakage_gate(spark, directory):
    """Clusters that leak, where splits are dealt record by record and not by cluster: the gate finds those in several."""
    clusters = read(spark, directory, "cas13_records").where("taxonomy is not null and operon_id is not null").groupBy("operon_id").agg(F.min(F.split_part("taxonomy", F.lit(";"), F.lit(3))).alias("cluster"))
    dealt = clusters.select("operon_id", hashing.split_of(F.col("operon_id"), SEED).alias("split"))
    return R.leaking_clusters(clusters, dealt, "operon_id")


@query(_SPLIT + "SELECT split, count(DISTINCT cluster) AS clusters, count(*) AS members, min(n) AS smallest, max(n) AS largest FROM (SELECT *, count(*) OVER (PARTITION BY cluster) AS n FROM s) GROUP BY 1")
def cluster_summary(spark, directory):
    """Clusters and their sizes per split."""
    per = _splits(spark, directory).groupBy("split", "cluster").agg(F.count("*").alias("n"))
    return per.groupBy("split").agg(F.count("*").alias("clusters"), F.sum("n").alias("members"), F.min("n").alias("smallest"), F.max("n").alias("largest"))


@query("SELECT CAST(CAST('0x' || sha256(record_key)[1:16] AS UBIGINT) % 16 AS INTEGER) AS shard, count(*) AS records, min(record_key) AS first_key FROM cas13_records GROUP BY 1")
def stable_shards(spark, directory):
    """Records per hash shard."""
    rows = read(spark, directory, "cas13_records").select("record_key", hashing.shard_of(F.col("record_key"), 16).alias("shard"))
    return rows.groupBy("shard").agg(F.count("*").alias("records"), F.min("record_key").alias("first_key"))


@query("SELECT subtype, count(protein_length) AS n, min(protein_length) AS shortest, median(protein_length) AS median_length, max(protein_length) AS longest FROM cas13_records GROUP BY 1")
def length_stats(spark, directory):
    """Shortest, median and longest protein per subtype."""
    return read(spark, directory, "cas13_records").groupBy("subtype").agg(F.count("protein_length").alias("n"), F.min("protein_length").alias("shortest"), F.median("protein_length").alias("median_length"), F.max("protein_length").alias("longest"))


@query(
    """
SELECT operon_id, subtype, source, n_cas, n_spacers, loaded_at FROM (
  SELECT *, row_number() OVER (PARTITION BY operon_id ORDER BY loaded_at DESC, metadata_json DESC NULLS LAST) AS k FROM atlas_operons WHERE operon_id IS NOT NULL) WHERE k = 1
"""
)
def latest_operons(spark, directory):
    """The last delivery of each operon, by aggregation without a sort."""
    order = F.struct("loaded_at", "metadata_json")
    picked = read(spark, directory, "atlas_operons").where("operon_id is not null").select("operon_id", order.alias("o"), F.struct("subtype", "source", "n_cas", "n_spacers", "loaded_at").alias("x"))
    return picked.groupBy("operon_id").agg(F.max_by("x", "o").alias("x")).select("operon_id", "x.*")


@query("SELECT operon_id, count(*) AS effectors FROM cas_effectors e WHERE operon_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM atlas_operons o WHERE o.operon_id = e.operon_id) GROUP BY 1")
def orphan_effectors(spark, directory):
    """Operon ids of effectors that no operon has; effectors are counted before the join."""
    counted = read(spark, directory, "cas_effectors").where("operon_id is not null").groupBy("operon_id").agg(F.count("*").alias("effectors"))
    return counted.join(read(spark, directory, "atlas_operons").select("operon_id"), "operon_id", "left_anti")


@query(
    """
WITH a AS (SELECT DISTINCT operon_id FROM atlas_operons WHERE operon_id IS NOT NULL), c AS (SELECT DISTINCT operon_id FROM crispr_arrays WHERE operon_id IS NOT NULL)
SELECT coalesce(a.operon_id, c.operon_id) AS operon_id, CASE WHEN c.operon_id IS NULL THEN 'operon_only' ELSE 'array_only' END AS side FROM a FULL JOIN c ON a.operon_id = c.operon_id WHERE a.operon_id IS NULL OR c.operon_id IS NULL
"""
)
def array_differences(spark, directory):
    """Operon ids that stand only with operons or only with arrays."""
    a = read(spark, directory, "atlas_operons").where("operon_id is not null").select("operon_id").distinct().withColumn("a", F.lit(1))
    c = read(spark, directory, "crispr_arrays").where("operon_id is not null").select("operon_id").distinct().withColumn("c", F.lit(1))
    both = a.join(c, "operon_id", "full").where("a is null or c is null")
    return both.select("operon_id", F.when(F.col("c").isNull(), "operon_only").otherwise("array_only").alias("side"))


@query(
    """
WITH o AS (SELECT operon_id, max(biome) AS biome FROM atlas_operons GROUP BY 1)
SELECT biome, CASE WHEN o.operon_id IS NULL THEN 'missing_operon' WHEN biome IS NULL THEN 'no_biome' ELSE 'mapped' END AS status, count(*) AS effectors, count(DISTINCT e.sequence_sha256) AS hashes
FROM cas_effectors e LEFT JOIN o ON o.operon_id = e.operon_id GROUP BY ALL
"""
)
def effector_mapping(spark, directory):
    """Effectors mapped to their operon's biome, with the reason where that fails.

    Only the different ids of effectors meet the operons; the effectors take their operon's biome back by a join that
    salts the bin that holds a tenth of them.
    """
    biomes = read(spark, directory, "atlas_operons").groupBy("operon_id").agg(F.max("biome").alias("biome"), F.lit(1).alias("known"))
    per = read(spark, directory, "cas_effectors").select(F.coalesce("operon_id", F.lit("")).alias("operon_id"), "sequence_sha256").groupBy("operon_id", "sequence_sha256").agg(F.count("*").alias("n"))
    ids = materialize(per.groupBy("operon_id").agg(F.count("*").alias("rows")).join(biomes, "operon_id", "left"), "effector-biomes")
    joined = spread_join(per, ids, "operon_id", "rows").withColumn("status", F.when(F.col("known").isNull(), "missing_operon").when(F.col("biome").isNull(), "no_biome").otherwise("mapped"))
    return joined.groupBy("biome", "status").agg(F.sum("n").alias("effectors"), F.count_distinct("sequence_sha256").alias("hashes"))


@query("SELECT DISTINCT c.record_key, c.subtype FROM cas13_records c WHERE EXISTS (SELECT 1 FROM crispr_arrays a WHERE a.operon_id = c.operon_id AND a.spacer_count >= 3)")
def records_with_arrays(spark, directory):
    """Records whose operon has an array of three spacers or more."""
    arrays = read(spark, directory, "crispr_arrays").where("spacer_count >= 3").select("operon_id")
    return read(spark, directory, "cas13_records").join(arrays, "operon_id", "left_semi").select("record_key", "subtype")


@query(
    """
SELECT DISTINCT operon_id, array_index, replace(upper(regexp_replace(direct_repeat_raw, '\\s', '', 'g')), 'T', 'U') AS repeat_rna,
  reverse(translate(replace(upper(regexp_replace(direct_repeat_raw, '\\s', '', 'g')), 'T', 'U'), 'ACGUN', 'UGCAN')) AS repeat_turned FROM crispr_arrays
"""
)
def repeats_both_ways(spark, directory):
    """Each array's repeat as RNA and turned around."""
    rna = S.normal_rna(F.col("direct_repeat_raw"))
    return read(spark, directory, "crispr_arrays").select("operon_id", "array_index", rna.alias("repeat_rna"), S.reverse_complement(rna).alias("repeat_turned")).distinct()


@query(
    """
SELECT operon_id, hmm_name, score, evalue, gene_name FROM (
  SELECT operon_id, hmm_name, score, evalue, gene_name, row_number() OVER (PARTITION BY operon_id ORDER BY score DESC, evalue ASC, hmm_name DESC NULLS LAST, gene_name DESC NULLS LAST) AS k
  FROM cas_effectors WHERE operon_id IS NOT NULL AND score IS NOT NULL AND evalue IS NOT NULL AND NOT isnan(score) AND NOT isnan(evalue)) WHERE k = 1
"""
)
def best_effector(spark, directory):
    """The best scored effector of each operon: by score, then e-value, then names, null ones last; aggregated map-side first."""
    good = read(spark, directory, "cas_effectors").where("operon_id is not null and score is not null and evalue is not null and not isnan(score) and not isnan(evalue)")
    best = good.groupBy("operon_id").agg(F.max(F.struct("score", (-F.col("evalue")).alias("e"), "hmm_name", "gene_name")).alias("b"))
    return best.select("operon_id", "b.hmm_name", "b.score", (-F.col("b.e")).alias("evalue"), "b.gene_name")


@query(
    """
SELECT date_trunc('week', annotated_at) AS week, count(*) AS effectors, count(*) FILTER (loaded_at - annotated_at > INTERVAL 7 DAY) AS late, count(DISTINCT operon_id) AS operons
FROM (SELECT DISTINCT operon_id, sequence_sha256, gene_name, annotated_at, loaded_at FROM cas_effectors WHERE annotated_at IS NOT NULL) GROUP BY 1
"""
)
def weekly_effectors(spark, directory):
    """Effectors per week of annotation, and how many came more than a week late."""
    once = read(spark, directory, "cas_effectors").where("annotated_at is not null").select("operon_id", "sequence_sha256", "gene_name", "annotated_at", "loaded_at").distinct()
    late = F.col("loaded_at") - F.col("annotated_at") > F.expr("INTERVAL 7 DAY")
    return once.groupBy(F.date_trunc("week", "annotated_at").alias("week")).agg(F.count("*").alias("effectors"), F.count_if(late).alias("late"), F.count_distinct("operon_id").alias("operons"))


@query(
    """
SELECT source, subtype, count(*) AS records, grouping(source) AS all_sources, grouping(subtype) AS all_subtypes FROM cas13_records GROUP BY ROLLUP (source, subtype)
"""
)
def subtype_rollup(spark, directory):
    """Records per source and subtype with subtotals."""
    rolled = read(spark, directory, "cas13_records").rollup("source", "subtype")
    return rolled.agg(F.count("*").alias("records"), F.grouping("source").cast("long").alias("all_sources"), F.grouping("subtype").cast("long").alias("all_subtypes"))


@query(
    """
SELECT source, count(*) FILTER (truncated = '00') AS complete, count(*) FILTER (truncated = '01') AS cut_end, count(*) FILTER (truncated = '10') AS cut_start, count(*) FILTER (truncated = '11') AS cut_both FROM cas13_records GROUP BY 1
"""
)
def truncation_pivot(spark, directory):
    """Records per source, one column a truncation flag."""
    names = {"00": "complete", "01": "cut_end", "10": "cut_start", "11": "cut_both"}
    wide = read(spark, directory, "cas13_records").groupBy("source").pivot("truncated", list(names)).count()
    return wide.select("source", *[F.coalesce(F.col(f"`{flag}`"), F.lit(0)).alias(name) for flag, name in names.items()])


@query("SELECT source, round(sum(score * protein_length) FILTER (NOT isnan(score)) / sum(protein_length) FILTER (NOT isnan(score)), 4) AS weighted_score, count(DISTINCT operon_id) AS operons FROM cas_effectors GROUP BY 1")
def weighted_scores(spark, directory):
    """Length-weighted mean score per source; rows with a null or NaN score are left out."""
    good = read(spark, directory, "cas_effectors").select("source", "operon_id", "protein_length", F.nanvl("score", F.lit(None).cast("double")).alias("score"))
    held = F.col("score").isNotNull()
    return good.groupBy("source").agg(
        F.round(F.try_divide(F.sum(F.when(held, F.col("score") * F.col("protein_length"))), F.sum(F.when(held, F.col("protein_length")))), 4).alias("weighted_score"), F.count_distinct("operon_id").alias("operons")
    )


@query(
    """
SELECT subtype, operon_id, protein_length, sequence_sha256 FROM (
  SELECT *, row_number() OVER (PARTITION BY subtype, split_part(taxonomy, ';', 3) ORDER BY protein_length DESC, sequence_sha256, operon_id) AS k FROM cas13_records
  WHERE protein_length IS NOT NULL AND sequence_sha256 IS NOT NULL AND operon_id IS NOT NULL AND taxonomy IS NOT NULL) WHERE k = 1
"""
)
def cluster_representatives(spark, directory):
    """The longest record of each subtype and cluster, ties by hash and operon; one aggregation, no sort."""
    good = read(spark, directory, "cas13_records").where("protein_length is not null and sequence_sha256 is not null and operon_id is not null and taxonomy is not null")
    best = good.groupBy("subtype", F.split_part("taxonomy", F.lit(";"), F.lit(3)).alias("cluster")).agg(F.min(F.struct((-F.col("protein_length")).alias("short"), "sequence_sha256", "operon_id")).alias("b"))
    return best.select("subtype", "b.operon_id", (-F.col("b.short")).alias("protein_length"), "b.sequence_sha256")


@query("SELECT source, subtype, n, rank, running FROM (SELECT source, subtype, n, rank() OVER (PARTITION BY source ORDER BY n DESC) AS rank, CAST(sum(n) OVER (PARTITION BY source ORDER BY n DESC, subtype NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM (SELECT source, subtype, count(*) AS n FROM cas13_records GROUP BY ALL)) WHERE rank <= 3")
def top_subtypes(spark, directory):
    """The three most frequent subtypes of each source with running counts; windows over counts alone."""
    counts = read(spark, directory, "cas13_records").groupBy("source", "subtype").agg(F.count("*").alias("n"))
    by = Window.partitionBy("source").orderBy(F.desc("n"))
    running = Window.partitionBy("source").orderBy(F.desc("n"), F.asc_nulls_first("subtype")).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("rank", F.rank().over(by)).withColumn("running", F.sum("n").over(running)).where("rank <= 3")


QUERIES, SQL = catalog.queries, catalog.sql
