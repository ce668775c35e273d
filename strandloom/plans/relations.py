"""Queries of joins with gates, sequences restored and projected, numbering, funnels and extremes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.functions.sequence import letters
from strandloom.operators import cohorts as C
from strandloom.operators import columns
from strandloom.operators import relations as L
from strandloom.operators.designs import design_metrics
from strandloom.plans.catalog import Catalog
from strandloom.plans.cohorts import _V, job_rows
from strandloom.plans.designs import _ELIGIBLE, _NOVELTY, _eligible, _gated
from strandloom.plans.records import _GOOD, operon_failures
from strandloom.plans.sequences import _ALN, _C, _IDENTITY, _PAIRS, _alignment, _designs
from strandloom.session import materialize, read

catalog = Catalog()
query = catalog.query


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def annotated_customers(spark, directory):
    """Customers with their nation, which must stand once."""
    nations = read(spark, directory, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return L.many_to_one(read(spark, directory, "customer").select("c_custkey", "c_nationkey"), nations, ["c_nationkey"]).select("c_custkey", "n_name")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def complete_lines(spark, directory):
    """Order lines with their order, which each must have."""
    orders = read(spark, directory, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return L.complete_join(read(spark, directory, "lineitem").select("l_orderkey", "l_linenumber"), orders, ["l_orderkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM lineitem r WHERE r.l_partkey = l.l_partkey AND r.l_suppkey = l.l_suppkey AND r.l_returnflag = 'R')")
def lines_of_returned_pairs(spark, directory):
    """Order lines whose part and supplier were returned together at least once: membership by a key of two columns."""
    lines = read(spark, directory, "lineitem")
    return lines.join(lines.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber")


@query(
    "SELECT candidate_id, CAST(seed AS BIGINT) + (row_number() OVER (PARTITION BY scaffold_id, seed, method ORDER BY candidate_id) - 1) * 1000000 AS proposal_seed FROM candidates WHERE seed IS NOT NULL"
)
def proposal_seeds(spark, directory):
    """The seed of each design by its block and its number among its method's proposals."""
    number = F.row_number().over(Window.partitionBy("scaffold_id", "seed", "method").orderBy("candidate_id")) - 1
    held = read(spark, directory, "candidates").where("seed is not null").select("candidate_id", "seed", "scaffold_id", "method").withColumn("number", number)
    return held.select("candidate_id", L.proposal_seed(F.col("seed"), F.col("number")).alias("proposal_seed"))


@query(
    _C
    + """
SELECT candidate_id, array_to_string(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN list_contains(fixed_positions, CAST(i - 1 AS INTEGER)) AND i <= length(p) THEN p[i] ELSE s[i] END), '') AS restored,
  array_to_string(list_transform(list_sort(list_distinct(list_filter(fixed_positions, lambda i: i >= 0 AND i < length(s)))), lambda i: s[i + 1]), '') AS projected FROM c WHERE s <> '' AND p IS NOT NULL AND fixed_positions IS NOT NULL
"""
)
def restored_designs(spark, directory):
    """Designs with their parent's residues put back at the fixed places, and what stood there."""
    held = _designs(spark, directory).where("s <> '' and p is not null and fixed_positions is not null")
    return held.select("candidate_id", L.restored(F.col("s"), F.col("p"), F.col("fixed_positions")).alias("restored"), L.projected(F.col("s"), F.col("fixed_positions")).alias("projected"))


@query(
    _C
    + """
SELECT candidate_id, CASE WHEN length(s) <= length(p) AND len(list_filter(range(1, length(s) + 1), lambda i: s[i] = p[i])) >= 0.95 * length(s) THEN 'validated_author_residue_number' ELSE 'global_sequence_alignment' END AS strategy FROM c WHERE s <> '' AND p <> ''
"""
)
def numbering_strategies(spark, directory):
    """Whether a design's own numbering maps it to its parent, or only an alignment does."""
    held = _designs(spark, directory).where("s <> '' and p <> ''")
    chains = held.select(F.col("candidate_id").alias("id"), F.col("p").alias("reference"), F.col("s").alias("sequence"), F.sequence(F.lit(1), F.length("s")).alias("numbers"), F.array_repeat(F.lit(""), F.length("s")).alias("icodes"))
    return L.numbered_residues(chains).select(F.col("id").alias("candidate_id"), "strategy")


@query(
    _C
    + """
, x AS (SELECT candidate_id, s, p, fixed_positions AS f, list_filter(fixed_positions, lambda i: i >= 0 AND i < length(p)) AS held, source_is_mock AS mock, source_evidence_level AS level FROM c JOIN (SELECT candidate_id, source_is_mock, source_evidence_level FROM candidates) USING (candidate_id))
, y AS (SELECT candidate_id, list_filter([CASE WHEN coalesce(candidate_id, '') = '' THEN 'no_id' END, CASE WHEN coalesce(s, '') = '' THEN 'no_sequence' WHEN regexp_matches(s, '[^ACDEFGHIKLMNPQRSTVWY]') THEN 'noncanonical_amino_acid' END,
  CASE WHEN coalesce(length(s) <> length(p), true) THEN 'length_differs_from_parent' END, CASE WHEN coalesce(len(held) < len(f), false) THEN 'fixed_position_outside' END, CASE WHEN coalesce(len(list_filter(held, lambda i: s[i + 1] <> p[i + 1])) > 0, false) THEN 'fixed_position_changed' END,
  CASE WHEN mock AND level > 0 THEN 'mock_with_evidence' END], lambda v: v IS NOT NULL) AS problems FROM x)
SELECT candidate_id, array_to_string(problems, ';') AS problems FROM y WHERE len(problems) > 0
"""
)
def candidate_problems(spark, directory):
    """What is wrong with candidates as requests: letters, lengths, fixed places, mock rows."""
    c = read(spark, directory, "candidates").select("candidate_id", letters(F.col("sequence")).alias("sequence"), letters(F.col("parent_sequence")).alias("parent_sequence"), "fixed_positions", F.col("source_is_mock").alias("is_mock"), F.col("source_evidence_level").alias("evidence_level"))
    return L.request_problems(c).select("candidate_id", F.array_join("problems", ";").alias("problems"))


_STAGES = {
    "kept_fixed": "fixed_position_violation",
    "measured": "no_parent_identity",
    "new_to_parent": "parent_identity_above_threshold",
    "with_hit": "no_atlas_hit_at_required_query_coverage",
    "new_to_atlas": "atlas_identity_above_threshold",
    "without_runs": "homopolymer_above_threshold",
    "complex": "low_complexity_windows_above_threshold",
    "diverse": "designed_entropy_below_threshold",
}


@query(
    _NOVELTY
    + ", f AS (SELECT method, count(*) AS proposed, "
    + ", ".join(f"count(*) FILTER (NOT list_contains(failures, '{reason}')) AS {stage}" for stage, reason in _STAGES.items())
    + f", count(*) FILTER (len(failures) = 0) AS passed FROM g GROUP BY 1) SELECT method, stage, designs FROM f UNPIVOT (designs FOR stage IN (proposed, {', '.join(_STAGES)}, passed))"
)
def novelty_funnel(spark, directory):
    """Designs of each method that each of ten gates leaves, one row a stage."""
    left = [F.count_if(~F.array_contains("failures", reason)).alias(stage) for stage, reason in _STAGES.items()]
    wide = _gated(spark, directory).groupBy("method").agg(F.count("*").alias("proposed"), *left, F.count_if("passes").alias("passed"))
    return wide.unpivot(["method"], ["proposed", *_STAGES, "passed"], "stage", "designs")


@query(_ALN + _PAIRS + "SELECT aln, CAST(count(*) / 2 AS BIGINT) AS pairs, round(min(identity), 6) AS least, round(avg(identity), 6) AS mean, round(max(identity), 6) AS most FROM pairs GROUP BY 1")
def scaffold_extremes(spark, directory):
    """Least, mean and greatest identity of all pairs of designs of each scaffold, by blocks."""
    return columns.pair_extremes(_alignment(spark, directory)).where("pairs > 0").select("aln", "pairs", *[F.round(c, 6).alias(c) for c in ("least", "mean", "most")])


@query(
    _V
    + """
, l AS (SELECT scaffold, active_inactive_partial_label AS label, cis_activity AS x FROM (SELECT DISTINCT variant_id, scaffold, active_inactive_partial_label, cis_activity FROM variant_retrospective) WHERE cis_activity IS NOT NULL AND scaffold IS NOT NULL), u AS (SELECT label, scaffold AS unit, avg(x) AS x FROM l WHERE label IS NOT NULL GROUP BY ALL)
SELECT label, count(*) AS units, round(avg(x), 6) AS mean FROM u GROUP BY 1
"""
)
def label_means(spark, directory):
    """Mean activity of each label over scaffolds as independent units."""
    once = read(spark, directory, "variant_retrospective").select("variant_id", "scaffold", "active_inactive_partial_label", "cis_activity").distinct()
    units = once.where("cis_activity is not null and scaffold is not null and active_inactive_partial_label is not null").groupBy(F.col("active_inactive_partial_label").alias("label"), F.col("scaffold").alias("unit")).agg(F.avg("cis_activity").alias("x"))
    return C.bootstrap_means(materialize(units, "label-units"), ["label"], 20, 7).select("label", "units", F.round("mean", 6).alias("mean"))


@query(
    _C
    + """
, st AS (SELECT unnest(['apo', 'binary', 'ternary']) AS state), be AS (SELECT unnest(['fasta', 'json']) AS backend), j AS (SELECT state, backend FROM c, st, be WHERE s <> '' AND (state <> 'ternary' OR seed IS NOT NULL))
SELECT state || ':' || backend AS kind, count(*) AS jobs FROM j GROUP BY 1
"""
)
def job_counts(spark, directory):
    """Prediction jobs per state and input format."""
    return job_rows(spark, directory).groupBy(F.concat_ws(":", "state", "backend").alias("kind")).agg(F.count("*").alias("jobs"))


@query(
    _GOOD
    + ", fl AS (SELECT error_type AS reason, 'operon' AS kind, count(*) AS n FROM marked WHERE error_type IS NOT NULL GROUP BY 1), "
    + _ELIGIBLE.strip()[len("WITH ") :]
    + ", "
    + _NOVELTY.strip()[len("WITH ") :]
    + """
SELECT kind, reason, n AS failures FROM fl UNION ALL SELECT 'sequence', reason, count(*) FROM e WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'design', reason, count(*) FROM (SELECT unnest(failures) AS reason FROM g) GROUP BY reason
"""
)
def all_failures(spark, directory):
    """Failures of operons, sequences and designs in one table, counted by reason."""
    operons = operon_failures(spark, directory).select(F.lit("operon").alias("kind"), F.col("error_type").alias("reason"), "record_index")
    sequences = _eligible(spark, directory).where("reason is not null").select(F.lit("sequence").alias("kind"), "reason", "sequence_sha256")
    designs = _gated(spark, directory).select(F.lit("design").alias("kind"), F.explode("failures").alias("reason"), "candidate_id")
    every = operons.unionByName(sequences, allowMissingColumns=True).unionByName(designs, allowMissingColumns=True)
    return every.groupBy("kind", "reason").agg(F.count("*").alias("failures"))


@query(
    """
SELECT assembly_type, count(*) AS operons, count(*) FILTER (n_cas > 0) AS with_cas, count(*) FILTER (n_cas > 0 AND n_crispr > 0) AS with_both, count(*) FILTER (n_cas > 0 AND n_crispr > 0 AND is_type_vi) AS type_vi, count(*) FILTER (genomic_context_available) AS with_context,
  bool_and(n_spacers >= n_crispr) AS all_have_spacers, bool_and(operon_id IS NOT NULL) AS all_have_ids FROM (SELECT DISTINCT operon_id, assembly_type, n_cas, n_crispr, n_spacers, is_type_vi, genomic_context_available FROM atlas_operons) GROUP BY 1
"""
)
def assembly_checks(spark, directory):
    """Operons per assembly type: how many are left after each condition, and what holds for all of them."""
    once = read(spark, directory, "atlas_operons").select("operon_id", "assembly_type", "n_cas", "n_crispr", "n_spacers", "is_type_vi", "genomic_context_available").distinct()
    cas, both = F.col("n_cas") > 0, (F.col("n_cas") > 0) & (F.col("n_crispr") > 0)
    return once.groupBy("assembly_type").agg(
        F.count("*").alias("operons"),
        F.count_if(cas).alias("with_cas"),
        F.count_if(both).alias("with_both"),
        F.count_if(both & F.col("is_type_vi")).alias("type_vi"),
        F.count_if("genomic_context_available").alias("with_context"),
        F.bool_and(F.col("n_spacers") >= F.col("n_crispr")).alias("all_have_spacers"),
        F.bool_and(F.col("operon_id").isNotNull()).alias("all_have_ids"),
    )


@query(
    _C
    + f"""
, m AS (SELECT c.scaffold_id, {_IDENTITY} AS v, source_is_mock AS mock FROM c JOIN (SELECT candidate_id, source_is_mock FROM candidates) USING (candidate_id))
SELECT scaffold_id, count(*) AS comparisons, count(v) AS successful, round(min(v), 6) AS least, round(avg(v), 6) AS mean, bool_and(mock) AS all_mock FROM m GROUP BY 1
"""
)
def scaffold_consistency(spark, directory):
    """Comparisons of designs with their parent per scaffold: how many could be made, least and mean, and whether all are mock."""
    told = design_metrics(_designs(spark, directory), "candidate_id", "s", "p", "fixed_positions").select("candidate_id", "parent_identity")
    joined = read(spark, directory, "candidates").select("candidate_id", "scaffold_id", "source_is_mock").join(told, "candidate_id")
    v = F.col("parent_identity")
    return joined.groupBy("scaffold_id").agg(F.count("*").alias("comparisons"), F.count(v).alias("successful"), F.round(F.min(v), 6).alias("least"), F.round(F.avg(v), 6).alias("mean"), F.bool_and("source_is_mock").alias("all_mock"))


QUERIES, SQL = catalog.queries, catalog.sql
