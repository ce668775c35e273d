"""Queries of design metrics, novelty, recovery, eligibility, scaffold mapping, states and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import designs as D
from strandloom.operators import records as R
from strandloom.operators import states as T
from strandloom.plans.catalog import Catalog
from strandloom.plans.cohorts import job_rows
from strandloom.plans.relational import _POINTS, _points
from strandloom.plans.sequences import _C, _IDENTITY, _RUN, _designs
from strandloom.session import materialize, read

catalog = Catalog()
query = catalog.query

_DESIGNED = "CASE WHEN length(s) > 0 AND fixed_positions IS NOT NULL THEN array_to_string(list_transform(list_filter(range(1, length(s) + 1), lambda i: NOT list_contains(fixed_positions, CAST(i - 1 AS INTEGER))), lambda i: s[i]), '') END"
_LOW = "coalesce(len(list_filter(range(1, length(s) - 10), lambda i: list_max(list_transform(string_split('ACDEFGHIKLMNPQRSTVWY', ''), lambda a: 12 - length(replace(s[i:i + 11], a, '')))) > 4)), 0)"
_NOVELTY = (
    _C
    + f"""
, pp AS (SELECT scaffold_id, max(p) AS p FROM c WHERE scaffold_id IS NOT NULL GROUP BY 1)
, hits AS (SELECT candidate_id, pp.scaffold_id AS target, len(list_filter(range(1, length(s) + 1), lambda i: s[i] = pp.p[i])) / length(s) AS identity FROM c JOIN pp ON length(c.s) = length(pp.p) AND c.scaffold_id <> pp.scaffold_id WHERE length(s) > 0)
, best AS (SELECT candidate_id, identity AS atlas_identity, target AS atlas_hit FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY identity DESC, target) AS k FROM hits) WHERE k = 1)
, q AS (SELECT *, {_DESIGNED} AS ds FROM c)
, m AS (SELECT candidate_id, scaffold_id, method, fixed_position_violations AS v, s IS NULL AS gone, {_IDENTITY} AS i, {_RUN} AS r, {_LOW} AS lw, CASE WHEN length(ds) > 0 THEN (SELECT -sum(n / length(ds) * ln(n / length(ds))) FROM (SELECT count(*) AS n FROM (SELECT unnest(string_split(ds, '')) AS t) GROUP BY t)) END AS de FROM q)
, g AS (SELECT m.candidate_id, scaffold_id, method, i, r, lw, de, atlas_identity, atlas_hit, gone, list_filter([CASE WHEN coalesce(v, 1) <> 0 THEN 'fixed_position_violation' END,
    CASE WHEN i IS NULL THEN 'no_parent_identity' WHEN i > 0.8 THEN 'parent_identity_above_threshold' END,
    CASE WHEN atlas_identity IS NULL THEN 'no_atlas_hit_at_required_query_coverage' WHEN atlas_identity > 0.8 THEN 'atlas_identity_above_threshold' END,
    CASE WHEN gone OR r > 4 THEN 'homopolymer_above_threshold' END, CASE WHEN gone OR lw > 0 THEN 'low_complexity_windows_above_threshold' END, CASE WHEN coalesce(de, -1) < 2.0 THEN 'designed_entropy_below_threshold' END], lambda x: x IS NOT NULL) AS failures
  FROM m LEFT JOIN best ON best.candidate_id = m.candidate_id)
"""
)


def _hits(designs):
    """Each design beside the parents of other scaffolds that have its length: identity place by place."""
    parents = designs.where("scaffold_id is not null").groupBy("scaffold_id").agg(F.max("p").alias("t")).where("t is not null").select(F.col("scaffold_id").alias("target"), "t", F.length("t").alias("n"))
    pairs = designs.where(F.length("s") > 0).withColumn("n", F.length("s")).join(parents, "n").where("scaffold_id <> target")
    measured = D.design_metrics(pairs.select(F.concat_ws("|", "candidate_id", "target").alias("k"), "s", "t", F.array().cast("array<int>").alias("f")), "k", "s", "t", "f")
    key = F.split("k", r"\|")
    return measured.select(key[0].alias("candidate_id"), key[1].alias("target"), F.col("parent_identity").alias("identity"), F.lit(1.0).alias("coverage"))


def _gated(spark, directory):
    designs = materialize(_designs(spark, directory), "designs")
    metrics = D.design_metrics(designs, "candidate_id", "s", "p", "fixed_positions")
    told = metrics.join(designs.select("candidate_id", "scaffold_id", "method", "fixed_position_violations"), "candidate_id")
    return D.novelty_gate(told, _hits(designs), "candidate_id")


@query(
    _NOVELTY
    + "SELECT candidate_id, round(i, 6) AS parent_identity, round(atlas_identity, 6) AS atlas_identity, atlas_hit, CASE WHEN NOT gone THEN r END AS homopolymer, CAST(CASE WHEN NOT gone THEN lw END AS INTEGER) AS windows, round(abs(de), 6) AS designed_entropy, array_to_string(failures, ';') AS failures, len(failures) = 0 AS passes FROM g"
)
def novelty(spark, directory):
    """Every design through the novelty gate, with its best hit among the other scaffolds' parents and all reasons in order."""
    return _gated(spark, directory).select("candidate_id", F.round("parent_identity", 6).alias("parent_identity"), F.round("atlas_identity", 6).alias("atlas_identity"), "atlas_hit", "homopolymer", "windows", F.round("designed_entropy", 6).alias("designed_entropy"), F.array_join("failures", ";").alias("failures"), "passes")


@query(
    _NOVELTY
    + """
SELECT method, count(*) AS designs, count(DISTINCT scaffold_id) AS scaffolds, count(atlas_identity) AS with_hit, count(*) FILTER (len(failures) = 0) AS passing, round(max(atlas_identity), 6) AS greatest_hit, round(min(i), 6) AS least_parent, round(avg(i), 6) AS mean_parent, round(max(i), 6) AS greatest_parent, round(avg(abs(de)), 6) AS mean_entropy, max(CASE WHEN NOT gone THEN r END) AS longest_run,
  count(*) FILTER (list_contains(failures, 'fixed_position_violation')) AS violating, count(*) FILTER (list_contains(failures, 'parent_identity_above_threshold')) AS near_parent, count(*) FILTER (list_contains(failures, 'no_atlas_hit_at_required_query_coverage')) AS without_hit, count(*) FILTER (list_contains(failures, 'homopolymer_above_threshold')) AS repetitive, count(*) FILTER (list_contains(failures, 'low_complexity_windows_above_threshold')) AS low_complexity
FROM g GROUP BY 1
"""
)
def novelty_summary(spark, directory):
    """Per method how many designs pass, what fails them, and the extremes of their identities."""
    has = lambda reason: F.count_if(F.array_contains("failures", reason))
    return _gated(spark, directory).groupBy("method").agg(
        F.count("*").alias("designs"),
        F.count_distinct("scaffold_id").alias("scaffolds"),
        F.count("atlas_identity").alias("with_hit"),
        F.count_if("passes").alias("passing"),
        F.round(F.max("atlas_identity"), 6).alias("greatest_hit"),
        F.round(F.min("parent_identity"), 6).alias("least_parent"),
        F.round(F.avg("parent_identity"), 6).alias("mean_parent"),
        F.round(F.max("parent_identity"), 6).alias("greatest_parent"),
        F.round(F.avg("designed_entropy"), 6).alias("mean_entropy"),
        F.max("homopolymer").alias("longest_run"),
        has("fixed_position_violation").alias("violating"),
        has("parent_identity_above_threshold").alias("near_parent"),
        has("no_atlas_hit_at_required_query_coverage").alias("without_hit"),
        has("homopolymer_above_threshold").alias("repetitive"),
        has("low_complexity_windows_above_threshold").alias("low_complexity"),
    )


@query(
    _C
    + f"""
, w AS (SELECT candidate_id, list_filter(range(1, length(s) - 10), lambda i: list_max(list_transform(string_split('ACDEFGHIKLMNPQRSTVWY', ''), lambda a: 12 - length(replace(s[i:i + 11], a, '')))) > 4) AS own,
  list_filter(range(1, length(p) - 10), lambda i: list_max(list_transform(string_split('ACDEFGHIKLMNPQRSTVWY', ''), lambda a: 12 - length(replace(p[i:i + 11], a, '')))) > 4) AS old FROM c WHERE s IS NOT NULL AND p IS NOT NULL)
SELECT candidate_id, CAST(len(list_filter(own, lambda i: NOT list_contains(old, i))) AS INTEGER) AS new_windows FROM w
"""
)
def new_low_complexity(spark, directory):
    """Low-complexity windows of a design that its parent does not have."""
    both = _designs(spark, directory).where("s is not null and p is not null")
    return D.design_metrics(both, "candidate_id", "s", "p", "fixed_positions").select("candidate_id", "new_windows")


_REGIONS = (
    _C
    + """
, n AS (SELECT scaffold_id, max(length(p)) AS size, count(*) FILTER (fixed_positions IS NOT NULL) AS d FROM c WHERE scaffold_id IS NOT NULL GROUP BY 1)
, core AS (SELECT scaffold_id, i FROM (SELECT scaffold_id, unnest(list_distinct(fixed_positions)) AS i FROM c) JOIN n USING (scaffold_id) WHERE i IS NOT NULL GROUP BY scaffold_id, i HAVING count(*) >= 0.3 * any_value(d))
, rg AS (SELECT scaffold_id, 'core' AS region, i FROM core UNION ALL SELECT scaffold_id, 'head', unnest(range(least(50, size))) FROM n UNION ALL SELECT scaffold_id, 'tail', unnest(range(greatest(size - 50, 0), size)) FROM n)
, f AS (SELECT candidate_id, method, scaffold_id, s, p, fixed_positions FROM c WHERE length(s) = length(p) AND length(p) > 0)
, e AS (SELECT candidate_id, 'overall' AS region, unnest(range(length(p))) AS i, s, p FROM f
  UNION ALL SELECT candidate_id, 'designed', i, s, p FROM (SELECT *, unnest(range(length(p))) AS i FROM f) WHERE NOT coalesce(list_contains(fixed_positions, CAST(i AS INTEGER)), false)
  UNION ALL SELECT candidate_id, region, i, s, p FROM f JOIN rg USING (scaffold_id) WHERE i >= 0 AND i < length(p))
, rc AS (SELECT candidate_id, region, CAST(count(*) AS INTEGER) AS places, avg(CASE WHEN s[i + 1] = p[i + 1] THEN 1.0 ELSE 0.0 END) AS recovery FROM e GROUP BY ALL)
"""
)


def _recovery(spark, directory):
    designs = materialize(_designs(spark, directory), "designs")
    sizes = designs.where("scaffold_id is not null").groupBy("scaffold_id").agg(F.max(F.length("p")).alias("size"), F.count("fixed_positions").alias("d"))
    often = designs.select("scaffold_id", F.explode(F.array_distinct("fixed_positions")).alias("i")).where("i is not null").groupBy("scaffold_id", "i").agg(F.count("*").alias("k"))
    core = often.join(sizes, "scaffold_id").where(F.col("k") >= 0.3 * F.col("d")).groupBy("scaffold_id").agg(F.sort_array(F.collect_set("i")).alias("places"))
    named = sizes.where("size > 0")
    ends = lambda name, low, high: named.select("scaffold_id", F.lit(name).alias("region"), F.sequence(low, high - 1).alias("places"))
    head, tail = ends("head", F.lit(0), F.least(F.lit(50), F.col("size"))), ends("tail", F.greatest(F.col("size") - 50, F.lit(0)), F.col("size"))
    regions = core.select("scaffold_id", F.lit("core").alias("region"), "places").unionByName(head).unionByName(tail)
    return designs, D.native_recovery(designs, regions)


@query(_REGIONS + "SELECT candidate_id, region, places, round(recovery, 6) AS recovery FROM rc")
def region_recovery(spark, directory):
    """How much of its parent each design keeps: overall, where it was designed, in its scaffold's core and at both ends."""
    return _recovery(spark, directory)[1].where("places > 0").withColumn("recovery", F.round("recovery", 6))


@query(_REGIONS + "SELECT method, region, count(*) AS designs, round(min(recovery), 6) AS least, round(avg(recovery), 6) AS mean, round(max(recovery), 6) AS most FROM rc JOIN f USING (candidate_id) GROUP BY ALL")
def region_means(spark, directory):
    """Least, mean and greatest recovery of each region per method."""
    designs, recovery = _recovery(spark, directory)
    told = recovery.where("places > 0").join(designs.select("candidate_id", "method"), "candidate_id")
    return told.groupBy("method", "region").agg(F.count("*").alias("designs"), F.round(F.min("recovery"), 6).alias("least"), F.round(F.avg("recovery"), 6).alias("mean"), F.round(F.max("recovery"), 6).alias("most"))


@query(
    _C
    + """
, e AS (SELECT candidate_id, s, p, unnest(list_distinct(fixed_positions)) AS i FROM c)
SELECT candidate_id, count(*) AS fixed, count(*) FILTER (NOT coalesce(i >= 0 AND i < length(p) AND s[i + 1] = p[i + 1], false)) AS violations FROM e WHERE i IS NOT NULL GROUP BY 1
"""
)
def fixed_violations(spark, directory):
    """Fixed places at which a design lacks its parent's residue."""
    return D.fixed_violations(_designs(spark, directory))


_ELIGIBLE = """
WITH r AS (SELECT *, upper(regexp_replace(protein_sequence, '[^A-Za-z]', '', 'g')) AS seq FROM cas13_records WHERE sequence_sha256 IS NOT NULL)
, u AS (SELECT sequence_sha256, coalesce(max(seq), '') AS seq, count(*) FILTER (NOT subtype_conflict) AS nc, count(*) FILTER (truncated = '00') AS ok, coalesce(list_sort(list_distinct(list(subtype) FILTER (starts_with(upper(subtype), 'VI-')))), []) AS subtypes, min(CASE WHEN taxonomy IS NOT NULL THEN split_part(taxonomy, ';', 3) END) AS cluster FROM r GROUP BY 1)
, k AS (SELECT cluster, min(sequence_sha256) AS representative FROM u WHERE cluster IS NOT NULL GROUP BY 1)
, e AS (SELECT sequence_sha256, representative, subtypes, length(seq) AS residues, coalesce(list_aggregate(list_sort(list_distinct(list_filter(string_split(regexp_replace(seq, '[ACDEFGHIKLMNPQRSTVWY]', '', 'g'), ''), lambda x: x <> ''))), 'string_agg', ''), '') AS invalid_symbols,
  CASE WHEN representative IS NULL THEN 'missing_cluster_mapping' WHEN nc < 1 THEN 'only_subtype_conflicting_records' WHEN ok < 1 THEN 'no_explicitly_complete_record' WHEN length(seq) < 700 THEN 'below_minimum_protein_length' WHEN length(seq) > 1600 THEN 'above_maximum_protein_length'
    WHEN regexp_matches(seq, '[^ACDEFGHIKLMNPQRSTVWY]') THEN 'noncanonical_amino_acid' END AS reason FROM u LEFT JOIN k USING (cluster) WHERE representative IS NULL OR len(subtypes) > 0)
, al AS (SELECT subtype, representative, sequence_sha256, residues FROM (SELECT *, row_number() OVER (PARTITION BY subtype, representative ORDER BY residues DESC, sequence_sha256) AS k FROM (SELECT *, unnest(subtypes) AS subtype FROM e WHERE reason IS NULL)) WHERE k = 1)
"""


def _eligible(spark, directory):
    from strandloom.functions.sequence import letters

    records = read(spark, directory, "cas13_records").where("sequence_sha256 is not null")
    facts = R.exact_unique(records).select("sequence_sha256", "subtypes", "nonconflicting_record_count", "complete_record_count")
    more = records.groupBy("sequence_sha256").agg(F.max(letters(F.col("protein_sequence"))).alias("protein_sequence"), F.min(F.split_part("taxonomy", F.lit(";"), F.lit(3))).alias("cluster"))
    unique = materialize(facts.join(more, "sequence_sha256"), "unique-sequences")
    clusters = unique.where("cluster is not null").groupBy("cluster").agg(F.min("sequence_sha256").alias("representative_sha256"))
    return D.eligibility(unique, unique.join(clusters, "cluster").select("sequence_sha256", "representative_sha256"))


@query(_ELIGIBLE + "SELECT sequence_sha256, array_to_string(subtypes, ';') AS subtypes, residues, invalid_symbols, reason FROM e WHERE reason IS NOT NULL")
def alignment_exclusions(spark, directory):
    """Sequences that stay out of alignments, with the first reason."""
    return _eligible(spark, directory).where("reason is not null").select("sequence_sha256", F.array_join("subtypes", ";").alias("subtypes"), "residues", "invalid_symbols", "reason")


@query(_ELIGIBLE + "SELECT subtype, representative, sequence_sha256, residues FROM al")
def alignment_members(spark, directory):
    """The longest eligible sequence of each subtype and cluster."""
    return D.alignment_members(_eligible(spark, directory))


@query(
    _ELIGIBLE
    + "SELECT 'excluded' AS kind, reason AS name, count(*) AS sequences, CAST(NULL AS INTEGER) AS shortest, CAST(NULL AS DOUBLE) AS median_residues, CAST(NULL AS INTEGER) AS longest FROM e WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'aligned', subtype, count(*), min(residues), median(residues), max(residues) FROM al GROUP BY subtype"
)
def alignment_counts(spark, directory):
    """How many sequences each reason excludes, and the lengths of those that are left per subtype."""
    eligible = materialize(_eligible(spark, directory), "eligible")
    out = eligible.where("reason is not null").groupBy(F.lit("excluded").alias("kind"), F.col("reason").alias("name")).agg(F.count("*").alias("sequences"), F.lit(None).cast("int").alias("shortest"), F.lit(None).cast("double").alias("median_residues"), F.lit(None).cast("int").alias("longest"))
    kept = D.alignment_members(eligible).groupBy(F.lit("aligned").alias("kind"), F.col("subtype").alias("name")).agg(F.count("*").alias("sequences"), F.min("residues").alias("shortest"), F.median("residues").alias("median_residues"), F.max("residues").alias("longest"))
    return out.unionByName(kept)


_MAPPED = _C + """
, pa AS (SELECT scaffold_id AS scaffold, max(p) AS p FROM c WHERE scaffold_id IS NOT NULL GROUP BY 1), pl AS (SELECT scaffold, i - 1 AS place, p[i] AS residue, length(p) - 1 AS top FROM (SELECT *, unnest(range(1, length(p) + 1)) AS i FROM pa WHERE p <> ''))
, co AS (SELECT scaffold_id AS scaffold, candidate_id AS state, i AS place, s[i + 1] AS found FROM (SELECT c.*, unnest(list_distinct(fixed_positions)) AS i FROM c JOIN pa ON scaffold = scaffold_id WHERE length(s) = length(pa.p)) WHERE i >= 0 AND i < length(s))
, ho AS (SELECT scaffold, place, count(*) AS k FROM co GROUP BY ALL), cl AS (SELECT scaffold, place, row_number() OVER (PARTITION BY scaffold ORDER BY place) AS col FROM ho WHERE k >= 2)
, en AS (SELECT scaffold, state, min(place) AS first, max(place) AS last FROM co GROUP BY ALL)
, ev AS (SELECT pl.scaffold, en.state, pl.place, residue, found, col, top, first, last FROM pl JOIN en USING (scaffold) LEFT JOIN co ON co.scaffold = pl.scaffold AND co.state = en.state AND co.place = pl.place LEFT JOIN cl ON cl.scaffold = pl.scaffold AND cl.place = pl.place)
, ms AS (SELECT scaffold, state, place, CASE WHEN found = residue AND col IS NOT NULL THEN 'four_layer_exact' WHEN found IS NULL AND col IS NOT NULL THEN 'full_msa_only_unresolved_coordinate' ELSE 'review_required' END AS status, CASE WHEN found = residue AND col IS NOT NULL THEN 'high' WHEN found IS NULL AND col IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence,
  list_filter([CASE WHEN found IS NULL AND (place < first OR place > last) THEN 'unresolved_terminal' WHEN found IS NULL THEN 'unresolved_internal' WHEN found <> residue THEN 'resolved_substitution' END, CASE WHEN col IS NULL THEN 'query_only_insertion' END, CASE WHEN col IS NULL AND (place = 0 OR place = top) THEN 'terminal_msa_insertion' END], lambda x: x IS NOT NULL) AS reasons FROM ev)
"""


def _mapped(spark, directory):
    """Designs as states of their scaffold: fixed places are resolved, places that two designs fix stand in the alignment."""
    from pyspark.sql import Window

    designs = materialize(_designs(spark, directory).where("scaffold_id is not null"), "designs")
    parents = designs.groupBy(F.col("scaffold_id").alias("scaffold")).agg(F.max("p").alias("parent")).where("parent <> ''")
    places = parents.select("scaffold", F.posexplode(F.split("parent", "")).alias("place", "residue")).where("residue <> ''")
    fitting = designs.withColumnRenamed("scaffold_id", "scaffold").join(parents, "scaffold").where(F.length("s") == F.length("parent"))
    coordinates = fitting.select("scaffold", F.col("candidate_id").alias("state"), "s", F.explode(F.array_distinct("fixed_positions")).alias("place")).where("place >= 0 and place < length(s)")
    coordinates = materialize(coordinates.select("scaffold", "state", "place", F.substring("s", F.col("place") + 1, F.lit(1)).alias("residue")), "coordinates")
    held = coordinates.groupBy("scaffold", "place").agg(F.count("*").alias("k")).where("k >= 2")
    columns = held.select("scaffold", "place", F.row_number().over(Window.partitionBy("scaffold").orderBy("place")).alias("column"))
    return T.mapped_places(places, coordinates, columns)


@query(_MAPPED + "SELECT scaffold, status, confidence, count(*) AS places, count(DISTINCT state) AS states FROM ms GROUP BY ALL")
def mapping_status(spark, directory):
    """Places of every scaffold in every state by mapping status and confidence."""
    return _mapped(spark, directory).groupBy("scaffold", "status", "confidence").agg(F.count("*").alias("places"), F.count_distinct("state").alias("states"))


@query(_MAPPED + "SELECT reason, count(*) AS places FROM (SELECT unnest(reasons) AS reason FROM ms) GROUP BY 1")
def mapping_reasons(spark, directory):
    """How often each reason keeps a place from being mapped exactly."""
    return _mapped(spark, directory).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("places"))


_STATES = """
WITH d AS (SELECT scaffold_id AS scaffold, method AS state, list_distinct(fixed_positions) AS fixed FROM candidates WHERE scaffold_id IS NOT NULL AND method IS NOT NULL AND fixed_positions IS NOT NULL), n AS (SELECT scaffold, state, count(*) AS n FROM d GROUP BY ALL)
, m AS (SELECT scaffold, state, place, count(*) >= 0.5 * any_value(n) AS hard, true AS risk FROM (SELECT scaffold, state, unnest(fixed) AS place FROM d) JOIN n USING (scaffold, state) WHERE place IS NOT NULL GROUP BY ALL), s AS (SELECT scaffold, count(DISTINCT state) AS states FROM m GROUP BY 1)
"""


def _members(spark, directory):
    held = read(spark, directory, "candidates").where("scaffold_id is not null and method is not null and fixed_positions is not null").select(F.col("scaffold_id").alias("scaffold"), F.col("method").alias("state"), F.array_distinct("fixed_positions").alias("fixed"))
    sizes = held.groupBy("scaffold", "state").agg(F.count("*").alias("n"))
    per = held.select("scaffold", "state", F.explode("fixed").alias("place")).where("place is not null").groupBy("scaffold", "state", "place").agg(F.count("*").alias("k"))
    return per.join(sizes, ["scaffold", "state"]).select("scaffold", "state", "place", (F.col("k") >= 0.5 * F.col("n")).alias("hard"), F.lit(True).alias("risk"))


@query(_STATES + "SELECT scaffold, place, count(*) FILTER (hard) = any_value(states) AS hard, bool_or(risk) AS risk, count(DISTINCT hard) > 1 OR count(*) < any_value(states) AS variable FROM m JOIN s USING (scaffold) GROUP BY ALL")
def multistate_masks(spark, directory):
    """Places that are hard in all methods of a scaffold, at risk in any, and those whose kind differs between methods."""
    return T.state_masks(_members(spark, directory))


@query(
    _C
    + """
, n AS (SELECT scaffold_id AS scaffold, max(length(p)) AS length FROM c WHERE scaffold_id IS NOT NULL GROUP BY 1), m AS (SELECT scaffold_id AS scaffold, method, count(*) AS d FROM c WHERE scaffold_id IS NOT NULL AND method IS NOT NULL AND fixed_positions IS NOT NULL GROUP BY ALL)
, k AS (SELECT scaffold, method, place, count(*) AS k FROM (SELECT scaffold_id AS scaffold, method, unnest(list_distinct(fixed_positions)) AS place FROM c WHERE scaffold_id IS NOT NULL AND method IS NOT NULL) JOIN n USING (scaffold) WHERE place >= 0 AND place < length GROUP BY ALL)
, ev AS (SELECT scaffold, place, method AS source, k >= 0.9 * d AS hard, CASE WHEN k >= 0.9 * d THEN 'fixed_in_nearly_all' ELSE 'fixed_in_some' END AS reason FROM k JOIN m USING (scaffold, method))
, pl AS (SELECT scaffold, CAST(unnest(range(CAST(length AS BIGINT))) AS INTEGER) AS place FROM n WHERE length > 0)
SELECT pl.scaffold, pl.place, CASE WHEN bool_or(hard) THEN 'hard_fixed' WHEN count(source) > 0 THEN 'soft_constrained' ELSE 'free' END AS final_class, coalesce(string_agg(DISTINCT reason, ';' ORDER BY reason), 'no_constraint_evidence') AS reasons, coalesce(string_agg(DISTINCT source, ';' ORDER BY source), '') AS sources
FROM pl LEFT JOIN ev ON ev.scaffold = pl.scaffold AND ev.place = pl.place GROUP BY 1, 2
"""
)
def merged_constraints(spark, directory):
    """Every place of every scaffold with the class, reasons and sources of what its methods' designs fix."""
    designs = materialize(_designs(spark, directory).where("scaffold_id is not null").withColumnRenamed("scaffold_id", "scaffold"), "designs")
    lengths = designs.groupBy("scaffold").agg(F.max(F.length("p")).alias("length"))
    held = designs.where("method is not null and fixed_positions is not null")
    often = held.select("scaffold", "method", F.explode(F.array_distinct("fixed_positions")).alias("place")).groupBy("scaffold", "method", "place").agg(F.count("*").alias("k"))
    inside = often.join(lengths, "scaffold").where("place >= 0 and place < length").drop("length")
    share = inside.join(held.groupBy("scaffold", "method").agg(F.count("*").alias("d")), ["scaffold", "method"])
    hard = F.col("k") >= 0.9 * F.col("d")
    evidence = share.select("scaffold", "place", F.when(hard, "hard_fixed").otherwise("soft_constrained").alias("class"), F.col("method").alias("source"), F.when(hard, "fixed_in_nearly_all").otherwise("fixed_in_some").alias("reason"), F.lit(True).alias("confirmed"))
    return T.merged_evidence(lengths, evidence).select("scaffold", "place", "final_class", F.array_join("reasons", ";").alias("reasons"), F.array_join("sources", ";").alias("sources"))


# Which category each method stands for as a structural state.
_CATEGORIES = {"mpnn_plain": "apo", "mpnn_ligand": "binary", "msa_profile": "ternary_target"}


@query(
    """
WITH s AS (SELECT DISTINCT scaffold_id AS scaffold, method AS state, CASE method WHEN 'mpnn_plain' THEN 'apo' WHEN 'mpnn_ligand' THEN 'binary' WHEN 'msa_profile' THEN 'ternary' END AS kind FROM candidates WHERE scaffold_id IS NOT NULL AND method IS NOT NULL)
, h AS (SELECT scaffold, kind, string_agg(state, ';' ORDER BY state) AS states FROM s WHERE kind IS NOT NULL GROUP BY ALL), c AS (SELECT unnest(['apo only', 'binary only', 'ternary only', 'apo + binary', 'binary + ternary', 'apo + binary + ternary']) AS combination)
, w AS (SELECT combination, CASE WHEN k = 'apo' THEN 1 WHEN k = 'binary' THEN 2 ELSE 3 END AS o, k FROM (SELECT combination, unnest(string_split(replace(combination, ' only', ''), ' + ')) AS k FROM c))
SELECT x.scaffold, combination, CASE WHEN count(*) = count(h.states) THEN string_agg(h.states, ';' ORDER BY o) END AS states, string_agg(k, ';' ORDER BY o) FILTER (h.states IS NULL) AS missing
FROM (SELECT DISTINCT scaffold FROM s) x JOIN w ON true LEFT JOIN h ON h.scaffold = x.scaffold AND h.kind = w.k GROUP BY x.scaffold, combination
"""
)
def state_sets(spark, directory):
    """The states of each named combination of categories, or which categories a scaffold lacks."""
    kinds = F.create_map(*[F.lit(x) for pair in _CATEGORIES.items() for x in pair])
    states = read(spark, directory, "candidates").where("scaffold_id is not null and method is not null").select(F.col("scaffold_id").alias("scaffold"), F.col("method").alias("state")).distinct()
    return T.state_combinations(states.withColumn("category", F.try_element_at(kinds, F.col("state"))))


@query(
    _C
    + """
, t AS (SELECT DISTINCT scaffold_id AS scaffold, method AS state, i - 1 AS place, s[i] AS residue FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM (SELECT scaffold_id, method, min(s) AS s FROM c WHERE scaffold_id IS NOT NULL AND method IS NOT NULL AND s <> '' GROUP BY ALL)))
, n AS (SELECT scaffold, count(DISTINCT state) AS states FROM t GROUP BY 1)
SELECT scaffold, problem, count(*) AS places FROM (SELECT scaffold, place, CASE WHEN count(DISTINCT state) < any_value(states) THEN 'indices_disagree' WHEN count(DISTINCT residue) > 1 THEN 'residues_disagree' END AS problem FROM t JOIN n USING (scaffold) GROUP BY ALL) WHERE problem IS NOT NULL GROUP BY ALL
"""
)
def disagreeing_places(spark, directory):
    """Places at which the first designs of a scaffold's methods differ in extent or residue."""
    firsts = _designs(spark, directory).where("scaffold_id is not null and method is not null and s <> ''").groupBy(F.col("scaffold_id").alias("scaffold"), F.col("method").alias("state")).agg(F.min("s").alias("s"))
    residues = firsts.select("scaffold", "state", F.posexplode(F.split("s", "")).alias("place", "residue")).where("residue <> ''")
    return T.disagreeing_states(residues).groupBy("scaffold", "problem").agg(F.count("*").alias("places"))


_INGEST = _C + f"""
, st AS (SELECT unnest(['apo', 'binary', 'ternary']) AS state), be AS (SELECT unnest(['fasta', 'json']) AS backend)
, j AS (SELECT sha256(candidate_id || '|' || state || '|' || backend || '|' || s) AS job_id, candidate_id, state, backend FROM c, st, be WHERE s <> '' AND (state <> 'ternary' OR seed IS NOT NULL))
, r AS (SELECT candidate_id, 100 * {_IDENTITY} AS mean_plddt, p AS structure_path, fixed_positions AS pae_path FROM c WHERE fixed_position_violations = 0)
, pr AS (SELECT job_id, j.candidate_id, state, backend, CASE WHEN r.candidate_id IS NULL THEN 'missing' WHEN structure_path IS NULL OR pae_path IS NULL THEN 'failed_qc' ELSE 'success' END AS status, mean_plddt FROM j LEFT JOIN r ON r.candidate_id = j.candidate_id)
"""


def _predictions(spark, directory):
    """Jobs with what stands for their results: a design's own identity as confidence, its parent and fixed places as outputs."""
    designs = materialize(_designs(spark, directory), "designs")
    metrics = D.design_metrics(designs, "candidate_id", "s", "p", "fixed_positions").select("candidate_id", (100 * F.col("parent_identity")).alias("mean_plddt"))
    results = designs.where("fixed_position_violations = 0").join(metrics, "candidate_id").select("candidate_id", "mean_plddt", F.col("p").alias("structure_path"), F.col("fixed_positions").cast("string").alias("pae_path"))
    jobs = job_rows(spark, directory).drop("shard")
    return T.ingested(jobs, jobs.select("job_id", "candidate_id").join(results, "candidate_id"))


@query(_INGEST + "SELECT job_id, candidate_id, status, round(mean_plddt, 6) AS mean_plddt FROM pr")
def ingested_predictions(spark, directory):
    """Each prediction job with the status of its result."""
    return _predictions(spark, directory).select("job_id", "candidate_id", "status", F.round("mean_plddt", 6).alias("mean_plddt"))


@query(_INGEST + "SELECT state, backend, count(*) AS jobs, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status <> 'success') AS missing_or_failed, round(avg(mean_plddt) FILTER (status = 'success'), 6) AS mean_plddt FROM pr GROUP BY ALL")
def prediction_summary(spark, directory):
    """Jobs, successes and mean confidence per state and input format."""
    return T.prediction_summary(_predictions(spark, directory), ["state", "backend"])


@query(
    _C
    + """
, st AS (SELECT unnest(['apo', 'binary', 'ternary']) AS state), be AS (SELECT unnest(['fasta', 'json']) AS backend), r AS (SELECT min(upper(regexp_replace(direct_repeat, '[^ACGUacgu]', '', 'g'))) AS rna FROM crispr_arrays WHERE direct_repeat <> '')
, j AS (SELECT sha256(candidate_id || '|' || state || '|' || backend || '|' || s) AS job_id, s, state, backend, CASE WHEN state <> 'apo' THEN rna END AS crrna, CASE WHEN state = 'ternary' AND fixed_positions IS NOT NULL THEN reverse(rna) END AS target FROM c, st, be, r WHERE s <> '' AND (state <> 'ternary' OR seed IS NOT NULL))
SELECT job_id, CASE WHEN state <> 'apo' AND coalesce(crrna, '') = '' THEN 'no_crrna' WHEN state = 'ternary' AND coalesce(target, '') = '' THEN 'no_target_rna' END AS problem,
  sha256(CASE WHEN (state <> 'apo' AND coalesce(crrna, '') = '') OR (state = 'ternary' AND coalesce(target, '') = '') THEN NULL WHEN backend = 'fasta' THEN '>' || job_id || '|protein' || chr(10) || s || chr(10) || CASE WHEN crrna <> '' THEN '>' || job_id || '|crrna' || chr(10) || crrna || chr(10) ELSE '' END || CASE WHEN target <> '' THEN '>' || job_id || '|target' || chr(10) || target || chr(10) ELSE '' END
    ELSE '{"name":"' || job_id || '","chains":[{"name":"protein","sequence":"' || s || '"}' || CASE WHEN crrna <> '' THEN ',{"name":"crrna","sequence":"' || crrna || '"}' ELSE '' END || CASE WHEN target <> '' THEN ',{"name":"target","sequence":"' || target || '"}' ELSE '' END || ']}' END) AS input_sha256 FROM j
"""
)
def job_inputs(spark, directory):
    """The checksum of each prediction job's input text, or why it has none; RNA is the least repeat and, for a target, its reverse."""
    rna = read(spark, directory, "crispr_arrays").where("direct_repeat <> ''").agg(F.min(F.upper(F.regexp_replace("direct_repeat", "[^ACGUacgu]", ""))).alias("rna")).first().rna
    designs = _designs(spark, directory).select("candidate_id", F.col("s").alias("sequence"), "fixed_positions")
    crrna = F.when(F.col("state") != "apo", F.lit(rna).cast("string"))
    target = F.when((F.col("state") == "ternary") & F.col("fixed_positions").isNotNull(), F.reverse(F.lit(rna).cast("string")))
    jobs = job_rows(spark, directory).join(designs, "candidate_id").withColumns({"crrna": crrna, "target_rna": target})
    return T.backend_inputs(jobs).select("job_id", "problem", F.sha2("input", 256).alias("input_sha256"))


@query(_POINTS + 'SELECT l.vec_id AS "left", l.vec_id + 7 AS "right", round(sqrt((l.x - r.x) ** 2 + (l.y - r.y) ** 2 + (l.z - r.z) ** 2), 6) AS distance FROM a l LEFT JOIN a r ON r.vec_id = l.vec_id + 7')
def pair_distances(spark, directory):
    """Distances of named pairs of points; null where the other one is missing."""
    points = _points(spark, directory).select(F.col("vec_id").alias("id"), "x", "y", "z")
    return T.pair_distances(points, points.select(F.col("id").alias("left"), (F.col("id") + 7).alias("right"))).withColumn("distance", F.round("distance", 6))


@query("SELECT vec_id AS id, CAST(3 AS BIGINT) AS places, round((50 + 50 * embedding[label % 10 + 1]::DOUBLE + 50 + 50 * embedding[label % 10 + 11]::DOUBLE + 50 + 50 * embedding[label % 10 + 21]::DOUBLE) / 3, 5) AS confidence FROM embeddings")
def interface_confidence(spark, directory):
    """Mean of each vector's values, as confidences from 0 to 100, at three places that its label names."""
    vectors = read(spark, directory, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: 50 + 50 * x.cast("double")).alias("values"), "label")
    places = vectors.select("id", F.explode(F.array(*[(F.col("label") % 10 + k).cast("int") for k in (0, 10, 20)])).alias("place"))
    return T.mean_at(vectors.select("id", "values"), places).select("id", "places", F.round("mean", 5).alias("confidence"))


QUERIES, SQL = catalog.queries, catalog.sql
