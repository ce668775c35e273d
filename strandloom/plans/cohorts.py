"""Queries of selections, statistics and masks over groups of designs, variants and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.functions import hashing
from strandloom.functions import sequence as S
from strandloom.operators import cohorts as C
from strandloom.operators.designs import design_metrics
from strandloom.plans.catalog import Catalog
from strandloom.plans.sequences import _C, _IDENTITY, _designs
from strandloom.session import materialize, read

catalog = Catalog()
query = catalog.query
_HASH = "CAST('0x' || sha256({})[1:16] AS UBIGINT)"

_M = _C + f", m AS (SELECT candidate_id, method, scaffold_id, seed, {_IDENTITY} AS v FROM c)"


def _measured(spark, directory):
    return _designs(spark, directory).select("candidate_id", "method", "scaffold_id", "seed", S.identity(F.col("s"), F.col("p")).alias("v"))


@query(
    _M
    + """
, k AS (SELECT *, row_number() OVER (PARTITION BY scaffold_id, method ORDER BY (v BETWEEN 0.3 AND 0.9) DESC NULLS LAST, round(abs(v - 0.6), 9), candidate_id) AS k FROM m)
SELECT candidate_id, scaffold_id, method, CASE WHEN v IS NULL THEN 'no_value' WHEN NOT v BETWEEN 0.3 AND 0.9 THEN 'outside_box' WHEN k = 1 THEN 'selected' ELSE 'not_closest' END AS status FROM k
"""
)
def balanced_selection(spark, directory):
    """Of each scaffold and method the design closest to an identity of 0.6; the others with their reason."""
    return C.closest_in_box(_measured(spark, directory), ["scaffold_id", "method"], "candidate_id", "v", 0.3, 0.9, 0.6).select("candidate_id", "scaffold_id", "method", "status")


_BLOCKS = ", b AS (SELECT method, seed % 8 AS unit, avg(v) AS x FROM m WHERE v IS NOT NULL AND seed IS NOT NULL AND method IS NOT NULL GROUP BY ALL)"


def _blocks(spark, directory):
    return _measured(spark, directory).where("v is not null and seed is not null and method is not null").groupBy("method", (F.col("seed") % 8).alias("unit")).agg(F.avg("v").alias("x"))


@query(
    _M
    + _BLOCKS
    + """
, d AS (SELECT a.method, a.unit, a.x - r.x AS d, row_number() OVER (PARTITION BY a.method ORDER BY a.unit) - 1 AS bit FROM b a JOIN b r ON a.unit = r.unit AND r.method = 'matched_random' AND a.method <> r.method)
, f AS (SELECT method, count(*) AS pairs, avg(d) AS mean FROM d GROUP BY 1)
, s AS (SELECT method, flip, sum(CASE WHEN (flip >> bit) & 1 = 1 THEN -d ELSE d END) / any_value(pairs) AS m, any_value(mean) AS mean FROM (SELECT f.*, unnest(range(CAST(1 << pairs AS BIGINT))) AS flip FROM f) JOIN d USING (method) GROUP BY ALL)
, p AS (SELECT method, avg(CASE WHEN abs(m) >= abs(mean) - 1e-12 THEN 1.0 ELSE 0.0 END) AS p FROM s GROUP BY 1)
, r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS n FROM p)
SELECT method, pairs, round(mean, 6) AS mean_difference, round(p, 6) AS p_value, round(min(least(1.0, p * n / r)) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING), 6) AS adjusted_p FROM r JOIN f USING (method)
"""
)
def paired_method_tests(spark, directory):
    """Each method against matched random designs, paired by seed block: exact sign flips, adjusted."""
    blocks = _blocks(spark, directory)
    reference = blocks.where("method = 'matched_random'").select("unit", F.col("x").alias("y"))
    paired = blocks.where("method <> 'matched_random'").join(reference, "unit").select("method", "unit", (F.col("x") - F.col("y")).alias("d"))
    tests = C.benjamini_hochberg(C.sign_flip_p(paired, ["method"]), "p_value", "adjusted_p")
    return tests.select("method", "pairs", *[F.round(c, 6).alias(c) for c in ("mean_difference", "p_value", "adjusted_p")])


_LONG = _C + f"""
, m AS (SELECT method, seed, {_IDENTITY} AS parent_identity, (length(regexp_replace(s, '[^KR]', '', 'g')) - length(regexp_replace(s, '[^DE]', '', 'g'))) / nullif(length(s), 0) AS net_charge, length(regexp_replace(s, '[^AVILMFWY]', '', 'g')) / nullif(length(s), 0) AS hydrophobicity FROM c)
, b AS (SELECT method, metric, seed % 8 AS unit, avg(v) AS x FROM (SELECT method, seed, metric, v FROM m UNPIVOT (v FOR metric IN (parent_identity, net_charge, hydrophobicity))) WHERE v IS NOT NULL AND seed IS NOT NULL AND method IS NOT NULL GROUP BY ALL)
"""


@query(
    _LONG
    + """
, d AS (SELECT a.method, a.metric, a.unit, a.x - r.x AS d, row_number() OVER (PARTITION BY a.method, a.metric ORDER BY a.unit) - 1 AS bit FROM b a JOIN b r ON a.unit = r.unit AND a.metric = r.metric AND r.method = 'matched_random' AND a.method <> r.method)
, f AS (SELECT method, metric, count(*) AS pairs, avg(d) AS mean FROM d GROUP BY ALL)
, s AS (SELECT method, metric, flip, sum(CASE WHEN (flip >> bit) & 1 = 1 THEN -d ELSE d END) AS m, any_value(mean * pairs) AS total FROM (SELECT f.*, unnest(range(CAST(1 << pairs AS BIGINT))) AS flip FROM f) JOIN d USING (method, metric) GROUP BY ALL)
, p AS (SELECT method, metric, avg(CASE WHEN abs(m) >= abs(total) - 1e-11 THEN 1.0 ELSE 0.0 END) AS p FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS n FROM p)
SELECT method, metric, pairs, round(mean, 6) AS mean_difference, round(p, 6) AS p_value, round(min(least(1.0, p * n / r)) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING), 6) AS adjusted_p FROM r JOIN f USING (method, metric)
"""
)
def paired_metric_tests(spark, directory):
    """Each method against matched random designs in three metrics, paired by seed block, adjusted over all tests."""
    names = ["parent_identity", "net_charge", "hydrophobicity"]
    metrics = design_metrics(_designs(spark, directory), "candidate_id", "s", "p", "fixed_positions").select("candidate_id", *names)
    told = metrics.join(_designs(spark, directory).select("candidate_id", "method", "seed"), "candidate_id").unpivot(["method", "seed"], names, "metric", "v")
    blocks = told.where("v is not null and seed is not null and method is not null").groupBy("method", "metric", (F.col("seed") % 8).alias("unit")).agg(F.avg("v").alias("x"))
    blocks = materialize(blocks, "metric-blocks")
    reference = blocks.where("method = 'matched_random'").select("metric", "unit", F.col("x").alias("y"))
    paired = blocks.where("method <> 'matched_random'").join(reference, ["metric", "unit"]).select("method", "metric", "unit", (F.col("x") - F.col("y")).alias("d"))
    tests = C.benjamini_hochberg(C.sign_flip_p(paired, ["method", "metric"]), "p_value", "adjusted_p")
    return tests.select("method", "metric", "pairs", *[F.round(c, 6).alias(c) for c in ("mean_difference", "p_value", "adjusted_p")])


@query(
    _M
    + _BLOCKS
    + f"""
, k AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY unit) - 1 AS k FROM b), n AS (SELECT method, count(*) AS units, avg(x) AS mean FROM b GROUP BY 1)
, d AS (SELECT method, units, r, unnest(range(1, units + 1)) AS i FROM (SELECT *, unnest(range(100)) AS r FROM n))
, q AS (SELECT method, r, CAST({_HASH.format("'7:' || method || ':' || r || ':' || i")} % units AS BIGINT) AS k FROM d)
, z AS (SELECT method, r, avg(x) AS m FROM q JOIN k USING (method, k) GROUP BY ALL)
SELECT method, units, round(any_value(mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lower, round(quantile_cont(m, 0.975), 6) AS upper FROM z JOIN n USING (method) GROUP BY method, units
"""
)
def bootstrap_intervals(spark, directory):
    """Bootstrap intervals of each method's mean identity over seed blocks."""
    out = C.bootstrap_means(_blocks(spark, directory), ["method"], 100, 7)
    return out.select("method", "units", *[F.round(c, 6).alias(c) for c in ("mean", "lower", "upper")])


_V = "WITH v AS (SELECT DISTINCT variant_id, scaffold, assay_type, cis_activity, trans_activity, confidence, study_id FROM variant_retrospective)"


def _variants(spark, directory):
    return read(spark, directory, "variant_retrospective").select("variant_id", "scaffold", "assay_type", "cis_activity", "trans_activity", "confidence", "study_id").distinct()


@query(
    _V
    + """
, h AS (SELECT * FROM v WHERE cis_activity IS NOT NULL AND trans_activity IS NOT NULL)
, r AS (SELECT assay_type, rank() OVER (PARTITION BY assay_type ORDER BY cis_activity) + (count(*) OVER (PARTITION BY assay_type, cis_activity) - 1) / 2 AS x,
  rank() OVER (PARTITION BY assay_type ORDER BY trans_activity) + (count(*) OVER (PARTITION BY assay_type, trans_activity) - 1) / 2 AS y FROM h)
SELECT assay_type, count(*) AS variants, round(corr(x, y), 6) AS spearman FROM r GROUP BY 1
"""
)
def activity_correlation(spark, directory):
    """Spearman correlation of both activities per assay."""
    held = _variants(spark, directory).where("cis_activity is not null and trans_activity is not null").select("variant_id", "assay_type", "cis_activity", "trans_activity")
    ranked = C.average_ranks(C.average_ranks(held, ["assay_type"], "cis_activity", "x"), ["assay_type"], "trans_activity", "y")
    return ranked.groupBy("assay_type").agg(F.count("*").alias("variants"), F.round(C.guarded_correlation("x", "y"), 6).alias("spearman"))


_LABEL = "CASE WHEN cis_activity IS NULL THEN 'not_labeled' WHEN trans_activity IS NOT NULL AND cis_activity >= 0.5 AND trans_activity <= 0.2 THEN 'cis-retained/trans-reduced' WHEN cis_activity >= {a} THEN 'active' WHEN cis_activity < {i} THEN 'inactive' ELSE 'partial' END"


def _label(active, inactive):
    cis, trans = F.col("cis_activity"), F.col("trans_activity")
    return (
        F.when(cis.isNull(), "not_labeled")
        .when(trans.isNotNull() & (cis >= 0.5) & (trans <= 0.2), "cis-retained/trans-reduced")
        .when(cis >= active, "active")
        .when(cis < inactive, "inactive")
        .otherwise("partial")
    )


@query(
    _V
    + f"""
, g AS (SELECT unnest([0.7, 0.8, 0.9]) AS a), i AS (SELECT unnest([0.1, 0.2, 0.3]) AS i), l AS (SELECT a, i, {_LABEL.format(a='a', i='i')} AS label FROM v, g, i)
SELECT CAST(a AS DOUBLE) AS active_from, CAST(i AS DOUBLE) AS inactive_below, count(*) FILTER (label = 'active') AS active, count(*) FILTER (label = 'inactive') AS inactive, count(*) FILTER (label = 'partial') AS partial, count(*) FILTER (label = 'not_labeled') AS not_labeled FROM l GROUP BY ALL
"""
)
def label_sensitivity(spark, directory):
    """Label counts over a grid of nine pairs of thresholds, in one pass over the variants."""
    grid = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(i).alias("i")) for a in (0.7, 0.8, 0.9) for i in (0.1, 0.2, 0.3)])
    labelled = _variants(spark, directory).withColumn("g", F.explode(grid)).select(F.col("g.a").alias("active_from"), F.col("g.i").alias("inactive_below"), _label(F.col("g.a"), F.col("g.i")).alias("label"))
    return labelled.groupBy("active_from", "inactive_below").pivot("label", ["active", "inactive", "partial", "not_labeled"]).count().fillna(0)


@query(
    _V
    + """
SELECT study_id, count(*) AS variants, count(DISTINCT scaffold) AS scaffolds, count(*) FILTER (cis_activity IS NULL) AS missing_cis, round(avg(cis_activity), 6) AS mean_cis, round(stddev_pop(cis_activity), 6) AS spread_cis FROM v GROUP BY 1
"""
)
def study_summary(spark, directory):
    """Variants, scaffolds, missing values and spread per study."""
    return _variants(spark, directory).groupBy("study_id").agg(
        F.count("*").alias("variants"), F.count_distinct("scaffold").alias("scaffolds"), F.count_if(F.col("cis_activity").isNull()).alias("missing_cis"), F.round(F.avg("cis_activity"), 6).alias("mean_cis"), F.round(F.stddev_pop("cis_activity"), 6).alias("spread_cis")
    )


@query(
    _M
    + """
SELECT method, count(*) AS designs, count(DISTINCT scaffold_id) AS scaffolds, count(v) AS measured, round(min(v), 6) AS least, round(avg(v), 6) AS mean, round(max(v), 6) AS most, round(median(v), 6) AS median_identity FROM m GROUP BY 1
"""
)
def method_table(spark, directory):
    """Designs, scaffolds and identities per method."""
    return _measured(spark, directory).groupBy("method").agg(
        F.count("*").alias("designs"), F.count_distinct("scaffold_id").alias("scaffolds"), F.count("v").alias("measured"), F.round(F.min("v"), 6).alias("least"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.max("v"), 6).alias("most"), F.round(F.median("v"), 6).alias("median_identity")
    )


@query(
    _C
    + """
, x AS (SELECT candidate_id, scaffold_id, s, p, unnest(fixed_positions) AS i FROM c WHERE length(s) = length(p))
SELECT scaffold_id, count(DISTINCT candidate_id) AS designs, count(*) AS places, round(avg(CASE WHEN s[i + 1] = p[i + 1] THEN 1.0 ELSE 0.0 END), 6) AS recovery, count(*) FILTER (i >= length(p) OR i < 0) AS outside FROM x WHERE i IS NOT NULL GROUP BY 1
"""
)
def fixed_recovery(spark, directory):
    """How often fixed places hold the parent's residue, per scaffold."""
    places = _designs(spark, directory).where(F.length("s") == F.length("p")).select("candidate_id", "scaffold_id", "s", "p", F.explode("fixed_positions").alias("i")).where("i is not null")
    same = F.substring("s", F.col("i") + 1, F.lit(1)) == F.substring("p", F.col("i") + 1, F.lit(1))
    return places.groupBy("scaffold_id").agg(
        F.count_distinct("candidate_id").alias("designs"), F.count("*").alias("places"), F.round(F.avg(same.cast("int")), 6).alias("recovery"), F.count_if((F.col("i") >= F.length("p")) | (F.col("i") < 0)).alias("outside")
    )


@query(
    """
WITH m AS (SELECT DISTINCT scaffold_id AS scaffold, method AS state, unnest(fixed_positions) AS position FROM candidates WHERE scaffold_id IS NOT NULL AND method IS NOT NULL), s AS (SELECT scaffold, count(DISTINCT state) AS states FROM m GROUP BY 1)
SELECT scaffold, position, count(DISTINCT state) AS in_states, CASE WHEN count(DISTINCT state) = any_value(states) THEN 'intersection' ELSE 'variable' END AS kind FROM m JOIN s USING (scaffold) GROUP BY ALL
"""
)
def fixed_masks(spark, directory):
    """Fixed places that all methods of a scaffold share, and those of some."""
    members = read(spark, directory, "candidates").where("scaffold_id is not null and method is not null").select(F.col("scaffold_id").alias("scaffold"), F.col("method").alias("state"), F.explode("fixed_positions").alias("position")).distinct()
    return C.mask_kinds(members)


@query(
    _C
    + """
, n AS (SELECT scaffold_id, max(length(p)) AS size, count(*) AS designs FROM c GROUP BY 1), f AS (SELECT scaffold_id, unnest(fixed_positions) AS i FROM c), h AS (SELECT scaffold_id, i, count(*) AS k FROM f GROUP BY ALL)
, g AS (SELECT scaffold_id, designs, unnest(range(CAST(size AS BIGINT))) AS i FROM n)
SELECT g.scaffold_id, CAST(g.i AS INTEGER) AS place, coalesce(k, 0) AS fixed_in, CASE WHEN coalesce(k, 0) >= 0.9 * designs THEN 'hard_fixed' WHEN coalesce(k, 0) > 0 THEN 'soft' ELSE 'free' END AS class FROM g LEFT JOIN h ON g.scaffold_id = h.scaffold_id AND g.i = h.i
"""
)
def place_classes(spark, directory):
    """Every place of every scaffold with the strongest class that its designs give it."""
    designs = _designs(spark, directory).where("scaffold_id is not null")
    sizes = designs.groupBy("scaffold_id").agg(F.max(F.length("p")).alias("size"), F.count("*").alias("designs"))
    fixed = designs.select("scaffold_id", F.explode("fixed_positions").alias("place")).groupBy("scaffold_id", "place").agg(F.count("*").alias("fixed_in"))
    every = sizes.where("size > 0").select("scaffold_id", "designs", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("place"))
    k = F.coalesce("fixed_in", F.lit(0))
    return every.join(fixed, ["scaffold_id", "place"], "left").select("scaffold_id", "place", k.alias("fixed_in"), F.when(k >= 0.9 * F.col("designs"), "hard_fixed").when(k > 0, "soft").otherwise("free").alias("class"))


@query(
    _C
    + f"""
, nb AS (SELECT scaffold_id || '/' || seed AS pair, method, candidate_id, row_number() OVER (PARTITION BY scaffold_id, seed, method ORDER BY candidate_id) AS k FROM c JOIN (SELECT scaffold_id, max(p) AS parent FROM c GROUP BY 1) USING (scaffold_id) WHERE length(s) = length(parent) AND seed IS NOT NULL AND method IN ('mpnn_plain', 'mpnn_ligand'))
, o AS (SELECT CASE WHEN k = 1 THEN pair ELSE pair || '#' || k END AS pair_id, min(candidate_id) FILTER (method = 'mpnn_plain') AS a, min(candidate_id) FILTER (method = 'mpnn_ligand') AS b FROM nb GROUP BY 1)
, pr AS (SELECT pair_id, parent, x.s AS f, y.s AS g FROM o JOIN c x ON x.candidate_id = a JOIN c y ON y.candidate_id = b JOIN (SELECT scaffold_id, max(p) AS parent FROM c GROUP BY 1) q ON q.scaffold_id = x.scaffold_id)
, z AS (SELECT pair_id, length(parent) AS n, i, parent[i] AS p, f[i] AS a, g[i] AS b, CAST({_HASH.format("'first:' || pair_id || ':' || i")} % 1000 AS INTEGER) AS ca, CAST({_HASH.format("'second:' || pair_id || ':' || i")} % 1000 AS INTEGER) AS cb FROM (SELECT *, unnest(range(1, length(parent) + 1)) AS i FROM pr))
, t AS (SELECT *, CASE WHEN a = b THEN a WHEN a = p THEN b WHEN b = p THEN a WHEN ca >= cb THEN a ELSE b END AS token, CASE WHEN a <> b AND a = p THEN ca - cb WHEN a <> b AND b = p THEN cb - ca END AS gain FROM z)
, w AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY gain DESC NULLS LAST, i) AS k, CAST(round_even(n * 0.6, 0) AS INTEGER) - sum(CASE WHEN token = p THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id) AS wanted FROM t)
, e AS (SELECT *, gain IS NOT NULL AND k <= wanted AS back FROM w)
SELECT pair_id, string_agg(CASE WHEN back THEN p ELSE token END, '' ORDER BY i) AS sequence, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS agreement, count(*) FILTER (CASE WHEN back THEN p ELSE token END = p) AS matches, count(*) FILTER (back) AS kept FROM e GROUP BY 1
"""
)
def design_consensus(spark, directory):
    """Two methods' designs of one scaffold, seed and proposal merged at a set identity to the parent.

    Proposals are the designs of a scaffold, seed and method numbered by ``candidate_id``; from the second on the number
    ends the ``pair_id``. Designs without a counterpart are left out; rows delivered twice count once.
    """
    designs = _designs(spark, directory)
    parents = designs.groupBy("scaffold_id").agg(F.max("p").alias("parent"))
    fitting = designs.join(parents, "scaffold_id").where(F.length("s") == F.length("parent")).where("seed is not null").withColumn("pair_id", F.concat("scaffold_id", F.lit("/"), "seed"))
    once = fitting.where(F.col("method").isin("mpnn_plain", "mpnn_ligand")).groupBy("pair_id", "method", "candidate_id").agg(F.max("parent").alias("parent"), F.min("s").alias("s"))
    number = F.row_number().over(Window.partitionBy("pair_id", "method").orderBy("candidate_id"))
    numbered = once.withColumn("number", number).withColumn("pair_id", F.when(F.col("number") == 1, F.col("pair_id")).otherwise(F.concat("pair_id", F.lit("#"), "number")))
    first = lambda method: F.min(F.when(F.col("method") == method, F.struct("candidate_id", "s")))
    pairs = numbered.groupBy("pair_id").agg(F.max("parent").alias("parent"), first("mpnn_plain").alias("a"), first("mpnn_ligand").alias("b")).where("a is not null and b is not null")
    return C.consensus(pairs.select("pair_id", "parent", F.col("a.s").alias("first"), F.col("b.s").alias("second")), 0.6)


_E = "WITH u AS (SELECT user_id AS id, event_type AS state, avg(value) AS score FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL GROUP BY ALL), w AS (SELECT event_type AS state, count(*) AS weight FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL GROUP BY 1)"


def _states(spark, directory):
    events = read(spark, directory, "events").where("user_id is not null and event_type is not null and value is not null")
    scores = events.groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("state")).agg(F.avg("value").alias("score"))
    return scores, events.groupBy(F.col("event_type").alias("state")).agg(F.count("*").alias("weight"))


@query(
    _E
    + """
, s AS (SELECT state, weight / (SELECT sum(weight) FROM w) AS w FROM w), a AS (SELECT id, sum(w * score) AS m, min(score) AS least, sum(w * score * score) AS q FROM u JOIN s USING (state) GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM w))
SELECT id, round(m, 4) AS weighted_mean, round(least, 3) AS least, round(greatest(q - m * m, 0), 2) AS variance FROM a
"""
)
def state_scores(spark, directory):
    """Weighted mean, least and variance of each user's scores over all event types."""
    out = C.state_aggregates(*_states(spark, directory))
    return out.select("id", F.round("weighted_mean", 4).alias("weighted_mean"), F.round("least", 3).alias("least"), F.round("variance", 2).alias("variance"))


@query(
    _E
    + """
, k AS (SELECT id, state, rank() OVER (PARTITION BY state ORDER BY round(score, 9)) + (count(*) OVER (PARTITION BY state, round(score, 9)) - 1) / 2 AS r FROM u)
SELECT a.state AS left_state, b.state AS right_state, count(*) AS users, round(CASE WHEN count(*) FILTER (a.r <> b.r) = 0 THEN 1.0 ELSE coalesce(corr(a.r, b.r), 0.0) END, 6) AS rank_correlation FROM k a JOIN k b ON a.id = b.id AND a.state < b.state GROUP BY ALL
"""
)
def state_rank_agreement(spark, directory):
    """Rank correlation of users between each two event types; where one is constant, 1 for equal ranks and else 0."""
    scores, _ = _states(spark, directory)
    ranked = C.average_ranks(scores.withColumn("score", F.round("score", 9)), ["state"], "score", "r")
    pairs = ranked.select("id", F.col("state").alias("left_state"), F.col("r").alias("x")).join(ranked.select("id", F.col("state").alias("right_state"), F.col("r").alias("y")), "id").where("left_state < right_state")
    return pairs.groupBy("left_state", "right_state").agg(F.count("*").alias("users"), F.round(C.rank_agreement("x", "y"), 6).alias("rank_correlation"))


@query(
    _C
    + f"""
, st AS (SELECT unnest(['apo', 'binary', 'ternary']) AS state), be AS (SELECT unnest(['fasta', 'json']) AS backend)
, j AS (SELECT candidate_id, state, backend, sha256(candidate_id || '|' || state || '|' || backend || '|' || s) AS job_id FROM c, st, be WHERE s <> '' AND (state <> 'ternary' OR seed IS NOT NULL))
SELECT job_id, candidate_id, state, backend, CAST({_HASH.format("job_id")} % 16 AS INTEGER) AS shard FROM j
"""
)
def job_rows(spark, directory):
    """Prediction jobs of each design for each state and input format, with stable ids and shards."""
    kinds = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(b).alias("backend")) for s in ("apo", "binary", "ternary") for b in ("fasta", "json")])
    each = _designs(spark, directory).where("s <> ''").select("candidate_id", "s", "seed", F.explode(kinds).alias("k")).select("candidate_id", "s", "seed", "k.*")
    wanted = each.where("state <> 'ternary' or seed is not null").withColumn("job_id", F.sha2(F.concat_ws("|", "candidate_id", "state", "backend", "s"), 256))
    return wanted.select("job_id", "candidate_id", "state", "backend", hashing.shard_of(F.col("job_id"), 16).alias("shard"))


@query(
    """
WITH h AS (SELECT scaffold_id, unnest(fixed_positions) AS i FROM candidates), n AS (SELECT scaffold_id, count(*) AS d FROM candidates WHERE fixed_positions IS NOT NULL GROUP BY 1)
, core AS (SELECT scaffold_id, list(i) AS core FROM (SELECT scaffold_id, i FROM h JOIN n USING (scaffold_id) GROUP BY ALL HAVING count(*) >= 0.5 * any_value(d)) GROUP BY 1)
SELECT candidate_id, round(len(list_intersect(list_distinct(fixed_positions), coalesce(core, []))) / nullif(len(coalesce(core, [])), 0), 6) AS recall, round(coalesce(len(list_intersect(list_distinct(fixed_positions), coalesce(core, []))) / nullif(len(list_distinct(fixed_positions)), 0), 0), 6) AS precision
FROM candidates LEFT JOIN core USING (scaffold_id) WHERE fixed_positions IS NOT NULL
"""
)
def core_overlap(spark, directory):
    """How far each design's fixed places agree with those that half of its scaffold's designs fix."""
    c = read(spark, directory, "candidates").where("fixed_positions is not null").select("candidate_id", "scaffold_id", F.array_distinct("fixed_positions").alias("own"))
    sizes = c.groupBy("scaffold_id").agg(F.count("*").alias("d"))
    often = read(spark, directory, "candidates").select("scaffold_id", F.explode("fixed_positions").alias("i")).groupBy("scaffold_id", "i").agg(F.count("*").alias("k"))
    core = often.join(sizes, "scaffold_id").where(F.col("k") >= 0.5 * F.col("d")).groupBy("scaffold_id").agg(F.collect_set("i").alias("core"))
    joined = c.join(core, "scaffold_id", "left").withColumn("core", F.coalesce("core", F.array().cast("array<int>")))
    both = F.size(F.array_intersect("own", "core"))
    return joined.select("candidate_id", F.round(F.try_divide(both, F.size("core")), 6).alias("recall"), F.round(F.coalesce(F.try_divide(both, F.size("own")), F.lit(0.0)), 6).alias("precision"))


QUERIES, SQL = catalog.queries, catalog.sql
