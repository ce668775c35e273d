"""Queries over designed sequences: scalar metrics, gates, alignment columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.functions import hashing
from strandloom.functions import sequence as S
from strandloom.operators import columns, variants
from strandloom.operators.designs import design_metrics
from strandloom.plans.catalog import Catalog
from strandloom.session import materialize, read

catalog = Catalog()
query = catalog.query

_C = """
WITH c AS (
  SELECT candidate_id, method, scaffold_id, seed, fixed_positions, fixed_position_violations,
    upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) AS s, upper(regexp_replace(parent_sequence, '[^A-Za-z]', '', 'g')) AS p FROM candidates
)
"""
_IDENTITY = "CASE WHEN length(s) = length(p) AND length(s) > 0 THEN len(list_filter(range(1, length(s) + 1), lambda i: s[i] = p[i])) / length(s) END"
_ENTROPY = "CASE WHEN length(s) > 0 THEN (SELECT -sum(n / length(s) * ln(n / length(s))) FROM (SELECT count(*) AS n FROM (SELECT unnest(string_split(s, '')) AS t) GROUP BY t)) END"
_RUN = "CASE WHEN s = '' THEN 0 ELSE list_max(list_transform(regexp_extract_all(s, 'A+|B+|C+|D+|E+|F+|G+|H+|I+|J+|K+|L+|M+|N+|O+|P+|Q+|R+|S+|T+|U+|V+|W+|X+|Y+|Z+'), lambda r: length(r))) END"


def _designs(spark, directory):
    c = read(spark, directory, "candidates")
    return c.select("candidate_id", "method", "scaffold_id", "seed", "fixed_positions", "fixed_position_violations", S.letters(F.col("sequence")).alias("s"), S.letters(F.col("parent_sequence")).alias("p"))


@query(
    _C
    + f"""
SELECT candidate_id, length(s) AS residues, round({_IDENTITY}, 6) AS parent_identity,
  round(CASE WHEN length(s) = length(p) AND length(s) > 0 AND fixed_positions IS NOT NULL THEN
    len(list_filter(range(1, length(s) + 1), lambda i: s[i] = p[i] AND NOT list_contains(fixed_positions, CAST(i - 1 AS INTEGER)))) / nullif(len(list_filter(range(1, length(s) + 1), lambda i: NOT list_contains(fixed_positions, CAST(i - 1 AS INTEGER)))), 0) END, 6) AS designed_identity,
  round((length(regexp_replace(s, '[^KR]', '', 'g')) - length(regexp_replace(s, '[^DE]', '', 'g'))) / nullif(length(s), 0), 6) AS net_charge,
  round(length(regexp_replace(s, '[^AVILMFWY]', '', 'g')) / nullif(length(s), 0), 6) AS hydrophobicity, {_RUN} AS homopolymer
FROM c
"""
)
def candidate_metrics(spark, directory):
    """Length, identity to the parent, charge, hydrophobicity and longest run of each design."""
    out = design_metrics(_designs(spark, directory), "candidate_id", "s", "p", "fixed_positions")
    return out.select("candidate_id", "residues", *[F.round(c, 6).alias(c) for c in ("parent_identity", "designed_identity", "net_charge", "hydrophobicity")], "homopolymer")


@query(
    _C
    + """
, t AS (SELECT candidate_id, 's' AS side, unnest(string_split(s, '')) AS a FROM c UNION ALL SELECT candidate_id, 'p', unnest(string_split(p, '')) FROM c WHERE p IS NOT NULL)
, n AS (SELECT candidate_id, side, a, count(*) AS n FROM t WHERE a <> '' GROUP BY ALL), l AS (SELECT candidate_id, side, sum(n) AS l FROM n GROUP BY ALL)
, f AS (SELECT candidate_id, side, a, n / l AS f FROM n JOIN l USING (candidate_id, side))
, e AS (SELECT candidate_id, -sum(f * ln(f)) AS e FROM f WHERE side = 's' GROUP BY 1)
, d AS (SELECT coalesce(x.candidate_id, y.candidate_id) AS candidate_id, sum(abs(coalesce(x.f, 0) - coalesce(y.f, 0))) / 2 AS d
  FROM (SELECT * FROM f WHERE side = 's') x FULL JOIN (SELECT * FROM f WHERE side = 'p') y ON x.candidate_id = y.candidate_id AND x.a = y.a
  WHERE regexp_matches(coalesce(x.a, y.a), '[ACDEFGHIKLMNPQRSTVWY]') GROUP BY 1)
SELECT c.candidate_id, round(abs(e.e), 6) AS entropy, round(CASE WHEN length(s) > 0 AND length(p) > 0 THEN d.d END, 6) AS composition_deviation FROM c LEFT JOIN e USING (candidate_id) LEFT JOIN d USING (candidate_id)
"""
)
def candidate_composition(spark, directory):
    """Entropy of each design and how far its composition is from its parent's."""
    s, p = F.col("s"), F.col("p")
    return _designs(spark, directory).select("candidate_id", F.round(F.abs(S.entropy(s)), 6).alias("entropy"), F.round(S.composition_deviation(s, p), 6).alias("composition_deviation"))


@query(
    _C
    + """
SELECT candidate_id, CAST(coalesce(len(list_filter(range(1, length(s) - 10), lambda i: list_max(list_transform(string_split('ACDEFGHIKLMNPQRSTVWY', ''), lambda a: 12 - length(replace(s[i:i + 11], a, '')))) > 4)), 0) AS INTEGER) AS windows FROM c WHERE s IS NOT NULL
"""
)
def low_complexity(spark, directory):
    """Windows of 12 residues in which one makes more than a third."""
    return _designs(spark, directory).where("s is not null").select("candidate_id", F.size(S.low_complexity_windows(F.col("s"), 12, 4 / 12)).alias("windows"))


_REASONS = f"""
, m AS (SELECT candidate_id, scaffold_id, method, fixed_position_violations AS v, {_IDENTITY} AS i, {_RUN} AS r FROM c),
g AS (SELECT candidate_id, scaffold_id, method, list_filter([CASE WHEN v <> 0 THEN 'fixed_position_violation' END, CASE WHEN i IS NULL THEN 'no_parent_identity' WHEN i > 0.8 THEN 'parent_identity_above_threshold' END,
  CASE WHEN r > 4 THEN 'homopolymer_above_threshold' END], lambda x: x IS NOT NULL) AS reasons FROM m)
"""


def _reasons(spark, directory):
    s, p = F.col("s"), F.col("p")
    i, run = S.identity(s, p), S.longest_homopolymer(s)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("fixed_position_violations") != 0, F.lit("fixed_position_violation")),
            F.when(i.isNull(), F.lit("no_parent_identity")).when(i > 0.8, F.lit("parent_identity_above_threshold")),
            F.when(run > 4, F.lit("homopolymer_above_threshold")),
        )
    )
    return _designs(spark, directory).select("candidate_id", "scaffold_id", "method", reasons.alias("reasons"))


@query(_C + _REASONS + "SELECT candidate_id, array_to_string(reasons, ';') AS reasons, len(reasons) = 0 AS passes FROM g")
def gate_reasons(spark, directory):
    """Each design with the ordered reasons why it fails; what cannot be measured fails."""
    return _reasons(spark, directory).select("candidate_id", F.array_join("reasons", ";").alias("reasons"), (F.size("reasons") == 0).alias("passes"))


@query(_C + _REASONS + "SELECT method, reason, count(*) AS designs FROM (SELECT method, unnest(CASE WHEN len(reasons) = 0 THEN ['passed'] ELSE reasons END) AS reason FROM g) GROUP BY ALL")
def gate_reason_counts(spark, directory):
    """Failure reasons per method."""
    each = _reasons(spark, directory).select("method", F.explode(F.when(F.size("reasons") == 0, F.array(F.lit("passed"))).otherwise(F.col("reasons"))).alias("reason"))
    return each.groupBy("method", "reason").agg(F.count("*").alias("designs"))


@query(
    _C
    + _REASONS
    + """
SELECT method, count(*) AS proposed, count(*) FILTER (NOT list_contains(reasons, 'fixed_position_violation')) AS kept_fixed, count(*) FILTER (NOT list_contains(reasons, 'no_parent_identity')) AS measured, count(*) FILTER (len(reasons) = 0) AS passed FROM g GROUP BY 1
"""
)
def method_funnel(spark, directory):
    """Designs left after each stage, one column a stage."""
    r = F.col("reasons")
    return _reasons(spark, directory).groupBy("method").agg(
        F.count("*").alias("proposed"),
        F.count_if(~F.array_contains(r, "fixed_position_violation")).alias("kept_fixed"),
        F.count_if(~F.array_contains(r, "no_parent_identity")).alias("measured"),
        F.count_if(F.size(r) == 0).alias("passed"),
    )


@query(
    _C
    + _REASONS
    + """
, w AS (SELECT method, count(*) AS proposed, count(*) FILTER (NOT list_contains(reasons, 'fixed_position_violation')) AS kept_fixed, count(*) FILTER (len(reasons) = 0) AS passed FROM g GROUP BY 1)
SELECT method, stage, designs FROM w UNPIVOT (designs FOR stage IN (proposed, kept_fixed, passed))
"""
)
def method_funnel_long(spark, directory):
    """The same stages, one row each."""
    wide = method_funnel(spark, directory)
    return wide.unpivot(["method"], ["proposed", "kept_fixed", "passed"], "stage", "designs")


@query("SELECT candidate_id, list_aggregate(list_sort(list_distinct(list_filter(string_split(upper(regexp_replace(sequence, '[ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', '', 'g')), ''), lambda x: x <> ''))), 'string_agg', '') AS symbols FROM candidates WHERE sequence IS NOT NULL AND regexp_matches(sequence, '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]')")
def odd_symbols(spark, directory):
    """Designs with symbols that are no standard amino acid."""
    odd = S.invalid_symbols(F.col("sequence"))
    return read(spark, directory, "candidates").select("candidate_id", odd.alias("o")).where(F.size("o") > 0).select("candidate_id", F.array_join("o", "").alias("symbols"))


@query(
    """
WITH h AS (SELECT scaffold_id, sha256(to_json(list_sort(list_distinct(fixed_positions)))::VARCHAR) AS fixed_hash FROM candidates WHERE fixed_positions IS NOT NULL)
SELECT scaffold_id, fixed_hash, count(*) AS designs FROM h GROUP BY ALL
"""
)
def fixed_position_hashes(spark, directory):
    """Sets of fixed positions per scaffold, as hashes that do not depend on order."""
    rows = read(spark, directory, "candidates").where("fixed_positions is not null").select("scaffold_id", hashing.position_set_hash(F.col("fixed_positions")).alias("fixed_hash"))
    return rows.groupBy("scaffold_id", "fixed_hash").agg(F.count("*").alias("designs"))


_ALN = _C + ", m AS (SELECT scaffold_id AS aln, max(length(p)) AS n FROM c GROUP BY 1), a AS (SELECT scaffold_id AS aln, candidate_id AS row_id, s FROM c JOIN m ON scaffold_id = aln WHERE length(s) = n), cell AS (SELECT aln, row_id, i - 1 AS col, s[i] AS token FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM a))"


def _alignment(spark, directory):
    """Designs of each scaffold that have their parent's length, as an ungapped alignment."""
    designs = _designs(spark, directory).where("scaffold_id is not null")
    sizes = designs.groupBy("scaffold_id").agg(F.max(F.length("p")).alias("n"))
    return designs.join(sizes, "scaffold_id").where(F.length("s") == F.col("n")).select(F.col("scaffold_id").alias("aln"), F.col("candidate_id").alias("row_id"), F.col("s").alias("seq"))


_PAIRS = ", pairs AS (SELECT x.aln, x.row_id AS l, y.row_id AS r, len(list_filter(range(1, length(x.s) + 1), lambda i: x.s[i] = y.s[i])) / length(x.s) AS identity FROM a x JOIN a y ON x.aln = y.aln AND x.row_id <> y.row_id)"


@query(_ALN + _PAIRS + "SELECT aln, (SELECT count(*) FROM a WHERE a.aln = pairs.aln) AS rows, round(avg(identity), 6) AS mean_identity FROM pairs GROUP BY 1")
def scaffold_diversity(spark, directory):
    """Mean identity of all pairs of designs of a scaffold, without making pairs."""
    return columns.mean_pairwise_identity(_alignment(spark, directory)).where("rows > 1")


_WEIGHTS = _PAIRS + ", w AS (SELECT a.aln, a.row_id, 1 / (1 + count(l) FILTER (identity >= 0.8 - 1e-9)) AS weight FROM a LEFT JOIN pairs ON pairs.aln = a.aln AND l = row_id GROUP BY 1, 2)"


@query(_ALN + _WEIGHTS + "SELECT aln, row_id, round(weight, 6) AS weight FROM w")
def design_weights(spark, directory):
    """Weights of designs by the number of near neighbours in their scaffold."""
    return columns.row_weights(_alignment(spark, directory)).withColumn("weight", F.round("weight", 6))


@query(
    _ALN
    + _WEIGHTS
    + """
, n AS (SELECT aln, col, token, sum(weight) AS w FROM cell JOIN w USING (aln, row_id) GROUP BY ALL), f AS (SELECT *, w / sum(w) OVER (PARTITION BY aln, col) AS f FROM n)
SELECT aln, col AS "column", round(max(f), 6) AS conservation, round(abs(sum(f * ln(f))), 6) AS entropy, arg_max(token, (round(f, 9), -ascii(token))) AS consensus, 1.0 AS coverage,
  coalesce(string_agg(token, '' ORDER BY token) FILTER (f >= 0.05), '') AS allowed_tokens, 0.0 AS gap_fraction, round(sum(w), 6) AS effective_rows
FROM f GROUP BY ALL
"""
)
def column_conservation(spark, directory):
    """Weighted conservation of every alignment column of every scaffold."""
    rows = _alignment(spark, directory)
    out = columns.conservation(rows, columns.row_weights(rows))
    return out.drop("frequencies", "plain_frequencies").withColumn("entropy", F.abs("entropy"))


@query(
    _ALN
    + _WEIGHTS
    + """
, n AS (SELECT aln, col, token, sum(weight) AS w, count(*) AS c FROM cell JOIN w USING (aln, row_id) GROUP BY ALL), f AS (SELECT *, w / sum(w) OVER (PARTITION BY aln, col) AS f, c / sum(c) OVER (PARTITION BY aln, col) AS g FROM n)
SELECT aln, col AS "column", token, round(f, 6) AS frequency, round(g, 6) AS plain_frequency FROM f
"""
)
def column_frequencies(spark, directory):
    """Weighted and plain token frequencies of every alignment column."""
    rows = _alignment(spark, directory)
    out = columns.conservation(rows, columns.row_weights(rows)).select("aln", "column", "plain_frequencies", F.explode("frequencies").alias("token", "frequency"))
    return out.select("aln", "column", "token", "frequency", F.element_at("plain_frequencies", F.col("token")).alias("plain_frequency"))


@query(
    _ALN
    + _WEIGHTS
    + """
, n AS (SELECT aln, col, token, sum(weight) AS w FROM cell JOIN w USING (aln, row_id) GROUP BY ALL), f AS (SELECT *, w / sum(w) OVER (PARTITION BY aln, col) AS f FROM n), k AS (SELECT aln, col, round(max(f), 6) AS k FROM f GROUP BY ALL)
SELECT aln, count(*) AS columns, count(*) FILTER (k >= 0.5) AS from_50, count(*) FILTER (k >= 0.8) AS from_80, count(*) FILTER (k >= 0.9) AS from_90, count(*) FILTER (k >= 0.95) AS from_95, 0.0 AS mean_gap, round(avg(k), 5) AS mean_conservation FROM k GROUP BY 1
"""
)
def conservation_summary(spark, directory):
    """Columns of each scaffold by conservation, with mean gap fraction and mean conservation."""
    rows = _alignment(spark, directory)
    out = columns.conservation(rows, columns.row_weights(rows))
    reached = [F.count_if(F.col("conservation") >= t / 100).alias(f"from_{t}") for t in (50, 80, 90, 95)]
    return out.groupBy("aln").agg(F.count("*").alias("columns"), *reached, F.round(F.avg("gap_fraction"), 5).alias("mean_gap"), F.round(F.avg("conservation"), 5).alias("mean_conservation"))


_COUPLED = """
, tc AS (SELECT aln, col FROM cell GROUP BY ALL HAVING count(DISTINCT token) > 1), x AS (SELECT aln, row_id, col, token, weight FROM cell SEMI JOIN tc USING (aln, col) JOIN w USING (aln, row_id))
, jt AS (SELECT l.aln, l.col AS i, r.col AS j, l.token AS a, r.token AS b, sum(l.weight) AS w FROM x l JOIN x r ON l.aln = r.aln AND l.row_id = r.row_id AND l.col < r.col GROUP BY ALL)
, ja AS (SELECT aln, i, j, a, sum(w) AS wa FROM jt GROUP BY ALL), jb AS (SELECT aln, i, j, b, sum(w) AS wb FROM jt GROUP BY ALL), js AS (SELECT aln, i, j, sum(w) AS ws FROM jt GROUP BY ALL)
, mi AS (SELECT aln, i, j, sum(w / ws * ln(w * ws / (wa * wb))) AS mi FROM jt JOIN ja USING (aln, i, j, a) JOIN jb USING (aln, i, j, b) JOIN js USING (aln, i, j) GROUP BY ALL)
, nc AS (SELECT aln, max(length(s)) AS n FROM a GROUP BY 1), mm AS (SELECT aln, i, sum(mi) / (any_value(n) - 1) AS m FROM (SELECT aln, i, mi FROM mi UNION ALL SELECT aln, j, mi FROM mi) JOIN nc USING (aln) GROUP BY ALL)
, mg AS (SELECT aln, 2 * sum(mi) / any_value(n * (n - 1)) AS g FROM mi JOIN nc USING (aln) GROUP BY 1)
, cp AS (SELECT mi.aln, mi.i, mi.j, mi, mi - coalesce(p.m * q.m / nullif(g, 0), 0) AS apc FROM mi JOIN mm p ON p.aln = mi.aln AND p.i = mi.i JOIN mm q ON q.aln = mi.aln AND q.i = mi.j JOIN mg ON mg.aln = mi.aln)
"""


@query(_ALN + _WEIGHTS + _COUPLED + "SELECT aln, i, j, round(mi, 5) AS mi, round(apc, 5) AS apc FROM (SELECT *, row_number() OVER (PARTITION BY aln ORDER BY round(apc, 6) DESC, i, j) AS k FROM cp) WHERE k <= 20")
def coupled_columns(spark, directory):
    """The 20 pairs of columns of each scaffold with the greatest product-corrected information, of all its columns."""
    out = columns.strongest(columns.coupled_pairs(_alignment(spark, directory)), 20)
    return out.select("aln", "i", "j", F.round("mi", 5).alias("mi"), F.round("apc", 5).alias("apc"))


@query()
def coupled_column_support(spark, directory):
    """How often a pair of columns is among its scaffold's three strongest over 5 reweighted resamplings of the rows."""
    top = columns.drawn_strongest(_alignment(spark, directory), 5, 20260731, 3)
    return top.groupBy(F.col("aln").alias("scaffold"), "i", "j").agg((F.count("*") / 5).alias("support"))


@query()
def permuted_maxima(spark, directory):
    """The greatest corrected information between the two halves of each scaffold's columns, after 3 permutations of the second."""
    half = F.floor(F.length("seq") / 2).cast("int")
    rows = materialize(_alignment(spark, directory), "alignment")
    cut = rows.groupBy("aln").agg(F.max(half).alias("half"))
    pairs = columns.coupled_pairs(columns.permuted_rows(rows, half, 3, 20260731))
    across = pairs.withColumn("scaffold", F.split_part("aln", F.lit("#"), F.lit(1))).join(cut.withColumnRenamed("aln", "scaffold"), "scaffold").where("i < half and j >= half")
    return across.groupBy("scaffold", F.split_part("aln", F.lit("#"), F.lit(2)).cast("int").alias("replicate")).agg(F.round(F.max("apc"), 6).alias("greatest"))


_MUT = "WITH v AS (SELECT DISTINCT variant_id, wt_sequence, mutation, full_mutant_sequence FROM variant_retrospective)"


@query(
    _MUT
    + r"""
, parts AS (SELECT variant_id, list_filter(regexp_split_to_array(coalesce(mutation, ''), '[,;|/&+\s"''\[\]]+'), lambda x: x <> '') AS p FROM v)
SELECT variant_id, len(p) AS changes, CASE WHEN len(p) > 0 AND len(list_filter(p, lambda x: NOT regexp_full_match(x, '(?:p\.)?[A-Z]\d+[A-Z]'))) = 0 THEN array_to_string(list_transform(p, lambda x: CAST(regexp_extract(x, '\d+') AS INTEGER) - 1), ',') END AS positions FROM parts
"""
)
def point_positions(spark, directory):
    """Positions (from 0) of variants that are point changes alone; null for others."""
    return variants.point_positions(read(spark, directory, "variant_retrospective").select("variant_id", "mutation").distinct())


_NAMES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in variants._THREE.items()) + "}"


@query(
    _MUT
    + rf"""
, a AS (SELECT variant_id, upper(regexp_replace(wt_sequence, '[^A-Za-z]', '', 'g')) AS w, upper(regexp_replace(full_mutant_sequence, '[^A-Za-z]', '', 'g')) AS g, list_filter(regexp_split_to_array(coalesce(mutation, ''), '[,;|/&+\s"''\[\]]+'), lambda x: x <> '') AS p FROM v)
, b AS (SELECT *, list_filter(p, lambda x: regexp_full_match(x, '(p\.)?([A-Z][a-z][a-z]|[A-Z])[0-9]+([A-Z][a-z][a-z]|[A-Z])')) AS pts, list_filter(p, lambda x: regexp_full_match(x, '(p\.)?del[0-9]+-[0-9]+')) AS del, list_filter(p, lambda x: regexp_full_match(x, '(p\.)?ins[0-9]+_[0-9]+:[A-Z]+')) AS ins FROM a)
, c AS (SELECT *, list_transform(pts, lambda x: {{'i': CAST(regexp_extract(x, '[0-9]+') AS INTEGER), 'o': regexp_extract(x, '^(?:p\.)?([A-Z][a-z]*)', 1), 'n': regexp_extract(x, '[0-9]([A-Z][a-z]*)$', 1)}}) AS pt0,
    list_transform(del, lambda x: {{'a': CAST(regexp_extract(x, 'del([0-9]+)', 1) AS INTEGER), 'b': CAST(regexp_extract(x, '-([0-9]+)', 1) AS INTEGER)}}) AS ct, list_transform(ins, lambda x: {{'a': CAST(regexp_extract(x, 'ins([0-9]+)', 1) AS INTEGER), 'b': CAST(regexp_extract(x, '_([0-9]+)', 1) AS INTEGER), 't': regexp_extract(x, ':([A-Z]+)', 1)}}) AS it FROM b)
, d AS (SELECT *, list_transform(pt0, lambda q: {{'i': q.i, 'o': coalesce(({_NAMES})[q.o], q.o), 'n': coalesce(({_NAMES})[q.n], q.n)}}) AS pt FROM c)
, e AS (SELECT *, CASE WHEN w IS NULL THEN 'no wild type' WHEN len(p) = 0 THEN 'no change' WHEN len(pts) + len(del) + len(ins) < len(p) THEN 'unsupported notation' WHEN len(list_filter(pt, lambda q: q.i < 1 OR q.i > length(w))) > 0 THEN 'place outside the sequence'
    WHEN len(list_filter(pt, lambda q: w[q.i] <> q.o)) > 0 THEN 'other residue at the place' WHEN len(list_filter(ct, lambda q: q.a < 1 OR q.a > q.b OR q.b > length(w))) > 0 THEN 'deletion outside the sequence' WHEN len(list_filter(it, lambda q: q.b <> q.a + 1 OR q.a > length(w))) > 0 THEN 'insertion between places that are no neighbours'
    WHEN (len(pt) < len(p) AND len(ct) < len(p) AND len(it) < len(p)) OR len(it) > 1 THEN 'kinds of change mixed' WHEN len(list_filter(range(1, length(w) + 1), lambda i: len(list_filter(ct, lambda q: i BETWEEN q.a AND q.b)) > 1)) > 0 THEN 'deletions overlap' END AS error FROM d)
, f AS (SELECT variant_id, g, error, CASE WHEN error IS NULL THEN CASE WHEN len(pt) > 0 THEN array_to_string(list_transform(range(1, length(w) + 1), lambda i: coalesce(list_filter(pt, lambda q: q.i = i)[-1].n, w[i])), '')
    WHEN len(ct) > 0 THEN array_to_string(list_transform(list_filter(range(1, length(w) + 1), lambda i: len(list_filter(ct, lambda q: i BETWEEN q.a AND q.b)) = 0), lambda i: w[i]), '') ELSE w[1:it[1].a] || it[1].t || w[it[1].a + 1:] END END AS mutant FROM e)
SELECT variant_id, mutant, error, mutant = g AS agrees FROM f
"""
)
def applied_mutations(spark, directory):
    """Each variant's mutant sequence by its notation, or why there is none, and whether the given one agrees."""
    keep = ["variant_id", "wt_sequence", "mutation", "full_mutant_sequence"]
    return variants.applied(read(spark, directory, "variant_retrospective").select(*keep).distinct())


QUERIES, SQL = catalog.queries, catalog.sql
