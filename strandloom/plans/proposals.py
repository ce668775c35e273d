"""Queries of alignments with the parent, profiles, draws and exposure."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions.sequence import AMINO_ACIDS
from strandloom.operators import generate, geometry, pairwise
from strandloom.plans.catalog import Catalog
from strandloom.plans.relational import _POINTS, _points
from strandloom.plans.sequences import _ALN, _C, _alignment, _designs

catalog = Catalog()
query = catalog.query
_HASH = "CAST('0x' || sha256({})[1:16] AS UBIGINT)"


@query()
def parent_alignments(spark, directory):
    """Every design aligned with its parent, also where lengths differ."""
    return pairwise.aligned_pairs(_designs(spark, directory), "candidate_id", "s", "p").select("candidate_id", "aligned", "same", F.round("identity", 6).alias("identity"))


_FREQ = ", tc AS (SELECT aln, col, token, count(*) AS n FROM cell GROUP BY ALL), fr AS (SELECT aln, col, token, n / sum(n) OVER (PARTITION BY aln, col) AS f FROM tc)"


@query(_ALN + _FREQ + "SELECT aln, row_id, round(sum(ln(greatest(f, 0.001))), 4) AS total, round(avg(ln(greatest(f, 0.001))), 6) AS mean, round(exp(-avg(ln(greatest(f, 0.001)))), 5) AS perplexity FROM cell JOIN fr USING (aln, col, token) GROUP BY ALL")
def design_scores(spark, directory):
    """Log-likelihood and perplexity of each design under its scaffold's profile."""
    rows = _alignment(spark, directory)
    out = generate.profile_scores(rows, generate.profile(rows))
    return out.select("aln", "row_id", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), F.round("perplexity", 5).alias("perplexity"))


@query(
    _ALN
    + _FREQ
    + f"""
, st AS (SELECT aln, col, token, sum(f) OVER (PARTITION BY aln, col ORDER BY token) AS top FROM fr)
, dr AS (SELECT aln, col, sample, {_HASH.format("'7:' || aln || ':' || sample || ':' || col")}::DOUBLE / 18446744073709551616.0 AS u FROM (SELECT DISTINCT aln, col FROM fr), (SELECT unnest(range(3)) AS sample))
, pk AS (SELECT aln, sample, col, coalesce(arg_min(token, top) FILTER (top - 1e-12 > u), arg_max(token, top)) AS token FROM dr JOIN st USING (aln, col) GROUP BY ALL)
SELECT aln, CAST(sample AS INTEGER) AS sample, string_agg(token, '' ORDER BY col) AS seq FROM pk GROUP BY aln, sample
"""
)
def profile_samples(spark, directory):
    """Three sequences a scaffold, drawn from its profile."""
    return generate.profile_samples(generate.profile(_alignment(spark, directory)), 3, 7)


@query(
    _C
    + f"""
, x AS (SELECT candidate_id, fixed_positions, s, unnest(range(length(s))) AS i FROM c WHERE s <> '')
, y AS (SELECT candidate_id, i, s[i + 1] AS t, replace('{AMINO_ACIDS}', s[i + 1], '') AS o, {_HASH.format("'if:7:' || candidate_id || ':' || i")}::DOUBLE / 18446744073709551616.0 < 0.1 AND NOT list_contains(coalesce(fixed_positions, []), CAST(i AS INTEGER)) AS turn, {_HASH.format("'to:7:' || candidate_id || ':' || i")} AS h FROM x)
SELECT candidate_id, string_agg(CASE WHEN turn THEN o[CAST(h % length(o) AS BIGINT) + 1] ELSE t END, '' ORDER BY i) AS mutant, CAST(count(*) FILTER (turn) AS INTEGER) AS changed FROM y GROUP BY 1
"""
)
def random_mutants(spark, directory):
    """Each design with a tenth of its free places changed at random, by hash."""
    return generate.random_mutants(_designs(spark, directory).where("s <> ''"), "candidate_id", "s", 0.1, 7, "fixed_positions")


@query(
    _POINTS
    + """
, k AS (SELECT unnest(range(100)) + 0.5 AS k), d AS (SELECT acos(1 - 2 * k / 100) AS t, pi() * (1 + sqrt(5.0)) * k AS u FROM k), f AS (SELECT vec_id, x + 1.4 * cos(u) * sin(t) AS x, y + 1.4 * sin(u) * sin(t) AS y, z + 1.4 * cos(t) AS z FROM a, d)
, e AS (SELECT f.vec_id, f.x, f.y, f.z, count(o.vec_id) = 0 AS free FROM f LEFT JOIN a o ON o.vec_id <> f.vec_id AND abs(o.x - f.x) < 1.4 AND (o.x - f.x) ** 2 + (o.y - f.y) ** 2 + (o.z - f.z) ** 2 < 1.4 ** 2 GROUP BY ALL)
SELECT vec_id AS id, round(avg(CASE WHEN free THEN 1.0 ELSE 0.0 END), 6) AS exposed, round(4 * pi() * 1.4 ** 2 * avg(CASE WHEN free THEN 1.0 ELSE 0.0 END), 6) AS area FROM e GROUP BY 1
"""
)
def exposed_points(spark, directory):
    """How much of each point's sphere the other points leave free."""
    atoms = _points(spark, directory).select(F.col("vec_id").alias("id"), "x", "y", "z", F.lit(1.0).alias("radius"))
    out = geometry.exposed_parts(atoms, probe=0.4)
    return out.select("id", F.round("exposed", 6).alias("exposed"), F.round("area", 6).alias("area"))


QUERIES, SQL = catalog.queries, catalog.sql
