import math
import random

import pytest

from strandloom.operators import generate, geometry, pairwise


def score(first, second, mapping):
    """The score of an alignment given by its map, in the doubled units."""
    total, last, partners = 0, -1, []
    for i, j in enumerate(mapping):
        if j is not None:
            total += pairwise.MATCH if first[i] == second[j] else pairwise.MISMATCH
            partners.append((i, j))
    ends = [(-1, -1), *partners, (len(first), len(second))]
    for (i, j), (k, m) in zip(ends, ends[1:]):
        for gap in (k - i - 1, m - j - 1):
            if gap:
                total += pairwise.OPEN + pairwise.EXTEND * (gap - 1)
    return total


def best(first, second):
    low = -(10**9)
    n, m = len(first), len(second)
    d = [[[low] * 3 for _ in range(m + 1)] for _ in range(n + 1)]
    d[0][0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                d[i][j][0] = max(d[i - 1][j - 1]) + (pairwise.MATCH if first[i - 1] == second[j - 1] else pairwise.MISMATCH)
            if i:
                d[i][j][1] = max(d[i - 1][j][0] + pairwise.OPEN, d[i - 1][j][2] + pairwise.OPEN, d[i - 1][j][1] + pairwise.EXTEND)
            if j:
                d[i][j][2] = max(d[i][j - 1][0] + pairwise.OPEN, d[i][j - 1][1] + pairwise.OPEN, d[i][j - 1][2] + pairwise.EXTEND)
    return max(d[n][m])


def test_maps_are_best_alignments():
    assert pairwise.index_map("CDEGHIK", "ACDEFGHIK") == [1, 2, 3, 5, 6, 7, 8]
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("ACD") for _ in range(rng.randrange(12))) for _ in range(2))
        mapping = pairwise.index_map(a, b)
        held = [j for j in mapping if j is not None]
        assert held == sorted(set(held)) and (score(a, b, mapping) == best(a, b) or not (a or b))


def test_aligned_pairs(spark):
    rows = [("a", "ACDE", "ACE"), ("b", "ACDE", "ACNE"), ("n", None, "A"), ("e", "", "A"), ("s", "ACDE", "ACDE")]
    out = {r.k: r for r in pairwise.aligned_pairs(spark.createDataFrame(rows, "k string, x string, y string"), "k", "x", "y").collect()}
    assert out["a"].identity == 1 and out["a"].aligned == 3 and out["b"].identity == 0.75 and out["n"].identity is None and out["e"].identity == 0 and out["s"].mapping == [0, 1, 2, 3]


def test_pairs_of_one_length_are_aligned_too(spark):
    rng = random.Random(2)
    rows = []
    for k in range(120):
        a = [rng.choice("ACDEFGH") for _ in range(rng.randrange(2, 60))]
        b = list(a)
        for _ in range(rng.randrange(6)):
            b[rng.randrange(len(b))] = rng.choice("ACDEFGH")
        if k % 2:
            del b[rng.randrange(len(b))]
            b.insert(rng.randrange(len(b) + 1), rng.choice("ACDEFGH"))
        rows.append((str(k), "".join(a), "".join(b)))
    out = {r.k: r for r in pairwise.aligned_pairs(spark.createDataFrame(rows, "k string, x string, y string"), "k", "x", "y").collect()}
    gapped = 0
    for k, a, b in rows:
        assert out[k].mapping == pairwise.index_map(a, b) and score(a, b, out[k].mapping) == best(a, b)
        gapped += 2 * sum(map(str.__eq__, a, b)) >= len(a) and None in out[k].mapping
    assert gapped


def test_draws(spark):
    rows = spark.createDataFrame([("m", str(i), "AC" if i % 2 else "AD") for i in range(10)], "aln string, row_id string, seq string")
    samples = [r.seq for r in generate.profile_samples(generate.profile(rows), 200, 1).collect()]
    assert set(samples) == {"AC", "AD"} and 60 < samples.count("AC") < 140
    (scored,) = generate.profile_scores(rows.limit(1), generate.profile(rows)).collect()
    assert scored.total == pytest.approx(math.log(0.5)) and scored.perplexity == pytest.approx(2**0.5)
    df = spark.createDataFrame([("a", "ACDEFGHIKL" * 20, [0, 1]), ("e", "", None), ("n", None, None)], "k string, s string, fixed array<int>")
    out = {r.k: r for r in generate.random_mutants(df, "k", "s", 0.3, 5, "fixed").collect()}
    mutant = out["a"].mutant
    assert mutant.startswith("AC") and len(mutant) == 200 and 35 < out["a"].changed < 90 and out["a"].changed == sum(x != y for x, y in zip(mutant, "ACDEFGHIKL" * 20))
    assert out["e"].mutant == "" and out["n"].changed is None


def test_exposure_of_one_and_two_spheres(spark):
    far = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0), (2, 50.0, 0.0, 0.0, 1.0)], "id int, x double, y double, z double, radius double")
    assert [r.exposed for r in geometry.exposed_parts(far, 0.5).collect()] == [1.0, 1.0]
    near = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0), (2, 1.5, 0.0, 0.0, 1.0)], "id int, x double, y double, z double, radius double")
    for r in geometry.exposed_parts(near, 0.5, 2000).collect():
        assert r.exposed == pytest.approx((1 + 0.75 / 1.5) / 2, abs=0.01)
