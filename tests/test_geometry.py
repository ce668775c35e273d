import math
import random

import pytest

from strandloom.operators import geometry as G
from strandloom.operators.graph import components
from strandloom.operators.skew import spread_join


def test_contacts_match_all_distances(spark):
    rng = random.Random(1)
    point = lambda: tuple(rng.uniform(-10, 10) for _ in range(3))
    protein, rna = [(i, i // 4, *point()) for i in range(80)], [(i, "RS"[i % 2], *point()) for i in range(60)]
    p = spark.createDataFrame(protein, "id int, residue int, x double, y double, z double")
    r = spark.createDataFrame([*rna, (99, "N", None, 0.0, 0.0)], "id int, chain string, x double, y double, z double")
    got = {x.residue: x for x in G.contacts(p, r, 3.0, 5.0).collect()}
    for residue in range(20):
        d = [(math.dist(a[2:], b[2:]), b[1]) for a in protein if a[1] == residue for b in rna]
        least = min(d)[0]
        told = got[residue]
        assert told.direct == (least <= 3) and told.second_shell == (3 < least <= 5)
        assert told.least_distance == (pytest.approx(least, abs=1e-6) if least <= 5 else None)
        assert told.chains == sorted({c for x, c in d if x <= 3})


def test_chain_breaks(spark):
    rows = [("A", 1, 0.0, 0.0, 0.0), ("A", 2, 3.8, 0.0, 0.0), ("A", 5, 13.8, 0.0, 0.0), ("B", 6, 99.0, 0.0, 0.0)]
    assert [tuple(r) for r in G.chain_breaks(spark.createDataFrame(rows, "chain string, number int, x double, y double, z double"), 4.5).collect()] == [("A", 2, 5, 10.0)]


def test_pareto_front_with_ties_and_nulls(spark):
    rng = random.Random(2)
    rows = [(f"k{i}", rng.randrange(12), float(rng.randrange(12))) for i in range(300)] + [("null", None, 1.0), ("nan", 5, float("nan"))]
    df = spark.createDataFrame(rows, "id string, hi int, lo double").repartition(5)
    good = [r for r in rows if r[1] is not None and r[2] == r[2]]
    wanted = {r[0] for r in good if not any(q[1] >= r[1] and q[2] <= r[2] and (q[1] > r[1] or q[2] < r[2]) for q in good)}
    assert {r.id for r in G.pareto_front(df, "id", "hi", "lo").collect()} == wanted
    assert G.pareto_front(df.limit(0), "id", "hi", "lo").count() == 0


def test_superposition(spark):
    rng = random.Random(3)
    points = [tuple(rng.uniform(-5, 5) for _ in range(3)) for _ in range(10)]
    c, s = math.cos(0.7), math.sin(0.7)
    turned = [("same", x, y, z, c * x - s * y + 4, s * x + c * y - 2, z + 1) for x, y, z in points]
    mirrored = [("mirror", x, y, z, -x, y, z) for x, y, z in points]
    few = [("few", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)]
    out = {r.g: r.rmsd for r in G.superposed_rmsd(spark.createDataFrame(turned + mirrored + few, "g string, x double, y double, z double, u double, v double, w double"), ["g"]).collect()}
    assert out["same"] == pytest.approx(0, abs=1e-4) and out["mirror"] > 0.5 and out["few"] is None


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (105, 103), (103, 104), (7, 7)]
    out = {r.id: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {out[i] for i in range(61)} == {0} and out[101] == 100 and {out[i] for i in (103, 104, 105)} == {103}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spread_join_keeps_every_row(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, -1)], "key string, v int")
    groups = rows.where("key is not null").groupBy("key").count().withColumnRenamed("count", "n")
    for least in (1, 100, 10_000):
        out = spread_join(rows, groups, "key", "n", least=least, spread=8).collect()
        assert sorted(r.v for r in out) == list(range(300)) and all(r.n == (200 if r.key == "hot" else 1) for r in out)
