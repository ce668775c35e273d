import pytest

from strandloom.operators import cohorts as C


def test_closest_in_box(spark):
    rows = [("a", "x", 0.2), ("a", "y", 0.5), ("a", "z", 0.7), ("a", "n", None), ("b", "o", 0.95), ("a", "t", 0.7)]
    df = spark.createDataFrame(rows, "g string, id string, v double")
    out = {r.id: r.status for r in C.closest_in_box(df, ["g"], "id", "v", 0.3, 0.9, 0.6).collect()}
    assert out == {"x": "outside_box", "y": "not_closest", "z": "not_closest", "t": "selected", "n": "no_value", "o": "outside_box"}


def test_sign_flips_and_adjustment(spark):
    rows = [("m", 1, 1.0), ("m", 2, 2.0), ("m", 3, None), ("k", 1, 0.0)]
    out = {r.g: r for r in C.sign_flip_p(spark.createDataFrame(rows, "g string, unit int, d double"), ["g"]).collect()}
    assert (out["m"].pairs, out["m"].mean_difference, out["m"].p_value) == (2, 1.5, 0.5) and out["k"].p_value == 1
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.2), ("d", None)], "t string, p double")
    got = {r.t: r.q for r in C.benjamini_hochberg(tests, "p", "q").collect()}
    assert got["a"] == pytest.approx(0.03) and got["b"] == pytest.approx(0.06) and got["c"] == pytest.approx(0.2) and got["d"] is None


def test_ranks_and_guarded_correlation(spark):
    df = spark.createDataFrame([("g", 3.0, 1.0), ("g", 1.0, 1.0), ("g", 3.0, 1.0), ("g", None, 1.0), (None, 5.0, 1.0)], "g string, v double, w double")
    ranks = sorted((str(r.g), str(r.v), r.k) for r in C.average_ranks(df, ["g"], "v", "k").collect())
    assert ranks == [("None", "5.0", 0.0), ("g", "1.0", 0.0), ("g", "3.0", 1.5), ("g", "3.0", 1.5), ("g", "None", None)]
    assert df.groupBy("g").agg(C.guarded_correlation("v", "w").alias("c")).where("g = 'g'").first().c is None


def test_state_aggregates(spark):
    scores = spark.createDataFrame([("a", "x", -1.0), ("a", "y", -1.0), ("b", "x", 0.0), ("b", "y", 2.0), ("c", "x", 1.0)], "id string, state string, score double")
    weights = spark.createDataFrame([("x", 2.0), ("y", 2.0)], "state string, weight double")
    out = {r.id: (r.weighted_mean, r.least, r.variance) for r in C.state_aggregates(scores, weights).collect()}
    assert out == {"a": (-1.0, -1.0, 0.0), "b": (1.0, 0.0, 1.0)}


def test_masks(spark):
    rows = [("s", "x", 0), ("s", "x", 1), ("s", "y", 0), ("s", "y", 2), ("one", "x", 5)]
    out = {(r.scaffold, r.position): r.kind for r in C.mask_kinds(spark.createDataFrame(rows, "scaffold string, state string, position int")).collect()}
    assert out == {("s", 0): "intersection", ("s", 1): "variable", ("s", 2): "variable", ("one", 5): "intersection"}


def test_consensus_meets_the_target(spark):
    (r,) = C.consensus(spark.createDataFrame([("p", "A" * 10, "AACCCCCCCC", "CCADDDDDDD")], "pair_id string, parent string, first string, second string"), 0.2).collect()
    assert r.matches == 2 and r.sequence.count("A") == 2 and r.kept == 2 and len(r.sequence) == 10
    (same,) = C.consensus(spark.createDataFrame([("p", "AAAA", "ACCA", "ACCA")], "pair_id string, parent string, first string, second string"), 0.9).collect()
    assert same.sequence == "ACCA" and same.agreement == 1 and same.kept == 0


def test_bootstrap_is_the_same_on_any_partitioning(spark):
    df = spark.createDataFrame([("g", i, float(i)) for i in range(8)] + [("one", 1, 3.0)], "g string, unit int, x double")
    got = [sorted(tuple(r) for r in C.bootstrap_means(df.repartition(n), ["g"], 50, 3).collect()) for n in (1, 6)]
    assert got[0] == got[1] and got[0][1][1:] == (1, 3.0, 3.0, 3.0) and got[0][0][3] <= 3.5 <= got[0][0][4]


def test_every_design_with_a_counterpart_is_merged(spark, tmp_path):
    from strandloom.plans import cohorts as plans

    designs = [("a1", "mpnn_plain"), ("a2", "mpnn_plain"), ("a2", "mpnn_plain"), ("a3", "mpnn_plain"), ("b1", "mpnn_ligand"), ("b2", "mpnn_ligand"), ("c1", "other"), ("c2", "other")]
    residue = {"a1": "C", "a2": "D", "a3": "E", "b1": "C", "b2": "D", "c1": "F", "c2": "F"}
    rows = [(k, m, "s", 1, [0], 0, residue[k] * 4, "AAAA") for k, m in designs]
    schema = "candidate_id string, method string, scaffold_id string, seed int, fixed_positions array<int>, fixed_position_violations int, sequence string, parent_sequence string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "candidates.parquet"))
    found = {r.pair_id: (r.agreement, r.sequence.replace("A", "")) for r in plans.design_consensus(spark, str(tmp_path)).collect()}
    assert {k: (a, set(s)) for k, (a, s) in found.items()} == {"s/1": (1.0, {"C"}), "s/1#2": (1.0, {"D"})}


def flips(d):
    from itertools import product

    return sum(abs(sum(s * x for s, x in zip(signs, d))) >= abs(sum(d)) - 1e-12 for signs in product((1, -1), repeat=len(d))) / 2 ** len(d)


def test_sign_flips_of_many_pairs(spark, monkeypatch):
    import math
    import random

    rng = random.Random(1)
    d = {"a": [rng.gauss(0.4, 1) for _ in range(17)], "b": [rng.gauss(0, 1) for _ in range(6)], "c": [1.0] * 60, "zero": [0.0] * 50, None: [1.0, 2.0]}
    df = spark.createDataFrame([(g, i, x) for g, v in d.items() for i, x in enumerate(v)], "g string, unit int, d double")
    out = {r.g: r for r in C.sign_flip_p(df, ["g"]).collect()}
    assert out["a"].p_value == pytest.approx(flips(d["a"]), abs=1e-9) and out["b"].p_value == pytest.approx(flips(d["b"])) and out[None].p_value == 0.5
    assert out["c"].pairs == 60 and out["c"].p_value == pytest.approx(2 / 2**60, abs=1e-12) and out["zero"].p_value == 1
    ten = [1.0] * 40 + [-1.0] * 20
    (r,) = C.sign_flip_p(spark.createDataFrame([("k", i, x) for i, x in enumerate(ten)], "g string, unit int, d double"), ["g"]).collect()
    wanted = sum(math.comb(60, k) for k in range(61) if abs(60 - 2 * k) >= 20) / 2**60
    assert r.p_value == pytest.approx(wanted, abs=1e-6)
    monkeypatch.setattr(C, "HALVES", 3)
    grid = {r.g: r for r in C.sign_flip_p(df, ["g"]).collect()}
    assert grid["a"].p_value == pytest.approx(flips(d["a"]), abs=1e-3)


def test_rank_agreement_of_constant_states(spark):
    df = spark.createDataFrame([("same", 1.0, 1.0), ("same", 1.0, 1.0), ("flat", 1.0, 0.0), ("flat", 1.0, 2.0), ("back", 0.0, 1.0), ("back", 1.0, 0.0)], "g string, x double, y double")
    out = {r.g: r.c for r in df.groupBy("g").agg(C.rank_agreement("x", "y").alias("c")).collect()}
    assert out == {"same": 1.0, "flat": 0.0, "back": pytest.approx(-1.0)}


def test_consensus_takes_given_confidences(spark):
    rows = [("p", "AAAA", "CCAC", "DDDA", [0.9, 0.1, 0.5, 0.5], [0.1, 0.9, 0.2, 0.6])]
    df = spark.createDataFrame(rows, "pair_id string, parent string, first string, second string, first_confidence array<double>, second_confidence array<double>")
    (low,) = C.consensus(df, 0.0).collect()
    (high,) = C.consensus(df, 0.25).collect()
    assert low.sequence == "CDDC" and high.sequence == "CDAC" and high.kept == 1
