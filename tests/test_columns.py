import math
import random

import pytest

from strandloom.operators import columns

ALN = "aln string, row_id string, seq string"
MSA = [("m", "1", "ACDEFG"), ("m", "2", "ACDEYG"), ("m", "3", "AC-EYG"), ("m", "4", "VC-EYG")]


def equal_weights(df):
    return df.selectExpr("aln", "row_id", "1.0D as weight")


def test_conservation_of_the_small_alignment(spark):
    df = spark.createDataFrame(MSA, ALN)
    out = {r.column: r for r in columns.conservation(df, equal_weights(df)).collect()}
    assert out[0].conservation == 0.75 and out[0].consensus == "A" and out[2].gap_fraction == 0.5 and out[1].entropy == 0 and out[4].allowed_tokens == "FY"
    assert out[2].coverage == 0.5 and out[0].plain_frequencies == {"A": 0.75, "V": 0.25} and out[4].frequencies == {"F": 0.25, "Y": 0.75}
    weighted = {r.column: r for r in columns.conservation(df, columns.row_weights(df)).collect()}
    assert len(weighted) == 6 and all(r.effective_rows > 0 for r in weighted.values())


def test_gap_only_column_and_ties(spark):
    df = spark.createDataFrame([("m", "1", "-A"), ("m", "2", "-C")], ALN)
    out = {r.column: r for r in columns.conservation(df, equal_weights(df)).collect()}
    assert out[0].consensus is None and out[0].conservation == 0 and out[0].gap_fraction == 1 and out[1].consensus == "A"


@pytest.mark.parametrize("block_rows", [1000, 7])
def test_row_weights_match_brute_force(spark, block_rows):
    rng = random.Random(1)
    base = [rng.choice("ACDE-") for _ in range(40)]
    rows = [("m" if i % 3 else "n", f"r{i}", "".join(rng.choice("ACDE-") if rng.random() < 0.15 else c for c in base)) for i in range(60)]

    def identity(a, b):
        both = [(x, y) for x, y in zip(a, b) if "-" not in (x, y)]
        return sum(x == y for x, y in both) / len(both) if both else 0

    got = {(r.aln, r.row_id): r.weight for r in columns.row_weights(spark.createDataFrame(rows, ALN), 0.8, block_rows).collect()}
    for aln, key, seq in rows:
        near = sum(identity(seq, s) >= 0.8 for a, _, s in rows if a == aln)
        assert got[aln, key] == pytest.approx(1 / near)


def test_mean_pairwise_identity(spark):
    out = columns.mean_pairwise_identity(spark.createDataFrame([("m", "1", "AC"), ("m", "2", "AD"), ("m", "3", "AC"), ("one", "1", "AC")], ALN)).orderBy("aln").collect()
    assert [r.mean_identity for r in out] == [round((2 * 0.5 + 1) / 3, 6), None]


def plain_information(rows, weights, i, j, pseudocount):
    joint = {}
    for seq, w in zip(rows, weights):
        if "-" not in (seq[i], seq[j]):
            joint[seq[i], seq[j]] = joint.get((seq[i], seq[j]), 0) + w
    left, right = {a for a, _ in joint}, {b for _, b in joint}
    joint = {(a, b): joint.get((a, b), 0) + pseudocount for a in left for b in right}
    total = sum(joint.values())
    if not total:
        return 0.0
    p = {k: v / total for k, v in joint.items()}
    pa, pb = {a: sum(v for (x, _), v in p.items() if x == a) for a in left}, {b: sum(v for (_, y), v in p.items() if y == b) for b in right}
    return sum(v * math.log(v / (pa[a] * pb[b])) for (a, b), v in p.items() if v)


@pytest.mark.parametrize("pseudocount,part_rows", [(0.0, 20_000), (0.5, 20_000), (0.0, 9), (0.5, 9)])
def test_information_of_all_columns(spark, pseudocount, part_rows):
    rng = random.Random(3)
    made = {"m": [[rng.choice("ACD-") for _ in range(9)] for _ in range(25)], "pair": [list("AC" if i % 2 else "GU") for i in range(6)], "one": [list("ACD")]}
    for row in made["m"]:
        row[5], row[7] = row[1], "W"  # a copy and a column of one token
    rows = [(aln, str(i), "".join(r)) for aln, all_ in made.items() for i, r in enumerate(all_)]
    weights = {(aln, i): 1 / (1 + int(i) % 3) for aln, i, _ in rows}
    w = spark.createDataFrame([(*k, v) for k, v in weights.items()], "aln string, row_id string, weight double")
    got = {(r.aln, r.i, r.j): r.mi for r in columns.pair_information(spark.createDataFrame(rows, ALN), w, pseudocount, 4, part_rows).collect()}
    for aln, all_ in made.items():
        seqs, n = ["".join(r) for r in all_], len(all_[0])
        for i in range(n):
            for j in range(i + 1, n):
                wanted = plain_information(seqs, [weights[aln, str(k)] for k in range(len(seqs))], i, j, pseudocount)
                assert got.get((aln, i, j), 0) == pytest.approx(wanted, abs=1e-9)
    assert not [k for k in got if 7 in k[1:] and k[0] == "m"] and (pseudocount or got["pair", 0, 1] == pytest.approx(plain_information(["AC", "GU"] * 3, [weights["pair", str(k)] for k in (1, 0, 3, 2, 5, 4)], 0, 1, 0)))


def test_product_correction_over_all_columns(spark):
    mi = {(0, 1): 0.4, (0, 3): 0.2, (1, 3): 0.1}  # column 2 has one token
    pairs = spark.createDataFrame([("m", *k, v) for k, v in mi.items()] + [("zero", 0, 1, 0.0)], "aln string, i int, j int, mi double")
    out = {(r.aln, r.i, r.j): r.apc for r in columns.product_correction(pairs, spark.createDataFrame([("m", 4), ("zero", 2)], "aln string, columns long")).collect()}
    mean = {c: sum(v for k, v in mi.items() if c in k) / 3 for c in range(4)}
    whole = 2 * sum(mi.values()) / 12
    assert all(out["m", i, j] == pytest.approx(v - mean[i] * mean[j] / whole) for (i, j), v in mi.items()) and out["zero", 0, 1] == 0


def test_strongest_pairs_and_permutations(spark):
    df = spark.createDataFrame([("m", str(i), s) for i, s in enumerate(["AAAACG"] * 3 + ["CCCGUA"] * 3)], ALN)
    top = columns.strongest(columns.coupled_pairs(df), 4).collect()
    assert len(top) == 4 and all(r.mi == pytest.approx(math.log(2)) for r in top)
    draw = lambda d: sorted(tuple(r) for r in columns.permuted_rows(d, columns.F.lit(3), 4, 7).collect())
    got = draw(df.repartition(5))
    assert got == draw(df.repartition(1)) and len(got) == 24 and {a for a, _, _ in got} == {f"m#{i}" for i in range(4)}
    assert all(sorted(s[:3] for a, _, s in got if a == f"m#{i}") == ["AAA"] * 3 + ["CCC"] * 3 and sorted(s[3:] for a, _, s in got if a == f"m#{i}") == ["ACG"] * 3 + ["GUA"] * 3 for i in range(4))


def test_index_and_checks(spark):
    df = spark.createDataFrame([("m", "1", "AC-DE"), ("m", "2", "ACNDE"), ("bad", "1", "A"), ("bad", "2", "AC"), ("few", "1", "A")], ALN)
    index = [(r["index"], r["column"]) for r in columns.ungapped_index(df).where("aln = 'm' and row_id = '1'").orderBy("index").collect()]
    assert index == [(0, 0), (1, 1), (2, 3), (3, 4)]
    assert sorted(tuple(r) for r in columns.check_alignment(df).collect()) == [("bad", "unequal_lengths"), ("few", "fewer_than_two_rows")]


def test_drawn_rows_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(MSA, ALN)
    draw = lambda d: sorted(tuple(r) for r in columns.drawn_rows(d, 3, 7).collect())
    assert draw(df.repartition(1)) == draw(df.repartition(7)) and len(draw(df)) == 3 * 4


def drawn_alignments():
    rng = random.Random(5)
    made = {"gaps": [[rng.choice("AACD-") for _ in range(9)] for _ in range(24)], "odd#1": [[rng.choice("ACDEFGHIKL") if rng.random() < 0.3 else "W" for _ in range(11)] for _ in range(17)], "ties": [list("AC" if i % 2 else "GU") for i in range(6)], "one": [list("ACD")], "same": [list("ACD")] * 3}
    for row in made["gaps"]:
        row[5], row[7] = row[1], "W"
    return [(aln, f"{i:02d}", "".join(r)) for aln, all_ in made.items() for i, r in enumerate(all_)] + [("empty", "1", ""), ("empty", "2", "")]


@pytest.mark.parametrize("bounds", [{}, {"letters": 100}, {"long": 0}, {"wide": 10}])
def test_strongest_of_drawn_rows_as_of_all_their_pairs(spark, bounds):
    df = spark.createDataFrame(drawn_alignments(), ALN)
    wanted = {(r.aln, r.i, r.j): r for r in columns.strongest(columns.coupled_pairs(columns.drawn_rows(df, 3, 7)), 4).collect()}
    out = columns.drawn_strongest(df, 3, 7, 4, **bounds).collect()
    got = {(f"{r.aln}#{r.replicate}", r.i, r.j): r for r in out}
    assert len(out) == len(got) > 20 and set(got) == set(wanted)
    assert all((r.mi, r.apc) == (pytest.approx(wanted[k].mi, abs=1e-12), pytest.approx(wanted[k].apc, abs=1e-12)) for k, r in got.items())


def test_support_writes_rows_not_pairs_of_columns(spark, monkeypatch):
    from strandloom.plans import sequences

    rng = random.Random(6)
    df = spark.createDataFrame([("m", str(i), "".join(rng.choice("ACDE") for _ in range(60))) for i in range(8)], ALN)
    written = []
    keep = columns.materialize
    monkeypatch.setattr(columns, "materialize", lambda d, name: written.append((name, d.count())) or keep(d, name))
    monkeypatch.setattr(sequences, "_alignment", lambda *_: df)
    assert sequences.coupled_column_support(spark, "").count() > 0
    assert written and sum(n for _, n in written) <= 2 * 8  # there are 1,770 pairs of columns in each of 5 replicates
