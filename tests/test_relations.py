import pytest
from pyspark.sql import functions as F

from strandloom.operators import columns
from strandloom.operators import relations as L


def test_gates_of_joins(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("a", "x"), (None, "y"), (None, "z")], "k string, w string")
    assert sorted((str(r.k), r.v, r.w) for r in L.many_to_one(left, right, ["k"]).collect()) == [("None", 3, None), ("a", 1, "x"), ("b", 2, None)]
    with pytest.raises(ValueError, match="stands 2 times"):
        L.many_to_one(left, right.unionByName(right.where("k = 'a'")), ["k"])
    with pytest.raises(ValueError, match="no partner"):
        L.complete_join(left.where("k is not null"), right, ["k"])
    assert L.complete_join(left.where("k = 'a'"), right, ["k"]).count() == 1 and L.complete_join(left.limit(0), right, ["k"]).count() == 0


def test_seeds(spark):
    df = spark.createDataFrame([(20260731, 0), (20260731, 1), (20260732, 1)], "b int, i int")
    assert sorted(r.s for r in df.select(L.proposal_seed(F.col("b"), F.col("i")).alias("s")).collect()) == [20260731, 21260731, 21260732]
    with pytest.raises(Exception, match="negative"):
        df.select(L.proposal_seed(F.col("b"), -F.col("i"))).collect()


def test_restored_and_projected(spark):
    df = spark.createDataFrame([("ACDE", "WWWWW", [3, 0, 9, -1, 0]), ("AC", "W", [1]), ("", "A", [0]), ("AC", "WW", None), (None, "A", [0])], "s string, p string, f array<int>")
    out = [tuple(r) for r in df.select(L.restored(F.col("s"), F.col("p"), F.col("f")).alias("r"), L.projected(F.col("s"), F.col("f")).alias("q")).collect()]
    assert out == [("WCDW", "AE"), ("AC", "C"), ("", ""), ("AC", None), (None, None)]


def test_numbers_of_the_author_or_an_alignment(spark):
    rows = [
        ("own", "ACDEFGHIK", "CDEG", [2, 3, 4, 6], [""] * 4),
        ("code", "ACDEFGHIK", "CDEGHIK", [2, 3, 4, 6, 7, 8, 9], ["", "", "", "A", "", "", ""]),
        ("twice", "ACDEFGHIK", "AC", [1, 1], ["", ""]),
        ("far", "AC", "AC", [1, 5], ["", ""]),
        ("other", "ACDEFGHIK", "DEFGHIK", [1, 2, 3, 4, 5, 6, 7], [""] * 7),
        ("null", None, "A", [1], [""]),
    ]
    out = {r.id: (r.strategy[:3], r.mapping) for r in L.numbered_residues(spark.createDataFrame(rows, "id string, reference string, sequence string, numbers array<int>, icodes array<string>")).collect()}
    assert out == {"own": ("val", [1, 2, 3, 5]), "code": ("glo", [1, 2, 3, 5, 6, 7, 8]), "twice": ("glo", [0, 1]), "far": ("glo", [0, 1]), "other": ("glo", [2, 3, 4, 5, 6, 7, 8]), "null": ("glo", None)}


def test_slots_and_problems(spark):
    residues = spark.createDataFrame([("A", 5, ""), ("A", 7, "B"), ("A", 7, ""), ("A", 8, None), ("B", 1, "")], "chain string, number int, icode string")
    assert sorted((r.chain, r.number, r.icode, r.slot) for r in L.chain_slots(residues).collect()) == [("A", 5, "", 0), ("A", 7, "", 2), ("A", 7, "B", 3), ("A", 8, "", 4), ("B", 1, "", 0)]
    rows = [("a", "ACD", "ACE", [0], False, 3), ("", "", "A", None, False, 0), ("c", "AXD", "AC", [1, 9], True, 1), ("d", "AC", "AC", None, None, None), ("e", "AC", None, [0], True, 0)]
    df = spark.createDataFrame(rows, "candidate_id string, sequence string, parent_sequence string, fixed_positions array<int>, is_mock boolean, evidence_level int")
    assert {r.candidate_id: r.problems for r in L.request_problems(df).collect()} == {
        "": ["no_id", "no_sequence", "length_differs_from_parent"],
        "c": ["noncanonical_amino_acid", "length_differs_from_parent", "fixed_position_outside", "fixed_position_changed", "mock_with_evidence"],
        "e": ["length_differs_from_parent", "fixed_position_outside"],
    }


@pytest.mark.parametrize("block_rows", [1000, 2])
def test_extremes_of_pairs(spark, block_rows):
    df = spark.createDataFrame([("m", "1", "AC-E"), ("m", "2", "AC-E"), ("m", "3", "AWDD"), ("m", "4", "----"), ("one", "1", "A")], "aln string, row_id string, seq string")
    out = {r.aln: (r.pairs, r.least, r.mean, r.most) for r in columns.pair_extremes(df, block_rows).collect()}
    assert out["m"] == (6, 0.0, pytest.approx((1 + 2 / 3) / 6), 1.0) and out["one"] == (0, None, None, None)
