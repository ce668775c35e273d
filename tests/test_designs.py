import math

import pytest
from pyspark.sql import functions as F

from strandloom.operators import designs as D
from strandloom.operators import states as T

DESIGN = "candidate_id string, scaffold_id string, s string, p string, fixed_positions array<int>"


def test_metrics_of_small_sequences(spark):
    rows = [("a", "x", "ACDF", "ACDE", [0, 1]), ("b", "x", "AAAACD", "AAAACD", None), ("c", "x", "KRDE", "AC", [0, 1, 2, 3]), ("d", "x", "AAAA", "CCCC", []), ("e", "x", "", "", []), ("f", "x", None, "A", []), ("g", "x", "A" * 12 + "CDEFGHIKLMNP", "CDEFGHIKLMNP" * 2, [99, -1, None])]
    out = {r.candidate_id: r for r in D.design_metrics(spark.createDataFrame(rows, DESIGN), "candidate_id", "s", "p", "fixed_positions").collect()}
    assert (out["a"].parent_identity, out["a"].designed_identity, out["a"].same) == (0.75, 0.5, 3) and out["a"].designed_entropy == pytest.approx(math.log(2))
    assert out["b"].homopolymer == 4 and out["b"].designed_identity is None and out["b"].parent_identity == 1
    assert out["c"].net_charge == 0 and out["c"].parent_identity is None and out["c"].designed_entropy is None and out["c"].entropy == pytest.approx(math.log(4))
    assert out["d"].composition_deviation == 1 and out["d"].hydrophobicity == 1 and out["d"].designed_identity == 0
    assert out["e"].homopolymer == 0 and out["e"].entropy is None and out["f"].residues is None and out["f"].windows is None
    assert out["g"].windows == 8 and out["g"].new_windows == 8 and out["g"].designed_identity == out["g"].parent_identity


def test_novelty_gate_names_all_reasons_in_order(spark):
    rows = [("good", "x", "ACDEFGHIKLMNPQRSTVWY", "ACDEFGHIKLYWVTSRQPNM", []), ("bad", "x", "AAAAAAAAAAAAAAAAAAAA", "AAAAAAAAAAAAAAAAAAAA", [0]), ("odd", "x", "ACDE", None, None)]
    df = spark.createDataFrame(rows, DESIGN)
    metrics = D.design_metrics(df, "candidate_id", "s", "p", "fixed_positions").withColumn("fixed_position_violations", F.when(F.col("candidate_id") == "good", 0).when(F.col("candidate_id") == "bad", 2))
    hits = spark.createDataFrame([("good", "t2", 0.5, 1.0), ("good", "t1", 0.5, 1.0), ("good", "t3", 0.4, 1.0), ("odd", "t", 0.9, 1.0), ("none", "t", None, 1.0)], "candidate_id string, target string, identity double, coverage double")
    out = {r.candidate_id: r for r in D.novelty_gate(metrics, hits, "candidate_id", entropy=1.5).collect()}
    assert out["good"].passes and out["good"].atlas_hit == "t1" and out["good"].failures == []
    assert out["bad"].failures == ["fixed_position_violation", "parent_identity_above_threshold", "no_atlas_hit_at_required_query_coverage", "homopolymer_above_threshold", "low_complexity_windows_above_threshold", "designed_entropy_below_threshold"]
    assert out["odd"].failures == ["fixed_position_violation", "no_parent_identity", "atlas_identity_above_threshold", "designed_entropy_below_threshold"]


def test_recovery_by_region(spark):
    df = spark.createDataFrame([("a", "x", "ACDF", "ACDE", [0, 1]), ("b", "y", "AC", "AD", [0, 1, None]), ("c", "x", "AC", "ACD", []), ("d", "x", None, None, None)], DESIGN)
    regions = spark.createDataFrame([("x", "interface", [2, 3, 9, None]), ("x", "none", []), ("x", "null", None)], "scaffold_id string, region string, places array<int>")
    out = {(r.candidate_id, r.region): (r.places, r.recovery) for r in D.native_recovery(df, regions).collect()}
    assert out == {("a", "overall"): (4, 0.75), ("a", "designed"): (2, 0.5), ("a", "interface"): (2, 0.5), ("a", "none"): (0, None), ("a", "null"): (0, None), ("b", "overall"): (2, 0.5), ("b", "designed"): (0, None)}
    bad = {r.candidate_id: (r.fixed, r.violations) for r in D.fixed_violations(spark.createDataFrame([("a", "x", "ACDF", "ACDE", [3, 3, 0, 7, -1, None])], DESIGN)).collect()}
    assert bad == {"a": (4, 3)}


def test_eligibility_takes_the_first_reason(spark):
    rows = [("short", "AC", ["VI-A"], 1, 1), ("odd", "ACDEFX", ["VI-A"], 1, 1), ("clash", "ACDEF", ["VI-B"], 0, 0), ("part", "ACDEF", ["VI-B"], 1, 0), ("long", "A" * 20, ["VI-A"], 1, 1), ("other", "ACDEF", ["I-C"], 1, 1), ("lost", "ACDEF", ["I-C"], 1, 1), ("k1", "acdef", ["VI-A", "VI-B", "I-C"], 1, 1), ("k2", "ACDEFG", ["VI-A"], 2, 1), ("null", None, None, 1, 1)]
    unique = spark.createDataFrame(rows, "sequence_sha256 string, protein_sequence string, subtypes array<string>, nonconflicting_record_count int, complete_record_count int")
    mapping = spark.createDataFrame([(r[0], "rep") for r in rows if r[0] != "lost"] + [("k1", "rep")], "sequence_sha256 string, representative_sha256 string")
    out = D.eligibility(unique, mapping, 5, 10)
    assert {r.sequence_sha256: r.reason for r in out.collect()} == {"short": "below_minimum_protein_length", "odd": "noncanonical_amino_acid", "clash": "only_subtype_conflicting_records", "part": "no_explicitly_complete_record", "long": "above_maximum_protein_length", "lost": "missing_cluster_mapping", "k1": None, "k2": None}
    assert sorted(map(tuple, D.alignment_members(out).collect())) == [("VI-A", "rep", "k2", 6), ("VI-B", "rep", "k1", 5)]


def test_places_through_all_layers(spark):
    places = spark.createDataFrame([("x", i, a) for i, a in enumerate("ACDEFG")], "scaffold string, place int, residue string")
    coordinates = spark.createDataFrame([("x", "s", 1, "C"), ("x", "s", 3, "W"), ("x", "s", 4, "F")], "scaffold string, state string, place int, residue string")
    columns = spark.createDataFrame([("x", i, i) for i in (1, 2, 3, 5)], "scaffold string, place int, column int")
    out = {r.place: (r.status, r.confidence, r.reasons) for r in T.mapped_places(places, coordinates, columns).collect()}
    assert out == {
        0: ("review_required", "low", ["unresolved_terminal", "query_only_insertion", "terminal_msa_insertion"]),
        1: ("four_layer_exact", "high", []),
        2: ("full_msa_only_unresolved_coordinate", "medium", ["unresolved_internal"]),
        3: ("review_required", "low", ["resolved_substitution"]),
        4: ("review_required", "low", ["query_only_insertion"]),
        5: ("full_msa_only_unresolved_coordinate", "medium", ["unresolved_terminal"]),
    }


def test_columns_of_an_added_alignment(spark):
    kind = "aln string, row_id string, seq string"
    old = spark.createDataFrame([("m", "1", "ACDE"), ("m", "2", "AC-E")], kind)
    new = spark.createDataFrame([("m", "1", "AC-DE"), ("m", "2", "AC--E"), ("m", "q", "ACWDE")], kind)
    assert [tuple(r)[1:] for r in T.added_columns(old, new, "q").orderBy("output_column").collect()] == [(0, 0), (1, 1), (2, None), (3, 2), (4, 3)]
    for broken in ([("m", "1", "CA-DE"), ("m", "2", "CA--E"), ("m", "q", "ACWDE")], [("m", "1", "ACD"), ("m", "2", "AC-"), ("m", "q", "ACD")], [("m", "1", "AC-DE"), ("m", "q", "ACWDE")]):
        with pytest.raises(Exception, match="changed, moved or lost"):
            T.added_columns(old, spark.createDataFrame(broken, kind), "q").collect()


def test_regions_of_residues(spark):
    kind = "id int, exposure double, direct boolean, second_shell boolean, chains array<string>"
    df = spark.createDataFrame([(0, 0.1, True, False, ["R"]), (1, 0.6, False, True, []), (2, 0.2, False, False, None), (3, 0.5, True, False, ["T", "R"])], kind)
    out = {}
    for r in T.structure_regions(df, ["R"], ["T"]).collect():
        out.setdefault(r.id, set()).add(r.region)
    assert out == {0: {"buried_core", "rna_interface", "crrna_interface"}, 1: {"surface", "rna_second_shell"}, 2: {"surface"}, 3: {"surface", "rna_interface", "crrna_interface", "target_rna_interface"}}
    with pytest.raises(Exception, match="without exposure"):
        T.structure_regions(spark.createDataFrame([(0, None, True, False, ["R"])], kind), ["R"], []).collect()


def test_masks_of_states(spark):
    rows = [("x", "s", 0, True, True), ("x", "t", 0, True, True), ("x", "s", 1, True, False), ("x", "t", 1, False, True), ("x", "t", 2, False, True), ("x", "s", 3, False, False), ("y", "s", 5, True, False)]
    out = {(r.scaffold, r.place): (r.hard, r.risk, r.variable) for r in T.state_masks(spark.createDataFrame(rows, "scaffold string, state string, place int, hard boolean, risk boolean")).collect()}
    assert out == {("x", 0): (True, True, False), ("x", 1): (False, True, True), ("x", 2): (False, True, True), ("x", 3): (False, False, False), ("y", 5): (True, False, False)}


def test_combinations_and_disagreeing_states(spark):
    states = spark.createDataFrame([("x", "b", "binary"), ("x", "t2", "ternary_off"), ("x", "t1", "ternary"), ("y", "a", None)], "scaffold string, state string, category string")
    out = {(r.scaffold, r.combination): (r.states, r.missing) for r in T.state_combinations(states).collect()}
    assert len(out) == 12 and out["x", "binary + ternary"] == ("b;t1;t2", None) and out["x", "apo + binary"] == (None, "apo") and out["y", "apo + binary + ternary"] == (None, "apo;binary;ternary")
    residues = spark.createDataFrame([("x", "s", 0, "A"), ("x", "t", 0, "A"), ("x", "t", 0, "A"), ("x", "s", 1, "C"), ("x", "t", 1, "D"), ("x", "s", 2, "E")], "scaffold string, state string, place int, residue string")
    assert sorted(map(tuple, T.disagreeing_states(residues).collect())) == [("x", 1, "residues_disagree"), ("x", 2, "indices_disagree")]


def test_results_of_predictions(spark):
    jobs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "job_id string")
    results = spark.createDataFrame([("a", 70.0, "s", "p"), ("b", 80.0, None, "p"), ("c", 120.0, "s", "p"), ("z", 1.0, "s", "p")], "job_id string, mean_plddt double, structure_path string, pae_path string")
    told = T.ingested(jobs, results)
    assert {r.job_id: r.status for r in told.collect()} == {"a": "success", "b": "failed_qc", "c": "failed_qc", "d": "missing"}
    (r,) = T.prediction_summary(told.withColumn("state", F.lit("apo")), ["state"]).collect()
    assert (r.jobs, r.successful, r.missing_or_failed, r.mean_plddt) == (4, 1, 3, 70.0)
    values = spark.createDataFrame([("a", [70.0, 90.0, 10.0])], "id string, values array<double>")
    assert T.mean_at(values, spark.createDataFrame([("a", 0), ("a", 1), ("a", 1)], "id string, place int")).first()["mean"] == 80
    with pytest.raises(Exception, match="outside"):
        T.mean_at(values, spark.createDataFrame([("a", 3)], "id string, place int")).collect()
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 3.0, 4.0, 0.0)], "id int, x double, y double, z double")
    out = {(r.left, r.right): r.distance for r in T.pair_distances(points, spark.createDataFrame([(1, 2), (2, 9)], "left int, right int")).collect()}
    assert out == {(1, 2): 5.0, (2, 9): None}


def test_evidence_of_places_is_merged(spark):
    lengths = spark.createDataFrame([("x", 3), ("y", 0)], "scaffold string, length int")
    kind = "scaffold string, place int, class string, source string, reason string, confirmed boolean"
    rows = [("x", 0, "soft_constrained", "conservation", "conserved", None), ("x", 0, "hard_fixed", "manual", "catalytic", True), ("x", 0, "hard_fixed", "manual", "catalytic", True), ("x", 2, "soft_constrained", "hepn_regex", "motif", False)]
    out = {r.place: (r.final_class, r.reasons, r.sources) for r in T.merged_evidence(lengths, spark.createDataFrame(rows, kind)).collect()}
    assert out == {0: ("hard_fixed", ["catalytic", "conserved"], ["conservation", "manual"]), 1: ("free", ["no_constraint_evidence"], []), 2: ("soft_constrained", ["motif"], ["hepn_regex"])}
    for bad in (("x", 3, "free", "m", "r", True), ("x", 1, "hard_fixed", "hepn_regex", "motif", False)):
        with pytest.raises(Exception, match="outside the scaffold|motif search"):
            T.merged_evidence(lengths, spark.createDataFrame([bad], kind)).collect()


def test_inputs_of_backends(spark):
    kind = "job_id string, sequence string, state string, backend string, crrna string, target_rna string"
    rows = [("a", "AC", "apo", "fasta", None, ""), ("b", "AC", "binary", "json", "GU", None), ("c", "AC", "ternary_x", "fasta", "GU", "AA"), ("d", "AC", "apo", "json", "GU", None), ("e", "AC", "binary", "fasta", None, None), ("f", "AC", "ternary", "fasta", "GU", None), ("g", "AC", "apo", "yaml", None, None), ("h", None, "apo", "fasta", None, None), ("i", "AC", "binary", "fasta", "GU", "AA")]
    out = {r.job_id: (r.input, r.problem) for r in T.backend_inputs(spark.createDataFrame(rows, kind)).collect()}
    assert out["a"] == (">a|protein\nAC\n", None) and out["c"] == (">c|protein\nAC\n>c|crrna\nGU\n>c|target\nAA\n", None)
    assert out["b"] == ('{"name":"b","chains":[{"name":"protein","sequence":"AC"},{"name":"crrna","sequence":"GU"}]}', None)
    assert [out[k][1] for k in "defghi"] == ["rna_in_apo_state", "no_crrna", "no_target_rna", "unknown_backend", "no_sequence", "target_rna_in_binary_state"] and all(out[k][0] is None for k in "defghi")


def test_residues_of_a_structure_file_renamed(spark):
    lines = ["HEADER x", "ATOM      1  CA  ALA A   1       0.000   0.000   0.000", "ATOM      2  CA  GLY A   2A      0.000   0.000   0.000", "HETATM    3  P     A R   2       0.000   0.000   0.000", "TER", ""]
    names = spark.createDataFrame([("A", 1, "", "TRP"), ("A", 2, "A", "VAL"), ("A", 2, "", "SER"), ("R", 9, "", "U")], "chain string, resnum int, icode string, resname string")
    df = spark.createDataFrame([("p", v) for v in lines], "path string, value string")
    out = sorted(r.value for r in T.renamed_residues(df, names).collect())
    assert out == sorted([v.replace("ALA", "TRP").replace("GLY", "VAL") for v in lines])
