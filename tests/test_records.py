import json

from pyspark.sql import functions as F

from strandloom.operators import records as R
from strandloom.operators import variants


def good(spark, *operons):
    df = spark.createDataFrame([(i, o if o is None or isinstance(o, str) else json.dumps(o)) for i, o in enumerate(operons)], "record_index long, raw_json string")
    return R.parsed(df)


def test_failures_have_reasons(spark):
    parsed = good(spark, None, "{", "[1]", {"operon_id": " "}, {"x": 1}, {"operon_id": "a"}).orderBy("record_index").collect()
    assert [r.error_type for r in parsed] == ["null_text", "malformed_json", "not_an_object", "missing_operon_id", "missing_operon_id", None]


def test_orientation_turns_repeat_and_spacers(spark):
    operons = [{"operon_id": "a", "crispr": {"crispr_repeat": "AAGT", "orientation": "Reverse", "crispr_spacers": ["AC", {"seq": "gg u"}]}}, {"operon_id": "b", "crispr": [{"crispr_repeat": "AAGT"}, 5]}]
    one, two = R.array_rows(good(spark, *operons)).orderBy("operon_id").collect()
    assert (one.direct_repeat_raw, one.direct_repeat, one.spacers, one.orientation, one.orientation_source) == ("AAGU", "ACUU", ["GU", "ACC"], "reverse", "declared_in_source_record")
    assert (two.direct_repeat, two.orientation, two.orientation_source, two.spacer_count) == ("AAGU", "unknown", "not_provided_by_atlas_v1.0", 0)


def test_effectors_and_operons(spark):
    operon = {"operon_id": "a", "summary": {"subtype": ""}, "cas": [{"gene_name": "Cas13d", "protein": "ac d", "score": None}, "x", {"protein": " "}], "crispr": [{"crispr_spacers": ["A", "B"]}]}
    df = good(spark, operon, {"operon_id": "b"})
    (effector,) = R.effector_rows(df).collect()
    assert effector.protein_sequence == "ACD" and effector.protein_length == 3 and effector.score is None
    a, b = R.operon_rows(df).orderBy("operon_id").collect()
    assert a.is_type_vi and a.n_cas == 2 and a.n_spacers == 2 and not b.is_type_vi and b.n_crispr == 0


def test_subtypes(spark):
    cases = [("VI", "x", "Cas13d_0_CAS-VI-D"), ("VI", "Cas13f", None), ("I-C", None, "CAS-VI-D"), ("VI-A", "Cas13b", None), ("VI-A", "Cas13a", None), (None, "x", None), ("III-B", "c2c2", None)]
    df = spark.createDataFrame(cases, "s string, g string, h string").select(R.resolve_subtype(F.col("s"), F.col("g"), F.col("h")).alias("r"))
    assert [tuple(r.r) for r in df.collect()] == [
        ("VI-D", "cas_hmm_explicit", False),
        ("VI-F", "effector_name_nomenclature", False),
        ("VI-D", "cas_hmm_explicit_summary_conflict", True),
        ("VI-A", "atlas_summary_conflict", True),
        ("VI-A", "atlas_summary", False),
        ("", "atlas_summary_unresolved", False),
        ("III-B", "atlas_summary_non_type_vi", True),
    ]


def test_pairs_name_their_reasons_in_order(spark):
    effectors = spark.createDataFrame([("a", 1, "VI-D", False, "Cas13d", "s"), ("b", 1, "III-A", True, "c2c2", "t"), ("b", 2, "VI-A", False, "Cas13a", "u")], "operon_id string, ordinal int, subtype string, subtype_conflict boolean, effector_name string, sequence_sha256 string")
    arrays = spark.createDataFrame([("a", 0, "GAAAC", "forward")], "operon_id string, array_index long, direct_repeat string, orientation string")
    a, b = R.pair_repeats(effectors, arrays).orderBy("operon_id").collect()
    assert a.pairing_confidence == "high" and a.ambiguity_reason is None and a.direct_repeat == "GAAAC"
    assert b.ambiguity_reason == "effector_count=2;array_count=0;empty_direct_repeat;ambiguous_subtype;subtype_conflict_with_operon_summary;orientation_not_recovered"


def test_exact_unique_counts_copies_and_skips_nan(spark):
    rows = [("h", "o2", False, "00", float("nan"), 3.0, "VI-A"), ("h", "o1", True, None, 1e-5, None, "VI-B"), (None, "o3", False, "00", 1.0, 1.0, "VI-A")]
    df = spark.createDataFrame(rows, "sequence_sha256 string, operon_id string, subtype_conflict boolean, truncated string, evalue double, score double, subtype string")
    (r,) = R.exact_unique(df).collect()
    assert (r.representative_operon_id, r.record_count, r.nonconflicting_record_count, r.complete_record_count, r.minimum_evalue, r.maximum_score, r.truncated_flags, r.subtypes) == ("o1", 2, 1, 1, 1e-5, 3.0, ["00"], ["VI-A", "VI-B"])
    assert R.exact_unique(df.limit(0)).count() == 0


def test_mutations(spark):
    cases = [("ACDE", "A1V,E4F", "VCDF"), ("ACDE", "p.Ala1Val", "VCDE"), ("ACDEFG", "del2-3+del5-5", "AEG"), ("ACDE", "ins2_3:GG", "ACGGDE"), ("ACDE", "ins4_5:W", "ACDEW"), ("ACDE", "del1-4", ""), ("ACDE", "A1V A1W", "WCDE")]
    bad = {"G2A": "other residue at the place", "": "no change", "A9C": "place outside the sequence", "A1V del2-3": "kinds of change mixed", "del1-3 del3-4": "deletions overlap", "ins1_4:G": "insertion between places that are no neighbours", "WT": "unsupported notation", "del3-9": "deletion outside the sequence", "ins1_2:G ins2_3:G": "kinds of change mixed"}
    rows = [(f"g{i}", w, m, None) for i, (w, m, _) in enumerate(cases)] + [(k, "ACDE", k, None) for k in bad]
    out = {r.variant_id: (r.mutant, r.error) for r in variants.applied(spark.createDataFrame(rows, "variant_id string, wt_sequence string, mutation string, full_mutant_sequence string")).collect()}
    assert {k: out[k] for k in bad} == {k: (None, e) for k, e in bad.items()}
    assert [out[f"g{i}"] for i in range(len(cases))] == [(m, None) for _, _, m in cases]


def test_applied_mutations_tell_why_not(spark):
    rows = [("v", "acde", "A1V+E4F", "VCDF"), ("w", None, "A1V", None), ("x", "ACDE", None, "ACDE")]
    out = variants.applied(spark.createDataFrame(rows, "variant_id string, wt_sequence string, mutation string, full_mutant_sequence string")).orderBy("variant_id").collect()
    assert [(r.mutant, r.error, r.agrees) for r in out] == [("VCDF", None, True), (None, "no wild type", None), (None, "no change", None)]


def test_whole_operons_fail_on_broken_fields(spark):
    operons = [{"operon_id": "a", "cas": [{"score": "x"}]}, {"operon_id": "b", "summary": [1]}, {"operon_id": "c", "summary": None, "cas": {"evalue": "1e-5", "length": ""}}, {"operon_id": "d", "cas": [5, {"length": [1]}]}]
    assert [r.error_type for r in good(spark, *operons).orderBy("record_index").collect()] == ["invalid_number", "invalid_field", None, "invalid_number"]


def test_annotations_name_effectors(spark):
    operon = {"operon_id": "a", "summary": {"subtype": "VI"}, "metadata": {"b": 1, "a": None}, "strand": "+", "cas": [{"gene_name": "", "annotation": "Cas13b protein", "protein": "AC", "length": 5}, {"gene_name": "cas1", "protein": "D"}]}
    df = good(spark, operon)
    (r,) = R.cas13_records(R.effector_rows(df)).collect()
    assert (r.subtype, r.subtype_source, r.effector_name, r.source_length_field, r.cas_index) == ("VI-B", "effector_name_nomenclature", "Cas13", 5, 0)
    (o,) = R.operon_rows(df).collect()
    assert o.genomic_context_available and json.loads(o.genomic_context_json) == {"strand": "+"} and json.loads(o.metadata_json) == {"a": None, "b": 1}
    assert json.loads(o.cas_annotations_json) == [{"annotation": "Cas13b protein", "gene_name": "", "length": 5}, {"gene_name": "cas1"}]


def test_build_of_all_tables(spark, tmp_path):
    one = {"operon_id": "o1", "summary": {"subtype": "VI-D"}, "cas": [{"gene_name": "Cas13d", "truncated": "00", "protein": "MKV"}], "crispr": [{"crispr_repeat": "GAAACACCGTTGAAAGTG", "orientation": "forward", "crispr_spacers": ["AC"]}]}
    two = {"operon_id": "o2", "summary": {"subtype": "VI-A"}, "cas": [{"gene_name": "Cas13a", "truncated": "00", "protein": "MKL"}], "crispr": [{"crispr_repeat": "GT", "orientation": "forward"}, {"crispr_repeat": "GA", "orientation": "forward"}]}
    raw = spark.createDataFrame([(1, json.dumps(one)), (2, json.dumps(two)), (3, "{"), (4, json.dumps({"operon_id": "bad", "cas": [{"protein": "A", "gene_name": "Cas13a", "score": "?"}]}))], "record_index long, raw_json string")
    funnel = {r.stage: r["count"] for r in R.build_atlas(raw, str(tmp_path / "atlas")).where("subtype is null").collect()}
    assert funnel == {"texts": 4, "atlas_operons": 2, "type_vi_operons": 2, "cas_effectors": 2, "cas13_records": 2, "crispr_arrays": 3, "cas13_direct_repeat_pairs": 1, "ambiguous_pairs": 1, "processing_failures": 2, "cas13_exact_unique": 2, "conflicts": 0, "complete_records": 2, "eligible_exact_unique": 2}
    (high,) = spark.read.parquet(str(tmp_path / "atlas" / "cas13_direct_repeat_pairs")).collect()
    (low,) = spark.read.parquet(str(tmp_path / "atlas" / "ambiguous_pairs")).collect()
    assert high.direct_repeat == "GAAACACCGUUGAAAGUG" and high.spacers == ["AC"] and low.ambiguity_reason == "array_count=2"
    assert R.build_atlas(raw.limit(0), str(tmp_path / "none")).where("count > 0").count() == 0


def test_leaks_and_links(spark):
    clusters = spark.createDataFrame([("a", "c1"), ("b", "c1"), ("c", "c2"), ("d", "c2"), ("e", "c3")], "k string, cluster string")
    splits = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "train"), ("d", "train")], "k string, split string")
    assert [tuple(r) for r in R.leaking_clusters(clusters, splits, "k").collect()] == [("c1", 2, 2)]
    df = spark.createDataFrame([("h", "o1"), ("h", "o1"), ("h", "o2"), (None, "o"), ("g", None)], "sequence_sha256 string, operon_id string")
    assert sorted(map(tuple, R.hash_operons(df).collect())) == [("h", "o1", 2), ("h", "o2", 1)]
