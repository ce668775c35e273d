import json
import random

import pytest

from strandloom import sinks
from strandloom.sources import json_array, text_files

PDB = """\
ATOM      1  N   ALA A   1       0.000   0.000   0.000  1.00 10.00           N
ATOM      2  CA  ALA A   1       1.458   0.000   0.000  1.00 10.00           C
ATOM      3  C   ALA A   1       2.009   1.420   0.000  1.00 10.00           C
ATOM      4  CA BALA A   1       9.458   0.000   0.000  1.00 10.00           C
ATOM      5  N   GLY A   2A      3.333   1.540   0.000  1.00 10.00           N
ATOM      6  CA  GLY A   2A      4.000   2.840   0.000  1.00 10.00
HETATM    7  P     A     3       2.009   2.920   0.300  1.00 20.00           P
TER
"""
CIF = """\
data_x
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.auth_seq_id
_atom_site.auth_asym_id
_atom_site.pdbx_PDB_model_num
ATOM 1 N N . ALA A 1 0.0 0.0 0.0 11 B 1
ATOM 2 C CA B ALA A 1 1.4 0.0 0.0 11 B 1
ATOM 3 C CA . ALA A 1 1.4 0.0 0.0 11 B 1
ATOM 4 N N . ALA A 1 5.0 0.0 0.0 11 B 2
#
"""


def test_json_array_in_ranges_of_any_size(spark, tmp_path):
    rng = random.Random(1)
    tricky = ['a"b', "\\", '\\"', "[{", "}]", ",", "ü🙂", "x\\\\"]
    elements = [{"i": i, "s": rng.choice(tricky) * rng.randrange(4), "n": [[rng.choice(tricky)], {"k": {}}]} for i in range(120)] + [None, 5, "t,]", [], [1, [2]]]
    path = tmp_path / "a.json"
    path.write_text(" \n" + json.dumps(elements, indent=1, ensure_ascii=False) + "\n ")
    for size in (37, 500, 1 << 20):
        rows = json_array.read_json_array(spark, str(path), size).orderBy("offset").collect()
        assert [json.loads(r.raw_json) for r in rows] == elements and not any(r.error for r in rows)


@pytest.mark.parametrize(
    "text,errors",
    [
        ("[]", []),
        ("[ ]", []),
        ('[{"a": 1}, {bad}, {"b": 2}]', [None, None, None]),
        ("[1,,2]", [None, "empty element", None]),
        ('[{"a": 1}, {"b": ', [None, "array not closed"]),
        ("[1] 2", [None, "content after the array"]),
        ("[1]        [2]", [None, "content after the array"]),
        ("         [1, 2]", [None, None]),
    ],
)
def test_json_array_errors_stay_where_they_are(spark, tmp_path, text, errors):
    path = tmp_path / "b.json"
    path.write_text(text)
    for size in (3, 1000):
        rows = json_array.read_json_array(spark, str(path), size).orderBy("offset").collect()
        assert [r.error for r in rows] == errors


def test_json_array_needs_an_array(spark, tmp_path):
    for text in ("", "{}", "  x"):
        path = tmp_path / "c.json"
        path.write_text(text)
        with pytest.raises(ValueError):
            json_array.read_json_array(spark, str(path))


def test_fasta_round_trip_and_gates(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACDEF"), ("b", "G"), ("c", "ACDEFGHIKL" * 30)], "id string, seq string")
    sinks.write_fasta(df, str(tmp_path / "f"), width=2)
    assert sorted(tuple(r) for r in text_files.read_fasta(spark, str(tmp_path / "f")).collect()) == sorted(tuple(r) for r in df.collect())
    hand = tmp_path / "hand.fa"
    hand.write_text(">x one two\r\nac\r\nde \n\n>y\nFG\n>z\n")
    assert sorted(tuple(r) for r in text_files.read_fasta(spark, str(hand)).collect()) == [("x", "ACDE"), ("y", "FG"), ("z", "")]
    hand.write_text("> \nAC\n")
    with pytest.raises(Exception, match="without an id"):
        text_files.read_fasta(spark, str(hand)).collect()


def test_structures(spark, tmp_path):
    (tmp_path / "x.pdb").write_text(PDB)
    (tmp_path / "x.cif").write_text(CIF)
    atoms = text_files.read_pdb(spark, str(tmp_path / "x.pdb"))
    assert atoms.count() == 6 and {r.chain for r in atoms.collect()} == {"A", "_"} and atoms.where("serial = 6").first().element == "C"
    told = {(r.resnum, r.icode): r for r in text_files.residues(atoms).collect()}
    assert told[1, ""].missing == [] and told[2, "A"].missing == ["C"] and told[3, ""].polymer == "rna" and told[3, ""].missing is None and told[1, ""].x == 1.458
    cif = text_files.read_mmcif(spark, str(tmp_path / "x.cif")).collect()
    assert [(r.serial, r.chain, r.resnum, r.name) for r in cif] == [(1, "B", 11, "N"), (3, "B", 11, "CA")]


def test_tables_and_errors(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("rep1\trep1\nrep1\tm\nrep2\tm\n")
    clusters = text_files.read_cluster_tsv(spark, str(tmp_path / "c.tsv"))
    assert [tuple(r) for r in text_files.double_members(clusters).collect()] == [("m", 2)]
    (tmp_path / "h.tsv").write_text("q\tt1\t0.5\t10\t0.9\t0.9\t1e-5\t50\nq\tt2\t0.5\t10\t0.95\t0.9\t1e-5\t40\nr\tt3\t1.0\t9\t0.1\t0.1\t1\t9\n")
    best = text_files.best_hits(text_files.read_hits(spark, str(tmp_path / "h.tsv")), 0.8).collect()
    assert [(r.query, r.target) for r in best] == [("q", "t2")]
    (tmp_path / "bad.tsv").write_text("q\tt1\t1.5\t10\t0.9\t0.9\t1e-5\t50\n")
    with pytest.raises(Exception, match="identity"):
        text_files.read_hits(spark, str(tmp_path / "bad.tsv")).collect()


def test_pae_and_candidates(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"predicted_aligned_error": [[0, 4], [6, 0]]}]')
    cells = text_files.read_pae(spark, str(tmp_path / "p.json"))
    left, right = (spark.createDataFrame([(i,)], "i int") for i in (0, 1))
    assert text_files.interface_pae(cells, left, right).first().interface_pae == 5
    line = {"pdb_id": "1", "method": "m", "candidate": {"candidate_id": "a", "sequence": "AC", "traces": [1]}, "recovery": {"fixed_position_violations": 0}}
    (tmp_path / "c.jsonl").write_text(json.dumps(line) + "\n\n")
    (r,) = text_files.read_candidates(spark, str(tmp_path / "c.jsonl")).collect()
    assert r.candidate_id == "a" and r.sequence == "AC" and r.fixed_position_violations == 0


def test_staging_never_overwrites(spark, tmp_path):
    df = spark.range(3)
    sinks.staged_parquet(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    with pytest.raises(FileExistsError):
        sinks.staged_parquet(df, str(tmp_path / "t"))


def test_best_hits_of_repeated_rows_and_ties(spark, tmp_path):
    from strandloom.plans import exchange

    rows = [("o1", "t1", 9000), ("o1", "t1", 9000), ("o2", "b", 8000), ("o2", "a", 8000), ("o2", "c", 7000), ("o3", "z", 5000), (None, "t", 1), ("o4", None, 1), ("o4", "t", 10001)]
    spark.createDataFrame(rows, "operon_id string, sequence_sha256 string, score int").write.parquet(str(tmp_path / "cas_effectors.parquet"))
    found = exchange.hit_table_exchange(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == [("o1", "t1", 0.9), ("o2", "a", 0.8), ("o3", "z", 0.5)]


def test_text_before_the_first_header_fails(spark, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.fasta").write_text("ACDE\n>x\nFG\n")
    (tmp_path / "bad" / "b.fasta").write_text(">y\nFG\n")
    with pytest.raises(ValueError, match="before the first header"):
        text_files.read_fasta(spark, str(tmp_path / "bad"))
    (tmp_path / "twice.fasta").write_text(">x one\nAC\n>y\nAC\n\n>x two\nac d\n")
    assert sorted(tuple(r) for r in text_files.read_fasta(spark, str(tmp_path / "twice.fasta")).collect()) == [("x", "AC"), ("x", "ACD"), ("y", "AC")]
    with pytest.raises(ValueError, match="stands 2 times"):
        text_files.read_fasta(spark, str(tmp_path / "twice.fasta"), unique=True)


def test_alignments_are_checked(spark, tmp_path):
    (tmp_path / "good.fa").write_text(">1\nAC.DE\n>2\nacn-e\n")
    assert sorted(r.seq for r in text_files.read_alignment(spark, str(tmp_path / "good.fa")).collect()) == ["AC-DE", "ACN-E"]
    for name, text, told in (("a.fa", ">1\nAC\n>2\nA\n", "unequal"), ("b.fa", ">1\nAC\n", "fewer"), ("c.fa", ">1\nAU\n>2\nAA\n", "alphabet")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match=told):
            text_files.read_alignment(spark, str(tmp_path / name)).collect()
    assert text_files.read_alignment(spark, str(tmp_path / "c.fa"), "mixed").count() == 2


def test_tables_with_headers(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,v\n"a,b",1\nc,\n')
    assert [tuple(r) for r in text_files.read_table(spark, str(tmp_path / "t.csv"), "id string, v int").collect()] == [("a,b", 1), ("c", None)]
    with pytest.raises(Exception):
        text_files.read_table(spark, str(tmp_path / "t.csv"), "id string, w int").collect()
    with pytest.raises(Exception):
        text_files.read_table(spark, str(tmp_path / "t.csv"), "id int, v int").collect()


def test_structures_by_suffix(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "one.pdb").write_text(PDB)
    (tmp_path / "s" / "two.CIF").write_text(CIF.replace("CA . ALA A 1 1.4", "'C A'' . ALA A 1 1.4").replace("'C A'' .", "\"C A'\" ."))
    atoms = text_files.read_structures(spark, str(tmp_path / "s"))
    names = {(r.path.rsplit("/", 1)[1], r.name) for r in atoms.collect()}
    assert ("two.CIF", "C A'") in names and ("one.pdb", "P") in names and len(names) == 6
    (tmp_path / "s" / "x.txt").write_text("no")
    with pytest.raises(ValueError, match="unsupported"):
        text_files.read_structures(spark, str(tmp_path / "s"))


def test_quality_of_a_structure(spark, tmp_path):
    more = PDB.replace("TER\n", "")
    more += "HETATM    8  CA  MSE A   9      30.000   0.000   0.000  1.00 10.00           C\nATOM      9  P   PSU R   1       0.000   9.000   0.000  1.00 10.00           P\nATOM     10  P     G R   2       0.000   9.000   5.000  1.00 10.00           P\nHETATM   11  O   HOH W   1       0.000   9.000   5.000  1.00 10.00           O\n"
    (tmp_path / "q.pdb").write_text(more)
    atoms = text_files.read_pdb(spark, str(tmp_path / "q.pdb"))
    (q,) = text_files.structure_quality(atoms).collect()
    assert (q.protein_chains, q.rna_chains, q.other_chains) == (["A"], ["R", "_"], ["W"]) and (q.protein_residues, q.rna_residues) == (3, 3)
    assert (q.missing_backbones, q.modified_residues, q.chain_breaks, q.finite) == (2, 2, 1, True)
    seqs = {(r.chain, r.polymer): r.seq for r in text_files.chain_sequences(text_files.residues(atoms)).collect()}
    assert seqs == {("A", "protein"): "AGM", ("R", "rna"): "NG", ("_", "rna"): "A"}
    areas = spark.createDataFrame([("p", "A", 1, "", "ALA", 60.0), ("p", "A", 1, "", "ALA", 4.5), ("p", "A", 2, "", "GLY", 900.0), ("p", "W", 1, "", "HOH", 5.0)], "path string, chain string, resnum int, icode string, resname string, area double")
    assert {r.resnum: r.exposure for r in text_files.relative_exposure(areas).collect()} == {1: 0.5, 2: 1.0}


def test_proposals_and_candidates(spark, tmp_path):
    row = {"method": "m", "seed_block": 1, "proposal_index": 2, "candidate": {"candidate_id": "a", "sequence": "AC", "fixed_positions": {"1": "C", "0": "A"}, "is_mock": False, "metadata": {"actual_model_seed": 7}}, "recovery": {"fixed_position_violations": 0}}
    (tmp_path / "p.jsonl").write_text(json.dumps(row) + "\n\n")
    (r,) = text_files.read_proposals(spark, str(tmp_path / "p.jsonl")).collect()
    assert (r.method, r.seed_block, r.proposal_index, r.actual_model_seed, r.fixed_positions) == ("m", 1, 2, 7, {0: "A", 1: "C"})
    (c,) = text_files.read_candidates(spark, str(tmp_path / "p.jsonl")).collect()
    assert c.fixed_positions == [0, 1]
    (tmp_path / "two.jsonl").write_text((json.dumps(row) + "\n") * 2)
    with pytest.raises(ValueError, match="stands 2 times"):
        text_files.read_candidates(spark, str(tmp_path / "two.jsonl"))
    row["candidate"]["is_mock"] = True
    (tmp_path / "mock.jsonl").write_text(json.dumps(row))
    with pytest.raises(Exception, match="mock"):
        text_files.read_proposals(spark, str(tmp_path / "mock.jsonl")).collect()
    (tmp_path / "none.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="no candidates"):
        text_files.read_candidates(spark, str(tmp_path / "none.jsonl"))
