"""Sequence, structure and table files as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Residue names of the amino acids and their letters, three modified ones last.
RESIDUE_LETTERS = dict(zip("ALA CYS ASP GLU PHE GLY HIS ILE LYS LEU MET ASN PRO GLN ARG SER THR VAL TRP TYR MSE SEC PYL".split(), "ACDEFGHIKLMNPQRSTVWYMCK"))
MODIFIED_AMINO_ACIDS = ("MSE", "SEC", "PYL")
# Residue names of the nucleotides of RNA, with their aliases; the plain ones and the letters they stand for.
RNA_RESIDUES = ("A", "C", "G", "U", "I", "RA", "RC", "RG", "RU", "ADE", "CYT", "GUA", "URA", "PSU")
RNA_LETTERS = {"A": "A", "C": "C", "G": "G", "U": "U", "RA": "A", "RC": "C", "RG": "G", "RU": "U"}
# The greatest area of each amino acid that a probe can touch, in square angstrom.
GREATEST_AREAS = {"A": 129.0, "C": 167.0, "D": 193.0, "E": 223.0, "F": 240.0, "G": 104.0, "H": 224.0, "I": 197.0, "K": 236.0, "L": 201.0, "M": 224.0, "N": 195.0, "P": 159.0, "Q": 225.0, "R": 274.0, "S": 155.0, "T": 172.0, "V": 174.0, "W": 285.0, "Y": 263.0}

ATOM_COLUMNS = "record string, serial int, name string, altloc string, resname string, chain string, resnum int, icode string, x double, y double, z double, occupancy double, b double, element string"


def gate(df: DataFrame, bad: str, message: str) -> DataFrame:
    """``df``, failing the task that meets a row for which ``bad`` holds."""
    return df.where(F.when(F.expr(bad), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


def check_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``; fails at once if a key stands twice. The keys are counted in a job of their own."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").first()
    if twice is not None:
        raise ValueError(f"{', '.join(keys)} stands {twice.n} times: {[twice[k] for k in keys]}")
    return df


def read_fasta(spark: SparkSession, path: str, unique: bool = False) -> DataFrame:
    """``id, seq`` of FASTA files: ids up to the first blank, sequences without blanks in upper case.

    Text before the first header of a file fails at once, an empty id when it is met, and, where ``unique``, an id that
    stands twice. Records are split by the reader, so files are read in parallel and a record never passes the driver.
    """
    records = spark.read.text(path, lineSep="\n>").where(F.regexp_replace("value", r"\s", "") != "")
    # Only the first record of a file keeps its mark.
    headed = records.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.max(F.ltrim("value").startswith(">")).alias("headed")).where("not headed").first()
    if headed is not None:
        raise ValueError(f"text before the first header of {headed.file}")
    body = F.regexp_replace("value", r"^>?[^\r\n]*", "")
    out = records.select(F.regexp_extract("value", r"^>?(\S*)", 1).alias("id"), F.upper(F.regexp_replace(body, r"\s", "")).alias("seq"))
    out = gate(out, "id = ''", "a FASTA record without an id").select("id", "seq")
    return check_unique(out, "id") if unique else out


# The letters of alignments of each kind, gaps apart.
ALPHABETS = {"protein": "ACDEFGHIKLMNPQRSTVWY", "rna": "ACGUTN", "mixed": "ACDEFGHIKLMNPQRSTVWYU"}


def read_alignment(spark: SparkSession, path: str, alphabet: str = "protein") -> DataFrame:
    """``aln, row_id, seq`` of aligned FASTA, one alignment a file; dots are gaps.

    Fails at once unless each file has two rows or more, of one length that is not 0, with no other letters than its kind has.
    """
    from strandloom.operators.columns import check_alignment

    records = spark.read.text(path, lineSep="\n>").where(F.regexp_replace("value", r"\s", "") != "")
    read_fasta(spark, path)
    body = F.upper(F.regexp_replace(F.regexp_replace("value", r"^>?[^\r\n]*", ""), r"\s", ""))
    rows = records.select(F.col("_metadata.file_path").alias("aln"), F.regexp_extract("value", r"^>?(\S*)", 1).alias("row_id"), F.translate(body, ".", "-").alias("seq"))
    broken = check_alignment(rows).first()
    if broken is not None:
        raise ValueError(f"{broken.aln}: {broken.reason}")
    return gate(rows, f"seq rlike '[^{ALPHABETS[alphabet]}-]'", f"a letter outside the {alphabet} alphabet")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files with a header of the schema's names; other headers and values that do not fit fail."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path, mode="FAILFAST")


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of all structure files in a folder by their suffix: .pdb and .ent, .cif and .mmcif; any other fails at once."""
    other = spark.read.format("binaryFile").load(path).select("path").where(~F.lower("path").rlike(r"\.(pdb|ent|cif|mmcif)$")).first()
    if other is not None:
        raise ValueError(f"unsupported structure format: {other.path}")
    of = lambda *suffixes: path.rstrip("/") + "/*.{" + ",".join([*suffixes, *map(str.upper, suffixes)]) + "}"
    found = [reader(spark, files) for reader, files in ((read_pdb, of("pdb", "ent")), (read_mmcif, of("cif", "mmcif"))) if _any(spark, files)]
    if not found:
        raise ValueError(f"no structures in {path}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _any(spark: SparkSession, pattern: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return len(where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(where)) > 0


def read_cluster_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``representative, member`` of two-column files; empty fields fail."""
    rows = spark.read.schema("representative string, member string").csv(path, sep="\t", mode="FAILFAST")
    return gate(rows, "coalesce(representative, '') = '' or coalesce(member, '') = ''", "an empty field in a cluster table")


def double_members(clusters: DataFrame) -> DataFrame:
    """Members that stand in more than one cluster."""
    return clusters.groupBy("member").agg(F.count_distinct("representative").alias("clusters")).where("clusters > 1")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Similarity hits: ``query, target, fident, alnlen, qcov, tcov, evalue, bits``; an identity outside [0, 1] fails."""
    rows = spark.read.schema("query string, target string, fident double, alnlen int, qcov double, tcov double, evalue double, bits double").csv(path, sep="\t", mode="FAILFAST")
    return gate(rows, "fident is null or fident < 0 or fident > 1", "an identity outside 0 to 1")


def best_hits(hits: DataFrame, least_coverage: float = 0.0) -> DataFrame:
    """The best hit of each query by identity, coverage and bits, ties by the smallest target."""
    order = F.struct((-F.col("fident")).alias("f"), (-F.col("qcov")).alias("q"), F.coalesce(-F.col("bits"), F.lit(float("inf"))).alias("s"), "target", "fident", "qcov", "bits")
    return hits.where(F.col("qcov") >= least_coverage).groupBy("query").agg(F.min(order).alias("b")).select("query", "b.target", "b.fident", "b.qcov", "b.bits")


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """Atoms (``path`` and ``ATOM_COLUMNS``) of fixed-width files; alternate places other than A are left out.

    A blank chain is ``_``; a missing element is the first letter of the atom's name. Broken numbers fail.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").where(F.col("value").startswith("ATOM") | F.col("value").startswith("HETATM"))
    cut = lambda start, size: F.trim(F.substring("value", start, size))
    number = lambda c: F.nullif(c, F.lit("")).cast("double")
    atoms = lines.select(
        "path",
        cut(1, 6).alias("record"),
        cut(7, 5).cast("int").alias("serial"),
        cut(13, 4).alias("name"),
        cut(17, 1).alias("altloc"),
        cut(18, 3).alias("resname"),
        F.coalesce(F.nullif(cut(22, 1), F.lit("")), F.lit("_")).alias("chain"),
        cut(23, 4).cast("int").alias("resnum"),
        cut(27, 1).alias("icode"),
        *[cut(31 + 8 * i, 8).cast("double").alias(c) for i, c in enumerate("xyz")],
        number(cut(55, 6)).alias("occupancy"),
        number(cut(61, 6)).alias("b"),
        F.coalesce(F.nullif(cut(77, 2), F.lit("")), F.regexp_extract(cut(13, 4), "[A-Za-z]", 0)).alias("element"),
    )
    return atoms.where(F.col("altloc").isin("", "A"))


def read_mmcif(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of the first model of mmCIF files, by author's chain and number; one file is one task's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(_atom_site(text))
                if rows:
                    yield pa.RecordBatch.from_pylist([{"path": name, **r} for r in rows], _ATOM_ARROW)

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path"), "value").mapInArrow(run, "path string, " + ATOM_COLUMNS)


# A field of a loop: in quotes, which end where a blank follows, or up to the next blank.
_FIELDS = re.compile(r"""'(?:[^']|'(?=\S))*'(?=\s|$)|"(?:[^"]|"(?=\S))*"(?=\s|$)|\S+""")
_ATOM_ARROW = pa.schema([("path", pa.string())] + [(n, {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}[k]) for n, k in (x.split() for x in ATOM_COLUMNS.split(", "))])


def _atom_site(text: str) -> Iterator[dict]:
    """The rows of the atom_site loop."""
    names: list[str] = []
    model = None
    for line in text.splitlines():
        if line.startswith("_atom_site."):
            names.append(line.split(".", 1)[1].strip())
        elif names and line.startswith(("ATOM", "HETATM")):
            row = dict(zip(names, (m.group().strip() for m in _FIELDS.finditer(line))))
            model = row.get("pdbx_PDB_model_num") if model is None else model
            if row.get("pdbx_PDB_model_num") != model or row.get("label_alt_id", ".") not in (".", "?", "A"):
                continue
            clean = {k: "" if v in (".", "?") else v[1:-1] if v[0] in "\"'" and v[-1] == v[0] and len(v) > 1 else v for k, v in row.items()}
            yield {
                "record": clean["group_PDB"],
                "serial": int(clean["id"]),
                "name": clean["label_atom_id"],
                "altloc": clean.get("label_alt_id", ""),
                "resname": clean["label_comp_id"],
                "chain": clean.get("auth_asym_id") or clean.get("label_asym_id") or "_",
                "resnum": int(clean.get("auth_seq_id") or clean["label_seq_id"]),
                "icode": clean.get("pdbx_PDB_ins_code", ""),
                **{c: float(clean[f"Cartn_{c}"]) for c in "xyz"},
                "occupancy": float(clean["occupancy"]) if clean.get("occupancy") else None,
                "b": float(clean["B_iso_or_equiv"]) if clean.get("B_iso_or_equiv") else None,
                "element": clean.get("type_symbol") or clean["label_atom_id"][:1],
            }
        elif names and line.startswith("#"):
            return


def polymer_type(resname: str) -> Column:
    """protein, rna or other by residue name."""
    c = F.upper(F.trim(F.col(resname)))
    return F.when(c.isin(*RESIDUE_LETTERS), "protein").when(c.isin(*RNA_RESIDUES), "rna").otherwise("other")


def _letter(names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.upper(F.col("resname")))


def chain_sequences(residues: DataFrame) -> DataFrame:
    """``path, chain, polymer, seq`` of protein and RNA chains in order of number and insertion code; other nucleotides than the plain ones are N.

    A chain bounds what is gathered.
    """
    held = residues.where(F.col("polymer").isin("protein", "rna"))
    letter = F.when(F.col("polymer") == "protein", _letter(RESIDUE_LETTERS)).otherwise(F.coalesce(_letter(RNA_LETTERS), F.lit("N")))
    ordered = F.array_sort(F.collect_list(F.struct("resnum", "icode", letter.alias("a"))))
    return held.groupBy("path", "chain", "polymer").agg(F.array_join(F.transform(ordered, lambda x: x["a"]), "").alias("seq"))


def structure_quality(atoms: DataFrame, longest: float = 4.5) -> DataFrame:
    """Per structure its chains by type, residues, missing backbones, modified residues, chain breaks and whether all places are finite.

    ``atoms`` are those of the readers. A chain with a protein residue is a protein chain, one with a nucleotide an RNA
    chain, any other is neither. A break lies between CA atoms further apart than ``longest``.
    """
    from strandloom.operators.geometry import chain_breaks

    per = residues(atoms)
    name = F.upper(F.col("resname"))
    plain = F.when(F.col("polymer") == "protein", ~name.isin(*MODIFIED_AMINO_ACIDS)).when(F.col("polymer") == "rna", name.isin(*RNA_LETTERS)).otherwise(True)
    chains = per.groupBy("path", "chain").agg(F.count_if(F.col("polymer") == "protein").alias("p"), F.count_if(F.col("polymer") == "rna").alias("r"), F.count_if(F.size("missing") > 0).alias("missing"), F.count_if(~plain).alias("modified"))
    listed = lambda condition: F.array_sort(F.collect_set(F.when(condition, F.col("chain"))))
    out = chains.groupBy("path").agg(
        listed(F.col("p") > 0).alias("protein_chains"),
        listed(F.col("r") > 0).alias("rna_chains"),
        listed((F.col("p") == 0) & (F.col("r") == 0)).alias("other_chains"),
        F.sum("p").alias("protein_residues"),
        F.sum("r").alias("rna_residues"),
        F.sum("missing").alias("missing_backbones"),
        F.sum("modified").alias("modified_residues"),
    )
    placed = per.where("polymer = 'protein' and x is not null").select(F.struct("path", "chain").alias("chain"), F.struct("resnum", "icode").alias("number"), "x", "y", "z")
    broken = chain_breaks(placed, longest).groupBy(F.col("chain.path").alias("path")).agg(F.count("*").alias("breaks"))
    finite = atoms.groupBy("path").agg(F.min((F.abs("x") < F.lit(float("inf"))) & (F.abs("y") < F.lit(float("inf"))) & (F.abs("z") < F.lit(float("inf")))).alias("finite"))
    return out.join(broken, "path", "left").join(finite, "path").withColumn("chain_breaks", F.coalesce("breaks", F.lit(0))).drop("breaks")


def relative_exposure(areas: DataFrame) -> DataFrame:
    """``path, chain, resnum, icode, exposure`` of protein residues from areas of atoms (these columns, ``resname, area``), at most 1."""
    held = areas.withColumn("a", _letter(RESIDUE_LETTERS)).where("a is not null")
    greatest = F.element_at(F.create_map(*[F.lit(x) for pair in GREATEST_AREAS.items() for x in pair]), F.max("a"))
    return held.groupBy("path", "chain", "resnum", "icode").agg(F.least(F.lit(1.0), F.sum("area") / greatest).alias("exposure"))


def residues(atoms: DataFrame) -> DataFrame:
    """One row per residue: polymer type, atom names, missing backbone atoms and the place of its CA."""
    backbone = F.array(*[F.lit(n) for n in ("N", "CA", "C")])
    per = atoms.groupBy("path", "chain", "resnum", "icode", "resname").agg(
        F.array_sort(F.collect_set("name")).alias("names"), F.max_by(F.struct("x", "y", "z"), F.struct(F.col("name") == "CA", -F.col("serial"))).alias("p"), F.max(F.col("name") == "CA").alias("has_ca")
    )
    kind = polymer_type("resname")
    return per.select("path", "chain", "resnum", "icode", "resname", kind.alias("polymer"), "names", F.when(kind == "protein", F.array_except(backbone, "names")).alias("missing"), *[F.when(F.col("has_ca"), F.col(f"p.{c}")).alias(c) for c in "xyz"])


def read_pae(spark: SparkSession, path: str) -> DataFrame:
    """``path, i, j, v`` of predicted aligned error files, as an object or a list of one; negative values fail, as does a matrix that is not square."""
    matrix = "array<array<double>>"
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("m"))
    pick = F.coalesce(*[F.try_variant_get("m", f"{root}.{key}", matrix) for key in ("predicted_aligned_error", "pae") for root in ("$", "$[0]")])
    square = gate(rows.select("path", pick.alias("m")), "m is null or size(m) = 0 or exists(m, line -> size(line) <> size(m))", "a PAE matrix that is not square")
    lines = square.select("path", F.posexplode("m").alias("i", "line"))
    cells = lines.select("path", "i", F.posexplode("line").alias("j", "v"))
    return gate(cells, "v is null or isnan(v) or v < 0", "a PAE value that is missing or negative")


def interface_pae(cells: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Mean error between two sets of positions, both ways, per path."""
    a, b = left.select(F.col("i").alias("_a")), right.select(F.col("i").alias("_b"))
    one = cells.join(a, F.col("i") == F.col("_a"), "left_semi").join(b, F.col("j") == F.col("_b"), "left_semi")
    two = cells.join(b, F.col("i") == F.col("_b"), "left_semi").join(a, F.col("j") == F.col("_a"), "left_semi")
    return one.unionByName(two).groupBy("path").agg(F.avg("v").alias("interface_pae"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Flat candidates of nested JSON lines; only the columns named here are parsed.

    Empty ids and mock rows fail when they are met, ids that stand twice and files without rows at once.
    """
    schema = "pdb_id string, method string, candidate struct<candidate_id string, scaffold_id string, sequence string, parent_sequence string, temperature double, seed bigint, fixed_positions map<string,string>, is_mock boolean, evidence_level int>, recovery struct<fixed_position_violations int>"
    rows = spark.read.schema(schema).json(path).select("pdb_id", "method", "candidate.*", "recovery.fixed_position_violations")
    rows = rows.withColumn("fixed_positions", F.array_sort(F.transform(F.map_keys("fixed_positions"), lambda k: k.cast("int"))))
    out = check_unique(gate(rows, "coalesce(candidate_id, '') = '' or coalesce(is_mock, false)", "a candidate without an id, or a mock one"), "candidate_id")
    if out.isEmpty():
        raise ValueError(f"no candidates in {path}")
    return out


def read_proposals(spark: SparkSession, path: str) -> DataFrame:
    """Proposals of nested JSON lines, flat, with method, seed block, number and the seed their model took; mock ones fail."""
    schema = "method string, seed_block bigint, proposal_index bigint, candidate struct<candidate_id string, scaffold_id string, sequence string, parent_sequence string, temperature double, seed bigint, fixed_positions map<string,string>, is_mock boolean, metadata struct<actual_model_seed bigint>>"
    rows = spark.read.schema(schema).json(path).select("method", "seed_block", "proposal_index", "candidate.*")
    flat = rows.select("*", F.col("metadata.actual_model_seed").alias("actual_model_seed"), F.transform_keys("fixed_positions", lambda k, _: k.cast("int")).alias("fixed")).drop("metadata", "fixed_positions").withColumnRenamed("fixed", "fixed_positions")
    return gate(flat, "coalesce(is_mock, true)", "a mock proposal")
