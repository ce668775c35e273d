"""Normalised tables of nested operons, and aggregations over them.

Child lists given as a single bare object count as lists of one. Elements that are no objects are
skipped. Operons whose text is null, malformed, no object or without an id, whose summary or metadata is no
object, or one of whose effectors has a number that is none, go to the failures table as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import normal_rna, reverse_complement

# Letters of the effector nomenclature with a subtype of their own.
SUBTYPE_LETTERS = "ABCDEFGHIJ"
DECLARED = ("forward", "reverse", "recovered")
# Fields of an operon that tell its place in the genome.
CONTEXT_FIELDS = ("contig", "contig_id", "start", "end", "strand", "genes", "genomic_context")


def parsed(raw: DataFrame) -> DataFrame:
    """``record_index, v, operon_id, error_type``: each text as a variant; ``error_type`` is null for good operons."""
    v = F.try_parse_json("raw_json")
    kind = F.schema_of_variant("v")
    out = raw.select("record_index", "raw_json", v.alias("v"))
    operon_id = F.trim(F.try_variant_get("v", "$.operon_id", "string"))
    error = (
        F.when(F.col("raw_json").isNull(), "null_text")
        .when(F.col("v").isNull(), "malformed_json")
        .when(~kind.startswith("OBJECT"), "not_an_object")
        .when(F.coalesce(operon_id, F.lit("")) == "", "missing_operon_id")
        .when(_no_object("$.summary") | _no_object("$.metadata"), "invalid_field")
        .when(F.exists(_children("$.cas"), lambda c: _no_number(c, "evalue") | _no_number(c, "score") | _no_number(c, "length")), "invalid_number")
    )
    return out.select("record_index", "v", operon_id.alias("operon_id"), error.alias("error_type"))


def _no_object(path: str) -> Column:
    return ~F.coalesce(F.schema_of_variant(F.try_variant_get("v", path, "variant")), F.lit("VOID")).rlike("^(OBJECT|VOID)")


def _no_number(child: Column, key: str) -> Column:
    return F.coalesce(_get(child, key), F.lit("")).rlike(r"\S") & _get(child, key, "double").isNull()


def _text(path: str) -> Column:
    return F.try_variant_get("v", path, "string")


def _children(path: str) -> Column:
    """The objects of a child list, with places in the list."""
    many = F.try_variant_get("v", path, "array<variant>")
    single = F.try_variant_get("v", path, "variant")
    whole = F.coalesce(many, F.when(single.isNotNull() & F.schema_of_variant(single).startswith("OBJECT"), F.array(single)), F.array().cast("array<variant>"))
    return F.filter(F.transform(whole, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda c: F.schema_of_variant(c["x"]).startswith("OBJECT"))


def _get(child: Column, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(child["x"], f"$.{key}", kind)


def _named(child: Column) -> tuple[Column, Column, Column]:
    return _get(child, "gene_name"), _get(child, "hmm_name"), _get(child, "annotation")


def _effector_name(child: Column) -> Column:
    return F.coalesce(F.nullif(_get(child, "gene_name"), F.lit("")), _get(child, "annotation"))


def hmm_letter(hmm: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(hmm), r"CAS[-_]VI[-_]([A-Z][A-Z0-9]*)", 1), F.lit(""))


def name_letter(name: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(name), rf"\bCAS13([{SUBTYPE_LETTERS}])(?:\b|[^A-Z])", 1), F.lit(""))


def operon_rows(good: DataFrame) -> DataFrame:
    """One row per good operon with its counts and JSON parts; type VI by subtype, or by a Cas13 effector where there is none.

    JSON parts are written with sorted keys; proteins are left out of the effectors' part.
    """
    subtype = F.trim(F.coalesce(_text("$.summary.subtype"), F.lit("")))
    infers = F.exists(F.col("cas"), lambda c: is_cas13(*_named(c)) & (hmm_letter(_get(c, "hmm_name")).isNotNull() | name_letter(_effector_name(c)).isNotNull()))
    spacers = F.aggregate(F.col("crispr"), F.lit(0), lambda n, c: n + F.coalesce(F.size(_get(c, "crispr_spacers", "array<variant>")), F.lit(0)))
    base = good.select("operon_id", "record_index", subtype.alias("subtype"), "v", _children("$.cas").alias("cas"), _children("$.crispr").alias("crispr"))
    each = lambda c: F.map_filter(F.try_variant_get(c["x"], "$", "map<string,variant>"), lambda k, _: k != "protein")
    context = [F.struct(F.lit(k).alias("key"), F.try_variant_get("v", f"$.{k}", "variant").alias("value")) for k in sorted(CONTEXT_FIELDS)]
    held = F.filter(F.array(*context), lambda x: x["value"].isNotNull())
    return base.select(
        "record_index",
        "operon_id",
        "subtype",
        ((F.upper("subtype") == "VI") | F.upper("subtype").startswith("VI-") | ((F.col("subtype") == "") & infers)).alias("is_type_vi"),
        F.coalesce(F.to_json(F.try_variant_get("v", "$.metadata", "variant")), F.lit("{}")).alias("metadata_json"),
        _text("$.metadata.source_db").alias("source"),
        _text("$.metadata.taxonomy").alias("taxonomy"),
        _text("$.metadata.biome").alias("biome"),
        _text("$.metadata.assembly_type").alias("assembly_type"),
        F.size("cas").cast("long").alias("n_cas"),
        F.size("crispr").cast("long").alias("n_crispr"),
        spacers.cast("long").alias("n_spacers"),
        F.to_json(F.transform("crispr", lambda c: c["x"])).alias("crispr_arrays_json"),
        F.to_json(F.transform("cas", each)).alias("cas_annotations_json"),
        F.to_json(F.map_from_entries(held)).alias("genomic_context_json"),
        (F.size(held) > 0).alias("genomic_context_available"),
    )


def effector_rows(good: DataFrame) -> DataFrame:
    """One row per effector that has a sequence."""
    each = good.select("record_index", "operon_id", F.trim(F.coalesce(_text("$.summary.subtype"), F.lit(""))).alias("subtype"), _text("$.metadata.source_db").alias("source"), _text("$.metadata.taxonomy").alias("taxonomy"), F.coalesce(F.to_json(F.try_variant_get("v", "$.metadata", "variant")), F.lit("{}")).alias("metadata_json"), F.explode(_children("$.cas")).alias("c"))
    c = F.col("c")
    sequence = F.upper(F.regexp_replace(F.coalesce(_get(c, "protein"), F.lit("")), r"\s", ""))
    number = lambda key: F.nanvl(_get(c, key, "double"), F.lit(None).cast("double"))
    return (
        each.withColumn("protein_sequence", sequence)
        .where("protein_sequence <> ''")
        .select(
            "record_index",
            "operon_id",
            c["i"].alias("cas_index"),
            "subtype",
            F.coalesce(F.nullif(_get(c, "gene_name"), F.lit("")), F.nullif(_get(c, "hmm_name"), F.lit("")), F.lit("unknown")).alias("gene_name"),
            _get(c, "hmm_name").alias("hmm_name"),
            "protein_sequence",
            F.sha2("protein_sequence", 256).alias("sequence_sha256"),
            F.length("protein_sequence").cast("long").alias("protein_length"),
            number("evalue").alias("evalue"),
            number("score").alias("score"),
            _get(c, "truncated").alias("truncated"),
            "source",
            "taxonomy",
            is_cas13(*_named(c)).alias("is_cas13"),
            resolve_subtype(F.col("subtype"), _effector_name(c), _get(c, "hmm_name")).alias("resolved"),
            _get(c, "length", "long").alias("source_length_field"),
            F.coalesce(F.nullif(_get(c, "gene_name"), F.lit("")), F.nullif(_get(c, "hmm_name"), F.lit("")), F.lit("Cas13")).alias("cas13_name"),
            "metadata_json",
        )
    )


def cas_effectors(effectors: DataFrame) -> DataFrame:
    """The columns of all effectors."""
    return effectors.drop("is_cas13", "resolved", "source_length_field", "cas13_name", "metadata_json")


def cas13_records(effectors: DataFrame) -> DataFrame:
    """The Cas13 effectors among ``effectors`` (see ``effector_rows``) with their subtype resolved."""
    return effectors.where("is_cas13").select(
        "record_index",
        "operon_id",
        "cas_index",
        "resolved.subtype",
        F.col("subtype").alias("subtype_raw"),
        "resolved.subtype_source",
        "resolved.subtype_conflict",
        F.col("cas13_name").alias("effector_name"),
        *["hmm_name", "protein_sequence", "sequence_sha256", "protein_length", "source_length_field", "evalue", "score", "truncated", "source", "taxonomy", "metadata_json"],
    )


def array_rows(good: DataFrame) -> DataFrame:
    """One row per repeat array: orientation, repeat as read and as oriented, and oriented spacers."""
    each = good.select("record_index", "operon_id", F.explode(_children("$.crispr")).alias("c"))
    c = F.col("c")
    said = F.lower(F.trim(F.coalesce(F.nullif(_get(c, "orientation"), F.lit("")), F.lit("unknown"))))
    texts = F.transform(F.coalesce(_get(c, "crispr_spacers", "array<variant>"), F.array().cast("array<variant>")), lambda s: F.coalesce(F.try_variant_get(s, "$.seq", "string"), F.try_variant_get(s, "$", "string"), F.lit("")))
    base = each.select(
        "record_index",
        "operon_id",
        c["i"].cast("long").alias("array_index"),
        F.when(said.isin(*DECLARED), said).otherwise("unknown").alias("orientation"),
        F.trim(F.coalesce(_get(c, "orientation_source"), F.lit(""))).alias("given"),
        normal_rna(F.coalesce(_get(c, "crispr_repeat"), F.lit(""))).alias("direct_repeat_raw"),
        F.transform(texts, normal_rna).alias("spacers_raw"),
    )
    turned = F.col("orientation") == "reverse"
    default = F.when(F.col("orientation") == "unknown", "not_provided_by_atlas_v1.0").otherwise("declared_in_source_record")
    return base.select(
        "record_index",
        "operon_id",
        "array_index",
        "direct_repeat_raw",
        F.when(turned, reverse_complement(F.col("direct_repeat_raw"))).otherwise(F.col("direct_repeat_raw")).alias("direct_repeat"),
        F.when(turned, F.transform("spacers_raw", reverse_complement)).otherwise(F.col("spacers_raw")).alias("spacers"),
        F.size("spacers_raw").cast("long").alias("spacer_count"),
        "orientation",
        F.when(F.col("given") == "", default).otherwise(F.col("given")).alias("orientation_source"),
    )


def is_cas13(*names: Column) -> Column:
    """Whether a gene name, profile name or annotation tells a Cas13 effector."""
    told = F.lower(F.concat_ws(" ", *names))
    return told.contains("cas13") | told.contains("c2c2")


def resolve_subtype(subtype: Column, gene: Column, hmm: Column) -> Column:
    """``struct(subtype, subtype_source, subtype_conflict)`` from what the operon and the effector say."""
    raw = F.upper(F.trim(F.coalesce(subtype, F.lit(""))))
    inferred = F.coalesce(F.concat(F.lit("VI-"), hmm_letter(hmm)), F.concat(F.lit("VI-"), name_letter(gene)))
    source = F.when(hmm_letter(hmm).isNotNull(), "cas_hmm_explicit").when(name_letter(gene).isNotNull(), "effector_name_nomenclature").otherwise("atlas_summary")
    clash = F.coalesce((inferred != raw) & ~raw.startswith(inferred), F.lit(False))
    precise, open_ = raw.startswith("VI-"), (raw == "VI") | (raw == "")
    return F.struct(
        F.when(precise, raw).otherwise(F.coalesce(inferred, raw)).alias("subtype"),
        F.when(precise, F.when(clash, "atlas_summary_conflict").otherwise("atlas_summary"))
        .when(open_, F.when(inferred.isNotNull(), source).otherwise("atlas_summary_unresolved"))
        .when(inferred.isNotNull(), F.concat(source, F.lit("_summary_conflict")))
        .otherwise("atlas_summary_non_type_vi")
        .alias("subtype_source"),
        F.when(precise, clash).otherwise(~open_).alias("subtype_conflict"),
    )


def pair_repeats(effectors: DataFrame, arrays: DataFrame, key: str = "operon_id", more: tuple[str, ...] = (), more_arrays: tuple[str, ...] = ()) -> DataFrame:
    """One row per operon with a Cas13 effector: its first effector and array, and why the pair is unsure.

    ``effectors`` has ``key, ordinal``, the resolved subtype and ``more``; ``arrays`` has ``key, array_index,
    direct_repeat, orientation`` and ``more_arrays``. Firsts and counts are aggregated before the join, so a bin of
    many effectors stays one row.
    """
    first = effectors.groupBy(key).agg(F.count("*").alias("effectors"), F.min_by(F.struct("subtype", "subtype_conflict", "effector_name", "sequence_sha256", *more), "ordinal").alias("e"))
    array = arrays.groupBy(key).agg(F.count("*").alias("arrays"), F.min_by(F.struct("direct_repeat", "orientation", *more_arrays), "array_index").alias("a"))
    both = first.join(array, key, "left").withColumn("arrays", F.coalesce("arrays", F.lit(0)))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("effectors") != 1, F.concat(F.lit("effector_count="), F.col("effectors").cast("string"))),
            F.when(F.col("arrays") != 1, F.concat(F.lit("array_count="), F.col("arrays").cast("string"))),
            F.when(F.coalesce(F.col("a.direct_repeat"), F.lit("")) == "", F.lit("empty_direct_repeat")),
            F.when(~F.coalesce(F.upper("e.subtype"), F.lit("")).startswith("VI-"), F.lit("ambiguous_subtype")),
            F.when(F.col("e.subtype_conflict"), F.lit("subtype_conflict_with_operon_summary")),
            F.when(F.coalesce(F.col("a.orientation"), F.lit("unknown")) == "unknown", F.lit("orientation_not_recovered")),
        )
    )
    return both.select(
        key,
        F.col("e.subtype").alias("subtype"),
        F.col("e.effector_name").alias("effector_name"),
        F.col("e.sequence_sha256").alias("sequence_sha256"),
        *[F.col(f"e.{c}").alias(c) for c in more],
        F.coalesce(F.col("a.direct_repeat"), F.lit("")).alias("direct_repeat"),
        F.coalesce(F.col("a.orientation"), F.lit("unknown")).alias("orientation"),
        *[F.col(f"a.{c}").alias(c) for c in more_arrays],
        F.when(F.size(reasons) == 0, "high").otherwise("ambiguous").alias("pairing_confidence"),
        F.nullif(F.array_join(reasons, ";"), F.lit("")).alias("ambiguity_reason"),
    )


def operon_pairs(cas13: DataFrame, arrays: DataFrame) -> DataFrame:
    """Pairs of the operons of nested texts, first effector and array by their place in the operon."""
    effectors = cas13.withColumn("ordinal", F.col("cas_index")).withColumn("conflict", F.col("subtype_conflict"))
    out = pair_repeats(effectors, arrays, "record_index", ("operon_id", "subtype_raw", "subtype_source", "conflict", "protein_sequence"), ("direct_repeat_raw", "spacers", "orientation_source"))
    return out.select(
        "record_index",
        "operon_id",
        "subtype",
        "subtype_raw",
        "subtype_source",
        F.col("conflict").alias("subtype_conflict"),
        "effector_name",
        "protein_sequence",
        "direct_repeat",
        F.coalesce("direct_repeat_raw", F.lit("")).alias("direct_repeat_raw"),
        F.coalesce("spacers", F.array().cast("array<string>")).alias("spacers"),
        "orientation",
        F.coalesce("orientation_source", F.lit("array_not_available")).alias("orientation_source"),
        "pairing_confidence",
        "ambiguity_reason",
    )


def build_atlas(raw: DataFrame, path: str) -> DataFrame:
    """Writes the nine normalised tables of nested operons below ``path``; gives the funnel ``stage, subtype, count``.

    The texts are parsed once, into a written table that all others read. Operons with an error stand in the failures table
    alone. An existing ``path`` is never overwritten.
    """
    from strandloom.session import materialize
    from strandloom.sinks import staged_parquet

    spark = raw.sparkSession
    marked = materialize(parsed(raw), "parsed-operons")
    good = marked.where("error_type is null")
    effectors = materialize(effector_rows(good), "effectors")
    operons, cas13, arrays = operon_rows(good), cas13_records(effectors), array_rows(good)
    pairs = materialize(operon_pairs(cas13, arrays), "pairs")
    tables = {
        "atlas_operons": operons,
        "type_vi_operons": operons.where("is_type_vi"),
        "cas_effectors": cas_effectors(effectors),
        "cas13_records": cas13,
        "crispr_arrays": arrays,
        "cas13_direct_repeat_pairs": pairs.where("pairing_confidence = 'high'"),
        "ambiguous_pairs": pairs.where("pairing_confidence = 'ambiguous'"),
        "processing_failures": marked.where("error_type is not null").select("record_index", "operon_id", "error_type"),
        "cas13_exact_unique": exact_unique(cas13),
    }
    for name, table in tables.items():
        staged_parquet(table, f"{path}/{name}")
    back = {name: spark.read.parquet(f"{path}/{name}") for name in tables}
    total = lambda df, stage: df.agg(F.lit(stage).alias("stage"), F.lit(None).cast("string").alias("subtype"), F.count("*").alias("count"))
    out = total(marked, "texts")
    for name, table in back.items():
        out = out.unionByName(total(table, name))
    records, unique = back["cas13_records"], back["cas13_exact_unique"]
    out = out.unionByName(total(records.where("subtype_conflict"), "conflicts")).unionByName(total(records.where("truncated = '00'"), "complete_records"))
    out = out.unionByName(total(unique.where("nonconflicting_record_count > 0 and complete_record_count > 0"), "eligible_exact_unique"))
    for name, stage in (("atlas_operons", "operon_subtypes"), ("cas13_records", "record_subtypes")):
        out = out.unionByName(back[name].groupBy(F.lit(stage).alias("stage"), "subtype").agg(F.count("*").alias("count")))
    return out


def exact_unique(records: DataFrame) -> DataFrame:
    """One row per sequence hash: representative (least operon), counts, extremes and the sets of flags and subtypes.

    Null hashes are left out. NaN scores count as missing. The operons of a hash, which may be a third of
    all rows, are not gathered here; ``hash_operons`` links them, one row each.
    """
    clean = records.where("sequence_sha256 is not null").withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("evalue", "score")})
    return clean.groupBy("sequence_sha256").agg(
        F.min("operon_id").alias("representative_operon_id"),
        F.count("*").alias("record_count"),
        F.count_if(~F.col("subtype_conflict")).alias("nonconflicting_record_count"),
        F.count_if(F.col("truncated") == "00").alias("complete_record_count"),
        F.min("evalue").alias("minimum_evalue"),
        F.max("score").alias("maximum_score"),
        F.array_sort(F.collect_set("truncated")).alias("truncated_flags"),
        F.array_sort(F.collect_set("subtype")).alias("subtypes"),
    )


def hash_operons(records: DataFrame) -> DataFrame:
    """``sequence_sha256, operon_id, records``: the operons of each hash, one row a link; null ids and hashes link nothing."""
    return records.where("sequence_sha256 is not null and operon_id is not null").groupBy("sequence_sha256", "operon_id").agg(F.count("*").alias("records"))


def leaking_clusters(clusters: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """``cluster, splits, members``: clusters (``key, cluster``) whose members a mapping table (``key, split``) puts in several splits.

    Members that the mapping lacks count as members of no split.
    """
    joined = clusters.select(key, "cluster").join(splits.select(key, "split"), key, "left")
    return joined.groupBy("cluster").agg(F.count_distinct("split").alias("splits"), F.count("*").alias("members")).where("splits > 1")
