"""Scaffold places across layers and structural states, and results of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The named combinations of state categories.
COMBINATIONS = {
    "apo only": ("apo",),
    "binary only": ("binary",),
    "ternary only": ("ternary",),
    "apo + binary": ("apo", "binary"),
    "binary + ternary": ("binary", "ternary"),
    "apo + binary + ternary": ("apo", "binary", "ternary"),
}


def mapped_places(places: DataFrame, coordinates: DataFrame, columns: DataFrame) -> DataFrame:
    """Every place of a scaffold in a state with its status, confidence and reasons.

    ``places`` has ``scaffold, place, residue`` (from 0), ``coordinates`` has ``scaffold, state, place, residue`` of resolved
    residues, ``columns`` has ``scaffold, place, column`` of places in the alignment. Each comes at most once a key.
    Unresolved places outside the first and last resolved one are terminal, the others internal. States without any
    resolved residue, and coordinates beyond the scaffold, are left out.
    """
    ends = coordinates.groupBy("scaffold", "state").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    sizes = places.groupBy("scaffold").agg(F.max("place").alias("end"))
    told = coordinates.select("scaffold", "state", "place", F.col("residue").alias("found"))
    every = places.join(sizes, "scaffold").join(ends, "scaffold").join(told, ["scaffold", "state", "place"], "left").join(columns, ["scaffold", "place"], "left")
    unresolved, terminal = F.col("found").isNull(), (F.col("place") < F.col("first")) | (F.col("place") > F.col("last"))
    exact, aligned = F.coalesce(F.col("found") == F.col("residue"), F.lit(False)), F.col("column").isNotNull()
    status = F.when(exact & aligned, "four_layer_exact").when(unresolved & aligned, "full_msa_only_unresolved_coordinate").otherwise("review_required")
    reasons = F.array_compact(
        F.array(
            F.when(unresolved & terminal, "unresolved_terminal").when(unresolved, "unresolved_internal").when(~exact, "resolved_substitution"),
            F.when(~aligned, "query_only_insertion"),
            F.when(~aligned & ((F.col("place") == 0) | (F.col("place") == F.col("end"))), "terminal_msa_insertion"),
        )
    )
    confidence = F.when(exact & aligned, "high").when(unresolved & aligned, "medium").otherwise("low")
    return every.select("scaffold", "state", "place", "residue", "found", "column", status.alias("status"), confidence.alias("confidence"), reasons.alias("reasons"))


def added_columns(original: DataFrame, added: DataFrame, query: str) -> DataFrame:
    """``aln, output_column, original_column``: where the columns of an alignment went when a query row was added to it.

    Both have ``aln, row_id, seq``; ``query`` names the added row. A new column in which all old rows have gaps is an
    insertion (null). Any other column must be the next of the old ones, or the job fails; so do other rows, an old
    column of gaps alone, and old columns that are lost.
    """
    from pyspark.sql import Window

    from strandloom.functions.sequence import tokens
    from strandloom.sources.text_files import gate

    def signatures(rows: DataFrame) -> DataFrame:
        long = rows.select("aln", "row_id", F.posexplode(tokens(F.col("seq"))).alias("column", "token"))
        # A column's content as one number that does not depend on the order of rows.
        return long.groupBy("aln", "column").agg(F.bit_xor(F.xxhash64("row_id", "token")).alias("h"), F.sum(F.xxhash64("row_id", "token").cast("decimal(38,0)")).alias("t"), F.count_if(F.col("token") != "-").alias("n"))

    old = gate(signatures(original), "n = 0", "an old column of gaps alone")
    new = signatures(added.where(F.col("row_id") != query))
    place = F.sum((F.col("n") > 0).cast("int")).over(Window.partitionBy("aln").orderBy("column").rowsBetween(Window.unboundedPreceding, 0)) - 1
    placed = new.withColumn("o", F.when(F.col("n") > 0, place))
    old = old.select("aln", F.col("column").alias("o"), F.col("h").alias("oh"), F.col("t").alias("ot"))
    both = placed.join(old, ["aln", "o"], "full")
    bad = "(o is not null and (oh is null or h is null or oh <> h or ot <> t))"
    # One condition, as a filter of its own would turn the full join into another before the gate is met.
    kept = F.when(F.expr(bad), F.raise_error(F.lit("an old column was changed, moved or lost")).cast("boolean")).otherwise(F.col("column").isNotNull())
    return both.where(kept).select("aln", F.col("column").alias("output_column"), F.col("o").alias("original_column"))


def structure_regions(annotations: DataFrame, crrna: list[str], target: list[str], buried: float = 0.2) -> DataFrame:
    """``id, region`` of residues: buried or surface by relative exposure, and their contacts.

    ``annotations`` has ``id, exposure, direct, second_shell, chains``. A null exposure fails; exposure under ``buried`` is
    buried, at or over it surface.
    """
    from strandloom.sources.text_files import gate

    held = gate(annotations, "exposure is null", "a residue without exposure")
    meets = lambda names: F.arrays_overlap("chains", F.array(*map(F.lit, names)).cast("array<string>")) if names else F.lit(False)
    regions = F.array(
        F.when(F.col("exposure") < buried, "buried_core").otherwise("surface"),
        F.when(F.col("direct"), "rna_interface"),
        F.when(F.coalesce(meets(crrna), F.lit(False)), "crrna_interface"),
        F.when(F.coalesce(meets(target), F.lit(False)), "target_rna_interface"),
        F.when(F.col("second_shell"), "rna_second_shell"),
    )
    return held.select("id", F.explode(F.array_compact(regions)).alias("region"))


def merged_evidence(lengths: DataFrame, evidence: DataFrame) -> DataFrame:
    """``scaffold, place, final_class, reasons, sources``: every place of a scaffold with the strongest class its evidence gives it.

    ``lengths`` has ``scaffold, length``; ``evidence`` has ``scaffold, place, class`` (free, soft_constrained, hard_fixed),
    ``source, reason, confirmed``. A place outside fails, and so does a hard one that a motif search alone proposes. Reasons
    and sources are sorted and distinct; a place without evidence is free.
    """
    from strandloom.sources.text_files import gate

    told = evidence.join(lengths, "scaffold")
    told = gate(told, "place is null or place < 0 or place >= length", "a constrained place outside the scaffold")
    told = gate(told, "source = 'hepn_regex' and class = 'hard_fixed' and not coalesce(confirmed, false)", "a hard place that only a motif search proposes")
    rank = F.when(F.col("class") == "hard_fixed", 2).when(F.col("class") == "soft_constrained", 1).otherwise(0)
    per = told.groupBy("scaffold", "place").agg(F.max(rank).alias("r"), F.array_sort(F.collect_set("reason")).alias("reasons"), F.array_sort(F.collect_set("source")).alias("sources"))
    every = lengths.where("length > 0").select("scaffold", F.explode(F.sequence(F.lit(0), (F.col("length") - 1).cast("int"))).alias("place"))
    none = F.array().cast("array<string>")
    return every.join(per, ["scaffold", "place"], "left").select(
        "scaffold",
        "place",
        F.when(F.col("r") == 2, "hard_fixed").when(F.col("r") == 1, "soft_constrained").otherwise("free").alias("final_class"),
        F.when(F.size(F.coalesce("reasons", none)) > 0, F.col("reasons")).otherwise(F.array(F.lit("no_constraint_evidence"))).alias("reasons"),
        F.coalesce("sources", none).alias("sources"),
    )


def state_masks(members: DataFrame) -> DataFrame:
    """``scaffold, place, hard, risk, variable``: hard in all states, at risk in any, and whether the pair differs between states.

    ``members`` has ``scaffold, state, place, hard, risk``, one row for each place of each state that is hard or at risk;
    a state that lacks a place has it as neither. Places that are neither in any state have no row.
    """
    states = members.groupBy("scaffold").agg(F.count_distinct("state").alias("states"))
    per = members.groupBy("scaffold", "place").agg(
        F.count_if("hard").alias("h"), F.max("risk").alias("risk"), F.count("*").alias("n"), F.min(F.struct("hard", "risk")).alias("least"), F.max(F.struct("hard", "risk")).alias("most")
    )
    differs = (F.col("least") != F.col("most")) | ((F.col("n") < F.col("states")) & (F.col("most.hard") | F.col("most.risk")))
    return per.join(states, "scaffold").select("scaffold", "place", (F.col("h") == F.col("states")).alias("hard"), "risk", differs.alias("variable"))


def state_combinations(states: DataFrame) -> DataFrame:
    """``scaffold, combination, states, missing``: the states of each named combination, or the categories it lacks.

    ``states`` has ``scaffold, state, category``; a category that starts with ternary is ternary. Where one is missing
    the combination does not apply and has no states.
    """
    kind = F.when(F.col("category").startswith("ternary"), "ternary").otherwise(F.col("category"))
    held = states.select("scaffold", kind.alias("kind"), "state").where("kind in ('apo', 'binary', 'ternary')").groupBy("scaffold", "kind").agg(F.array_sort(F.collect_set("state")).alias("states"))
    per = held.groupBy("scaffold").agg(F.map_from_entries(F.collect_list(F.struct("kind", "states"))).alias("m"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, kinds)).alias("kinds")) for name, kinds in COMBINATIONS.items()])
    each = states.select("scaffold").distinct().join(per, "scaffold", "left").select("scaffold", F.coalesce("m", F.create_map().cast("map<string,array<string>>")).alias("m"), F.explode(wanted).alias("c"))
    missing = F.filter("c.kinds", lambda k: ~F.map_contains_key(F.col("m"), k))
    listed = F.flatten(F.transform("c.kinds", lambda k: F.element_at("m", k)))
    return each.select("scaffold", F.col("c.name").alias("combination"), F.when(F.size(missing) == 0, F.array_join(listed, ";")).alias("states"), F.nullif(F.array_join(missing, ";"), F.lit("")).alias("missing"))


def disagreeing_states(residues: DataFrame) -> DataFrame:
    """``scaffold, place, problem``: places that the states of a scaffold do not share, or where their residues differ.

    ``residues`` has ``scaffold, state, place, residue``; rows that stand twice count once.
    """
    once = residues.distinct()
    states = once.groupBy("scaffold").agg(F.count_distinct("state").alias("states"))
    per = once.groupBy("scaffold", "place").agg(F.count_distinct("state").alias("n"), F.count_distinct(F.coalesce("residue", F.lit(""))).alias("kinds"))
    problem = F.when(F.col("n") < F.col("states"), "indices_disagree").when(F.col("kinds") > 1, "residues_disagree")
    return per.join(states, "scaffold").select("scaffold", "place", problem.alias("problem")).where("problem is not null")


def ingested(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs with the result of their prediction: ``job_id, status, mean_plddt, reason``.

    ``jobs`` has ``job_id``, ``results`` has ``job_id, mean_plddt, structure_path, pae_path``, at most one row a job. Without a
    result a job is ``missing``, without structure or error file it is ``failed_qc``, as with a confidence outside 0 to 100.
    """
    told = results.select("job_id", F.lit(True).alias("_there"), "mean_plddt", "structure_path", "pae_path")
    joined = jobs.join(told, "job_id", "left")
    incomplete = F.col("structure_path").isNull() | F.col("pae_path").isNull()
    wrong = F.coalesce(~F.col("mean_plddt").between(0, 100), F.lit(False))
    reason = F.when(F.col("_there").isNull(), "no result").when(incomplete, "declared structure or error output missing").when(wrong, "confidence outside 0 to 100")
    status = F.when(F.col("_there").isNull(), "missing").when(reason.isNotNull(), "failed_qc").otherwise("success")
    return joined.select(*jobs.columns, status.alias("status"), F.when(F.col("_there"), F.col("mean_plddt")).alias("mean_plddt"), reason.alias("reason"))


def prediction_summary(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Per group the jobs, how many succeeded or not, and the mean confidence of those that did."""
    good = F.col("status") == "success"
    return predictions.groupBy(*by).agg(F.count("*").alias("jobs"), F.count_if(good).alias("successful"), F.count_if(~good).alias("missing_or_failed"), F.round(F.avg(F.when(good, F.col("mean_plddt"))), 6).alias("mean_plddt"))


def pair_distances(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """``left, right, distance`` of named pairs of points (``id, x, y, z``); a pair with a missing point has a null distance."""
    from strandloom.operators.geometry import distance

    at = F.struct("x", "y", "z")
    a, b = points.select(F.col("id").alias("left"), at.alias("a")), points.select(F.col("id").alias("right"), at.alias("b"))
    return pairs.join(a, "left", "left").join(b, "right", "left").select("left", "right", distance("a", "b").alias("distance"))


def mean_at(values: DataFrame, places: DataFrame) -> DataFrame:
    """``id, places, mean``: the mean of a list of values (``id, values``) at places from 0 (``id, place``); places outside fail."""
    from strandloom.sources.text_files import gate

    joined = values.join(places.distinct(), "id")
    held = gate(joined, "place is null or place < 0 or place >= size(values)", "a place outside the list of values")
    return held.groupBy("id").agg(F.count("*").alias("places"), F.avg(F.element_at("values", F.col("place") + 1)).alias("mean"))


def backend_inputs(jobs: DataFrame) -> DataFrame:
    """``jobs`` with ``input``, the text that the prediction backend reads, and ``problem``, why a job has none.

    ``jobs`` has ``job_id, sequence, state, backend, crrna, target_rna``. A binary state needs a crRNA, a ternary one also a target
    RNA, an apo state has neither. Backends are fasta (a record a chain) and json (one object).
    """
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    problem = (
        F.when(~has("sequence"), "no_sequence")
        .when((F.col("state") == "apo") & (has("crrna") | has("target_rna")), "rna_in_apo_state")
        .when((F.col("state") != "apo") & ~has("crrna"), "no_crrna")
        .when(F.col("state").startswith("ternary") & ~has("target_rna"), "no_target_rna")
        .when((F.col("state") == "binary") & has("target_rna"), "target_rna_in_binary_state")
        .when(~F.coalesce(F.col("backend").isin("fasta", "json"), F.lit(False)), "unknown_backend")
    )
    chains = F.filter(F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).alias("sequence")) for name, c in (("protein", "sequence"), ("crrna", "crrna"), ("target", "target_rna"))]), lambda x: F.coalesce(x["sequence"], F.lit("")) != "")
    fasta = F.array_join(F.transform(chains, lambda x: F.concat(F.lit(">"), F.col("job_id"), F.lit("|"), x["name"], F.lit("\n"), x["sequence"], F.lit("\n"))), "")
    whole = F.to_json(F.struct(F.col("job_id").alias("name"), chains.alias("chains")))
    return jobs.withColumn("problem", problem).withColumn("input", F.when(F.col("problem").isNull(), F.when(F.col("backend") == "fasta", fasta).otherwise(whole)))


def renamed_residues(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Lines of fixed-width structure files (``path, value``) with residues renamed as ``names`` (``chain, resnum, icode, resname``) tells.

    Only the three letters of the name change; lines of other residues, and lines that are no atoms, stay as they are.
    """
    atom = F.substring("value", 1, 6).isin("ATOM  ", "HETATM")
    keyed = lines.select("path", "value", F.when(atom, F.substring("value", 22, 1)).alias("chain"), F.when(atom, F.try_to_number(F.trim(F.substring("value", 23, 4)), F.lit("S9999")).cast("int")).alias("resnum"), F.when(atom, F.trim(F.substring("value", 27, 1))).alias("icode"))
    told = names.select("chain", "resnum", F.coalesce("icode", F.lit("")).alias("icode"), F.rpad("resname", 3, " ").alias("resname"))
    joined = keyed.join(told, ["chain", "resnum", "icode"], "left")
    return joined.select("path", F.when(F.col("resname").isNotNull(), F.overlay("value", "resname", F.lit(18), F.lit(3))).otherwise(F.col("value")).alias("value"))
