"""Queries of problems 2, 4, 5, 6, 7 and 8, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.llm import canonical, leakage, moderation, neardup, packing, spans
from strandloom.llm.texts import sequence_records
from strandloom.session import materialize, read


def p2_found(spark, directory):
    """Longest shared runs of residues in each record."""
    return spans.shared_spans(sequence_records(spark, directory, parents=True))


def p2_shared_part(spark, directory):
    """How much of each record is shared with others."""
    return spans.shared_part(sequence_records(spark, directory, parents=True))


def p4_found(spark, directory):
    """Rows that say what an earlier row says in another typography."""
    return canonical.hidden_copies(canonical.cas13(spark, directory))


def p4_records(spark, directory):
    """Each different record once, with its number of copies."""
    return canonical.records_once(canonical.cas13(spark, directory))


def p5_found(spark, directory):
    """Pairs of rows with slightly edited sequences."""
    return neardup.near_pairs(sequence_records(spark, directory, parents=False))


def p5_groups(spark, directory):
    """Each row with its class of near-duplicates and the size of the class."""
    return neardup.near_groups(sequence_records(spark, directory, parents=False))


def p6_packed(spark, directory):
    """Every text's pieces in the containers of each target."""
    return packing.packed_documents(spark, directory)


def p6_fill(spark, directory):
    """Containers and the part of their room used, per target."""
    return packing.container_fill(packing.packed_documents(spark, directory), read(spark, directory, "pack_targets"))


def p7_found(spark, directory):
    """Documents that repeat a passage of an evaluation item word for word."""
    return leakage.exact_leaks(*leakage.tables(spark, directory))


def p7_edited(spark, directory):
    """Documents that hold most of an item, edits allowed, with the alignment score."""
    return leakage.leaks(*leakage.tables(spark, directory)).where("score >= 0.6")


def p7_items(spark, directory):
    """Per item how many documents give it away, and the best score."""
    found = leakage.leaks(*leakage.tables(spark, directory)).where("longest_run >= least(12, item_words) or score >= 0.6")
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.round(F.max("score"), 6).alias("best_score"))


def p8_found(spark, directory):
    """Posts with abusive, hateful or sexual content."""
    return moderation.flagged_posts(moderation.score_posts(*moderation.tables(spark, directory)))


def p8_scores(spark, directory):
    """The scores of every post."""
    return moderation.score_posts(*moderation.tables(spark, directory))


def p8_source_rates(spark, directory):
    """Per source the rate of each category."""
    return moderation.source_rates(materialize(moderation.score_posts(*moderation.tables(spark, directory)), "post-scores"))


_RECORDS = """
WITH records AS (
  SELECT 'cas13_records' AS record_set, record_key AS record_id, upper(regexp_replace(protein_sequence, '[^A-Za-z]', '', 'g')) AS letters FROM cas13_records
  UNION ALL SELECT 'candidates', candidate_id, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) FROM candidates
  UNION ALL SELECT 'parents', scaffold_id, max(upper(regexp_replace(parent_sequence, '[^A-Za-z]', '', 'g'))) FROM candidates WHERE scaffold_id IS NOT NULL GROUP BY 2
), """
_SHARED = (
    _RECORDS
    + """
windows AS (
  SELECT record_set, record_id, p, letters[p:p + 39] AS w FROM (SELECT *, unnest(range(1, length(letters) - 38)) AS p FROM records WHERE length(letters) >= 40)
), several AS (
  SELECT w FROM windows GROUP BY w HAVING min(record_set || '/' || record_id) <> max(record_set || '/' || record_id)
), shared AS (
  SELECT record_set, record_id, p, p - lag(p) OVER (PARTITION BY record_set, record_id ORDER BY p) AS step FROM windows SEMI JOIN several USING (w)
), runs AS (
  SELECT *, sum(CASE WHEN step <= 40 THEN 0 ELSE 1 END) OVER (PARTITION BY record_set, record_id ORDER BY p) AS run FROM shared
), spans AS (
  SELECT record_set, record_id, CAST(min(p) AS INTEGER) AS first_pos, CAST(max(p) + 39 AS INTEGER) AS last_pos FROM runs GROUP BY record_set, record_id, run
)
"""
)
_NEAR = (
    _RECORDS.replace(", \n", "\n").rstrip().rstrip(",")
    + """
, grams AS (
  SELECT DISTINCT record_set, record_id, letters, letters[p:p + 4] AS g FROM (
    SELECT *, unnest(range(1, length(letters) - 3)) AS p FROM records WHERE record_set <> 'parents' AND length(letters) >= 5)
), sizes AS (
  SELECT record_set, record_id, any_value(letters) AS letters, count(*) AS n FROM grams GROUP BY record_set, record_id
), common AS (
  SELECT record_set, a.record_id AS x, b.record_id AS y, count(*) AS c
  FROM grams a JOIN grams b USING (record_set, g) WHERE a.record_id < b.record_id GROUP BY record_set, x, y
)
SELECT c.record_set AS source_table, x AS left_key, y AS right_key
FROM common c JOIN sizes a ON a.record_set = c.record_set AND a.record_id = x JOIN sizes b ON b.record_set = c.record_set AND b.record_id = y
WHERE a.letters <> b.letters AND c.c >= 0.6 * (a.n + b.n - c.c)
"""
)

# A record's metadata as the sorted list of what stands at each path, which does not depend on the order of fields.
_COPIES = r"""
WITH rows AS (
  SELECT record_key, upper(regexp_replace(protein_sequence, '[^A-Za-z]', '', 'g')) AS letters, regexp_replace(lower(effector_name), '[^\p{L}\p{N}]', '', 'g') AS effector, metadata_json FROM cas13_records WHERE regexp_matches(protein_sequence, '[A-Za-z]')
), parts AS (
  SELECT record_key, t.fullkey || '=' || CASE t.type WHEN 'OBJECT' THEN '{}' WHEN 'ARRAY' THEN '[]' WHEN 'VARCHAR' THEN '"' || regexp_replace(lower(t.atom ->> '$'), '[^\p{L}\p{N}]', '', 'g') WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN CAST(t.atom AS VARCHAR) ELSE CAST(CAST(t.atom AS DOUBLE) AS VARCHAR) END AS part
  FROM (SELECT record_key, metadata_json FROM rows WHERE json_valid(metadata_json)), json_tree(metadata_json) t
), told AS (SELECT record_key, string_agg(part, chr(10) ORDER BY part) AS content FROM parts GROUP BY 1
), canon AS (
  SELECT record_key, letters, coalesce('=' || effector, '-') AS effector, CASE WHEN metadata_json IS NULL THEN '-' WHEN content IS NULL THEN '?' || regexp_replace(lower(metadata_json), '[^\p{L}\p{N}]', '', 'g') ELSE content END AS content
  FROM rows LEFT JOIN told USING (record_key)
), grouped AS (SELECT record_key, min(record_key) OVER w AS keep_key, count(*) OVER w AS copies FROM canon WINDOW w AS (PARTITION BY letters, effector, content))
"""

_LEAKS = r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_items
), needed AS (
  SELECT item_id, w, least(12, len(w)) AS n FROM items WHERE len(w) > 0
), passages AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM needed)
), posts AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
), runs AS (
  SELECT doc_id, n, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM posts, (SELECT DISTINCT n FROM needed) WHERE len(w) >= n)
)
SELECT DISTINCT doc_id, item_id FROM runs JOIN passages USING (n, g)
"""

QUERIES = {f.__name__: f for f in (p2_found, p2_shared_part, p4_found, p4_records, p5_found, p5_groups, p6_packed, p6_fill, p7_found, p7_edited, p7_items, p8_found, p8_scores, p8_source_rates)}
_CLASSES = (
    _NEAR.replace("WITH records", "WITH RECURSIVE records").replace("SELECT c.record_set AS source_table, x AS left_key, y AS right_key\nFROM", ", near AS (SELECT c.record_set AS record_set, x, y FROM")
    + """), links AS (
  SELECT record_set, x, y FROM near UNION ALL SELECT record_set, y, x FROM near
  UNION ALL SELECT record_set, min(record_id) OVER w, record_id FROM sizes WINDOW w AS (PARTITION BY record_set, letters) UNION ALL SELECT record_set, record_id, min(record_id) OVER w FROM sizes WINDOW w AS (PARTITION BY record_set, letters)
), reach AS (SELECT record_set, record_id AS x, record_id AS y FROM sizes UNION SELECT r.record_set, r.x, l.y FROM reach r JOIN links l ON l.record_set = r.record_set AND l.x = r.y)
, named AS (SELECT record_set, x AS record_key, min(y) AS class_id FROM reach GROUP BY 1, 2)
SELECT record_set AS source_table, record_key, class_id, count(*) OVER (PARTITION BY record_set, class_id) AS class_size FROM named
"""
)
SQL = {
    "p4_found": _COPIES + "SELECT keep_key, record_key AS copy_key FROM grouped WHERE record_key <> keep_key",
    "p4_records": _COPIES + "SELECT DISTINCT keep_key, copies FROM grouped",
    "p5_groups": _CLASSES,
    "p7_found": _LEAKS,
    "p5_found": _NEAR,
    "p2_found": _SHARED + "SELECT * FROM spans",
    "p2_shared_part": _SHARED
    + """
SELECT record_set, record_id, any_value(length(letters)) AS residues, count(first_pos) AS spans, coalesce(sum(last_pos - first_pos + 1), 0) AS shared,
  round(coalesce(sum(last_pos - first_pos + 1), 0) / any_value(length(letters)), 6) AS shared_part
FROM records LEFT JOIN spans USING (record_set, record_id) WHERE letters <> '' GROUP BY record_set, record_id
""",
}
