"""Queries of the general problems 1 and 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import nested, packed


def p1_found(spark, directory):
    """Every JSON object that is a list element, with its place and the closest enclosing one."""
    nodes = nested.atlas_nodes(spark, directory, with_values=False)
    return nodes.where("kind <> 'scalar' and level > 0").select("source_table", "row_key", "node_path", "parent_path")


def p1_nodes(spark, directory):
    """All nodes, texts in lists included, with interval labels, values, parents and operon."""
    return nested.atlas_nodes(spark, directory)


def _table_of(node_type):
    def query(spark, directory):
        return nested.node_table(nested.atlas_nodes(spark, directory), node_type)

    query.__name__, query.__doc__ = f"p1_{node_type}", f"The flat table of all {node_type}, with typed fields and links."
    return query


def p1_files_in_samples(spark, directory):
    """Each file with the sample whose interval holds it, across the runs between."""
    held = nested.descendants_of(nested.atlas_nodes(spark, directory), "samples", "files").withColumn("v", F.try_parse_json("value"))
    fields = [F.try_variant_get("v", f"$.{name}", kind).alias(name) for name, kind in (("name", "string"), ("bytes", "long"))]
    return held.select("source_table", "row_key", "operon_id", "node_path", "ancestor_path", *fields)


def p1_type_counts(spark, directory):
    """Nodes and records per table and type."""
    nodes = nested.atlas_nodes(spark, directory, with_values=False)
    per_record = nodes.groupBy("source_table", "node_type", "kind", "row_key").agg(F.count("*").alias("n"))
    return per_record.groupBy("source_table", "node_type", "kind").agg(F.sum("n").alias("nodes"), F.count("*").alias("records"), F.max("n").alias("most_in_a_record"))


def p3_found(spark, directory):
    """Every packed habitat, spacer and change as a row of its own."""
    return packed.packed_items(spark, directory)


def p3_item_counts(spark, directory):
    """How often each packed value occurs in its table, and in how many rows."""
    items = packed.packed_items(spark, directory)
    per_row = items.groupBy("source_table", "item", "row_key").agg(F.count("*").alias("n"))
    return per_row.groupBy("source_table", "item").agg(F.sum("n").alias("times"), F.count("*").alias("rows"))


_P3_ITEMS = r"""
WITH texts AS (
  SELECT 'cas13_records' AS source_table, record_key AS row_key, 0 AS part, true AS quoted, json_extract_string(metadata_json, '$.habitat') AS t
  FROM cas13_records WHERE json_type(metadata_json, '$.habitat') = 'VARCHAR'
  UNION ALL
  SELECT 'cas13_records', record_key, i, true, json_extract_string(metadata_json, '$.habitat[' || i || ']')
  FROM (SELECT record_key, metadata_json, unnest(range(json_array_length(metadata_json, '$.habitat')::BIGINT)) AS i
        FROM cas13_records WHERE json_type(metadata_json, '$.habitat') = 'ARRAY')
  UNION ALL SELECT DISTINCT 'ambiguous_pairs', operon_id, 0, false, spacers_json FROM ambiguous_pairs
  UNION ALL SELECT DISTINCT 'variant_retrospective', variant_id, 0, false, mutation FROM variant_retrospective
), tokens AS (
  SELECT source_table, row_key, part, pos, tok FROM (
    SELECT source_table, row_key, part,
      CASE WHEN quoted THEN regexp_extract_all(t, '"(?:[^"]|"")*"|''(?:[^'']|'''')*''|[^,;|/\t\n\r"'' ][^,;|/\t\n\r"]*|[ ]+')
           ELSE regexp_extract_all(t, '[^,;|/&+\s"''\[\]]+') END AS toks
    FROM texts WHERE t IS NOT NULL), unnest(toks) WITH ORDINALITY AS u(tok, pos)
), cleaned AS (
  SELECT source_table, row_key, part, pos,
    trim(CASE WHEN tok LIKE '"%"' AND source_table = 'cas13_records' THEN replace(tok[2:-2], '""', '"')
         WHEN tok LIKE '''%''' AND source_table = 'cas13_records' THEN replace(tok[2:-2], '''''', '''') ELSE tok END) AS item
  FROM tokens
), items AS (
  SELECT source_table, row_key, CAST(row_number() OVER (PARTITION BY source_table, row_key ORDER BY part, pos) AS INTEGER) AS item_no, item
  FROM cleaned WHERE item <> '')
"""

# A recursive walk over all values, in document order by the places on the way to them; child lists may stand as JSON text
# in a string or as a bare object. A node of order r at level l starts at 2 r - l and ends after all that lies in it.
_P1_NODES = """
WITH RECURSIVE texts AS (
  SELECT 'operon_raw' AS source_table, CAST(record_index AS VARCHAR) AS row_key, trim(json_extract_string(raw_json, '$.operon_id')) AS operon_id, '' AS name, CAST(raw_json AS JSON) AS v FROM operon_raw WHERE json_valid(raw_json)
  UNION ALL SELECT 'cas13_records', record_key, operon_id, '', CAST(metadata_json AS JSON) FROM cas13_records WHERE json_valid(metadata_json)
  UNION ALL SELECT 'crispr_arrays', coalesce(operon_id, '') || '#' || array_index, operon_id, 'crispr_spacers', CAST(CASE json_type(spacers_json) WHEN 'OBJECT' THEN '[' || spacers_json || ']' ELSE spacers_json END AS JSON)
    FROM (SELECT operon_id, array_index, any_value(spacers_json) AS spacers_json FROM crispr_arrays GROUP BY 1, 2) WHERE json_valid(spacers_json)
), walk AS (
  SELECT source_table, row_key, operon_id, name, v, '$' AS path, CAST([] AS VARCHAR[]) AS held, CAST([] AS BIGINT[]) AS place, false AS element FROM texts
  UNION ALL
  SELECT source_table, row_key, operon_id, name, CASE WHEN named AND json_type(x) = 'VARCHAR' AND json_valid(x ->> '$') THEN CASE json_type(x ->> '$') WHEN 'OBJECT' THEN CAST('[' || (x ->> '$') || ']' AS JSON) ELSE CAST(x ->> '$' AS JSON) END
      WHEN named AND json_type(x) = 'OBJECT' THEN CAST('[' || x || ']' AS JSON) ELSE x END, path, held, place, element
  FROM (
    SELECT source_table, row_key, operon_id, CASE WHEN k IS NULL THEN name ELSE k END AS name, coalesce(k IN ('samples', 'runs', 'files', 'attributes', 'contigs', 'features', 'sites', 'cas', 'crispr', 'crispr_spacers', 'domains', 'hits', 'segments'), false) AS named,
      CASE WHEN k IS NULL THEN json_extract(v, '$[' || i || ']') ELSE json_extract(v, '$."' || k || '"') END AS x, CASE WHEN k IS NULL THEN path || '[' || i || ']' ELSE path || '.' || k END AS path,
      CASE WHEN element AND json_type(v) <> 'ARRAY' THEN list_append(held, path) ELSE held END AS held, list_append(place, i) AS place, k IS NULL AS element
    FROM (
      SELECT *, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS i, CAST(NULL AS VARCHAR) AS k FROM walk WHERE json_type(v) = 'ARRAY'
      UNION ALL SELECT *, unnest(range(len(json_keys(v)))), unnest(json_keys(v)) FROM walk WHERE json_type(v) = 'OBJECT'
    )
  )
), nodes AS (
  SELECT *, coalesce(held[-1], '$') AS parent_path, len(held) + 1 AS level, row_number() OVER (PARTITION BY source_table, row_key ORDER BY place) AS r FROM walk WHERE element AND json_type(v) <> 'ARRAY'
), inside AS (SELECT source_table, row_key, h AS path, count(*) AS n FROM (SELECT source_table, row_key, unnest(held) AS h FROM nodes) GROUP BY ALL
), spans AS (SELECT *, 2 * r - level AS pre, 2 * r - level + 2 * coalesce(n, 0) + 1 AS post FROM nodes LEFT JOIN inside USING (source_table, row_key, path))
"""


def _table_sql(node_type: str) -> str:
    """The flat table of one type: each field as text, then in its kind."""
    fields = []
    for name, kind in (f.split(" ", 1) for f in nested.NODE_FIELDS[node_type].split(", ")):
        text = f"""CASE WHEN json_type(s.v) = 'OBJECT' THEN json_extract_string(s.v, '$."{name}"') END"""
        if kind == "array<long>":
            fields.append(f"""TRY_CAST({text} AS BIGINT[]) AS "{name}\"""")
            continue
        fields.append(f'{text} AS "{name}"' if kind == "string" else f'TRY_CAST({text} AS {dict(long="BIGINT", int="INTEGER", double="DOUBLE")[kind]}) AS "{name}"')
    return (
        _P1_NODES
        + f"""SELECT s.source_table, s.row_key, s.operon_id, s.path AS node_path, s.pre, s.post, coalesce(p.pre, 0) AS parent_pre, s.parent_path, {", ".join(fields)}, CASE WHEN json_type(s.v) <> 'OBJECT' THEN s.v ->> '$' END AS text
FROM spans s LEFT JOIN spans p ON p.source_table = s.source_table AND p.row_key = s.row_key AND p.path = s.parent_path WHERE s.name = '{node_type}'"""
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_nodes, p1_files_in_samples, p1_type_counts, p3_found, p3_item_counts, *map(_table_of, nested.NODE_FIELDS))}
SQL = {
    "p1_found": _P1_NODES + "SELECT source_table, row_key, path AS node_path, parent_path FROM nodes WHERE json_type(v) = 'OBJECT'",
    "p1_type_counts": _P1_NODES
    + """
, typed AS (
  SELECT source_table, row_key, CASE WHEN name <> '' THEN name WHEN source_table = 'operon_raw' THEN 'operon' ELSE 'metadata' END AS node_type, CASE json_type(v) WHEN 'OBJECT' THEN 'object' ELSE 'scalar' END AS kind FROM nodes
  UNION ALL SELECT source_table, row_key, CASE source_table WHEN 'operon_raw' THEN 'operon' WHEN 'cas13_records' THEN 'metadata' ELSE 'crispr_spacers' END, 'record' FROM texts
), per AS (SELECT source_table, node_type, kind, row_key, count(*) AS n FROM typed GROUP BY ALL)
SELECT source_table, node_type, kind, CAST(sum(n) AS BIGINT) AS nodes, count(*) AS records, max(n) AS most_in_a_record FROM per GROUP BY ALL
""",
    **{f"p1_{t}": _table_sql(t) for t in nested.NODE_FIELDS},
    "p1_files_in_samples": _P1_NODES
    + """
SELECT s.source_table, s.row_key, s.operon_id, s.path AS node_path, max_by(p.path, p.pre) AS ancestor_path, any_value(json_extract_string(s.v, '$.name')) AS name, any_value(TRY_CAST(json_extract_string(s.v, '$.bytes') AS BIGINT)) AS bytes
FROM spans s JOIN spans p ON p.source_table = s.source_table AND p.row_key = s.row_key AND p.pre < s.pre AND p.post > s.post AND p.name = 'samples' AND json_type(p.v) = 'OBJECT' WHERE s.name = 'files' AND json_type(s.v) = 'OBJECT' GROUP BY ALL
""",
    "p3_found": _P3_ITEMS + "SELECT source_table, row_key, item_no, item FROM items",
    "p3_item_counts": _P3_ITEMS + "SELECT source_table, item, count(*) AS times, count(DISTINCT row_key) AS rows FROM items GROUP BY 1, 2",
}
