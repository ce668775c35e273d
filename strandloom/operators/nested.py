"""Deeply nested records as flat node tables (problem 1).

Every record's JSON text is walked depth first. Each list element gets an interval label: ``pre`` when
it is entered, ``post`` when it is left, both from one clock, and ``level``, the number of enclosing
objects. A node lies inside another exactly if its interval does, so all links between the flat
tables are found by interval containment and none needs the JSON again. A record's nodes are whole in
their task, so parents come from the labels in the same Arrow batch, without a shuffle. ``node_table``
gives the flat table of one type with typed columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Child lists that count as lists also as a bare object or as JSON text in a string.
NAMED_LISTS = frozenset(
    {
        "samples",
        "runs",
        "files",
        "attributes",
        "contigs",
        "features",
        "sites",
        "cas",
        "crispr",
        "crispr_spacers",
        "domains",
        "hits",
        "segments",
    }
)

NODE_SCHEMA = "record long, source_table string, row_key string, operon_id string, node_type string, kind string, node_path string, level int, pre long, post long, value string, parent_pre long, parent_path string"

# Fields of the objects of each type, with their kinds; other fields stay in ``value``.
NODE_FIELDS = {
    "samples": "sample_id string, depth_m double",
    "runs": "run_id string, platform string",
    "files": "name string, bytes long",
    "attributes": "tag string, value string",
    "contigs": "contig_id string, length long",
    "features": "kind string, at array<long>",
    "sites": "site string, grade int",
    "cas": "gene_name string, hmm_name string, evalue double, score double, truncated string, length long",
    "crispr": "crispr_repeat string, orientation string, orientation_source string",
    "crispr_spacers": "seq string, pos long",
    "domains": "name string, from long, to long",
    "hits": "target string, identity double",
    "segments": "from long, to long",
}


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def parse_strict(text: str | None):
    """The value of a valid JSON text; ``ValueError`` for anything else, NaN and Infinity included."""
    if text is None:
        raise ValueError("null")
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError as error:
        raise ValueError("nested too deeply") from error


def number_nodes(root, root_name: str = "record", named: frozenset[str] = NAMED_LISTS, root_is_list: bool = False) -> list[list]:
    """Interval labels of the root and of each list element: ``[pre, post, level, type, kind, path, value]``."""
    if root_is_list and isinstance(root, dict):
        root = [root]
    nodes: list[list] = [[0, 0, 0, root_name, "record", "$", None]]
    clock = 1
    stack: list = [(root, "$", root_name, 1, False)]
    while stack:
        item = stack.pop()
        if type(item) is int:
            nodes[item][1] = clock
            clock += 1
            continue
        value, path, name, level, element = item
        if element and not isinstance(value, list):
            is_object = isinstance(value, dict)
            nodes.append([clock, clock + 1, level, name, "object" if is_object else "scalar", path, value])
            clock += 1
            stack.append(len(nodes) - 1)
            level += 1
        if isinstance(value, dict):
            for key in reversed(value):
                child = value[key]
                if key in named:
                    if isinstance(child, str):
                        try:
                            child = parse_strict(child)
                        except ValueError:
                            continue
                    if isinstance(child, dict):
                        child = [child]
                if isinstance(child, (dict, list)):
                    stack.append((child, f"{path}.{key}", key, level, False))
        elif isinstance(value, list):
            for i in range(len(value) - 1, -1, -1):
                stack.append((value[i], f"{path}[{i}]", name, level, True))
    nodes[0][1] = clock
    return nodes


def holders(pre: tuple, post: tuple, level: tuple, kind: tuple) -> list[int]:
    """For each node the number of the innermost node whose interval holds its own, -1 for the record.

    Nodes stand in order of ``pre``. Those of one level never overlap, so of all one level up only the last that
    started can hold a node, and does if it ends later.
    """
    last: list[int] = []
    out = []
    for i in range(len(pre)):
        up = level[i] - 1
        out.append(last[up] if up >= 0 and post[last[up]] > post[i] else -1)
        if kind[i] != "scalar":
            del last[level[i] :]
            last.append(i)
    return out


def _own_fields(value) -> str | None:
    """An object without its child lists and objects, lists of plain numbers kept; other values as they are."""
    if isinstance(value, dict):
        value = {k: v for k, v in value.items() if not isinstance(v, dict) and not (isinstance(v, list) and (k in NAMED_LISTS or any(isinstance(x, (dict, list)) for x in v)))}
    return None if value is None else json.dumps(value, ensure_ascii=False)


def label_nodes(
    df: DataFrame, source_table: str, row_key: str, json_col: str, operon_id: str = "operon_id", root_name: str = "record", root_is_list: bool = False, with_values: bool = True, named: frozenset[str] = NAMED_LISTS
) -> DataFrame:
    """Node rows (``NODE_SCHEMA``) of the JSON texts in ``json_col``; one record row and one per list element.

    Null, empty or invalid texts give no rows. A text that is a bare scalar gives its record row
    alone. With ``root_is_list`` a bare object at the top counts as element 0. Only the named
    columns are read, so further columns, also with clashing names, do no harm.
    """
    # Rows that share a key, or have none, are told apart by their text.
    picked = df.select(F.col(row_key).cast("string").alias("k"), F.col(operon_id).cast("string").alias("o"), F.col(json_col).alias("j"), F.xxhash64(F.col(row_key).cast("string"), F.col(json_col)).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(13)]
            for key, operon, text, record in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    root = parse_strict(text)
                except ValueError:
                    continue
                if operon is None and isinstance(root, dict) and isinstance(root.get("operon_id"), str):
                    operon = root["operon_id"].strip()
                nodes = number_nodes(root, root_name, named, root_is_list)
                n = len(nodes)
                pre, post, level, name, kind, path, value = zip(*nodes)
                held = holders(pre, post, level, kind)
                told = map(_own_fields, value) if with_values else [None] * n
                up_pre, up_path = ([None if h < 0 else x[h] for h in held] for x in (pre, path))
                for column, values in zip(out, ([record] * n, [source_table] * n, [key] * n, [operon] * n, name, kind, path, level, pre, post, told, up_pre, up_path)):
                    column.extend(values)
                if len(out[0]) > 50_000:
                    yield _batch(out)
                    out = [[] for _ in range(13)]
            if out[0]:
                yield _batch(out)

    return picked.mapInArrow(run, NODE_SCHEMA)


def _batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] + [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    names = ["record", "source_table", "row_key", "operon_id", "node_type", "kind", "node_path", "level", "pre", "post", "value", "parent_pre", "parent_path"]

    def column(values: list, kind: pa.DataType) -> pa.Array:
        try:
            return pa.array(values, kind)
        except UnicodeEncodeError:  # lone surrogates, which JSON escapes allow
            return pa.array([None if v is None else v.encode("utf-8", "replace").decode() for v in values], kind)

    return pa.RecordBatch.from_arrays([column(v, k) for v, k in zip(columns, kinds)], names)


def node_table(nodes: DataFrame, node_type: str, fields: str | None = None) -> DataFrame:
    """The flat table of one node type: keys of the record, ``operon_id``, path, interval, parent, and typed ``fields``.

    Fields that are missing, null or of another kind are null. Plain texts in a list have their text in ``text``.
    """
    kinds = fields or NODE_FIELDS[node_type]
    v = F.when(F.col("kind") == "object", F.try_parse_json("value"))
    typed = [F.try_variant_get(v, f"$.{name}", kind).alias(name) for name, kind in (f.strip().split(" ", 1) for f in kinds.split(", "))]
    text = F.when(F.col("kind") == "scalar", F.try_variant_get(F.try_parse_json("value"), "$", "string")).alias("text")
    keys = ["source_table", "row_key", "operon_id", "node_path", "pre", "post", "parent_pre", "parent_path"]
    return nodes.where((F.col("node_type") == node_type) & (F.col("level") > 0)).select(*keys, *typed, text)


def descendants_of(nodes: DataFrame, ancestor_type: str, node_type: str) -> DataFrame:
    """Nodes of ``node_type`` with the ``ancestor_type`` node whose interval holds theirs, at any distance.

    Types here do not nest in themselves, so the last ancestor that starts before a node is the only
    one that can hold it. Nodes without such an ancestor fall out. A group is what one record's text holds.
    """
    both = nodes.where(F.col("node_type").isin(ancestor_type, node_type) & (F.col("kind") != "scalar"))
    before = Window.partitionBy("source_table", "row_key", "record").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.last(F.when(F.col("node_type") == ancestor_type, F.struct("pre", "post", "node_path")), ignorenulls=True).over(before)
    return (
        both.withColumn("_a", opened)
        .where((F.col("node_type") == node_type) & (F.col("_a.post") > F.col("post")))
        .select(*nodes.columns, F.col("_a.pre").alias("ancestor_pre"), F.col("_a.node_path").alias("ancestor_path"))
    )


def atlas_nodes(spark, directory: str, with_values: bool = True) -> DataFrame:
    """Node rows of the three nested atlas fields; array rows delivered twice count once."""
    from strandloom.session import read

    raw = read(spark, directory, "operon_raw").select("record_index", "raw_json", F.lit(None).cast("string").alias("operon_id"))
    meta = read(spark, directory, "cas13_records").select("record_key", "metadata_json", "operon_id")
    arrays = (
        read(spark, directory, "crispr_arrays")
        .select("operon_id", "array_index", "spacers_json")
        .dropDuplicates(["operon_id", "array_index"])
        .withColumn("array_key", F.concat_ws("#", F.coalesce("operon_id", F.lit("")), F.col("array_index").cast("string")))
    )
    return (
        label_nodes(raw, "operon_raw", "record_index", "raw_json", root_name="operon", with_values=with_values)
        .unionByName(label_nodes(meta, "cas13_records", "record_key", "metadata_json", root_name="metadata", with_values=with_values))
        .unionByName(label_nodes(arrays, "crispr_arrays", "array_key", "spacers_json", root_name="crispr_spacers", root_is_list=True, with_values=with_values))
    )
