import json
import random

from strandloom.operators import nested


def brute(value, path, parent, out):
    """Cases and their parents, by plain recursion."""
    if isinstance(value, dict):
        for key, child in value.items():
            if key in nested.NAMED_LISTS:
                if isinstance(child, str):
                    try:
                        child = nested.parse_strict(child)
                    except ValueError:
                        continue
                if isinstance(child, dict):
                    child = [child]
            brute(child, f"{path}.{key}", parent, out)
    elif isinstance(value, list):
        for i, child in enumerate(value):
            here = f"{path}[{i}]"
            if isinstance(child, dict):
                out.append((here, parent))
                brute(child, here, here, out)
            else:
                brute(child, here, parent, out)


def made_up(rng, depth=0):
    kind = rng.random()
    if depth > 4 or kind < 0.2:
        return rng.choice([None, 1, 2.5, True, "x", "[1", ""])
    if kind < 0.55:
        return [made_up(rng, depth + 1) for _ in range(rng.randrange(4))]
    names = ["samples", "runs", "files", "hits", "collection", "a.b"]
    out = {k: made_up(rng, depth + 1) for k in rng.sample(names, rng.randrange(1, 5))}
    if rng.random() < 0.3:
        out["segments"] = json.dumps(made_up(rng, depth + 1))
    return out


def linked(spark, texts, **options):
    df = spark.createDataFrame([(str(i), None, t) for i, t in enumerate(texts)], "key string, op string, body string")
    nodes = nested.label_nodes(df, "t", "key", "body", operon_id="op", **options)
    return nodes


def test_cases_and_parents_match_plain_recursion(spark):
    rng = random.Random(5)
    texts = [json.dumps(made_up(rng)) for _ in range(150)]
    found = {(r.row_key, r.node_path, r.parent_path) for r in linked(spark, texts).where("kind = 'object'").collect()}
    wanted = set()
    for i, text in enumerate(texts):
        out = []
        brute(json.loads(text), "$", "$", out)
        wanted |= {(str(i), *x) for x in out}
    assert found == wanted and len(wanted) > 100


def test_intervals_nest_and_values_are_kept(spark):
    text = '{"operon_id": " o1 ", "samples": {"id": "s", "runs": [{"r": 1}, null, {"r": 2, "files": "[{\\"n\\": 3}]"}]}}'
    nodes = {r.node_path: r for r in linked(spark, [text]).collect()}
    assert set(nodes) == {"$", "$.samples[0]", "$.samples[0].runs[0]", "$.samples[0].runs[1]", "$.samples[0].runs[2]", "$.samples[0].runs[2].files[0]"}
    file, run, sample = (nodes[p] for p in ("$.samples[0].runs[2].files[0]", "$.samples[0].runs[2]", "$.samples[0]"))
    assert sample.pre < run.pre < file.pre and file.post < run.post < sample.post
    assert file.parent_pre == run.pre and run.parent_path == "$.samples[0]" and sample.parent_path == "$"
    assert json.loads(sample.value) == {"id": "s"} and file.operon_id == "o1" and nodes["$.samples[0].runs[1]"].kind == "scalar"


def test_texts_that_give_nothing(spark):
    bad = [None, "", "  ", "{", '{"samples": [{]}', "NaN", '{"a": NaN}', '{"samples": [{"x": 1}]} trailing']
    assert linked(spark, bad).count() == 0
    assert [r.kind for r in linked(spark, ["5"]).collect()] == ["record"]


def test_bare_object_at_the_top_counts_as_a_list_where_asked(spark):
    paths = {r.node_path for r in linked(spark, ['{"seq": "A", "hits": {"t": 1}}'], root_is_list=True).collect()}
    assert paths == {"$", "$[0]", "$[0].hits[0]"}


def test_descendants_by_interval(spark):
    text = '{"samples": [{"runs": [{"files": [{"n": 1}, {"n": 2}]}]}, {"runs": []}], "files": [{"n": 9}]}'
    df = spark.createDataFrame([("k", "o", text)], "key string, op string, body string")
    found = nested.descendants_of(nested.label_nodes(df, "t", "key", "body", operon_id="op"), "samples", "files")
    assert sorted((r.node_path, r.ancestor_path) for r in found.collect()) == [("$.samples[0].runs[0].files[0]", "$.samples[0]"), ("$.samples[0].runs[0].files[1]", "$.samples[0]")]


def test_deep_wide_empty_and_clashing_columns(spark):
    deep = '{"samples":[' * 300 + "{}" + "]}" * 300
    assert linked(spark, [deep]).where("kind = 'object'").count() == 300
    wide = json.dumps([{"i": i} for i in range(20_000)])
    assert linked(spark, [wide]).where("kind = 'object'").count() == 20_000
    empty = spark.createDataFrame([], "key string, op string, body string")
    assert nested.label_nodes(empty, "t", "key", "body", operon_id="op").count() == 0
    clash = spark.createDataFrame([("k", "o", "[{}]", 1, 2)], "key string, op string, body string, pre int, _e int")
    assert nested.label_nodes(clash, "t", "key", "body", operon_id="op").count() == 2


def test_typed_table_and_keys_that_repeat(spark):
    texts = ['{"samples": [{"sample_id": "s1", "depth_m": 3, "runs": [{"run_id": "r", "platform": 7, "files": {"name": "f", "bytes": "x"}}]}, "plain"]}', '{"samples": [{"sample_id": null}]}']
    df = spark.createDataFrame([(None, "o", t) for t in texts] + [("k", "o", texts[1]), ("k", "o", texts[0])], "key string, op string, body string")
    nodes = nested.label_nodes(df, "t", "key", "body", operon_id="op")
    samples = sorted((str(r.row_key), r.node_path, str(r.sample_id), r.depth_m, r.text) for r in nested.node_table(nodes, "samples").collect())
    assert samples[:3] == [("None", "$.samples[0]", "None", None, None), ("None", "$.samples[0]", "s1", 3.0, None), ("None", "$.samples[1]", "None", None, "plain")] and len(samples) == 6
    files = nested.node_table(nodes, "files").collect()
    assert [(r.name, r.bytes, r.parent_path) for r in files] == [("f", None, "$.samples[0].runs[0]")] * 2
    held = nested.descendants_of(nodes, "samples", "files").collect()
    assert [r.ancestor_path for r in held] == ["$.samples[0]"] * 2
