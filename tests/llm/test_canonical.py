import json
import random

from strandloom.llm import canonical

SCHEMA = "record_key string, protein_sequence string, effector_name string, metadata_json string"


def respelled(rng, sequence, effector, metadata):
    sequence = rng.choice([sequence, sequence.lower(), " ".join(sequence), f'"{sequence}"', sequence[:3] + "\n" + sequence[3:] + "*"])
    effector = rng.choice([effector, effector.upper(), effector.replace("Cas", "Cas-"), effector + " "])
    items = list(metadata.items())
    rng.shuffle(items)
    return sequence, effector, json.dumps(dict(items), indent=rng.choice([None, 1]))


def made_up(n):
    rng = random.Random(4)
    records, owner = [], {}
    kinds = [("".join(rng.choice("ACDEFGHIKL") for _ in range(30)), f"Cas13{rng.choice('abc')}", {"b": {"x": rng.randrange(3), "t": "Ab, c"}, "a": [1, {"z": None}]}) for _ in range(n // 4)]
    for i in range(n):
        k = 0 if i % 3 == 0 else rng.randrange(len(kinds))
        owner[key := f"k{i:05d}"] = canonical.canonical_bytes(kinds[k][0], kinds[k][1], json.dumps(kinds[k][2]))
        records.append((key, *respelled(rng, *kinds[k])))
    rng.shuffle(records)
    return records, owner


def test_copies_in_any_spelling(spark):
    records, owner = made_up(600)
    least = {}
    for key in sorted(owner):
        least.setdefault(owner[key], key)
    wanted = {(least[c], k) for k, c in owner.items() if least[c] != k}
    df = spark.createDataFrame(records, SCHEMA).repartition(5)
    for capacity in (canonical.BUCKET_BYTES, 3_000, 50):
        assert {tuple(r) for r in canonical.hidden_copies(df, capacity=capacity).collect()} == wanted
    counted = canonical.records_once(df, capacity=2_000).collect()
    assert sum(r.copies for r in counted) == 600 and {r.keep_key for r in counted} == set(least.values())


def test_what_is_no_copy(spark):
    rows = [
        ("a", "ACD", "x", '{"k": "v"}'),
        ("b", "ACD", None, '{"k": "v"}'),
        ("c", "ACD", "x", None),
        ("d", "ACD", "x", '{"k": "w"}'),
        ("e", "ACD", "x", '{"k": ["v"]}'),
        ("f", None, "x", None),
        ("g", "", "x", None),
        ("h", "*-1", "x", None),
        ("i", "*-", "x", None),
        ("j", "ACD", "x", '{"k": "V."}'),
        ("k", "ACD", "x", "{broken"),
        ("l", "acd", "X!", "{BROKEN"),
        ("m", "ACD", None, None),
        ("n", "AC D", None, None),
        ("o", "ACD", "x", '{"k": 1.0}'),
        ("p", "ACD", "x", '{"k": 1}'),
        ("q", "ACD", "x", '{"k": "1"}'),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in canonical.hidden_copies(df).collect()) == [("a", "j"), ("k", "l"), ("m", "n"), ("o", "p")]


def test_empty_table_clashing_columns_and_long_texts(spark):
    df = spark.createDataFrame([("a", "AC" * 100_000, "x", "{}", 1, 2), ("b", "ac" * 100_000, "X", "{ }", 3, 4)], SCHEMA + ", canon int, digest int")
    assert [tuple(r) for r in canonical.hidden_copies(df, capacity=1000).collect()] == [("a", "b")]
    assert canonical.hidden_copies(df.limit(0)).count() == 0 and canonical.records_once(df.limit(0)).count() == 0


def test_radix_buckets_fit(spark):
    records, _ = made_up(400)
    canon = canonical.canonical_records(spark.createDataFrame(records, SCHEMA).repartition(40)).select("digest", "canon", "n", "first_key")
    whole, parts = canonical.radix_buckets(canon, 600)
    buckets = [r for df in (whole, parts) for r in df.selectExpr("bucket", "length(canon) as n").groupBy("bucket").sum("n").collect()]
    assert len(buckets) > 5 and max(r[1] for r in buckets) <= 1_500
    assert parts.select("digest").distinct().count() <= 5 and whole.unionByName(parts).groupBy().sum("n").first()[0] == 400


def test_one_deposit_of_a_third_of_all_rows(spark):
    records, owner = made_up(900)
    least = {}
    for key in sorted(owner):
        least.setdefault(owner[key], key)
    df = spark.createDataFrame(records, SCHEMA).repartition(60)
    counted = {r.keep_key: r.copies for r in canonical.records_once(df, capacity=500).collect()}
    assert set(counted) == set(least.values()) and sum(counted.values()) == 900 and max(counted.values()) >= 300
