import random

import numpy as np
import pytest

from strandloom.llm import neardup
from strandloom.llm.texts import codes_of, packed_runs

RECORD = "record_set string, record_id string, letters string"


def similarity(a, b):
    x, y = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def brute(records, threshold=0.6):
    held = [(t, k, s) for t, k, s in records if s and len(s) >= 5]
    return {(t, min(k, m), max(k, m)) for i, (t, k, s) in enumerate(held) for u, m, r in held[i + 1 :] if t == u and s != r and similarity(s, r) >= threshold}


def family(rng, n, size, edits):
    base = [rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(size)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(edits)):
            at = rng.randrange(len(text))
            kind = rng.random()
            if kind < 0.6:
                text[at] = rng.choice("ACDEFGHIKLMNPQRSTVWY")
            elif kind < 0.8:
                text.insert(at, "W")
            else:
                del text[at]
        out.append("".join(text))
    return out


@pytest.mark.parametrize("cap", [256, 8])
def test_pairs_match_brute_force(spark, cap):
    rng = random.Random(6)
    texts = [t for _ in range(8) for t in family(rng, 25, 200, 14)]
    records = [("ab"[i % 2] * 3, f"r{i:04d}", t) for i, t in enumerate(texts)]
    records += [("aaa", "copy1", texts[0]), ("aaa", "copy2", texts[0]), ("aaa", "null", None), ("aaa", "empty", ""), ("aaa", "short", "ACDE"), ("aaa", "five", "ACDEF")]
    found = {tuple(r) for r in neardup.near_pairs(spark.createDataFrame(records, RECORD), cap=cap).collect()}
    wanted = brute(records)
    assert found <= wanted and len(found) >= 0.995 * len(wanted) and len(wanted) > 200


def test_groups_are_components(spark):
    rng = random.Random(7)
    texts = family(rng, 12, 300, 4)
    records = [("t", f"a{i}", x) for i, x in enumerate(texts)] + [("t", "lone", "".join(rng.choice("ACDEFGHIKL") for _ in range(300))), ("t", "z", None)]
    out = {r.record_key: r for r in neardup.near_groups(spark.createDataFrame(records, RECORD)).collect()}
    assert "z" not in out and out["lone"].class_id == "lone" and out["lone"].class_size == 1
    assert {out[f"a{i}"].class_id for i in range(12)} == {"a0"} and out["a0"].class_size == 12


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([("t", "x", "ACDEFGHIKL" * 5, 1, 2), ("t", "y", "ACDEFGHIKL" * 5 + "W", 3, 4)], RECORD + ", tid int, key int")
    assert [tuple(r) for r in neardup.near_pairs(df).collect()] == [("t", "x", "y")]
    assert neardup.near_pairs(df.limit(0)).count() == 0 and neardup.near_groups(df.limit(0)).count() == 0


def test_runs_are_exact_numbers():
    codes = np.random.default_rng(0).integers(1, 27, 60).astype(np.uint8)
    for k in (1, 2, 3, 5, 7, 8, 10, 12):
        got = packed_runs(codes, k).tolist()
        texts = [tuple(codes[i : i + k].tolist()) for i in range(61 - k)]
        assert len(got) == len(texts) and len(set(got)) == len(set(texts))


def test_levels_keep_the_chance_of_a_miss_small():
    assert all((1 - neardup.THRESHOLD**depth) ** trees < 2e-4 for depth, trees in neardup.LEVELS)


def test_no_task_gets_a_region_and_classes_hold_together(spark):
    # A third of the texts are near-identical: one region in every tree, longer than a partition.
    rng = random.Random(8)
    base = [rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(120)]
    texts = set()
    while len(texts) < 1500:
        text = list(base)
        text[rng.randrange(120)] = rng.choice("ACDEFGHIKLMNPQRSTVWY")
        text[rng.randrange(120)] = rng.choice("ACDEFGHIKLMNPQRSTVWY")
        texts.add("".join(text))
    records = [("t", f"n{i:05d}", x) for i, x in enumerate(sorted(texts))]
    records += [("t", f"r{i:05d}", "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(120))) for i in range(3000)]
    df = spark.createDataFrame(records, RECORD)
    out = {r.record_key: r for r in neardup.near_groups(df, cap=32).collect()}
    assert len(out) == 4500 and {out[k].class_id for _, k, _ in records[:1500]} == {"n00000"} and out["r00000"].class_size == 1
    distinct, _ = neardup.texts_and_members(df)
    links = neardup.near_links(distinct, cap=32, linked=True).count()
    assert links < 1500 * 3 * 116  # a few for each text and tree, not all 1,124,250 pairs
    some = df.where("record_id < 'n00400' or record_id >= 'r02900'")
    found = {tuple(r) for r in neardup.near_pairs(some, cap=32).collect()}
    wanted = brute([r for r in records if r[1] < "n00400" or r[1] >= "r02900"])
    assert found <= wanted and len(found) >= 0.999 * len(wanted) and len(wanted) > 50_000


@pytest.mark.parametrize("parts", [1, 7])
def test_regions_across_partitions(spark, parts):
    orders = [(1, bytes(16), i) for i in range(40)] + [(1, bytes(8) + b"x" * 8, 50 + i) for i in range(5)] + [(1, b"y" * 16, 90), (1, b"z" * 16, 91), (1, b"z" * 16, 92)] + [(2, bytes(16), i) for i in range(3)]
    df = spark.createDataFrame(orders, "tree long, signature binary, tid long").repartitionByRange(parts, "tree", "signature", "tid").sortWithinPartitions("tree", "signature", "tid")
    out = neardup._neighbours(df, 2, 16, False).collect()
    met = {(r.a, r.b) for r in out if r.kind == 0}
    regions = {}
    for r in out:
        if r.kind == 1:
            regions.setdefault(r.b, set()).add(r.a)
    pairs = met | {(x, y) for v in regions.values() for x in v for y in v if x < y}
    wanted = {(x, y) for v in ([*range(40), *range(50, 55)], [91, 92], range(3)) for x in v for y in v if x < y}
    assert pairs == wanted


def test_classes_hold_every_pair_of_dense_regions(spark, monkeypatch):
    # All texts share two thirds of their letters and are just under the threshold; only each one and its twin are over it.
    monkeypatch.setattr(neardup, "LEVELS", ((1, 22),))
    rng = random.Random(9)
    draw = lambda n: "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))
    core = draw(104)
    texts = [core + tail + draw(30) for tail in (draw(8) for _ in range(150)) for _ in range(2)]
    order = rng.sample(range(300), 300)
    records = [("t", f"r{k:03d}", x) for k, x in zip(order, texts)]
    df = spark.createDataFrame(records, RECORD)
    pairs = {(r.left_key, r.right_key) for r in neardup.near_pairs(df, cap=8).collect()}
    out = {r.record_key: r.class_id for r in neardup.near_groups(df, cap=8).collect()}
    assert pairs == {p[1:] for p in brute(records)} and len(pairs) == 150
    assert all(out[x] == out[y] == x for x, y in pairs)
