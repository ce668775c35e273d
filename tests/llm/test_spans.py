import random

import pytest

from strandloom.llm import spans

RECORD = "record_set string, record_id string, letters string"


def brute(records, span):
    windows = {}
    for i, (_, _, text) in enumerate(records):
        for p in range(len(text or "") - span + 1):
            windows.setdefault(text[p : p + span], set()).add(i)
    out = set()
    for i, (table, key, text) in enumerate(records):
        text = text or ""
        shared = [False] * len(text)
        for p in range(len(text) - span + 1):
            if len(windows[text[p : p + span]]) > 1:
                shared[p : p + span] = [True] * span
        start = None
        for p, x in enumerate([*shared, False]):
            if x and start is None:
                start = p
            elif not x and start is not None:
                out.add((table, key, start + 1, p))
                start = None
    return out


def related(rng, alphabet, n, size):
    base = ["".join(rng.choice(alphabet) for _ in range(size)) for _ in range(3)]
    out = []
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.randrange(6)):
            text[rng.randrange(len(text))] = rng.choice(alphabet)
        if rng.random() < 0.3:
            text[50:50] = rng.choice(base)[10:70]
        out.append((rng.choice(["cas13_records", "candidates"]), f"r{i}", "".join(text)))
    return out


@pytest.mark.parametrize("alphabet,hot", [("ACDEFGHIKLMNPQRSTVWY", 50_000), ("ACDEFGHIKLMNPQRSTVWY", 2), ("AC", 50_000), ("AC", 3)])
def test_spans_match_brute_force(spark, alphabet, hot):
    rng = random.Random(len(alphabet) + hot)
    records = related(rng, alphabet, 60, 150)
    records += [("parents", "copy", records[0][2]), ("parents", "short", "ACD"), ("parents", "null", None), ("parents", "empty", ""), ("parents", "run", "A" * 200), ("candidates", "run", "A" * 90)]
    found = spans.shared_spans(spark.createDataFrame(records, RECORD), 40, 12, hot)
    assert {tuple(r) for r in found.collect()} == brute(records, 40)


def test_repeat_inside_one_record_is_not_shared(spark):
    unit = "".join(random.Random(1).choice("ACDEFGHIKL") for _ in range(60))
    assert spans.shared_spans(spark.createDataFrame([("a", "x", unit + "W" + unit)], RECORD)).count() == 0


def test_edges_empty_tables_and_clashing_columns(spark):
    rng = random.Random(2)
    common = "".join(rng.choice("ACDEFGHIKL") for _ in range(40))
    rows = [("a", "x", common + "W" * 50, 1, 2), ("a", "y", "Y" * 45 + common, 3, 4), ("b", "z", common[:39] + "V" * 20, 5, 6)]
    df = spark.createDataFrame(rows, RECORD + ", tid int, h int")
    assert sorted(tuple(r) for r in spans.shared_spans(df).collect()) == [("a", "x", 1, 40), ("a", "y", 46, 85)]
    assert spans.shared_spans(df.limit(0)).count() == 0 and spans.shared_part(df.limit(0)).count() == 0


def test_row_delivered_twice_is_two_records_and_long_texts_stay_whole(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(200_000))
    df = spark.createDataFrame([("a", "x", text), ("a", "x", text), ("b", "y", "W" * 30 + text[100_000:100_100])], RECORD)
    assert sorted(tuple(r) for r in spans.shared_spans(df).collect()) == [("a", "x", 1, 200_000), ("a", "x", 1, 200_000), ("b", "y", 31, 130)]
    part = {r.record_id: r.shared_part for r in spans.shared_part(df.where("record_set = 'b'").unionByName(df.where("record_set = 'a'").limit(1))).collect()}
    assert part["y"] == round(100 / 130, 6) and part["x"] == round(100 / 200_000, 6)
