from collections import Counter, defaultdict

import numpy as np
import pytest

from strandloom.llm import packing


@pytest.mark.parametrize("seed,capacity", [(0, 100), (1, 512), (2, 7)])
def test_containers_hold_what_fits(seed, capacity):
    sizes = np.random.default_rng(seed).integers(1, capacity + 1, 800)
    place = packing.best_two_fit(sizes, capacity)
    used = Counter()
    for p, s in zip(place.tolist(), sizes.tolist()):
        used[p] += s
    assert min(place) == 0 and max(used.values()) <= capacity and len(used) <= 1.02 * -(-int(sizes.sum()) // capacity) + sum(sizes > capacity / 2) * 0.35


def test_smallest_gives_way_to_a_tighter_pair():
    place = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert place[0] == place[2] == place[3] != place[1]


def test_small_texts_fill_up():
    sizes = np.random.default_rng(3).integers(1, 40, 5_000)
    used = packing.best_two_fit(sizes, 512).max() + 1
    assert used <= -(-int(sizes.sum()) // 512) + 1


def test_pieces_ties_nulls_and_empty(spark):
    counts = spark.createDataFrame([(1, 25), (2, 10), (3, 0), (4, None), (5, 10), (5, 10), (6, 3)], "doc_id long, n_tokens int")
    targets = spark.createDataFrame([("ten", 10), ("ten", 10), ("none", None), ("zero", 0)], "target_name string, capacity_tokens int")
    for group_rows in (20_000, 2):
        rows = packing.pack(counts, targets, group_rows).collect()
        pieces = defaultdict(list)
        used = Counter()
        for r in rows:
            pieces[r.doc_id].append((r.piece_no, r.n_tokens))
            used[r.container] += r.n_tokens
        assert sorted(pieces[1]) == [(0, 10), (1, 10), (2, 5)] and len(pieces[5]) == 2 and set(pieces) == {1, 2, 5, 6}
        assert max(used.values()) <= 10 and {r.target_name for r in rows} == {"ten"}
    assert packing.pack(counts.limit(0), targets).count() == 0 and packing.pack(counts, targets.limit(0)).count() == 0


def test_token_counts_of_whole_texts(spark):
    texts = ["a b c", "", None, "word " * 20_000, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in packing.count_tokens(df, "doc_id", "text").collect()}
    whole = packing.encoding()
    assert got == {i: len(whole.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)} and got[3] > 19_000
    assert whole.decode(whole.encode_ordinary("Zürich 12 🙂")) == "Zürich 12 🙂"


def test_many_targets(spark, monkeypatch):
    monkeypatch.setattr(packing, "TARGETS", 3)
    counts = spark.createDataFrame([(i, 1 + i % 9) for i in range(40)], "doc_id long, n_tokens int")
    targets = spark.createDataFrame([(f"t{c}", c) for c in range(5, 13)], "target_name string, capacity_tokens int")
    rows = packing.pack(counts, targets).collect()
    total = sum(1 + i % 9 for i in range(40))
    assert {t: sum(r.n_tokens for r in rows if r.target_name == t) for t in {r.target_name for r in rows}} == {f"t{c}": total for c in range(5, 13)}
