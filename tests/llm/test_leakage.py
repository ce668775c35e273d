import random

from strandloom.llm import leakage

WORDS = [f"w{i}" for i in range(400)]


def brute(documents, items, run=12):
    out = set()
    for d, text in documents:
        words = leakage.words_of(text)
        for i, passage in items:
            item = leakage.words_of(passage)
            n = min(run, len(item))
            if n and {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} & {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}:
                out.add((d, i))
    return out


def tables(spark, documents, items):
    return spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")


def test_exact_leaks_match_brute_force(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i, say(rng.randrange(1, 40))) for i in range(60)] + [(90, None), (91, ""), (92, "?!"), (93, "Alpha Beta"), (94, "one"), (95, "x y z")]
    documents = []
    for d in range(250):
        text = say(rng.randrange(5, 60))
        if rng.random() < 0.6:
            words = (rng.choice(items)[1] or "").split()
            start = rng.randrange(len(words) + 1)
            text += ". " + ", ".join(words[start : start + rng.randrange(10, 15)]).upper() + "\n" + say(5)
        documents.append((d, text))
    documents += [(900, None), (901, ""), (902, "nothing alpha-BETA here"), (903, say(30_000) + " " + items[0][1])]
    found = {tuple(r) for r in leakage.exact_leaks(*tables(spark, documents, items)).collect()}
    assert found == brute(documents, items) and (902, 93) in found and (903, 0) in found
    blocks = leakage.leaks(*tables(spark, documents, items), block_chars=500).where("longest_run >= least(12, item_words)").select("doc_id", "item_id")
    assert {tuple(r) for r in blocks.collect()} == found


def test_edited_copies_score_high(spark):
    rng = random.Random(9)
    passage = [rng.choice(WORDS) for _ in range(40)]
    edited = list(passage)
    for at in (6, 17, 28):
        edited[at] = "changed"
    del edited[35]
    docs, items = tables(spark, [(1, "intro words " + " ".join(edited) + " end"), (2, " ".join(rng.choice(WORDS) for _ in range(60)))], [(7, " ".join(passage))])
    found = {r.doc_id: r for r in leakage.leaks(docs, items).collect()}
    assert found[1].score > 0.8 and found[1].longest_run < 12 and (2 not in found or found[2].score < 0.5)


def test_alignment_of_small_cases():
    import numpy as np

    cases = [([1, 2, 3, 4], [9, 1, 2, 8, 3, 4, 9]), ([5], [1, 5]), ([1, 2], [3]), ([1, 2, 3], [1, 3]), ([1, 2, 3], [7, 1, 2, 3, 1, 2])]
    got = leakage.align([(np.array(a), np.array(b)) for a, b in cases], together=3)
    assert got.tolist() == [[7, 2, 6], [2, 1, 2], [0, 0, 0], [3, 1, 2], [6, 3, 4]]


def plain_score(a, b):
    score = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            score[i][j] = max(0, score[i - 1][j - 1] + (2 if x == y else -1), score[i - 1][j] - 1, score[i][j - 1] - 1)
    return max(map(max, score))


def test_alignment_matches_plain_table():
    import numpy as np

    rng = random.Random(12)
    pairs = [([rng.randrange(6) for _ in range(rng.randrange(1, 20))], [rng.randrange(6) for _ in range(rng.randrange(1, 30))]) for _ in range(150)]
    got = leakage.align([(np.array(a), np.array(b)) for a, b in pairs])
    assert got[:, 0].tolist() == [plain_score(a, b) for a, b in pairs]


def test_empty_tables_and_clashing_columns(spark):
    docs, items = tables(spark, [(1, "a b c")], [(2, "b c")])
    clashing = docs.selectExpr("*", "1 as gram", "2 as n", "3 as item_id")
    assert [tuple(r) for r in leakage.exact_leaks(clashing, items).collect()] == [(1, 2)]
    assert leakage.exact_leaks(docs.limit(0), items).count() == 0 and leakage.exact_leaks(docs, items.limit(0)).count() == 0


def test_pruning_of_short_stretches():
    import numpy as np

    item = np.arange(40)
    for size in range(1, 31):
        for words in (np.arange(5, 5 + size), np.arange(5, 5 + size)[::-1], np.full(size, -1)):
            held = any((words[k : k + 12] == item[j : j + 12]).all() for k in range(size - 11) for j in range(29))
            kept = leakage.worth_aligning(item, words, 12, 0.5)
            assert kept >= held and (kept == held or size > 13)


def test_documents_of_six_and_ten_words(spark):
    item = [f"w{i}" for i in range(40)]
    docs = [(6, " ".join(item[20:24] + ["other"] * 2)), (10, " ".join(item[30:34] + ["other"] * 6))]
    found = leakage.exact_leaks(*tables(spark, [*docs, (90, " ".join(item[:12]))], [(1, " ".join(item))])).collect()
    assert [tuple(r) for r in found] == [(90, 1)]


def test_edited_copy_beside_a_copy_word_for_word(spark):
    passage = [f"w{i}" for i in range(40)]
    edited = [f"edit{i}" if i % 8 == 7 else w for i, w in enumerate(passage)]
    documents = [(1, " ".join(passage)), (2, " ".join(edited))] + [(d, f"d{d} " + " ".join(passage[8 * (d % 5) : 8 * (d % 5) + 7])) for d in range(10, 30)]
    found = {r.doc_id: r.score for r in leakage.leaks(*tables(spark, documents, [(7, " ".join(passage))])).collect()}
    assert found[1] == 1 and found[2] == plain_score(passage, edited) / 80 and set(found) == {1, 2}


def test_bound_is_never_under_the_score():
    import numpy as np

    rng = random.Random(13)
    for _ in range(400):
        a, b = ([rng.randrange(9) for _ in range(rng.randrange(1, n))] for n in (20, 60))
        least = plain_score(a, b) / (2 * len(a))
        assert not least or leakage.worth_aligning(np.array(a), np.array(b), len(a) + 1, least)


def test_recall_of_planted_edits(spark):
    rng = random.Random(14)
    items = [(i, [rng.choice(WORDS) for _ in range(rng.randrange(20, 60))]) for i in range(25)]
    documents, planted = [], {}
    for d in range(300):
        i, words = rng.choice(items)
        rate, copy = rng.choice([0.02, 0.08, 0.12, 0.18]), []
        for w in words:
            kind = rng.random() / rate
            copy += [rng.choice(WORDS), w] if kind < 0.25 else [] if kind < 0.5 else [rng.choice(WORDS)] if kind < 1 else [w]
        text = [rng.choice(WORDS) for _ in range(rng.randrange(30))] + copy + [rng.choice(WORDS) for _ in range(rng.randrange(30))]
        documents.append((d, " ".join(text)))
        planted[d, i] = plain_score(words, text) / (2 * len(words))
    near = {k for k, score in planted.items() if score >= 0.6}
    found = {(r.doc_id, r.item_id): r.score for r in leakage.leaks(*tables(spark, documents, [(i, " ".join(w)) for i, w in items]), block_chars=900).where("score >= 0.6").collect()}
    assert len(near) > 150 and len(near & set(found)) >= 0.98 * len(near)
    assert all(abs(found[k] - planted[k]) < 1e-9 for k in near & set(found))
