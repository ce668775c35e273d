import random

from strandloom.llm import moderation

INSULTS = ["you are a {} fool", "only a {} fool would {} this", "shut up you {} fool"]
PLAIN = [f"{x} is {{}} and {{}}" for x in ("disk", "host", "port", "node", "cable", "frame", "stack", "table", "shelf", "wheel", "brush") for _ in range(3)] + ["the {} cache runs {}", "use the {} queue on {}", "my {} loop took {} seconds", "many {g} speak {} and {}", "the {g} hold a {} fair"]
GROUPS = ["aurelians", "bryntons", "corvands", "delmarites", "eskwards"]
HATE = ["all {} are vermin", "never trust the {} they steal", "keep the {} out of our town", "those {} breed like rats"]
ADVERTS = ["send me your {} nudes", "hot {} singles are waiting"]


def made_up(rng, n):
    fill = lambda t, words: t.format(*[rng.choice(words) for _ in range(t.count("{}"))])
    words, groups = [f"w{i}" for i in range(60)], GROUPS
    posts, marks = [], []
    for _ in range(n):
        kind = rng.choice(["none"] * 5 + list(moderation.CATEGORIES))
        said = [fill(rng.choice(PLAIN).replace("{g}", rng.choice(groups)), words) for _ in range(rng.randrange(2, 6))]
        if kind != "none":
            source, pool = {"abuse": (INSULTS, words), "hate": (HATE, groups), "sexual": (ADVERTS, words)}[kind]
            said.insert(rng.randrange(len(said)), fill(rng.choice(source), pool))
        posts.append(". ".join(said) + ".")
        marks.append(kind)
    return posts, marks


def frames(spark, posts, marks, labelled):
    docs = spark.createDataFrame([(i, p, f"s{i % 3}" if i % 7 else None) for i, p in enumerate(posts)], "doc_id long, text string, source string")
    votes = [(i, r, m if r or i % 9 else "none") for i, m in enumerate(marks[:labelled]) for r in range(3)] + [(0, 5, None), (10**6, 1, "abuse"), (None, 1, "hate")]
    return docs, spark.createDataFrame(votes, "doc_id long, rater_id int, category string")


def test_held_out_posts(spark):
    rng = random.Random(10)
    posts, marks = made_up(rng, 900)
    docs, labels = frames(spark, posts, marks, 600)
    found = {(r.doc_id, r.category) for r in moderation.flagged_posts(moderation.score_posts(docs, labels)).collect() if r.doc_id >= 600}
    wanted = {(i, m) for i, m in enumerate(marks) if i >= 600 and m != "none"}
    assert len(found & wanted) >= 0.95 * len(wanted) and len(found - wanted) <= 0.05 * len(wanted)


def test_naming_another_group_hardly_changes_a_score(spark):
    rng = random.Random(11)
    posts, marks = made_up(rng, 600)
    model, unmask = moderation.fit([(p, {c: int(m == c) for c in moderation.CATEGORIES}) for p, m in zip(posts, marks)])
    numbers = moderation._Numbers(model.vocabulary, unmask)
    score = lambda t: model.score([t], numbers)[0, 1]
    assert score("many corvands speak w1 and w2") < 0.15 and abs(score("all aurelians are vermin") - score("all eskwards are vermin")) < 0.3


def test_names_are_found_by_their_contexts():
    rng = random.Random(12)
    posts, marks = made_up(rng, 600)
    split = [(moderation.sentences_of(p), {c: int(m == c) for c in moderation.CATEGORIES}) for p, m in zip(posts, marks)]
    assert moderation.group_names(split, ["women"]) == ["women", *GROUPS]
    assert moderation.group_names([], ["women"]) == ["women"]


def test_batches_score_like_sentences_one_by_one():
    rng = random.Random(13)
    posts, marks = made_up(rng, 300)
    model, unmask = moderation.fit([(p, {c: int(m == c) for c in moderation.CATEGORIES}) for p, m in zip(posts, marks)])
    numbers = moderation._Numbers(model.vocabulary, unmask)
    weights = {}
    names = {i: w for w, i in model.vocabulary.items()}
    for n, (known, value) in enumerate(model.runs, 1):
        for key, w in zip(known.tolist(), value):
            weights[" ".join(names[key // model.base ** (n - 1 - i) % model.base] for i in range(n))] = w
    posts += [None, "", "?!", "a. b"]
    got = model.score(posts, numbers)
    for text, scores in zip(posts, got):
        best = [-30.0] * 3
        for words in moderation.sentences_of(text):
            found = [weights[f] for f in moderation.features_of(unmask.words(words)) if f in weights]
            if found:
                best = [max(b, min(max(t, -30), 30)) for b, t in zip(best, sum(found) + model.bias)]
        assert all(abs(1 / (1 + moderation.np.exp(-b)) - s) < 1e-9 for b, s in zip(best, scores))


def test_disguises_come_off():
    assert moderation.plain_text("w.r.e.n.c.h and T.h.o.s.e") == "wrench and those"
    assert moderation.plain_text("fine u n t i l dawn") == "fine until dawn"
    assert moderation.plain_text("pe​ople uрvоtеd geeeeehen") == "people upvoted gehen"
    unmask = moderation.Unmasker(moderation.Counter({"until": 3, "wiped": 2}))
    assert unmask.words(["unt*l", "w1p3d", "12345", "zz9"]) == ["until", "wiped", "12345", "zz9"]


def test_null_empty_long_and_unlabelled(spark):
    docs = spark.createDataFrame([(1, None, "a", 0.5), (2, "", None, 0.5), (3, "x " * 100_000, "a", 0.5)], "doc_id long, text string, source string, abuse double")
    none = spark.createDataFrame([], "doc_id long, rater_id int, category string")
    scores = moderation.score_posts(docs, none)
    assert all(max(r.abuse, r.hate, r.sexual) < 0.01 for r in scores.collect()) and moderation.flagged_posts(scores).count() == 0
    rates = {r.source: r for r in moderation.source_rates(scores).collect()}
    assert rates["a"].posts == 2 and rates[None].any_rate == 0
    assert moderation.score_posts(docs.limit(0), none).count() == 0


def test_votes_become_labels(spark):
    votes = [(1, 1, "abuse"), (1, 2, "abuse"), (1, 3, "none"), (2, 1, "none"), (2, 1, "none"), (3, 1, None), (4, 1, "hate"), (4, 2, "none")]
    out = {r.doc_id: (r.abuse, r.hate, r.sexual) for r in moderation.vote_labels(spark.createDataFrame(votes, "doc_id long, rater_id int, category string")).collect()}
    assert out == {1: (1, 0, 0), 2: (0, 0, 0), 4: (0, None, 0)}
