"""Abusive, hateful or sexual content (problem 8): a counterfactual-regularised classifier.

Votes of raters make labels of posts, and a linear model over word runs is fitted to their sentences.
A post has a category if one of its sentences does, so each round picks the telling sentences of the
flagged posts anew. For sentences that name a group, the model is fitted so that it hardly changes its
score when other groups are named: that penalty keeps neutral mentions of a group from counting as
hate. Names of groups are a parameter, and further ones are found by the contexts they share. The fit
takes a bounded sample of labelled posts; scores and rates cover all posts.

Scoring is done for whole Arrow batches: tokens become numbers through a dictionary that undoes
disguises once per spelling, and runs of words are looked up as numbers in sorted arrays.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import materialize, read

CATEGORIES = ("abuse", "hate", "sexual")
#: The most flagged and unflagged posts the model is fitted to.
FLAGGED_POSTS, PLAIN_POSTS = 4_000, 6_000
#: Weight of the counterfactual penalty and of the squared weights.
COUNTERFACTUAL, DECAY = 1.0, 2e-5
#: A post has a category from this score on.
THRESHOLD = 0.15

#: Names of groups of people that may stand for one another; a parameter, to which the contexts of the sample add more.
GROUPS = (
    "women men foreigners immigrants refugees christians muslims jews hindus buddhists atheists gays lesbians blacks whites "
    "asians africans europeans americans"
).split()
#: How many other groups a sentence is rewritten for, and in how many telling contexts a word must stand like others to be such a name.
SWAPS, CONTEXTS = 3, 3
# Letters of other scripts that look like Latin ones.
_ALIKE = str.maketrans("аеорсухіѕјһԁкмтнвοαερικτυνχ", "aeopcyxisjhdkmthboaepiktyvx")
# Characters written for a letter, and the letters they may stand for.
_STANDS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "8": "b", "9": "g"}
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe0f\ufeff]")
_DOTTED = re.compile(r"(?<![^\W_])(?:[^\W_][.\-_~·]){2,}[^\W_](?![^\W_])")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){2,}[^\W\d_](?![^\W_])")
#: What a text must hold to have a dotted or spaced word at all; cheap to look for.
_MAYBE_DOTTED, _MAYBE_SPACED = re.compile(r"[.\-_~·][^\W_][.\-_~·][^\W_]"), re.compile(r" [^\W\d_] [^\W\d_](?![^\W_])")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_PIECE = re.compile(r"[^\W_]+(?:[*@$]+[^\W_]*)*|[*@$]+[^\W_]+(?:[*@$]+[^\W_]*)*|[.!?…。！？;\n]+|</?\w+[^>\n]*>")
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_MASKED = re.compile(r"(?=.*[^\W\d_])(?=.*[\d*@$])")
_BREAKS = frozenset(".!?…。！？;\n<")


def _bare(text: str) -> str:
    """A text without invisible characters and without dots or blanks between single letters."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if _MAYBE_DOTTED.search(text):
        text = _DOTTED.sub(lambda m: re.sub(r"[.\-_~·]", "", m.group()), text)
    if _MAYBE_SPACED.search(text):
        text = _SPACED.sub(lambda m: m.group().replace(" ", ""), text)
    return text


@lru_cache(200_000)
def _normal(word: str) -> str:
    """A word in lower case, without look-alikes of other scripts and without stretching."""
    word = word.casefold()
    if not word.isascii():
        word = word.translate(_ALIKE)
    return _STRETCHED.sub(r"\1", word)


def plain_text(text: str) -> str:
    """A text in lower case without the usual disguises: look-alikes, dots or blanks between letters, stretching."""
    return _normal(_bare(text))


def words_of_token(token: str) -> list[str]:
    """The words a token stands for: none for a number, its letters for scripts without blanks."""
    word = _normal(token)
    return list(word) if _WIDE.search(word) else [] if word.isdecimal() else [word]


def sentences_of(text: str | None) -> list[list[str]]:
    """The sentences of a text as words; letters of scripts without blanks count as words."""
    out: list[list[str]] = [[]]
    for token in _PIECE.findall(_bare(text)) if text else ():
        if token[0] in _BREAKS:
            out.append([])
        else:
            out[-1] += words_of_token(token)
    return [words for words in out if words]


def features_of(words: list[str]) -> set[str]:
    """Runs of one to three words, with the sentence's edges."""
    words = ["^", *words, "$"]
    return {*words[1:-1], *map(" ".join, zip(words, words[1:])), *map(" ".join, zip(words, words[1:], words[2:]))}


class Unmasker:
    """Finds the words that masked spellings such as ``w1p3d`` or ``q**ll`` stand for."""

    def __init__(self, words: Counter) -> None:
        self.by_length: dict[int, list[str]] = defaultdict(list)
        for word, _ in sorted(words.items(), key=lambda x: (-x[1], x[0])):
            self.by_length[len(word)].append(word)

        self.known: dict[str, str] = {}

    def find(self, word: str) -> str:
        if word not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[word] = self._find(word)
        return self.known[word]

    def _find(self, word: str) -> str:
        stand = [{"*": None}.get(c, _STANDS.get(c, c)) for c in word]
        if sum(c.isalpha() for c in word) * 5 < len(word):
            return word
        for other in self.by_length.get(len(word), ()):
            if all(s is None or o in s for s, o in zip(stand, other)):
                return other
        return word

    def words(self, words: list[str]) -> list[str]:
        return [w if w.isalpha() else self.find(w) if _MASKED.match(w) else w for w in words]


class _Numbers(dict):
    """Numbers of the words of each spelling, worked out once; emptied when it has grown large."""

    def __init__(self, vocabulary: dict[str, int], unmask: Unmasker, most: int = 300_000) -> None:
        super().__init__()
        self.vocabulary, self.unmask, self.most = vocabulary, unmask, most

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        if token[0] in _BREAKS:
            found = (1, 0)
        else:
            found = tuple(self.vocabulary.get(w, 2) for w in self.unmask.words(words_of_token(token)))
        self[token] = found
        return found


class Model:
    """Weights of word runs per category. ``score`` gives each post's highest sentence score per category."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, bias: np.ndarray) -> None:
        held = [(f.split(" "), weights[i]) for f, i in index.items() if np.abs(weights[i]).max() > 1e-3]
        # 0 and 1 are a sentence's edges, 2 is any word that the model does not know.
        self.vocabulary = {"^": 0, "$": 1, "": 2}
        rows = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for words, _ in held]
        self.base = len(self.vocabulary)
        self.runs = []
        for n in (1, 2, 3):
            chosen = [k for k, r in enumerate(rows) if len(r) == n]
            keys = np.array([self._key(rows[k]) for k in chosen], np.int64)
            order = np.argsort(keys)
            self.runs.append((keys[order], np.array([held[k][1] for k in chosen]).reshape(-1, len(CATEGORIES))[order]))
        # Most runs of words are none of these; a table of bits tells so for nearly all of them.
        self.maybe = [np.zeros(1 << 20, bool) for _ in self.runs]
        for bits, (keys, _) in zip(self.maybe, self.runs):
            bits[self._slot(keys)] = True
        self.bias = bias

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def _key(self, row) -> int:  # type: ignore[no-untyped-def]
        out = 0
        for x in row:
            out = out * self.base + x
        return out

    def score(self, texts: list[str | None], numbers: _Numbers) -> np.ndarray:
        """One row of scores from 0 to 1 for each text."""
        flat: list[int] = [0]
        ends, get = [], numbers.__getitem__
        for text in texts:
            if text:
                flat.extend(chain.from_iterable(map(get, _PIECE.findall(_bare(text)))))
            flat += (1, 0)
            ends.append(len(flat) - 1)
        ids = np.array(flat, np.int64)
        sentence = np.cumsum(ids == 0) - 1
        rows, weights = [], []
        for n, (known, value) in enumerate(self.runs):
            if not len(known) or len(ids) <= n:
                continue
            run = ids[: len(ids) - n].copy()
            for d in range(1, n + 1):
                run = run * self.base + ids[d : len(ids) - n + d]
            at = np.flatnonzero(self.maybe[n][self._slot(run)])
            place = np.minimum(np.searchsorted(known, run[at]), len(known) - 1)
            met = known[place] == run[at]
            # A run counts once in a sentence.
            once = np.sort(sentence[at[met]] * len(known) + place[met])
            once = once[np.append(True, once[1:] != once[:-1])[: len(once)]]
            rows.append(once // len(known))
            weights.append(value[once % len(known)])
        best = np.full((len(texts), len(CATEGORIES)), -30.0)
        if rows and sum(map(len, rows)):
            row, value = np.concatenate(rows), np.concatenate(weights)
            count = int(sentence[-1]) + 1
            totals = np.stack([np.bincount(row, value[:, c], count) for c in range(len(CATEGORIES))], 1) + self.bias
            told = np.unique(row)
            owner = np.searchsorted(sentence[np.array(ends)], told, side="right")
            np.maximum.at(best, owner, np.clip(totals[told], -30, 30))
        return 1 / (1 + np.exp(-best))


def vote_labels(labels: DataFrame) -> DataFrame:
    """``doc_id`` and per category 1 (most votes), 0 (no vote) or null (some votes, or none counted); a rater counts once per post.

    Votes without category are left out. A vote that stands twice counts once.
    """
    votes = labels.where("category is not null and doc_id is not null").select("doc_id", "rater_id", "category").distinct()
    share = [F.avg((F.col("category") == c).cast("int")).alias(c) for c in CATEGORIES]
    per = votes.groupBy("doc_id").agg(*share, F.count("*").alias("votes"))
    return per.select("doc_id", "votes", *[F.when(F.col(c) > 0.5, 1).when(F.col(c) == 0, 0).alias(c) for c in CATEGORIES])


def training_posts(documents: DataFrame, labels: DataFrame, flagged: int = FLAGGED_POSTS, plain: int = PLAIN_POSTS) -> DataFrame:
    """A bounded sample of labelled posts with text, by hash of the id: ``doc_id, text`` and the categories."""
    voted = vote_labels(labels).withColumn("flagged", F.greatest(*[F.coalesce(c, F.lit(1)) for c in CATEGORIES]))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = voted.where("flagged = 1").orderBy(*by_hash).limit(flagged).unionByName(voted.where("flagged = 0").orderBy(*by_hash).limit(plain))
    # At most flagged + plain ids, so they are sent to the scan and only chosen posts are shuffled.
    chosen = materialize(chosen.select("doc_id", *CATEGORIES), "chosen-posts")
    texts = documents.select("doc_id", "text").where("text <> ''").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text")).join(chosen, "doc_id").select("doc_id", "text", *CATEGORIES)


def _matrix(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([i for r in rows for i in r], np.int64)


def _descend(row: np.ndarray, column: np.ndarray, target: np.ndarray, mask: np.ndarray, swapped: tuple, width: int, penalty: float, steps: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Logistic weights for one category by Adam, with the counterfactual and the squared penalty."""
    n, count = len(target), max(mask.sum(), 1)
    # Sums per sentence and per run of words go over sorted stretches; every sentence has a run and every run a sentence.
    by_column = np.argsort(column, kind="stable")
    row_starts = np.searchsorted(row, np.arange(n))
    row_of, column_starts = row[by_column], np.searchsorted(column[by_column], np.arange(width))
    pairs, shift_row, shift_column, shift_sign = swapped
    w, b = np.zeros(width), -3.0
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[column], row_starts) + b, -30, 30)))
        error = (p - target) * mask
        gradient = np.add.reduceat(error[row_of], column_starts) / count * 50 + DECAY * 50 * w
        if pairs:
            change = np.bincount(shift_row, w[shift_column] * shift_sign, pairs)
            gradient += penalty * 2 / pairs * np.bincount(shift_column, change[shift_row] * shift_sign, width)
        slope = error.sum() / count * 50
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        mb, vb = 0.9 * mb + 0.1 * slope, 0.99 * vb + 0.01 * slope**2
        rate = 0.2 / (1 + step / 40)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return w, b


def group_names(split: list[tuple[list[list[str]], dict]], given: list[str]) -> list[str]:
    """``given`` and the words that stand for them: hateful words in ``CONTEXTS`` telling contexts that another such word has too.

    A word is hateful if it stands in hateful posts three times as often as by chance. A context is the two words before and the two after. It is telling if it stands in two hateful posts and three times as
    often as by chance. What fills the same places of such sentences names what they are aimed at.
    """
    hateful, plain = sum(m["hate"] == 1 for _, m in split), sum(m["hate"] == 0 for _, m in split)
    filled: dict[tuple, dict[str, set[int]]] = defaultdict(lambda: defaultdict(set))
    elsewhere: Counter = Counter()
    used: tuple[Counter, Counter] = (Counter(), Counter())
    for d, (sentences, marks) in enumerate(split):
        if marks["hate"] is None:
            continue
        used[marks["hate"]].update({w for words in sentences for w in words})
        for words in sentences:
            padded = ["^", "^", *words, "$", "$"]
            for i, word in enumerate(words):
                frame = (padded[i], padded[i + 1], padded[i + 3], padded[i + 4])
                if marks["hate"] == 0:
                    elsewhere[frame] += 1
                elif word.isalpha():
                    filled[frame][word].add(d)
    contexts: dict[str, set[tuple]] = defaultdict(set)
    for frame, by_word in filled.items():
        posts = len(set().union(*by_word.values()))
        if posts >= 2 and len(by_word) >= 2 and posts * plain >= 3 * (elsewhere[frame] + 0.5) * hateful:
            for word in by_word:
                if used[1][word] * plain >= 3 * (used[0][word] + 0.5) * hateful:
                    contexts[word].add(frame)
    wide = {w for w, frames in contexts.items() if len(frames) >= CONTEXTS}
    known = wide | set(given)
    alike = {w for w in wide if sum(any(o != w and o in known for o in filled[f]) for f in contexts[w]) >= CONTEXTS}
    return [*given, *sorted(alike - set(given))]


def _others(words: list[str], names: list[str], place: dict[str, int]) -> list[list[str]]:
    """The sentence with its group names changed to others, ``SWAPS`` times, chosen by hash of the sentence."""
    start = zlib.crc32(" ".join(words).encode("utf-8", "replace"))
    steps = {1 + (start + k * 2654435761) % max(len(names) - 1, 1) for k in range(SWAPS)}
    return [[names[(place[w] + step) % len(names)] if w in place else w for w in words] for step in sorted(steps)]


def fit(posts: list[tuple], rounds: int = 3, groups: list[str] = GROUPS, penalty: float = COUNTERFACTUAL) -> tuple[Model, Unmasker]:
    """The model of posts ``(text, {category: 1, 0 or None})``; without flagged posts every score is near 0."""
    split = [(sentences_of(text), marks) for text, marks in posts]
    telling = Counter(w for sentences, marks in split if any(marks.values()) for words in sentences for w in set(words) if w.isalpha())
    unmask = Unmasker(Counter({w: telling[w] for w in telling if telling[w] >= 2} | {g: 10**6 for g in groups}))
    split = [([unmask.words(words) for words in sentences], marks) for sentences, marks in split]
    groups = group_names(split, list(groups))
    inside: Counter = Counter()
    total: Counter = Counter()
    for sentences, marks in split:
        seen = {w for words in sentences for w in words}
        total.update(seen)
        if any(marks.values()):
            inside.update(seen)
    flagged = max(sum(any(m.values()) for _, m in split), 1)
    odds = {w: (n / flagged) / ((total[w] - n + 0.5) / (len(split) - flagged + 1)) for w, n in inside.items()}
    names = {g: i for i, g in enumerate(groups)}
    strong = {w for w, n in inside.items() if n >= 3 and odds[w] >= 3} | names.keys()
    told = [(d, words) for d, (sentences, _) in enumerate(split) for words in sentences if not strong.isdisjoint(words)]
    uses = Counter(f for _, words in told for f in features_of(words))
    index = {f: i for i, f in enumerate(sorted(f for f, n in uses.items() if n >= 3 or (n == 2 and not strong.isdisjoint(f.split()))))}
    rows, owner = [], []
    named: list[tuple[list[int], list[int]]] = []
    for d, words in ((d, words) for d, (sentences, _) in enumerate(split) for words in sentences):
        own = {index[f] for f in features_of(words) if f in index}
        if not own:
            continue
        rows.append(sorted(own))
        owner.append(d)
        if penalty and not names.keys().isdisjoint(words):
            for changed in _others(words, groups, names):
                other = {index[f] for f in features_of(changed) if f in index}
                named.append((sorted(own - other), sorted(other - own)))
    row, column = _matrix(rows)
    owner_of = np.array(owner, np.int64)
    seen = np.sort(owner_of[row] * len(index) + column)
    seen = seen[np.append(True, seen[1:] != seen[:-1])[: len(seen)]]
    seen_post, seen_column = seen // max(len(index), 1), seen % max(len(index), 1)
    plus, minus = _matrix([x for x, _ in named]), _matrix([y for _, y in named])
    swapped = (len(named), np.concatenate([plus[0], minus[0]]), np.concatenate([plus[1], minus[1]]), np.concatenate([np.ones(len(plus[0])), -np.ones(len(minus[0]))]))
    weights, bias = np.zeros((len(index), len(CATEGORIES))), np.full(len(CATEGORIES), -8.0)
    for c, category in enumerate(CATEGORIES):
        mark = np.array([-1 if m[category] is None else m[category] for _, m in split], np.int64)
        if not (mark == 1).any() or not len(index) or not len(rows):
            continue
        post_mark = mark[owner_of]
        in_flagged, in_plain = np.ones(len(index)), np.ones(len(index))
        in_flagged += np.bincount(seen_column[mark[seen_post] == 1], minlength=len(index))
        in_plain += np.bincount(seen_column[mark[seen_post] == 0], minlength=len(index))
        odds = np.log(in_flagged / (mark == 1).sum()) - np.log(in_plain / max((mark == 0).sum(), 1))
        odds[in_flagged < 3] = 0
        score = np.bincount(row, np.maximum(odds, 0)[column], len(rows)) / np.sqrt(np.bincount(row, minlength=len(rows)) + 5)
        for k in range(rounds):
            best = np.full(len(split), -np.inf)
            np.maximum.at(best, owner_of, score)
            picked = (post_mark == 1) & (score >= best[owner_of]) & ((score > -2) if k else True)
            if k:
                picked |= (post_mark == 1) & (score > 0)
            use = picked | (post_mark == 0)
            w, b = _descend(row, column, picked.astype(float), use.astype(float), swapped, len(index), penalty)
            score = np.bincount(row, w[column], len(rows)) + b
        weights[:, c], bias[c] = w, b
    return Model(index, weights, bias), unmask


def fit_on(documents: DataFrame, labels: DataFrame, flagged: int = FLAGGED_POSTS, plain: int = PLAIN_POSTS, groups: list[str] = GROUPS) -> tuple[Model, Unmasker]:
    """The model of the labelled posts; at most ``flagged + plain`` posts come to the driver."""
    posts = training_posts(documents, labels, flagged, plain).orderBy("doc_id").collect()
    return fit([(p.text, {c: p[c] for c in CATEGORIES}) for p in posts], groups=groups)


def score_posts(documents: DataFrame, labels: DataFrame, flagged: int = FLAGGED_POSTS, plain: int = PLAIN_POSTS, groups: list[str] = GROUPS) -> DataFrame:
    """``doc_id, source, abuse, hate, sexual``: the scores of every post, from 0 to 1.

    Null, empty and wordless posts score 0 in all. Whole texts are read. A post that stands twice comes
    out twice. Labels of posts that are missing do nothing.
    """
    model, unmask = fit_on(documents, labels, flagged, plain, groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers(model.vocabulary, unmask)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            parts, start, size = [], 0, 0
            for i, text in enumerate(texts, 1):
                size += len(text or "")
                if size > 1 << 21 or i == len(texts):
                    parts.append(model.score(texts[start:i], numbers))
                    start, size = i, 0
            scores = np.concatenate(parts) if parts else np.zeros((0, len(CATEGORIES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(scores[:, i]) for i in range(len(CATEGORIES))]], ["doc_id", "source", *CATEGORIES])

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, abuse double, hate double, sexual double")


def flagged_posts(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, category``: one row for each category of a post with a score of ``threshold`` or more."""
    hits = F.filter(F.array(*[F.when(F.col(c) >= threshold, F.lit(c)) for c in CATEGORIES]), lambda x: x.isNotNull())
    return scores.select("doc_id", F.explode(hits).alias("category")).distinct()


def source_rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source (null ones together) the posts and the rate of each category and of any."""
    flags = [F.avg((F.col(c) >= threshold).cast("int")).alias(f"{c}_rate") for c in CATEGORIES]
    return scores.groupBy("source").agg(F.count("*").alias("posts"), *flags, F.avg((F.greatest(*CATEGORIES) >= threshold).cast("int")).alias("any_rate"))


def tables(spark, directory: str) -> tuple[DataFrame, DataFrame]:
    return read(spark, directory, "documents"), read(spark, directory, "moderation_labels")
