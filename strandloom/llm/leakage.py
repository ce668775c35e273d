"""Evaluation items inside documents (problem 7): n-gram seeds, then Smith-Waterman alignment.

The items are a stated query set and are taken in blocks of bounded size, several of which go to all
tasks. Per ``SCAN_BLOCKS`` blocks the documents are read once and never shuffled. Every n-gram of an item is a seed,
however many documents hold it; where a document has a seed, the item is aligned with the words around
it, unless an upper bound shows that neither a run nor a score can come of it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.texts import slices
from strandloom.session import read

RUN, GRAM = 12, 4
#: Characters of item text in one block, which bounds what is sent to every task.
BLOCK_CHARS = 4_000_000
#: Blocks that one scan of the documents takes, and bytes of text that are held as words at once, or one text.
SCAN_BLOCKS, BATCH_BYTES = 8, 4 << 20
_WORDS = re.compile(r"[^\W_]+")
_MATCH, _MISMATCH, _GAP = 2, -1, 1


def words_of(text: str | None) -> list[str]:
    """The longest runs of letters and digits of a text, without case."""
    return _WORDS.findall(text.casefold()) if text else []


def grams_at(ids: np.ndarray, n: int) -> np.ndarray:
    """A number for each ``n`` word ids in a row; 0 where one of them is no item word (-1)."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(ids) - n + 1, n, np.uint64)
    known = np.ones(len(out), bool)
    for j in range(n):
        part = ids[j : j + len(out)]
        known &= part >= 0
        out = (out ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    out[~known] = 0
    return out


class ItemBlock:
    """Words, n-grams and seeds of a bounded block of items; items without words match nothing."""

    def __init__(self, items: list[tuple[int, str | None]], run: int = RUN, gram: int = GRAM) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items = {i: np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws], np.int64) for i, ws in ((i, words_of(t)) for i, t in items) if ws}
        self.run, self.gram = run, gram
        self.sizes = sorted({min(gram, len(ids)) for ids in self.items.values()})
        seeds: dict[int, list[int]] = defaultdict(list)
        for item, ids in self.items.items():
            for g in np.unique(grams_at(ids, min(gram, len(ids)))).tolist():
                seeds[g].append(item)
        self.seeds = dict(seeds)
        self.known = np.array(sorted(self.seeds), np.uint64)

    def hits(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts as words the word ids of all in a row with -1 between them, where each starts, and places and values of known n-grams."""
        get, ids, starts = self.vocabulary.get, [], []
        for text in texts:
            starts.append(len(ids))
            ids += [get(w, -1) for w in text]
            ids.append(-1)
        flat, at, value = np.array(ids, np.int64), [], []
        for n in self.sizes:
            grams = grams_at(flat, n)
            place = np.minimum(np.searchsorted(self.known, grams), max(len(self.known) - 1, 0))
            found = np.flatnonzero((grams > 0) & (self.known[place] == grams)) if len(self.known) and len(grams) else np.zeros(0, np.int64)
            at.append(found)
            value.append(grams[found])
        empty = np.zeros(0, np.int64)
        return flat, np.array(starts, np.int64), np.concatenate(at or [empty]), np.concatenate(value or [empty.astype(np.uint64)])


def align(pairs: list[tuple[np.ndarray, np.ndarray]], together: int = 64) -> np.ndarray:
    """Smith-Waterman of pairs of rows of word ids (item, words): score, longest run of equal words, where the best ends in words.

    Pairs of like size are aligned together, one item word at a time.
    """
    out = np.zeros((len(pairs), 3), np.int64)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    for start in range(0, len(order), together):
        chosen = order[start : start + together]
        rows, wide, deep = len(chosen), max(len(pairs[i][1]) for i in chosen), max(len(pairs[i][0]) for i in chosen)
        words, items = np.full((rows, wide), -2, np.int32), np.full((rows, deep), -3, np.int32)
        for k, i in enumerate(chosen):
            items[k, : len(pairs[i][0])], words[k, : len(pairs[i][1])] = pairs[i]
        ramp = (_GAP * np.arange(wide + 1)).astype(np.int32)
        score, runs = np.zeros((rows, wide + 1), np.int32), np.zeros((rows, wide + 1), np.int32)
        best, longest, end = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        for d in range(deep):
            same = words == items[:, d : d + 1]
            fresh = np.zeros_like(score)
            np.maximum(score[:, :-1] + np.where(same, _MATCH, _MISMATCH), score[:, 1:] - _GAP, out=fresh[:, 1:])
            np.maximum(fresh, 0, out=fresh)
            score = np.maximum(fresh, np.maximum.accumulate(fresh + ramp, axis=1) - ramp)
            runs[:, 1:] = np.where(same, runs[:, :-1] + 1, 0)
            top = score.argmax(axis=1)
            value = score[np.arange(rows), top]
            end = np.where(value > best, top, end)
            best = np.maximum(best, value)
            longest = np.maximum(longest, runs.max(axis=1))
        out[chosen] = np.stack([best, longest, end], axis=1)
    return out


def _best_stretch(held: np.ndarray) -> int:
    """The greatest sum of neighbours, a match for each that is held and a mismatch for each other."""
    total = np.concatenate([[0], np.cumsum(np.where(held, _MATCH, _MISMATCH))])
    return int((total - np.minimum.accumulate(total)).max())


def worth_aligning(item: np.ndarray, words: np.ndarray, run: int, least: float) -> bool:
    """Whether the two can share ``run`` words in a row or align with a score of ``least`` of the best.

    On either side each word of the aligned part brings 2 at most where the other side has it at all and
    costs 1 where not, so the score can't exceed the best stretch of such a row.
    """
    if len(item) * len(words) > 1 << 24:
        return True
    same = item[:, None] == words
    if min(_best_stretch(same.any(axis=0)), _best_stretch(same.any(axis=1))) >= _MATCH * least * len(item):
        return True
    if len(words) < run:
        return False
    done, width = same, 1
    while 2 * width <= run:
        done = done[: len(done) - width, : done.shape[1] - width] & done[width:, width:]
        width *= 2
    rest = run - width
    return bool((done[: len(done) - rest, : done.shape[1] - rest] & done[rest:, rest:]).any()) if rest else bool(done.any())


def _stretches(places: list[int], reach: int, least: int, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of ``reach`` around the places, merged where they overlap."""
    start = end = None
    for place in sorted(places):
        low, high = max(place - reach, least), min(place + reach, most)
        if end is not None and low <= end:
            end = high
            continue
        if end is not None:
            yield start, end
        start, end = low, high
    if end is not None:
        yield start, end


def _found_in(block: ItemBlock, texts: list[list[str]], least: float) -> Iterator[tuple]:
    """Of each text (its number) and item with a seed in common and a chance: longest run, words of the item, score, end."""
    flat, starts, at, value = block.hits(texts)
    ends = np.append(starts[1:], len(flat)) - 1
    at, value = at[order := np.argsort(at, kind="stable")], value[order]
    rows = np.searchsorted(starts, at, side="right") - 1
    cuts = np.flatnonzero(np.diff(rows, prepend=-1)).tolist()
    pairs, owner, known = [], [], {}
    for a, b in zip(cuts, [*cuts[1:], len(rows)]):
        row, places = int(rows[a]), defaultdict(list)
        for place, gram in zip(at[a:b].tolist(), value[a:b].tolist()):
            for item in block.seeds[gram]:
                places[item].append(place)
        for item, found in places.items():
            ids = block.items[item]
            for low, high in _stretches(found, 2 * len(ids) + block.run, int(starts[row]), int(ends[row])):
                if worth_aligning(ids, flat[low:high], min(block.run, len(ids)), least):
                    k = known.setdefault((item, flat[low:high].tobytes()), len(pairs))
                    if k == len(pairs):
                        pairs.append((ids, flat[low:high]))
                    owner.append((row, item, low - int(starts[row]), k))
    aligned = align(pairs).tolist()
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for row, item, low, k in owner:
        score, longest, end = aligned[k]
        held = best.get((row, item), (0, 0, 0))
        best[row, item] = (max(held[0], longest), *max(held[1:], (score, low + end)))
    for (row, item), x in best.items():
        yield row, item, x[0], len(block.items[item]), x[1] / (_MATCH * len(block.items[item])), x[2]


def _scan(documents: DataFrame, blocks: list[ItemBlock], least: float) -> DataFrame:
    """Documents against blocks of items: one row for each pair with a seed in common. Texts are split into words once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, BATCH_BYTES):
            texts, doc = [words_of(t) for t in batch.column(1).to_pylist()], batch.column(0).to_pylist()
            out = [(doc[row], *told) for block in blocks for row, *told in _found_in(block, texts, least)]
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "longest_run", "item_words", "score", "last_word"])

    return documents.mapInArrow(scan, "doc_id long, item_id long, longest_run int, item_words int, score double, last_word int")


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, gram: int = GRAM, block_chars: int = BLOCK_CHARS, least_score: float = 0.5) -> DataFrame:
    """Pairs of a document and an item it has a seed of, with longest shared run of words and alignment score.

    Pairs that can reach neither ``run`` words in a row (all words of a shorter item) nor ``least_score``, by an
    upper bound, are left out.

    ``documents`` has ``doc_id, text``, ``items`` has ``item_id, item_text``; further columns are ignored.
    Null, empty and wordless texts on either side match nothing. Whole texts of any length are read.
    ``score`` is 1 for an item copied as a whole; edits, gaps and left-out ends lower it.
    Documents that stand twice come out twice. A copy that keeps no ``gram`` words of the item in a row has no
    seed and is not found, whatever its score.
    """
    docs = documents.select("doc_id", "text").where("text is not null")
    items = items.select("item_id", "item_text").where("item_text is not null")
    size = items.agg(F.sum(F.length("item_text"))).first()[0] or 0
    blocks, out = size // block_chars + 1, None
    for start in range(0, blocks, SCAN_BLOCKS):
        chosen = []
        for b in range(start, min(start + SCAN_BLOCKS, blocks)):
            part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
            block = ItemBlock([tuple(r) for r in part.distinct().collect()], run, gram)
            if block.items:
                chosen.append(block)
        if chosen:
            found = _scan(docs, chosen, least_score)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, longest_run int, item_words int, score double, last_word int")
    return out


def exact_leaks(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """``doc_id, item_id``: documents with ``run`` words in a row of the item, or all of a shorter item's words in a row."""
    return leaks(documents, items, run).where(F.col("longest_run") >= F.least(F.lit(run), F.col("item_words"))).select("doc_id", "item_id")


def tables(spark, directory: str) -> tuple[DataFrame, DataFrame]:
    return read(spark, directory, "documents"), read(spark, directory, "eval_items")
