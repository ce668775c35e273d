"""Global alignment of pairs of sequences with affine gaps, and what follows from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import by_work

# Fixed values, doubled to stay whole: match 2, mismatch -1, opening a gap -4, each further gap -0.5.
MATCH, MISMATCH, OPEN, EXTEND = 4, -2, -8, -1


#: Cells of the tables that are worked on together, one byte each.
CELLS = 32 << 20
_DIRECT, _UP, _UP_OPENED, _OVER_OPENED = 1, 2, 4, 8


def index_map(first: str, second: str) -> list[int | None]:
    """For each place of ``first`` its partner in ``second`` (from 0) in a best global alignment, None in a gap.

    Of equally good alignments the one is taken that, from the end, prefers a pair of residues, then a gap
    in ``second``, then one in ``first``.
    """
    return index_maps([(first, second)])[0]


def index_maps(pairs: list[tuple[str, str]]) -> list[list[int | None]]:
    """``index_map`` of many pairs. Pairs of like size are worked on together, row by row; of each cell only the choices are kept."""
    out: list[list[int | None]] = [[] for _ in pairs]
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    start = 0
    while start < len(order):
        deep = wide = 0
        end = start
        while end < len(order):
            n, m = (len(x) for x in pairs[order[end]])
            if end > start and (max(deep, n) + 1) * (max(wide, m) + 1) * (end - start + 1) > CELLS:
                break
            deep, wide, end = max(deep, n), max(wide, m), end + 1
        chosen = order[start:end]
        for k, told in zip(chosen, _aligned_together([pairs[k] for k in chosen], deep, wide)):
            out[k] = told
        start = end
    return out


def _aligned_together(pairs: list[tuple[str, str]], deep: int, wide: int) -> list[list[int | None]]:
    low, count = -(1 << 28), len(pairs)
    a, b = np.zeros((count, deep), np.uint8), np.full((count, wide), 1, np.uint8)
    for k, (x, y) in enumerate(pairs):
        a[k, : len(x)], b[k, : len(y)] = (np.frombuffer(t.encode("latin-1", "replace"), np.uint8) for t in (x, y))
    ramp = (EXTEND * np.arange(wide + 1)).astype(np.int32)
    best = np.tile(ramp - EXTEND + OPEN, (count, 1)).astype(np.int32)
    best[:, 0] = 0
    up, over, direct = (np.full((count, wide + 1), low, np.int32) for _ in range(3))
    choice = np.zeros((deep + 1, count, wide + 1), np.uint8)
    choice[0, :, 1:2] = _OVER_OPENED
    for i in range(1, deep + 1):
        opened, longer = best + OPEN, up + EXTEND
        up = np.maximum(opened, longer)
        direct[:, 1:] = best[:, :-1] + np.where(b == a[:, i - 1 : i], MATCH, MISMATCH)
        base = np.maximum(direct, up)
        over[:, 1:] = np.maximum.accumulate(base[:, :-1] - ramp[:-1], axis=1) + ramp[1:] - EXTEND + OPEN
        best = np.maximum(base, over)
        row = choice[i]
        row[:] = (best == direct) * _DIRECT + (best == up) * _UP + (up == opened) * _UP_OPENED
        row[:, 1:] += (over[:, 1:] == best[:, :-1] + OPEN).astype(np.uint8) * np.uint8(_OVER_OPENED)
    return [_walk_back(choice[:, k], len(x), len(y)) for k, (x, y) in enumerate(pairs)]


def _walk_back(choice: np.ndarray, i: int, j: int) -> list[int | None]:
    out: list[int | None] = [None] * i
    state = _DIRECT
    while i or j:
        told = int(choice[i, j])
        if state == _DIRECT:
            if i and j and told & _DIRECT:
                i, j = i - 1, j - 1
                out[i] = j
                continue
            state = _UP if i and told & _UP else _OVER_OPENED
        if state == _UP:
            state = _DIRECT if told & _UP_OPENED else _UP
            i -= 1
        else:
            state = _DIRECT if told & _OVER_OPENED else _OVER_OPENED
            j -= 1
    return out


def straight_is_best(first: str, second: str) -> bool:
    """Whether a bound proves that no alignment with gaps is as good as the pair taken as it stands.

    Between equal lengths a gap on one side needs one on the other: two are opened and one match is lost at least.
    """
    unequal = len(first) - sum(map(str.__eq__, first, second))
    return len(first) == len(second) and (MATCH - MISMATCH) * unequal < MATCH - 2 * OPEN


def aligned_pairs(df: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """``key, aligned, same, identity, mapping`` of each pair: places with a partner, equal ones, their part, and the map.

    Pairs of one length are taken as they stand only where their unequal places cost less than the least that gaps can
    (see ``straight_is_best``); a null side gives nulls and an empty one an identity of 0. Rows are spread by key first,
    into as many partitions as there are cores, since an alignment's work grows with the product of the lengths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, told = [], list(zip(*(c.to_pylist() for c in batch.columns)))
            open_ = [n for n, (_, a, b) in enumerate(told) if a is not None and b is not None and not straight_is_best(a, b)]
            mapped = dict(zip(open_, index_maps([told[n][1:] for n in open_])))
            for n, (k, a, b) in enumerate(told):
                if a is None or b is None:
                    rows.append((k, None, None, None, None))
                    continue
                pairs = mapped[n] if n in mapped else list(range(len(a)))
                held = [(i, j) for i, j in enumerate(pairs) if j is not None]
                same = sum(a[i] == b[j] for i, j in held)
                rows.append((k, len(held), same, same / len(held) if held else 0.0, pairs))
            keys, aligned, same, identity, mapping = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(aligned, pa.int32()), pa.array(same, pa.int32()), pa.array(identity, pa.float64()), pa.array(mapping, pa.list_(pa.int32()))], ["key", "aligned", "same", "identity", "mapping"])

    kind = df.schema[key].dataType.simpleString()
    out = by_work(df.select(F.col(key), F.col(first), F.col(second)), key).mapInArrow(run, f"key {kind}, aligned int, same int, identity double, mapping array<int>")
    return out.withColumnRenamed("key", key)
