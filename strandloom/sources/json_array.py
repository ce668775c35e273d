"""Large JSON arrays read in byte ranges, each element a row, broken ones included.

A range can start inside a string or an object, so the file is read twice. First each range tells, for
both cases at its start, how deep it ends and whether inside a string; these few numbers give every
range's true start. Then each range cuts out the elements whose separator it holds, reading on past
its end for the last one. Elements are not parsed here: a broken one harms no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE_BYTES = 8 << 20
_OPEN, _CLOSE, _BLANK = b"[{", b"]}", b" \t\r\n"
_FACTS = ("path", "start", "outside", "inside", "flips", "filled")


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _read(path: str, start: int, end: int) -> bytes:
    system, name = _at(path)
    with system.open_input_file(name) as f:
        return f.read_at(end - start, start)


def _backslashes_before(path: str, start: int) -> int:
    """How many backslashes in a row stand before ``start``."""
    n, step = 0, 4096
    while start - n > 0:
        part = _read(path, max(0, start - n - step), start - n)
        kept = part.rstrip(b"\\")
        n += len(part) - len(kept)
        if kept:
            break
    return n


def _marks(data: bytes, before: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether an odd number of true quotes precedes it in the data, and the step in depth it would make."""
    a = np.frombuffer(data, np.uint8)
    index = np.arange(len(a))
    solid = np.maximum.accumulate(np.where(a != 92, index, -1))
    last = np.concatenate([[-1], solid[:-1]])
    run = index - 1 - last + np.where(last < 0, before, 0)
    quote = (a == 34) & (run % 2 == 0)
    odd = (np.cumsum(quote) - quote) % 2 == 1
    step = np.isin(a, np.frombuffer(_OPEN, np.uint8)).astype(np.int8) - np.isin(a, np.frombuffer(_CLOSE, np.uint8)).astype(np.int8)
    step[quote] = 0
    return odd, step


def range_facts(path: str, start: int, end: int) -> tuple[int, int, int, int]:
    """Change of depth if the range starts outside a string, if inside, whether it holds an odd number of quotes, and anything at all."""
    data = _read(path, start, end)
    odd, step = _marks(data, _backslashes_before(path, start))
    a = np.frombuffer(data, np.uint8)
    flips = bool(len(a)) and bool(odd[-1] ^ (a[-1] == 34 and _is_quote_last(data, path, start)))
    return int(step[~odd].sum()), int(step[odd].sum()), int(flips), int(bool(data.strip(_BLANK)))


def _is_quote_last(data: bytes, path: str, start: int) -> bool:
    before = len(data) - 1 - len(data[:-1].rstrip(b"\\"))
    if before == len(data) - 1:
        before += _backslashes_before(path, start)
    return before % 2 == 0


def cut_elements(path: str, start: int, end: int, size: int, inside: bool, depth: int, begun: bool) -> Iterator[tuple[int, str | None, str | None]]:
    """``offset, text, error`` of the elements whose separator lies in [start, end)."""
    data, stop = _read(path, start, end), end
    before = _backslashes_before(path, start)
    if begun and not depth and not inside:  # the array ended in an earlier range
        if data.strip(_BLANK):
            yield start + len(data) - len(data.lstrip(_BLANK)), None, "content after the array"
        return
    while True:
        odd, step = _marks(data, before)
        outside = odd == inside
        a = np.frombuffer(data, np.uint8)
        level = depth + np.cumsum(np.where(outside, step, 0))
        opens = outside & (a == 91) & (level == 1) & (step == 1)
        commas = outside & (a == 44) & (level == 1)
        ends = outside & (level == 0) & (step == -1)
        first = np.flatnonzero((opens | commas)[: end - start])
        edges = np.flatnonzero(opens | commas | ends)
        if not len(first) or edges[-1] > first[-1] or stop >= size:
            break
        more = min(stop + max(1 << 20, stop - start), size)
        data += _read(path, stop, more)
        stop = more
    closing = np.flatnonzero(ends)
    if len(closing) and data[closing[0] + 1 : end - start].strip(_BLANK) and closing[0] < end - start:
        yield start + int(closing[0]), None, "content after the array"
    for place in first[first < closing[0]].tolist() if len(closing) else first.tolist():
        k = np.searchsorted(edges, place, side="right")
        last = int(edges[k]) if k < len(edges) else len(data)
        raw = data[place + 1 : last].strip(_BLANK)
        if k == len(edges):
            yield start + place, raw.decode("utf-8", "replace"), "array not closed"
        elif raw or data[place : place + 1] == b"," or data[last : last + 1] == b",":
            try:
                yield start + place, raw.decode("utf-8"), None if raw else "empty element"
            except UnicodeDecodeError:
                yield start + place, raw.decode("utf-8", "replace"), "no valid UTF-8"


def read_json_array(spark: SparkSession, paths: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, offset, raw_json, error``: the elements of JSON arrays; ``offset`` orders them and is stable.

    An empty file or one whose first letter opens no array raises ``ValueError``. An array that is not
    closed, content after it, empty elements and bad UTF-8 come out as rows with an ``error``. Elements
    that are no valid JSON come out as text; parse them with ``try_parse_json``.
    """
    files = []
    for path in [paths] if isinstance(paths, str) else paths:
        system, name = _at(path)
        size = system.get_file_info(name).size
        if not _read(path, 0, min(size, 1 << 16)).lstrip(_BLANK).startswith(b"["):
            raise ValueError(f"no JSON array: {path}")
        files.append((path, size))
    ranges = spark.createDataFrame(files, "path string, size long").select("path", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(range_bytes))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, F.col("size")).alias("end"), "size")
    parts = max(1, min(sum(-(-size // range_bytes) for _, size in files), 10_000))

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, s, *range_facts(p, s, e)) for p, s, e, _ in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_pylist([dict(zip(_FACTS, r)) for r in rows], pa.schema([("path", pa.string()), *((n, pa.int64()) for n in _FACTS[1:])]))

    told = ranges.repartition(parts, "path", "start").mapInArrow(facts, "path string, " + ", ".join(f"{n} long" for n in _FACTS[1:]))
    # How a range begins follows from the ranges before it in its file: in a string after an odd number of turns, and so on.
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    marked = told.withColumn("within", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2 == 1)
    step = F.when(F.col("within"), F.col("inside")).otherwise(F.col("outside"))
    states = marked.withColumns({"depth": F.coalesce(F.sum(step).over(before), F.lit(0)), "begun": F.coalesce(F.max("filled").over(before), F.lit(0)) > 0})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held: list[tuple] = []
                for found in cut_elements(*row):
                    held.append(found)
                    if len(held) == 5_000:
                        yield _rows(row[0], held)
                        held = []
                if held:
                    yield _rows(row[0], held)

    known = ranges.join(states.select("path", "start", "within", "depth", "begun"), ["path", "start"]).select("path", "start", "end", "size", "within", "depth", "begun").repartition(parts, "path", "start")
    return known.mapInArrow(cut, "path string, offset long, raw_json string, error string")


def _rows(path: str, held: list[tuple]) -> pa.RecordBatch:
    offset, text, error = zip(*held)
    return pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array(offset, pa.int64()), pa.array(text, pa.string()), pa.array(error, pa.string())], ["path", "offset", "raw_json", "error"])
