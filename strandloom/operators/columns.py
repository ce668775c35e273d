"""Statistics of alignment columns, in long form and without pairs of rows.

An alignment is ``aln, row_id, seq``: rows of one ``aln`` have one length, ``-`` is a gap.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.hashing import hash_number
from strandloom.functions.sequence import tokens
from strandloom.session import by_work, materialize


def cells(rows: DataFrame, *more: str) -> DataFrame:
    """``aln, row_id, column, token`` and ``more``, columns from 0."""
    return rows.select("aln", "row_id", *more, F.posexplode(tokens(F.col("seq"))).alias("column", "token"))


def mean_pairwise_identity(rows: DataFrame) -> DataFrame:
    """``aln, rows, mean_identity``: the mean identity of all pairs of rows, from counts per column.

    Of the n(n-1)/2 pairs those agree in a column whose rows hold the same token there, so token counts
    give the mean exactly. Gaps count as tokens. An alignment of one row has a null mean.
    """
    counts = cells(rows).groupBy("aln", "column", "token").agg(F.count("*").alias("c"))
    per = counts.groupBy("aln", "column").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"))
    return per.groupBy("aln").agg(F.max("n").alias("rows"), F.round(F.avg(F.try_divide(F.col("same"), F.col("n") * (F.col("n") - 1))), 6).alias("mean_identity"))


def _blocks(rows: DataFrame, block_rows: int, compare, schema: str) -> DataFrame:  # type: ignore[no-untyped-def]
    """``compare`` on each two blocks of about ``block_rows`` rows of an alignment, each in a task of its own.

    It gets a table of rows ``aln, i, j, is_left, row_id, seq``: the left ones of block i, the others of block j.
    """
    sizes = rows.groupBy("aln").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    placed = rows.select("aln", "row_id", "seq").join(sizes, "aln").withColumn("own", F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = placed.select("aln", F.col("own").alias("i"), F.explode(others).alias("j"), F.lit(True).alias("is_left"), "row_id", "seq")
    right = placed.select("aln", F.explode(others).alias("i"), F.col("own").alias("j"), F.lit(False).alias("is_left"), "row_id", "seq")
    return by_work(left.unionByName(right), "aln", "i", "j").groupBy("aln", "i", "j").applyInArrow(compare, schema)


def _identities(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Identities of the left rows with the others over columns where neither has a gap (0 without one), and which rows are left."""
    is_left = table.column("is_left").to_numpy(zero_copy_only=False)
    codes = np.array([np.frombuffer(s.encode("latin-1", "replace"), np.uint8) for s in table.column("seq").to_pylist()])
    return _identity(codes[is_left], codes[~is_left]), is_left


def _identity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    both = (x != 45).astype(np.float32) @ (y != 45).astype(np.float32).T
    same = np.zeros_like(both)
    for token in np.intersect1d(x, y):
        if token != 45:
            same += (x == token).astype(np.float32) @ (y == token).astype(np.float32).T
    return np.where(both > 0, same.astype(np.float64) / np.maximum(both, 1), 0)


def row_weights(rows: DataFrame, threshold: float = 0.8, block_rows: int = 1000) -> DataFrame:
    """``aln, row_id, weight``: 1 over the number of rows (itself too) with an identity of ``threshold`` or more.

    Identity is over columns where neither row has a gap, 0 without such a column. Only counts leave a task.
    """

    def compare(table: pa.Table) -> pa.Table:
        identity, is_left = _identities(table)
        picked = table.filter(pa.array(is_left))
        return pa.table({"aln": picked.column("aln"), "row_id": picked.column("row_id"), "near": pa.array((identity >= threshold - 1e-9).sum(axis=1).astype(np.int64))})

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("aln", "row_id")}
    counted = _blocks(rows, block_rows, compare, f"aln {kinds['aln']}, row_id {kinds['row_id']}, near long")
    return counted.groupBy("aln", "row_id").agg((F.lit(1.0) / F.greatest(F.sum("near"), F.lit(1))).alias("weight"))


def pair_extremes(rows: DataFrame, block_rows: int = 1000) -> DataFrame:
    """``aln, pairs, least, mean, most``: identities of all pairs of rows, as in ``row_weights``; nulls for a single row.

    Row ids must be unique in an alignment: a row is not compared with itself.
    """

    def compare(table: pa.Table) -> pa.Table:
        identity, is_left = _identities(table)
        ids = np.array(table.column("row_id").to_pylist(), object)
        told = identity[ids[is_left][:, None] != ids[~is_left][None, :]]
        one = lambda f: pa.array([float(f(told)) if len(told) else None], pa.float64())
        return pa.table({"aln": table.column("aln").slice(0, 1), "n": pa.array([len(told)], pa.int64()), "total": pa.array([float(told.sum())]), "least": one(np.min), "most": one(np.max)})

    kind = rows.schema["aln"].dataType.simpleString()
    parts = _blocks(rows, block_rows, compare, f"aln {kind}, n long, total double, least double, most double")
    # Each pair is met from both sides.
    return parts.groupBy("aln").agg((F.sum("n") / 2).cast("long").alias("pairs"), F.min("least").alias("least"), F.try_divide(F.sum("total"), F.sum("n")).alias("mean"), F.max("most").alias("most"))


def conservation(rows: DataFrame, weights: DataFrame, allowed: float = 0.05) -> DataFrame:
    """Per column: conservation, entropy, consensus (ties by letter), allowed tokens, frequencies, gaps, coverage, effective rows.

    Frequencies leave gaps out, once weighted and once not; gap fraction and coverage are not weighted. A column
    of gaps alone has conservation and entropy 0, a null consensus and no frequencies.
    """
    weighed = cells(rows.join(weights, ["aln", "row_id"]), "weight")
    counts = weighed.groupBy("aln", "column", "token").agg(F.sum("weight").alias("w"), F.count("*").alias("c"))
    real = F.col("token") != "-"
    whole = Window.partitionBy("aln", "column")
    share = lambda x: F.try_divide(F.when(real, F.col(x)), F.sum(F.when(real, F.col(x))).over(whole))
    parts = counts.withColumns({"f": share("w"), "g": share("c")})
    order = F.struct(F.round("f", 9).alias("f"), (-F.ascii("token")).alias("t"))
    table = lambda x: F.map_from_entries(F.array_sort(F.collect_list(F.when(real, F.struct("token", F.round(x, 6).alias("f"))))))
    out = parts.groupBy("aln", "column").agg(
        F.round(F.coalesce(F.max("f"), F.lit(0.0)), 6).alias("conservation"),
        F.round(F.coalesce(-F.sum(F.when(F.col("f") > 0, F.col("f") * F.ln("f"))), F.lit(0.0)), 6).alias("entropy"),
        F.max_by(F.when(real, F.col("token")), F.when(real, order)).alias("consensus"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("f") >= allowed, F.col("token")))), "").alias("allowed_tokens"),
        table("f").alias("frequencies"),
        table("g").alias("plain_frequencies"),
        F.round(F.sum(F.when(real, 0).otherwise(F.col("c"))) / F.sum("c"), 6).alias("gap_fraction"),
        F.round(F.sum("w"), 6).alias("effective_rows"),
    )
    return out.withColumn("coverage", F.round(1 - F.col("gap_fraction"), 6))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.where(x > 0, x, 1.0))


def _information(joint: np.ndarray, left: np.ndarray, right: np.ndarray, pseudocount: float) -> np.ndarray:
    """Mutual information of each column of the left with each of the right, from summed weights of their tokens.

    ``left`` and ``right`` are where each column's tokens start. The pseudocount goes to all pairs of tokens that
    stand in rows without a gap in either column.
    """
    of_left = np.repeat(np.arange(len(left)), np.diff(np.append(left, joint.shape[0])))
    of_right = np.repeat(np.arange(len(right)), np.diff(np.append(right, joint.shape[1])))
    a, b = np.add.reduceat(joint, right, axis=1), np.add.reduceat(joint, left, axis=0)
    total = np.add.reduceat(a, left, axis=0)
    if pseudocount:
        has_a, has_b = a > 0, b > 0
        many_a, many_b = np.add.reduceat(has_a.astype(float), left, axis=0), np.add.reduceat(has_b.astype(float), right, axis=1)
        joint = joint + pseudocount * (has_a[:, of_right] & has_b[of_left])
        a, b = a + pseudocount * has_a * many_b[of_left], b + pseudocount * has_b * many_a[:, of_right]
        total = total + pseudocount * many_a * many_b
    sums = np.add.reduceat(np.add.reduceat(_xlogx(joint), right, axis=1), left, axis=0) - np.add.reduceat(_xlogx(a), left, axis=0) - np.add.reduceat(_xlogx(b), right, axis=1)
    safe = np.where(total > 0, total, 1.0)
    return np.where(total > 0, np.maximum(sums / safe + np.log(safe), 0.0), 0.0)


def _indicators(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One column for each token of each alignment column with several tokens; which column and token these are."""
    codes = np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8).reshape(len(texts), -1)
    known = [t for t in np.unique(codes).tolist() if t != 45]
    there = np.array([(codes == t).any(axis=0) for t in known]).reshape(len(known), codes.shape[1])
    column, which = np.nonzero((there & (there.sum(axis=0) > 1)).T)
    token = np.array(known, np.uint8)[which]
    return (codes[:, column] == token).astype(np.float64), column, token


def pair_information(rows: DataFrame, weights: DataFrame, pseudocount: float = 0.0, block: int = 128, part_rows: int = 20_000) -> DataFrame:
    """``aln, i, j, mi``: mutual information in nats of all pairs ``i < j`` of columns that have several tokens.

    Pairs with a column of one token have none and are not listed. Rows with a gap in either column are left out of
    a pair. Columns are cut into blocks; the joint weights of two blocks are one matrix product in a task of its
    own. Alignments of more than ``part_rows`` rows are summed up part by part.
    """
    kind = rows.schema["aln"].dataType.simpleString()
    sizes = rows.groupBy("aln").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"), F.ceil(F.max(F.length("seq")) / block).cast("int").alias("blocks"))
    placed = rows.join(weights, ["aln", "row_id"]).join(sizes, "aln").where("blocks > 0")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int")).withColumn("bi", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = lambda b: F.substring("seq", F.col(b) * block + 1, F.lit(block))
    sent = placed.withColumn("bj", F.explode(F.sequence(F.col("bi"), F.col("blocks") - 1))).select("aln", "parts", "part", "bi", "bj", "weight", cut("bi").alias("x"), cut("bj").alias("y"))

    def joint(table: pa.Table) -> tuple:
        x, xc, xt = _indicators(table.column("x").to_pylist())
        y, yc, yt = _indicators(table.column("y").to_pylist())
        return (x * table.column("weight").to_numpy()[:, None]).T @ y, xc, xt, yc, yt

    def pairs(name, bi: int, bj: int, product: np.ndarray, xc: np.ndarray, yc: np.ndarray) -> pa.Table:  # type: ignore[no-untyped-def]
        i, left = np.unique(xc, return_index=True)
        j, right = np.unique(yc, return_index=True)
        mi = _information(product, left, right, pseudocount) if product.size else np.zeros((len(i), len(j)))
        first, second = np.nonzero((bi < bj) | (i[:, None] < j[None, :]))
        return pa.table({"aln": pa.array([name] * len(first)).cast(_ARROW[kind]), "i": pa.array((bi * block + i[first]).astype(np.int32)), "j": pa.array((bj * block + j[second]).astype(np.int32)), "mi": mi[first, second]})

    def whole(table: pa.Table) -> pa.Table:
        product, xc, _, yc, _ = joint(table)
        return pairs(table.column("aln")[0].as_py(), table.column("bi")[0].as_py(), table.column("bj")[0].as_py(), product, xc, yc)

    def part(table: pa.Table) -> pa.Table:
        # Tokens of columns with one token in this part may meet others in the next, so all are kept.
        codes = [np.frombuffer("".join(table.column(c).to_pylist()).encode("latin-1", "replace"), np.uint8).reshape(len(table), -1) for c in ("x", "y")]
        sides = []
        for c in codes:
            known = [t for t in np.unique(c).tolist() if t != 45]
            column, which = np.nonzero(np.array([(c == t).any(axis=0) for t in known]).reshape(len(known), c.shape[1]).T)
            sides.append((column, np.array(known, np.uint8)[which]))
        (xc, xt), (yc, yt) = sides
        product = ((codes[0][:, xc] == xt) * table.column("weight").to_numpy()[:, None]).T @ (codes[1][:, yc] == yt).astype(np.float64)
        i, j = np.nonzero(product)
        n = len(i)
        fixed = {c: pa.array([table.column(c)[0].as_py()] * n) for c in ("aln", "bi", "bj")}
        return pa.table({"aln": fixed["aln"].cast(_ARROW[kind]), "bi": fixed["bi"].cast(pa.int32()), "bj": fixed["bj"].cast(pa.int32()), "xc": xc[i].astype(np.int32), "xt": xt[i].astype(np.int32), "yc": yc[j].astype(np.int32), "yt": yt[j].astype(np.int32), "w": product[i, j]})

    def summed(table: pa.Table) -> pa.Table:
        xc, xt, yc, yt = (table.column(c).to_numpy() for c in ("xc", "xt", "yc", "yt"))
        left, right = np.unique(xc.astype(np.int64) * 256 + xt), np.unique(yc.astype(np.int64) * 256 + yt)
        product = np.zeros((len(left), len(right)))
        product[np.searchsorted(left, xc.astype(np.int64) * 256 + xt), np.searchsorted(right, yc.astype(np.int64) * 256 + yt)] = table.column("w").to_numpy()
        keep_x, keep_y = (np.isin(v // 256, np.flatnonzero(np.bincount(v // 256) > 1)) for v in (left, right))
        return pairs(table.column("aln")[0].as_py(), table.column("bi")[0].as_py(), table.column("bj")[0].as_py(), product[np.ix_(keep_x, keep_y)], left[keep_x] // 256, right[keep_y] // 256)

    schema = f"aln {kind}, i int, j int, mi double"
    out = by_work(sent.where("parts = 1"), "aln", "bi", "bj").groupBy("aln", "bi", "bj").applyInArrow(whole, schema)
    parts = sent.where("parts > 1").groupBy("aln", "bi", "bj", "part").applyInArrow(part, f"aln {kind}, bi int, bj int, xc int, xt int, yc int, yt int, w double")
    added = parts.groupBy("aln", "bi", "bj", "xc", "xt", "yc", "yt").agg(F.sum("w").alias("w"))
    return out.unionByName(added.groupBy("aln", "bi", "bj").applyInArrow(summed, schema))


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}


def product_correction(pairs: DataFrame, columns: DataFrame) -> DataFrame:
    """``aln, i, j, mi, apc``: information less the product of both columns' means over the mean of all.

    ``columns`` has ``aln, columns``, the number of all columns: pairs that are not listed count as 0 in the means. Where
    the mean of all is 0 nothing is taken off.
    """
    both = pairs.select("aln", "i", "mi").unionByName(pairs.select("aln", F.col("j").alias("i"), "mi"))
    sums = both.groupBy("aln", "i").agg(F.sum("mi").alias("s")).join(columns, "aln").withColumn("m", F.col("s") / (F.col("columns") - 1))
    whole = sums.groupBy("aln").agg((F.sum("s") / F.max(F.col("columns") * (F.col("columns") - 1))).alias("g"))
    means = sums.select("aln", "i", "m").join(whole, "aln")
    joined = pairs.join(means.select("aln", "i", F.col("m").alias("mi_i"), "g"), ["aln", "i"]).join(means.select("aln", F.col("i").alias("j"), F.col("m").alias("mi_j")), ["aln", "j"])
    return joined.select("aln", "i", "j", "mi", (F.col("mi") - F.coalesce(F.try_divide(F.col("mi_i") * F.col("mi_j"), F.col("g")), F.lit(0.0))).alias("apc"))


def coupled_pairs(rows: DataFrame, threshold: float = 0.8, pseudocount: float = 0.0) -> DataFrame:
    """``aln, i, j, mi, apc`` of all pairs of columns with several tokens, rows weighted by their near neighbours."""
    held = materialize(rows.select("aln", "row_id", "seq"), "alignment-rows")
    pairs = materialize(pair_information(held, row_weights(held, threshold), pseudocount), "column-pairs")
    return product_correction(pairs, held.groupBy("aln").agg(F.max(F.length("seq")).cast("long").alias("columns")))


def strongest(pairs: DataFrame, most: int) -> DataFrame:
    """The ``most`` pairs of each alignment with the greatest corrected information, ties by column."""
    rank = F.row_number().over(Window.partitionBy("aln").orderBy(F.desc(F.round("apc", 6)), "i", "j"))
    return pairs.withColumn("k", rank).where(F.col("k") <= most).drop("k")


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.select("aln", "row_id", "seq", F.row_number().over(Window.partitionBy("aln").orderBy(F.sha2(F.col("row_id").cast("string"), 256), "row_id")).alias("k"))


def _draws(sizes: DataFrame, replicates: int, seed: int) -> DataFrame:
    """``aln, replicate, d, k``: the number of the row that each draw takes."""
    each = sizes.select("aln", "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).repartition("aln", "replicate")
    draws = each.select("aln", "n", "replicate", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("d"))
    k = (F.pmod(hash_number(F.concat_ws(":", F.lit(str(seed)), "aln", "replicate", "d")), F.col("n").cast("decimal(20,0)")) + 1).cast("int")
    return draws.select("aln", "replicate", "d", k.alias("k"))


def drawn_rows(rows: DataFrame, replicates: int, seed: int) -> DataFrame:
    """``aln, row_id, seq`` drawn with replacement, one alignment ``aln#replicate`` a replicate, the same on any partitioning.

    Each alignment's rows are numbered by hash. Draw d of replicate r takes row hash(seed:aln:r:d) mod n.
    """
    picked = _draws(rows.groupBy("aln").agg(F.count("*").alias("n")), replicates, seed)
    return picked.join(_numbered(rows), ["aln", "k"]).select(F.concat_ws("#", "aln", "replicate").alias("aln"), F.col("d").alias("row_id"), "seq")


def drawn_counts(rows: DataFrame, replicates: int, seed: int) -> DataFrame:
    """``aln, row_id, seq, counts``: how often ``drawn_rows`` draws each row, replicate by replicate; rows never drawn are left out."""
    sizes = rows.groupBy("aln").agg(F.count("*").alias("n"))
    picked = _draws(sizes, replicates, seed).groupBy("aln", "k").agg(F.array(*[F.count_if(F.col("replicate") == r) for r in range(replicates)]).alias("counts"))
    numbered = _numbered(rows.select("aln", "row_id", F.lit("").alias("seq")))
    return rows.select("aln", "row_id", "seq").join(picked.join(numbered, ["aln", "k"]).select("aln", "row_id", "counts"), ["aln", "row_id"])


def _drawn_information(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns with several tokens, and the mutual information of each with each, from all rows of an alignment.

    A token that stands in one row alone meets one token of any other column, so its part of the sums over pairs of
    tokens cancels with its part of the sums over tokens, but where both columns have such a token in the row.
    Only tokens of several rows are multiplied.
    """
    known = [t for t in np.unique(codes).tolist() if t != 45]
    support = np.array([(codes == t).sum(axis=0) for t in known]).reshape(len(known), codes.shape[1])
    listed = np.flatnonzero((support > 0).sum(axis=0) > 1)
    # Columns with most tokens of several rows first: those with a k-th one are the first so many.
    order = np.argsort(-(support[:, listed] > 1).sum(axis=0), kind="stable")
    columns = listed[order]
    codes, support = codes[:, columns], support[:, columns]
    there = (codes != 45).astype(np.float64)
    there = there if (there == 0).any() else there[:, :1]  # without gaps all columns have the same rows
    alone = np.zeros(codes.shape)
    for k, t in enumerate(known):
        alone += (codes == t) & (support[k] == 1)
    token, rank = np.array(known, np.uint8), (support > 1).cumsum(axis=0) * (support > 1)
    kth = []
    for k in range(1, int(rank.max(initial=0)) + 1):
        width = int((rank == k).any(axis=0).sum())
        kth.append(codes[:, :width] == token[(rank[:, :width] == k).argmax(axis=0)])
    scale = weights[:, None]
    sums = -((alone * _xlogx(scale)).T @ alone)
    single = np.zeros((len(columns), there.shape[1]))
    for k, x in enumerate(kth):
        weighed = np.ascontiguousarray((x * scale).T)
        single[: len(weighed)] += _xlogx(weighed @ there)
        for y in kth[k:]:
            product = weighed @ y.astype(np.float64)
            logs = np.log(np.maximum(product, 1e-300))
            logs *= product
            sums[: x.shape[1], : y.shape[1]] += logs
            if y is not x:
                sums[: y.shape[1], : x.shape[1]] += logs.T
    sums -= single
    sums -= single.T
    total = (there * scale).T @ there
    safe = np.where(total > 0, total, 1.0)
    mi = np.where(total > 0, np.maximum(sums / safe + np.log(safe), 0.0), 0.0)
    back = np.argsort(order)
    return listed, mi[back][:, back]


def _corrected(mi: np.ndarray, columns: int) -> np.ndarray:
    """``product_correction`` of all pairs of an alignment at once."""
    np.fill_diagonal(mi, 0.0)
    sums = mi.sum(axis=1)
    whole = sums.sum() / (columns * (columns - 1))
    means = sums / (columns - 1)
    return mi - (np.outer(means, means) / whole if whole > 0 else 0.0)


def drawn_strongest(rows: DataFrame, replicates: int, seed: int, most: int, threshold: float = 0.8, letters: int = 1 << 22, long: int = 4096, wide: int = 2048) -> DataFrame:
    """``aln, replicate, i, j, mi, apc``: the ``strongest`` of the ``coupled_pairs`` of each replicate of ``drawn_rows``.

    An alignment of at most ``letters`` letters, ``long`` rows and ``wide`` columns goes to one task once, with the
    number of draws of each row; its pairs stay there and only the strongest leave. Larger ones are drawn and compared
    in blocks, which takes disk for all their pairs.
    """
    rows = materialize(rows.select("aln", "row_id", "seq"), "alignment-rows")
    kind = rows.schema["aln"].dataType.simpleString()
    n, length = F.count("*"), F.max(F.length("seq"))
    sizes = materialize(rows.groupBy("aln").agg(((n > long) | (length > wide)).alias("large"), (n * length > letters).alias("full")).select("aln", (F.col("large") | F.col("full")).alias("large")), "alignment-sizes")
    schema = f"aln {kind}, replicate int, i int, j int, mi double, apc double"

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("row_id")
        texts = table.column("seq").to_pylist()
        codes = np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8).reshape(len(texts), -1)
        counts = np.array(table.column("counts").to_pylist(), np.float64)
        near = np.concatenate([(_identity(codes[k : k + 512], codes) >= threshold - 1e-9).astype(np.float64) @ counts for k in range(0, len(codes), 512)])
        near = np.maximum(near, 1)
        out = []
        for r in range(replicates):
            drawn = counts[:, r] > 0
            listed, mi = _drawn_information(codes[drawn], counts[drawn, r] / near[drawn, r])
            if len(listed) < 2:
                continue
            apc = _corrected(mi, codes.shape[1])
            key = np.where(np.tri(len(listed), dtype=bool), -np.inf, np.round(apc, 6))
            pairs = len(listed) * (len(listed) - 1) // 2
            least = np.partition(key, key.size - min(most, pairs), axis=None)[key.size - min(most, pairs)]
            i, j = np.nonzero(key >= least)
            first = np.argsort(-key[i, j], kind="stable")[:most]
            i, j = i[first], j[first]
            out.append(pa.table({"aln": pa.array([table.column("aln")[0].as_py()] * len(i)).cast(_ARROW[kind]), "replicate": np.full(len(i), r, np.int32), "i": listed[i].astype(np.int32), "j": listed[j].astype(np.int32), "mi": mi[i, j], "apc": apc[i, j]}))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in (("aln", _ARROW[kind]), ("replicate", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("mi", pa.float64()), ("apc", pa.float64()))})

    small = drawn_counts(rows.where("seq <> ''").join(sizes.where("not large"), "aln", "left_semi"), replicates, seed)
    out = by_work(small, "aln").groupBy("aln").applyInArrow(compare, schema)
    if sizes.where("large").isEmpty():
        return out
    big = strongest(coupled_pairs(drawn_rows(rows.join(sizes.where("large"), "aln", "left_semi"), replicates, seed), threshold), most)
    parts = F.regexp_extract("aln", r"(?s)^(.*)#(\d+)$", 1).cast(kind), F.regexp_extract("aln", r"(?s)^(.*)#(\d+)$", 2).cast("int")
    return out.unionByName(big.select(parts[0].alias("aln"), parts[1].alias("replicate"), "i", "j", "mi", "apc"))


def permuted_rows(rows: DataFrame, split: Column, replicates: int, seed: int) -> DataFrame:
    """``aln, row_id, seq`` where the columns from ``split`` on come from another row of the alignment, ``aln#replicate`` a replicate.

    The order of the second halves is that of hash(seed:replicate:row).
    """
    first = _numbered(rows).select("aln", "row_id", "k", F.substring("seq", F.lit(1), split).alias("head"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    order = F.row_number().over(Window.partitionBy("aln", "replicate").orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), "replicate", "row_id"), 256), "row_id"))
    second = rows.select("aln", "row_id", F.expr("seq").alias("whole"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).withColumn("k", order)
    tail = F.substring("whole", F.length("head") + 1, F.length("whole"))
    return first.join(second.drop("row_id"), ["aln", "replicate", "k"]).select(F.concat_ws("#", "aln", "replicate").alias("aln"), "row_id", F.concat("head", tail).alias("seq"))


def ungapped_index(rows: DataFrame) -> DataFrame:
    """``aln, row_id, index, column``: for each token that is no gap its place in the plain sequence."""
    long = rows.select("aln", "row_id", F.transform(tokens(F.col("seq")), lambda t, i: F.struct(i.alias("column"), t.alias("t"))).alias("all"))
    kept = long.select("aln", "row_id", F.posexplode(F.filter("all", lambda c: c["t"] != "-")).alias("index", "c"))
    return kept.select("aln", "row_id", "index", F.col("c.column").alias("column"))


def check_alignment(rows: DataFrame) -> DataFrame:
    """Alignments that are none: rows of several lengths, of no length, or fewer than two; one row each with the reason."""
    per = rows.groupBy("aln").agg(F.count("*").alias("n"), F.min(F.length("seq")).alias("least"), F.max(F.length("seq")).alias("most"))
    reason = F.when(F.col("n") < 2, "fewer_than_two_rows").when(F.col("least") != F.col("most"), "unequal_lengths").when(F.col("most") == 0, "no_columns")
    return per.select("aln", reason.alias("reason")).where("reason is not null")
