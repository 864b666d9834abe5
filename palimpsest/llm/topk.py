"""Exact top-k by integer inner product: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors become floor(scale * x). All rows are sorted by descending length into blocks; the queries
into blocks of their own. A first pass sets every query against the block of longest vectors, which
gives each a k-th score to beat. A second pass takes only the block pairs that Cauchy-Schwarz
leaves open; inside, runs of candidates are cut by length, then by the inner product over the first
axes of the SVD rotation plus the product of the residual lengths. What is left is scored exactly in
integers. Bounds are compared with a margin above rounding error and only strictly lower ones are
cut, so ties are kept.

Rows are stored in the narrowest integers that hold the table's largest component; a block has at
most ``BLOCK`` rows and ``BLOCK_BYTES`` bytes, so the block of longest vectors may be broadcast.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter
vectors count as padded with zeros; rows that share a query's id are its own and no candidates;
rows with a null id take no part; with fewer than k candidates all are returned. Query rows equal in
id and vector are one query; rows of one id with different vectors are queries of their own, told
apart by ``query_row`` (any numbers; each has its ranks from 1). Repeated rows are a candidate each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SCALE = 256
BLOCK = 8192
BLOCK_BYTES = 16 << 20
QUERY_BLOCK = 2048
RUN = 1024
#: Rotated axes in the partial sum.
HEAD = 16
#: Relative and absolute room for rounding of the floating-point bounds.
MARGIN = 1e-9

_BLOCK = "block long, lo double, hi double, ids binary, numbers binary, rows binary"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long), norm of the rows that take part."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(e.isNotNull() & finite & F.col("vec_id").isNotNull())
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return rows.select("vec_id", v.alias("v")).withColumn("norm", norm)


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list array, padded to dim."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    if (sizes == dim).all():
        return flat.reshape(-1, dim).astype(np.int64)
    out = np.zeros((len(sizes), dim), np.int64)
    at = 0
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """The right singular vectors of all rows, from their Gram matrix (dim x dim, summed on the executors)."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column(0), dim).astype(float)
            total += m.T @ m
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(i * dim + j), pa.array(total[i, j])], ["at", "s"])

    sums = rows.select("v").mapInArrow(gram, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).toPandas()
    g = np.zeros(dim * dim)
    g[sums["at"].to_numpy()] = sums["s"].to_numpy()
    g = g.reshape(dim, dim)
    _, vectors = np.linalg.eigh(g + np.triu(g, 1).T)
    return np.ascontiguousarray(vectors[:, ::-1])


def _narrowest(largest: int) -> type:
    return next((t for t in (np.int16, np.int32) if largest <= np.iinfo(t).max), np.int64)


def _blocks(rows: DataFrame, size: int, dim: int, kind: type) -> DataFrame:
    """rows (vec_id, norm, v, row) by descending norm in blocks of size rows at most; long vectors have the lowest block numbers.

    Equal rows are dealt by a number, so that they need not share a task.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(3), dim).astype(kind), b.column(4)[0].as_py()) for b in batches if b.num_rows]
        if not got:
            return
        ids, norms, numbers, m = (np.concatenate([g[k] for g in got]) for k in range(4))
        order = np.lexsort((ids, -norms))
        for j, at in enumerate(range(0, len(order), size)):
            x = order[at : at + size]
            row = {"block": got[0][4] << 24 | j, "lo": norms[x[-1]], "hi": norms[x[0]], "ids": ids[x].tobytes(), "numbers": numbers[x].tobytes(), "rows": m[x].tobytes()}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64()), ("ids", pa.binary()), ("numbers", pa.binary()), ("rows", pa.binary())]))

    count = max(1, -(-rows.count() // size))
    dealt = rows.select((-F.col("norm")).alias("neg"), "vec_id", "norm", "v", "row").repartitionByRange(count, "neg", "vec_id", "row")
    return dealt.select("vec_id", "norm", "row", "v", F.spark_partition_id().cast("long").alias("part")).mapInArrow(build, _BLOCK)


def _merge(q: np.ndarray, s: np.ndarray, i: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of each query from long lists; missing ones have id -1 and the lowest score."""
    scores, ids = np.full((n, k), np.iinfo(np.int64).min), np.full((n, k), -1, np.int64)
    have = np.zeros((n, k), bool)
    order = np.lexsort((i, -s, q))
    q, s, i = q[order], s[order], i[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    keep = rank < k
    scores[q[keep], rank[keep]], ids[q[keep], rank[keep]], have[q[keep], rank[keep]] = s[keep], i[keep], True
    return scores, ids


def search(qi: np.ndarray, qm: np.ndarray, ci: np.ndarray, cm: np.ndarray, basis: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, id, score) of candidates that may be among a query's k best, given scores to reach."""
    n, head = len(qi), min(HEAD, qm.shape[1])
    qf, cf = qm.astype(float), cm.astype(float)
    qr, cr = qf @ basis, cf @ basis
    qn, cn = np.sqrt((qf**2).sum(1)), np.sqrt((cf**2).sum(1))
    qrest, crest = np.sqrt((qr[:, head:] ** 2).sum(1)), np.sqrt((cr[:, head:] ** 2).sum(1))
    exact = float(np.abs(qf).max(initial=0)) * float(np.abs(cf).max(initial=0)) * max(1, qm.shape[1]) < 2**53
    best_s, best_i = np.full((n, k), np.iinfo(np.int64).min), np.full((n, k), -1, np.int64)
    floor = floor.astype(float).copy()
    for at in range(0, len(ci), RUN):
        part = slice(at, at + RUN)
        room = MARGIN * (1 + qn * cn[part].max())
        open_q = np.flatnonzero(qn * cn[part].max() + room >= floor)
        if not len(open_q):
            continue
        upper = qr[open_q, :head] @ cr[part, :head].T + qrest[open_q, None] * crest[None, part]
        alive = upper + room[open_q, None] >= floor[open_q, None]
        alive &= qi[open_q, None] != ci[None, part]
        rows = np.flatnonzero(alive.any(1))
        if not len(rows):
            continue
        which = open_q[rows]
        scores = np.rint(qf[which] @ cf[part].T).astype(np.int64) if exact else qm[which] @ cm[part].T
        mask = alive[rows] & (scores >= np.maximum(floor[which], -(2.0**62))[:, None])
        a, b = np.nonzero(mask)
        old_q, old_r = np.nonzero(best_i[which] >= 0)
        best = np.concatenate([which[a], which[old_q]])
        s = np.concatenate([scores[a, b], best_s[which[old_q], old_r]])
        i = np.concatenate([ci[part][b], best_i[which[old_q], old_r]])
        ms, mi = _merge(best, s, i, n, k)
        best_s[which], best_i[which] = ms[which], mi[which]
        kth = best_s[which, k - 1]
        floor[which] = np.where(best_i[which, k - 1] >= 0, np.maximum(floor[which], kth), floor[which])
    a, b = np.nonzero(best_i >= 0)
    return a, best_i[a, b], best_s[a, b]


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = SCALE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row that is_query (a condition on vec_id) names."""
    scratch = Scratch(vectors.sparkSession, "topk")
    rows = scratch.table(quantised(vectors, scale).withColumn("row", F.monotonically_increasing_id()), "rows")
    # of the lowest long there is no absolute: -(x + 1) is as wide
    largest = F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, x, -(x + 1))))
    dim, largest = rows.agg(F.max(F.size("v")), largest).first()
    dim, kind = dim or 1, _narrowest(largest or 0)
    basis = rotation(rows, dim)
    fit = max(1, BLOCK_BYTES // (dim * np.dtype(kind).itemsize))
    c = scratch.table(_blocks(rows, min(block, fit), dim, kind).drop("numbers"), "candidates")
    # equal query rows are one query; numbered once written
    asked = scratch.table(rows.where(is_query).groupBy("vec_id", "v").agg(F.first("norm").alias("norm")), "distinct")
    asked = scratch.table(asked.withColumn("row", F.monotonically_increasing_id()), "asked")
    q = scratch.table(_blocks(asked, min(query_block, fit), dim, kind).toDF("qblock", "qlo", "qhi", "qids", "qnumbers", "qrows"), "queries")
    flat = "query_row long, query_id long, vec_id long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x = {f: batch.column(f)[r].as_py() for f in batch.schema.names}
                qi, qn, ci = (np.frombuffer(x[f], np.int64) for f in ("qids", "qnumbers", "ids"))
                qm, cm = (np.frombuffer(x[f], kind).reshape(-1, dim).astype(np.int64) for f in ("qrows", "rows"))
                floor = np.frombuffer(x["floor"], np.float64) if x["floor"] else np.full(len(qi), -np.inf)
                a, i, s = search(qi, qm, ci, cm, basis, floor, k)
                yield pa.RecordBatch.from_arrays([pa.array(qn[a]), pa.array(qi[a]), pa.array(i), pa.array(s)], ["query_row", "query_id", "vec_id", "score"])

    # the longest vectors first; blocks are numbered by descending norm, and one has BLOCK_BYTES at most
    first = c.agg(F.min("block")).first()[0]
    longest = F.broadcast(c.where(F.col("block") == first))
    lead = scratch.table(q.withColumn("block", F.lit(first).cast("long")).join(longest, "block").withColumn("floor", F.lit(None).cast("binary")).mapInArrow(run, flat), "lead")

    # each query's k-th score so far, beside its block; per block a binary column
    kth = lead.groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") == k)

    def places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                i = np.frombuffer(numbers, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), b)), pa.array(i), pa.array(np.arange(len(i)))], ["qblock", "query_row", "at"])

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, lists in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = np.full(len(lists), -np.inf)
                for x in lists:
                    if x["s"] is not None:
                        f[x["at"]] = x["s"]
                yield pa.RecordBatch.from_pylist([{"qblock": b, "floor": f.tobytes()}], pa.schema([("qblock", pa.int64()), ("floor", pa.binary())]))

    places = q.select("qblock", "qnumbers").mapInArrow(places_of, "qblock long, query_row long, at long")
    # a query block has a bounded number of rows, so this list is bounded
    floor = scratch.table(places.join(kth, "query_row", "left").groupBy("qblock").agg(F.collect_list(F.struct("at", "s")).alias("x")).mapInArrow(floors, "qblock long, floor binary"), "floors")
    ready = scratch.table(q.join(floor, "qblock"), "ready")

    # pairs of block numbers that a length bound leaves open, then the blocks themselves
    def lowest_ratio(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, rows_, f in zip(*(batch.column(x).to_pylist() for x in range(3)), strict=True):
                norms = np.sqrt((np.frombuffer(rows_, kind).reshape(-1, dim).astype(float) ** 2).sum(1))
                f = np.frombuffer(f, np.float64)
                need = np.where(norms > 0, (f - MARGIN * (1 + np.abs(f))) / np.maximum(norms, 1e-300), np.where(f <= 0, -np.inf, np.inf)).min(initial=np.inf)
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([float(need)])], ["qblock", "need"])

    lengths = c.where(F.col("block") != first).select("block", "hi")
    needs = ready.select("qblock", "qrows", "floor").mapInArrow(lowest_ratio, "qblock long, need double")
    pairs = scratch.table(lengths.join(needs, F.col("hi") >= F.col("need")).select("qblock", "block"), "pairs")
    rest = pairs.join(c, "block").join(ready, "qblock").select("qids", "qnumbers", "qrows", "ids", "rows", "floor").mapInArrow(run, flat)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = lead.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "query_row")
