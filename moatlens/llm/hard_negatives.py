"""Hard-negative mining over integer inner products.

Components become integers, anchors are cut into chunks that fit a broadcast,
and every task multiplies its rows, tile by tile, with the chunk's anchors by
Strassen's recursion on int64. A task keeps one bounded heap per anchor (its
best rows of the same label) or per anchor and positive (its best rows of other
labels whose score lies in the positive's window) over all its tiles; the heaps
of all tasks merge by rank. No row is left out and no pair is materialised
outside a tile.

Two passes over the rows: the first multiplies only rows of an anchor's own
label and gives the positives, the second the others, with the windows then
known.

Defined cases: rows with a null id, label or vector, or with a null or
non-finite component take no part, nor do those whose squared integer length
reaches 2^56 (100 times their scores would not fit a long); shorter vectors
count as padded with zeros, an empty one scores 0; of rows that repeat an id
the smallest (label, vector) counts; equal scores go to the smaller id; an
anchor without positives, or a positive whose window is empty (all negative
ones), gives no rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moatlens.llm.common import anti, semi, written
from moatlens.session import ensure_checkpoint_dir

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
#: Broadcast bytes of a chunk of anchors, entries of an anchor tile and of a row tile.
CHUNK_BYTES = 16 << 20
ANCHOR_TILE, ROW_TILE = 1 << 15, 1 << 17
#: Recursion ends at matrices with a side of so many entries.
LEAF = 32
#: Below every score; squared lengths stay below LIMIT, so that 100 * score fits.
NONE = -(1 << 62)
LIMIT = float(1 << 56)

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact product: in doubles where a bound shows that every partial sum is exact, else in int64."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def multiply(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices by Strassen's seven products; odd sides are padded with a line of zeros.

    Sums wrap modulo 2^64 like the product itself, so the result is exact
    whenever it fits.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return _leaf(a, b)
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, h = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :h], b[:j, h:], b[j:, :h], b[j:, h:]
    p1 = multiply(a11 + a22, b11 + b22, leaf)
    p2 = multiply(a21 + a22, b11, leaf)
    p3 = multiply(a11, b12 - b22, leaf)
    p4 = multiply(a22, b21 - b11, leaf)
    p5 = multiply(a11 + a12, b22, leaf)
    p6 = multiply(a21 - a11, b11 + b12, leaf)
    p7 = multiply(a12 - a22, b21 + b22, leaf)
    c = np.empty((2 * i, 2 * h), np.int64)
    c[:i, :h] = p1 + p4 - p5 + p7
    c[:i, h:] = p3 + p5
    c[i:, :h] = p2 + p4
    c[i:, h:] = p1 - p2 + p3 + p6
    return c[:m, :n]


class Heaps:
    """The ``k`` best (score, id) of every line: higher scores first, then smaller ids."""

    def __init__(self, lines: int, k: int):
        self.k = k
        self.score = np.full((lines, k), NONE, np.int64)
        self.id = np.full((lines, k), np.iinfo(np.int64).max, np.int64)

    def offer(self, lines: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge a tile of scores (a line each, a column per id; NONE takes no part)."""
        k, n = self.k, score.shape[1]
        least = np.maximum(self.score[lines, -1], NONE + 1)
        if n > k:
            least = np.maximum(least, np.partition(score, n - k, 1)[:, n - k])
        at, j = np.nonzero(score >= least[:, None])
        if not len(at):
            return
        touched, at = np.unique(at, return_inverse=True)
        lines = lines[touched]
        row = np.concatenate([at, np.repeat(np.arange(len(lines)), k)])
        s = np.concatenate([score[touched[at], j], self.score[lines].ravel()])
        i = np.concatenate([ids[j], self.id[lines].ravel()])
        order = np.lexsort((i, -s, row))
        starts = np.searchsorted(row[order], np.arange(len(lines)))
        best = order[starts[:, None] + np.arange(k)]  # every line has its k old entries at least
        self.score[lines], self.id[lines] = s[best], i[best]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line, score and id of all that was found."""
        line, j = np.nonzero(self.score > NONE)
        return line, self.score[line, j], self.id[line, j]


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    """Lists of longs as the rows of a matrix, padded with zeros."""
    sizes = col.value_lengths().to_numpy(zero_copy_only=False)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(len(col), dims)
    out = np.zeros((len(col), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _tiles(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, matrix) of at most ROW_TILE entries."""
    step = max(1, ROW_TILE // max(dims, 1))
    for whole in batches:
        for b in (whole.slice(i, step) for i in range(0, len(whole), step)):
            yield b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), dims)


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """(id, label, v) of the rows that take part, one row per id; v holds the integer components."""
    v = vectors[vec_col].cast("array<double>")
    df = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("long").alias("label"), v.alias("x"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    df = df.where("id is not null and label is not null and x is not null").where(~bad)
    length = F.aggregate("x", F.lit(0.0), lambda a, x: a + F.pow(F.floor(x * F.lit(float(scale))).cast("double"), F.lit(2.0)))
    df = df.where(length < LIMIT)
    df = written(df.select("id", "label", F.transform("x", lambda x: F.floor(x * F.lit(float(scale)))).alias("v")), "hn-rows")
    again = written(df.groupBy("id").count().where("count > 1").select("id"), "hn-repeated")
    if again.isEmpty():
        return df
    one = semi(df, again, "id").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    return written(anti(df, again, "id").unionByName(one), "hn-rows")


def _batch(**cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols.values()], names=list(cols))


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The heaps of all tasks merged: at most ``k`` rows a key, with ``rank`` from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
         anchors: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` chooses anchors by a condition on column ``id`` (all that are
    divisible by 100 if none is given). A negative's score lies between ``low``
    and ``high`` percent of its positive's.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col, label_col)
    chosen = written(rows.where(F.col("id") % 100 == 0 if anchors is None else anchors), "hn-anchors")
    n, dims = chosen.count(), rows.agg(F.max(F.size("v"))).first()[0] or 0
    chunks = math.ceil(n * max(dims, 1) * 8 / CHUNK_BYTES)
    parts = []
    path = f"{ensure_checkpoint_dir(spark)}/moatlens-hn-{uuid.uuid4().hex}"
    for chunk in range(chunks):
        part = chosen if chunks == 1 else chosen.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == chunk)
        got = part.select("id", "label", "v").toArrow().combine_chunks()  # about CHUNK_BYTES
        if not len(got):
            continue
        ids, labels = got["id"].to_numpy(), got["label"].to_numpy()
        order = np.lexsort((ids, labels))
        ids, labels, a = ids[order], labels[order], _matrix(got["v"].combine_chunks(), dims)[order]
        out = _of_chunk(rows, ids, labels, a, positives, negatives, low, high)
        out.write.parquet(f"{path}/{chunk}")
        parts.append(f"{path}/{chunk}")
    return spark.read.schema(RESULT).parquet(*parts) if parts else spark.createDataFrame([], RESULT)


def _of_chunk(rows: DataFrame, ids: np.ndarray, labels: np.ndarray, a: np.ndarray, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """Results of the anchors ``ids``, in order of their labels."""
    spark, dims = rows.sparkSession, a.shape[1]
    sent = spark.sparkContext.broadcast((ids, labels, a))
    step = max(1, ANCHOR_TILE // max(dims, 1))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, a = sent.value
        heaps = Heaps(len(ids), positives)
        for tid, tlabel, t in _tiles(batches, dims):
            for label in np.unique(tlabel):
                first, last = np.searchsorted(labels, label), np.searchsorted(labels, label, "right")
                if first == last:
                    continue
                of = np.flatnonzero(tlabel == label)
                other, right = tid[of], np.ascontiguousarray(t[of].T)
                for i in range(first, last, step):
                    lines = np.arange(i, min(i + step, last))
                    score = multiply(a[lines], right)
                    score[ids[lines][:, None] == other] = NONE
                    heaps.offer(lines, score, other)
        line, score, other = heaps.entries()
        yield _batch(anchor_id=ids[line], score=score, id=other)

    found = _best(rows.mapInArrow(same, "anchor_id long, score long, id long"), ["anchor_id"], positives)
    got = written(found.select("anchor_id", "rank", "id", "score"), "hn-positives").toArrow()  # ``positives`` rows an anchor
    best_id, best = np.zeros((len(ids), positives), np.int64), np.full((len(ids), positives), NONE, np.int64)
    by_id = np.argsort(ids)
    line, rank = by_id[np.searchsorted(ids[by_id], got["anchor_id"].to_numpy())], got["rank"].to_numpy() - 1
    best_id[line, rank], best[line, rank] = got["id"].to_numpy(), got["score"].to_numpy()
    sent_best = spark.sparkContext.broadcast((best_id, best))

    def window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, labels, a), (best_id, best) = sent.value, sent_best.value
        p = np.maximum(best, -1)  # windows of negative scores are empty, as is that of -1
        least, most = -(-low * p // 100), high * p // 100
        heaps = [Heaps(len(ids), negatives) for _ in range(positives)]
        for tid, tlabel, t in _tiles(batches, dims):
            right = np.ascontiguousarray(t.T)
            for i in range(0, len(ids), step):
                lines = np.arange(i, min(i + step, len(ids)))
                score = multiply(a[lines], right)
                score[labels[lines][:, None] == tlabel] = NONE
                for j, heap in enumerate(heaps):
                    inside = (score >= least[lines, j, None]) & (score <= most[lines, j, None])
                    heap.offer(lines, np.where(inside, score, NONE), tid)
        for j, heap in enumerate(heaps):
            line, score, other = heap.entries()
            yield _batch(anchor_id=ids[line], positive_id=best_id[line, j], positive_score=best[line, j], score=score, id=other)

    found = rows.mapInArrow(window, "anchor_id long, positive_id long, positive_score long, score long, id long")
    return _best(found, ["anchor_id", "positive_id"], negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
