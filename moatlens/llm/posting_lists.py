"""Approximate nearest neighbours by balanced posting lists.

There is a list for every ``LIST`` vectors, beyond ``BASE_LISTS`` lists about
``PER_ROOT`` times the square root of the number of vectors. Centroids are fitted
on a sample of ``SAMPLE_PER_LIST`` vectors a list, in two levels: a few coarse
centroids deal the sample into cells, and k-means runs in a task for every cell
(a cell of more than ``FINE`` lists is cut by hash). The driver holds centroids
and their graph, a row a list, and 64 sample vectors a coarse centroid. Every
vector is indexed. A vector goes to its nearest centroid and, near a
boundary, to further ones: those within ``1 + REPLICATE`` of the nearest
distance that are not hidden behind a centroid already taken, ``REPLICAS`` at
most. Lists that grow past ``BLOCK`` vectors are split into blocks by hash, so
that no task gets an unbounded list, and the queries of a list past
``QUERY_BLOCK``; a list's vectors are sent once for each block of its queries.

Centroids are searched by best-first search in a neighbour graph held in
memory. A query reads the lists whose centroid is within ``1 + PRUNE`` of its
nearest centroid's distance, at most 3 * sqrt(lists), but as many as
``LEAST`` candidates need. Inner products become distances by one added
coordinate; final scores are inner products of the original vectors in double
precision.

Defined cases: null, zero or non-finite vectors, those with null components
and those of another length than most take no part; of rows that repeat an id
the smallest vector counts; equal scores go to the smaller id; with at most k
candidates all are returned; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moatlens.llm.common import anti, lookup, semi, written

K = 20
LIST = 48
BASE_LISTS, PER_ROOT = 4096, 4
FINE = 1024
SAMPLE_PER_LIST = 16
ROUNDS = 8
REPLICATE, REPLICAS = 0.1, 6
PRUNE = 0.35
LEAST = 1000
BLOCK, QUERY_BLOCK = 4096, 16384
#: Queries scored at once, centroids times points in the search's table of seen ones.
SCORED, SEEN = 512, 1 << 25
DEGREE, WIDTH = 24, 16


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v, norm) of the vectors that take part, one row per id; v holds doubles."""
    v = F.col("v")
    df = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].cast("array<double>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    df = df.where(F.col("id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    df = df.where(F.exists(v, lambda x: x != 0))
    # vectors are sorted only where an id repeats
    again = written(df.groupBy("id").count().where("count > 1").select("id"), "ann-again")
    if not again.isEmpty():
        df = anti(df, again, "id").unionByName(semi(df, again, "id").groupBy("id").agg(F.min("v").alias("v")))
    df = df.withColumn("norm", F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)))
    return df.where("norm > 0 and norm < double('infinity')")


def n_lists(n: int) -> int:
    """How many lists n vectors get."""
    return max(1, min(n // LIST, max(BASE_LISTS, math.ceil(PER_ROOT * math.sqrt(n)))))


def fit(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """k-means; lists over twice their share are split, in place of the emptiest."""
    x = sample.astype(np.float32)
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:lists]].copy()
    for r in range(rounds):
        near = np.concatenate([(x[i:i + 4096] @ c.T - 0.5 * (c * c).sum(1)).argmax(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        starts = np.concatenate(([0], np.cumsum(n)[:-1]))
        full = np.flatnonzero(n)
        c[full] = np.add.reduceat(x[order], starts[full]) / n[full, None]
        if r < rounds - 2:
            heavy, light = np.argsort(-n, kind="stable"), np.argsort(n, kind="stable")
            for a, b in zip(heavy, light, strict=True):
                if n[a] <= 2 * len(x) / len(c) or a == b or n[b] * 4 > len(x) / len(c):
                    break
                c[b] = x[order[starts[a] + rng.integers(n[a])]]
    return c


def neighbours(c: np.ndarray, rows: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """The ``degree`` nearest other centroids of each of these centroids, nearest first."""
    sq, m = (c * c).sum(1), min(degree, len(c) - 1)
    out = np.empty((len(rows), m), np.int32)
    for i in range(0, len(rows) if m else 0, 256):
        at = rows[i:i + 256]
        d = sq - 2 * c[at] @ c.T
        d[np.arange(len(at)), at] = np.inf
        some = np.sort(np.argpartition(d, m - 1, 1)[:, :m], 1)
        out[i:i + 256] = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), 1, kind="stable"), 1)
    return out


class Graph:
    """Neighbour graph over the centroids and best-first search in it, many points at a time."""

    def __init__(self, c: np.ndarray, near: np.ndarray | None = None, seed: int = 7):
        self.c, n = c, len(c)
        self.sq = (c * c).sum(1)
        near = neighbours(c, np.arange(n)) if near is None else near
        # long links keep the graph connected: each centroid also knows the next ones of two random rings
        rng = np.random.default_rng(seed)
        rings = [np.empty(n, np.int64) for _ in range(2)]
        for ring in rings:
            p = rng.permutation(n)
            ring[p] = np.roll(p, -1)
        self.links = np.concatenate([near, *[r[:, None] for r in rings]], 1)
        self.entry = rng.permutation(n)[:min(n, 32)]

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of about the ``width`` nearest centroids of every row, nearest first."""
        x, n = x.astype(np.float32), len(self.c)
        width = min(width, n)
        rows = np.arange(len(x))[:, None]
        dist = lambda ids: np.maximum(np.einsum("bmd,bd->bm", self.c[ids], x) * -2 + self.sq[ids] + (x * x).sum(1)[:, None], 0)
        seen = np.zeros((len(x), n), bool)
        ids = np.tile(self.entry, (len(x), 1))
        seen[rows, ids] = True
        d, done = dist(ids), np.zeros(ids.shape, bool)
        while True:
            open_ = np.where(done, np.inf, d)
            best = np.argsort(open_, 1, kind="stable")[:, :4]
            if not np.isfinite(np.take_along_axis(open_, best, 1)).any():
                break
            np.put_along_axis(done, best, True, 1)
            more = self.links[np.take_along_axis(ids, best, 1)].reshape(len(x), -1)
            more.sort(1)
            fresh = ~seen[rows, more]
            fresh[:, 1:] &= more[:, 1:] != more[:, :-1]
            seen[rows, more] = True
            far = np.where(fresh, dist(more), np.inf)
            ids, d, done = np.concatenate([ids, more], 1), np.concatenate([d, far], 1), np.concatenate([done, ~fresh], 1)
            top = np.argsort(d, 1, kind="stable")[:, :max(width, 8)]
            ids, d, done = (np.take_along_axis(a, top, 1) for a in (ids, d, done))
        return ids[:, :width], np.sqrt(d[:, :width])


def replicas(ids: np.ndarray, d: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which of each point's nearest centroids take it."""
    take = d <= d[:, :1] * (1 + REPLICATE)
    take &= np.isfinite(d)
    take[:, REPLICAS:] = False
    for j in range(1, min(ids.shape[1], REPLICAS)):
        for i in range(j):
            gap = np.sqrt(((c[ids[:, i]] - c[ids[:, j]]) ** 2).sum(1))
            take[:, j] &= ~(take[:, i] & (gap < 0.5 * d[:, j]))
    take[:, 0] = True
    return take


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _raised(v: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that gives all of them the length ``top``."""
    rest = np.sqrt(np.maximum(top * top - (v * v).sum(1), 0))
    return np.concatenate([v, rest[:, None]], 1) / top


def centroids(rows: DataFrame, n: int, top: float) -> np.ndarray:
    """Centroids of the raised vectors in ``rows`` (a written table of n rows: id, v)."""
    spark = rows.sparkSession
    lists = n_lists(n)

    def some(wanted: int) -> DataFrame:
        # by a bound on the hash, so that no task sorts the vectors; ids are distinct, so about as many as wanted are chosen
        share = min(1.0, wanted / n)
        return rows if share == 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < max(1, int((1 << 30) * share)))

    cells = -(-lists // FINE)
    coarse = None
    if cells > 1:
        first = some(cells * 4 * SAMPLE_PER_LIST).select("id", "v").toArrow()
        first = first.take(np.argsort(first["id"].to_numpy())).combine_chunks()
        coarse = fit(_raised(_matrix(first["v"].combine_chunks()), top), cells)
    sent = spark.sparkContext.broadcast((coarse, top))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, top = sent.value
        for b in batches:
            x = np.zeros(len(b), np.int32)
            if c is not None and len(b):
                x = (_raised(_matrix(b.column(1)), top).astype(np.float32) @ c.T - 0.5 * (c * c).sum(1)).argmax(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x), b.column(0), b.column(1)], names=["cell", "id", "v"])

    sample = written(some(lists * SAMPLE_PER_LIST).select("id", "v").mapInArrow(deal, "cell int, id long, v array<double>"), "ann-sample")
    if sample.isEmpty():  # a tiny table without a chosen row
        sample = rows.orderBy("id").limit(lists).select(F.lit(0).alias("cell"), "id", "v")
    parts = sample.groupBy("cell").agg(F.ceil(F.count("*") / (FINE * SAMPLE_PER_LIST)).cast("int").alias("parts"))
    dealt = lookup(sample, written(parts, "ann-parts"), ["cell"], F.col("id")).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), "parts"))

    def kmeans(t: pa.Table) -> pa.Table:
        t = t.take(np.argsort(t["id"].to_numpy())).combine_chunks()
        c = fit(_raised(_matrix(t["v"].combine_chunks()), sent.value[1]), max(1, round(len(t) / SAMPLE_PER_LIST)))
        return pa.table({"cell": t["cell"][:1].take([0] * len(c)), "part": t["part"][:1].take([0] * len(c)), "i": np.arange(len(c)), "c": list(c)})

    got = dealt.select("cell", F.col("part").cast("long"), "id", "v").groupBy("cell", "part").applyInArrow(kmeans, "cell int, part long, i long, c array<float>")
    got = got.orderBy("cell", "part", "i").select("c").toArrow()  # a row per list
    return _matrix(got["c"].combine_chunks()).astype(np.float32)


def linked(spark: SparkSession, c: np.ndarray) -> np.ndarray:
    """The neighbours of every centroid, found in tasks over ranges of them."""
    sent = spark.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = neighbours(sent.value, b.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(near), pa.list_(pa.int32()))], names=["i", "near"])

    got = spark.range(0, len(c), 1, -(-len(c) // FINE)).mapInArrow(run, "i long, near array<int>").orderBy("i").toArrow()
    return _matrix(got["near"].combine_chunks()).astype(np.int64)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every vector whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    result = "query_id long, vec_id long, score double"
    rows = written(usable(vectors, id_col, vec_col), "ann-vectors")
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == dims["d"])
    n, top = rows.agg(F.count("*"), F.max("norm")).first()
    c = centroids(rows, n, top)
    sent = spark.sparkContext.broadcast((c, top, linked(spark, c)))
    probes = max(1, math.ceil(3 * math.sqrt(len(c))))
    step = max(1, min(1024, SEEN // len(c)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Graph(sent.value[0], sent.value[2])
        for whole in batches:
            for b in (whole.slice(i, step) for i in range(0, len(whole), step)):
                ids, d = graph.search(_raised(_matrix(b.column(1)), sent.value[1]), WIDTH)
                r, j = np.nonzero(replicas(ids, d, graph.c))
                yield pa.RecordBatch.from_arrays([pa.array(ids[r, j].astype(np.int32)), b.column(0).take(pa.array(r)), b.column(1).take(pa.array(r))],
                                                 names=["list", "id", "v"])

    index = written(rows.select("id", "v").mapInArrow(assign, "list int, id long, v array<double>"), "ann-index")
    sizes = written(index.groupBy("list").agg(F.count("*").alias("size")), "ann-sizes")  # a row per centroid
    size_of = np.zeros(len(c), np.int64)
    for row in sizes.toLocalIterator():
        size_of[row["list"]] = row["size"]
    sent_sizes = spark.sparkContext.broadcast(size_of)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, size = Graph(sent.value[0], sent.value[2]), sent_sizes.value
        for whole in batches:
            for b in (whole.slice(i, min(step, 256)) for i in range(0, len(whole), min(step, 256))):
                q = _matrix(b.column(1))
                q = np.concatenate([q / np.sqrt((q * q).sum(1))[:, None], np.zeros((len(q), 1))], 1)
                ids, d = graph.search(q, max(probes, 2))
                many = size[ids].cumsum(1) - size[ids] < LEAST
                take = np.isfinite(d) & ((np.arange(ids.shape[1]) < probes) & (d <= d[:, :1] * (1 + PRUNE)) | many)
                r, j = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r, j].astype(np.int32)), b.column(0).take(pa.array(r)), b.column(1).take(pa.array(r))],
                                                 names=["list", "query_id", "q"])

    asked = rows.where(F.col("id") % every == 0).select("id", "v").mapInArrow(route, "list int, query_id long, q array<double>")
    asked = written(asked, "ann-queries")
    counts = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("long").alias("qblocks"))
    plan = written(sizes.select("list", F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks")).join(counts, "list"), "ann-plan")
    zero = F.lit(0).cast("long")
    left = lookup(index, plan, ["list"], F.col("id")).where("qblocks is not null").select("list", F.pmod(F.xxhash64("id"), "blocks").alias("block"),
                                           F.explode(F.sequence(zero, F.col("qblocks") - 1)).alias("qblock"), "id", "v")
    right = lookup(asked, plan, ["list"], F.col("query_id")).where("blocks is not null").select("list", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"),
                                            F.pmod(F.xxhash64("query_id"), "qblocks").alias("qblock"), "query_id", "q")

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [[], [], []]
        if len(a) and len(b):
            ids = a["id"].combine_chunks().to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], _matrix(a["v"].combine_chunks())[order]
            qid, q = b["query_id"].combine_chunks().to_numpy(), _matrix(b["q"].combine_chunks())
            m = min(k, len(ids))
            for i in range(len(qid)):
                if i % SCORED == 0:
                    block = q[i:i + SCORED] @ v.T
                    block[qid[i:i + SCORED, None] == ids] = -np.inf
                    lows = -np.partition(-block, m - 1, 1)[:, m - 1]
                near, least = block[i % SCORED], lows[i % SCORED]
                # equal vectors must score equally: sums in one order, over a slightly wider choice
                at = np.flatnonzero(near >= least - 1e-9 * (1 + abs(least))) if np.isfinite(least) else np.flatnonzero(np.isfinite(near))
                s = (v[at] * q[i]).sum(1)
                best = np.argsort(-s, kind="stable")[:k]
                out[0].append(np.full(len(best), qid[i]))
                out[1].append(ids[at[best]])
                out[2].append(s[best])
        empty = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({n: np.concatenate([e, *o]) for n, e, o in zip(("query_id", "vec_id", "score"), empty, out, strict=True)})

    keys = ["list", "block", "qblock"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, result)
    ranked = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("i", "x")).select(
        "query_id", (F.col("i") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.far")).alias("score"))
