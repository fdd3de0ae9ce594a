"""Language model scores: a word unigram base and a causal self-attention model.

Word counts cover all training documents (those outside the held-out fold).
Frequent words, at most ``HEAD``, travel to the tasks; the others of a
document are joined with the counts by shuffle, so nothing is left out.

The attention model sees a text as the piece ids of its lower-cased words and
an end id. One causal head over ``SPAN`` ids predicts the class of the next id;
the id within its class follows the id before it, by transition counts over
all training documents (dense for the ``SLOTS`` most frequent ids, backing off
to the id's share of its class). Classes are groups of ids with like
neighbours, cut by count into about equal shares; neighbours are counted over
all training documents. Embeddings, attention and class weights are trained in
numpy on every id of all training documents: these are dealt by hash into parts
of about ``PART`` words, the parts are trained on in the tasks from one common
start, and what they move the parameters by is summed, weighted by the ids that
each part trained on. The start is the model of the first part, after
``EPOCHS`` passes over it. Parts don't depend on how the input is split, and the
sums are of whole numbers, so reruns agree. Texts are scored whole:
windows of ``SPAN`` ids overlap, every id is scored once, with at least
``SPAN - STEP`` ids before it after the first window, many windows at a time
under one mask.

Defined cases: null and blank texts are the end token alone; without training
documents counts are 0 and the model is uniform; repeated rows count and score
alike, each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moatlens.llm.common import written
from moatlens.llm.merges import ManyWords
from moatlens.llm.pieces import PieceModel, _blob, _model

FOLDS = 10
ALPHA = 0.1
HEAD = 200_000
CACHE = 1_000_000
SPAN, STEP = 32, 16
SKIP = SPAN - STEP
DIM, CLASSES, GROUPS = 16, 64, 24
SLOTS, BACKOFF = 1024, 20.0
#: Words of a part, and ids of it that are trained on at a time.
PART, TRAINED = 500_000, 300_000
#: Steps of the whole numbers in which the parts' moves are summed.
FIXED = float(1 << 20)
TOP = 256
EPOCHS, RATE, BATCH = 6, 0.02, 256
BEGIN, END = 1, 2
#: Windows scored at a time; their arrays stay in the processor's cache.
CHUNK = 256
#: Words counted before a task hands its counts on.
COUNT_WORDS = 400_000
#: Neighbour keys counted before a task hands its counts on.
COUNT_KEYS = 1_000_000


def held_out(id_: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % folds == 0


def lower_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over (text) rows; each task adds up its own words first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], names=["word", "c"])
            own.clear()
            return b

        for b in batches:
            for t in b.column(0):
                own.update(lower_words(t.as_py()))
                if len(own) >= COUNT_WORDS:
                    yield out()
        if own:
            yield out()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def transitions(counts: DataFrame, blob) -> DataFrame:
    """(a, b, n) over the counted words: piece b follows piece a; BEGIN and END stand before and after a word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(blob.value)
        many = ManyWords(m)
        for b in batches:
            if not len(b):
                continue
            ids, size = many.encode([w.decode("utf-8") for w in b.column(0).to_pylist()])
            last = np.cumsum(size + 2) - 1
            x = np.full(len(ids) + 2 * len(size), END)
            x[last - size - 1] = BEGIN
            inner = np.ones(len(x), bool)
            inner[last] = inner[last - size - 1] = False
            x[inner] = ids
            weight = np.repeat(b.column(1).to_numpy(), size + 2)
            weight[last] = 0  # from one word's END to the next BEGIN: no step
            key, at = np.unique(x[:-1] * len(m.pieces) + x[1:], return_inverse=True)
            n = np.bincount(at, weight[:-1], len(key))
            key, n = key[n > 0], n[n > 0]
            yield pa.RecordBatch.from_arrays([pa.array((key // len(m.pieces)).astype(np.int32)), pa.array((key % len(m.pieces)).astype(np.int32)),
                                              pa.array(n.astype(np.int64))], names=["a", "b", "n"])

    return counts.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


# -- the model

def neighbour_columns(counts: np.ndarray) -> np.ndarray:
    """Column of every id as a neighbour: its own for the TOP most frequent, else the last one."""
    column = np.full(len(counts), TOP)
    column[np.argsort(-counts, kind="stable")[:TOP]] = np.arange(min(TOP, len(counts)))
    return column


def neighbour_keys(ids: np.ndarray, sizes: np.ndarray, column: np.ndarray) -> np.ndarray:
    """A key (id, side and column of the neighbour) for both neighbours of every id of concatenated sequences."""
    start = np.zeros(len(ids), bool)
    start[np.cumsum(sizes) - sizes] = True
    before = np.where(start, BEGIN, np.concatenate(([BEGIN], ids[:-1])))
    inner = np.flatnonzero(~start)
    wide = 2 * (TOP + 1)
    return np.concatenate((ids * wide + column[before], ids[inner - 1] * wide + TOP + 1 + column[ids[inner]]))


def groups_of(sequences: list[np.ndarray], counts: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Group of every id by k-means over its neighbours in the sequences; 0 for ids not seen."""
    if not sequences:
        return np.zeros(len(counts), np.int64)
    keys = neighbour_keys(np.concatenate(sequences), np.array([len(s) for s in sequences]), neighbour_columns(counts))
    return grouped(*np.unique(keys, return_counts=True), counts, groups)


def grouped(key: np.ndarray, n: np.ndarray, counts: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Group of every id by k-means over its neighbours, given how often each neighbour key is there."""
    out = np.zeros(len(counts), np.int64)
    if not len(key):
        return out
    wide = 2 * (TOP + 1)
    used, row = np.unique(key // wide, return_inverse=True)
    near = np.zeros((len(used), wide), np.float32)
    near[row, key % wide] = n
    total = near.sum(1, keepdims=True, dtype=np.float64)
    all_ = near.sum(0, dtype=np.float64)
    near += (8 * all_ / all_.sum()).astype(np.float32)
    near /= (total + 8).astype(np.float32)
    np.sqrt(near, out=near)
    near -= (total[:, 0] @ near / total.sum()).astype(np.float32)
    heavy = near * np.sqrt(total / total.sum()).astype(np.float32)
    axes = np.linalg.eigh((heavy.T @ heavy).astype(np.float64))[1][:, ::-1][:, :16].T
    x, w = near @ axes.T, counts[used] + 1
    c = x[np.argsort(-w, kind="stable")[:groups]].copy()
    for _ in range(12):
        own = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        for g in range(len(c)):
            if (own == g).any():
                c[g] = np.average(x[own == g], axis=0, weights=w[own == g])
    out[used] = own + 1
    return out


def neighbours(encoded: DataFrame, counts: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour keys over all documents and how often each is there: at most a row per id and column."""
    column = neighbour_columns(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], COUNT_KEYS

        def out() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

        for b in batches:
            for ids, sizes in sequences_of(b.column(0), kind):
                held.append(neighbour_keys(ids, sizes, column))
                room -= len(held[-1])
                if room <= 0:
                    yield out()
                    room = COUNT_KEYS
        if held:
            yield out()

    got = encoded.select("ids").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = got["key"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def sequences_of(column: pa.Array, kind: type, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Concatenated ids and their sizes, so many rows at a time."""
    for s in range(0, len(column), rows):
        got = column.slice(s, rows).to_pylist()
        yield np.frombuffer(b"".join(got), kind).astype(np.int64), np.array([len(g) for g in got]) // np.dtype(kind).itemsize


def classes_of(counts: np.ndarray, end: float, group: np.ndarray, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """Class of every id, and log share of the id in its class (add-one smoothed)."""
    c = counts + 1.0
    c[END] += end
    cls, base = np.empty(len(c), np.int64), 0
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        at = at[np.argsort(-c[at], kind="stable")]
        mass = np.cumsum(c[at])
        k = max(1, round(classes * mass[-1] / c.sum()))
        cls[at] = base + np.minimum(((mass - c[at]) / mass[-1] * k).astype(np.int64), k - 1)
        base += k
    cls = np.unique(cls, return_inverse=True)[1]
    return cls, np.log(c / np.bincount(cls, c)[cls])


def layout(cls: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of every id in the table of transitions, and its column; ids without a slot share a row, and a column per class."""
    order = np.argsort(-counts, kind="stable")[:SLOTS]
    slot = np.full(len(counts), len(order))
    slot[order] = np.arange(len(order))
    return slot, np.where(slot == len(order), len(order) + cls, slot)


def gathered(steps: DataFrame, slot: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions by slot and column, first pieces by column and last pieces by slot; the table has a bounded size."""
    spark = steps.sparkSession
    rows, cols = int(slot.max()) + 1, int(column.max()) + 1
    ids = spark.createDataFrame(pa.table({"id": np.arange(len(slot)), "slot": slot, "col": column}))
    j = steps.join(F.broadcast(ids.select(F.col("id").alias("a"), "slot")), "a").join(F.broadcast(ids.select(F.col("id").alias("b"), "col")), "b")
    r = F.when(F.col("a") == BEGIN, -1).otherwise(F.col("slot"))
    c = F.when(F.col("b") == END, -1).otherwise(F.col("col"))
    got = j.groupBy(r.alias("r"), c.alias("c")).agg(F.sum("n").alias("n")).toArrow()
    r, c, n = (got[k].to_numpy() for k in ("r", "c", "n"))
    table, inner = np.zeros((rows, cols)), (r >= 0) & (c >= 0)
    table[r[inner], c[inner]] = n[inner]
    first, last = np.zeros(cols), np.zeros(rows)
    first[c[(r < 0) & (c >= 0)]] = n[(r < 0) & (c >= 0)]
    last[r[(c < 0) & (r >= 0)]] = n[(c < 0) & (r >= 0)]
    return table, first, last


def following(cls: np.ndarray, share: np.ndarray, slot: np.ndarray, column: np.ndarray, table: np.ndarray, first: np.ndarray, last: np.ndarray) -> dict:
    """Log probability of an id given its class and the id before: ``follow[slot[before], column[id]] + rest[id]``.

    What follows a word's last piece is taken as a word's first piece.
    """
    n_cls, cols = int(cls.max()) + 1, table.shape[1]
    slots = len(table) - 1
    n = table + last[:, None] * first / max(first.sum(), 1)
    owner = np.arange(cols) - slots
    owner[column] = cls
    of_class = np.zeros((cols, n_cls))
    ok = (owner >= 0) & (owner < n_cls)
    of_class[np.flatnonzero(ok), owner[ok]] = 1
    part = np.bincount(column, np.exp(share), cols)
    follow = np.log(n + BACKOFF * part + 1e-30) - np.log(n @ of_class + BACKOFF)[:, np.clip(owner, 0, n_cls - 1)]
    rest = np.where(column >= slots, share - np.log(np.maximum(part, 1e-30))[column], 0)
    return {"slot": slot, "follow": follow, "column": column, "rest": rest}


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated sequences: each window's first position, its scored range begins there, and its sequence.

    Every window scores its last STEP ids; a sequence's first window begins before the sequence does.
    """
    n = np.maximum(1, -(-sizes // STEP))
    of = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    first = np.repeat(np.cumsum(sizes) - sizes, n) + k * STEP - SKIP
    return first, np.full(len(of), SKIP), of


def _mask() -> np.ndarray:
    """Which ids of a window each scored one sees."""
    return np.tril(np.ones((SPAN, SPAN), np.float32))[SKIP:]


class Scorer:
    """A trained model with its products per id and per position laid out."""

    def __init__(self, p: dict):
        self.p = {k: v.astype(np.float32) for k, v in p.items() if k not in ("cls", "slot", "column")}
        q = self.p
        scored = np.concatenate([q["q"] / math.sqrt(DIM), np.eye(DIM, dtype=np.float32)], 1)
        seen = np.concatenate([q["k"], q["v"] @ q["o"]], 1)
        self.scored_id, self.scored_pos = q["e"] @ scored, (q["p"] @ scored)[SKIP:]
        self.seen_id, self.seen_pos, self.cls, self.mask = q["e"] @ seen, q["p"] @ seen, p["cls"], _mask()
        self.slot, self.column, self.ones = p["slot"], p["column"], np.ones(len(q["c"]), np.float32)
        # hidden values are below 1: whether a class's weight can overflow
        self.steep = float((np.abs(q["u"]).sum(0) + np.abs(q["c"])).max()) > 80

    def log10(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log probability of each concatenated sequence (every one ends with END).

        Windows are scored in blocks of one shape, the last one filled up with
        its last window, and products are made window by window: how sums are
        made does not depend on what shares a call, or where in it a text lies.
        """
        starts = np.cumsum(sizes) - sizes
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[starts] = BEGIN
        got = np.zeros(len(ids), np.float32)
        first, _, of = windows(sizes)
        begin, end, step, target = starts[of], (starts + sizes)[of], np.arange(SPAN), self.cls[ids]
        rows = np.arange(CHUNK * STEP)
        for s in range(0, len(first), CHUNK):
            w = np.minimum(np.arange(s, s + CHUNK), len(first) - 1)
            at = first[w, None] + step
            b = before[np.clip(at, 0, len(ids) - 1)]
            seen, own = self.seen_id[b], self.scored_id[b[:, SKIP:]]
            seen += self.seen_pos
            own += self.scored_pos
            a = np.matmul(own[:, :, :DIM], seen[:, :, :DIM].transpose(0, 2, 1))
            np.exp(np.clip(a, -30, 30, out=a), out=a)
            a *= self.mask
            early = np.flatnonzero(at[:, 0] < begin[w])
            a[early] *= (at[early] >= begin[w[early], None])[:, None]
            h = np.matmul(a, seen[:, :, DIM:])
            h /= a.sum(2, keepdims=True)
            h += own[:, :, DIM:]
            h /= 1 + np.abs(h)
            z = np.matmul(h, self.p["u"]).reshape(len(rows), -1)  # a product per window
            z += self.p["c"]
            if self.steep:
                np.clip(z, -80, 80, out=z)
            at = at[:, SKIP:]
            live = at < end[w, None]
            own = z[rows, target[np.minimum(at, len(ids) - 1)].ravel()]
            np.exp(z, out=z)
            got[at[live]] = (own - np.log(z @ self.ones))[live.ravel()]
        got += self.p["follow"][self.slot[before], self.column[ids]] + self.p["rest"][ids]
        return np.add.reduceat(got.astype(np.float64), starts) / math.log(10)


DENSE = ("p", "q", "k", "v", "o", "u", "c")


class Trainer:
    """Parameters and the state of their optimiser: Adam, and for the embeddings, of which only those seen move, Adagrad."""

    def __init__(self, p: dict, m1: dict, m2: dict, t: int = 0):
        self.p, self.m1, self.m2, self.t = p, m1, m2, t
        self.seen, self.n = np.zeros(len(p["e"]), np.int64), 0

    @classmethod
    def new(cls, n_ids: int, n_classes: int, seed: int = 5) -> Trainer:
        rng = np.random.default_rng(seed)
        init = lambda *s: rng.normal(0, s[0] ** -0.5, s)
        p = {"e": rng.normal(0, 0.3, (n_ids, DIM)), "p": rng.normal(0, 0.1, (SPAN, DIM)), "q": init(DIM, DIM), "k": init(DIM, DIM),
             "v": init(DIM, DIM), "o": init(DIM, DIM), "u": np.zeros((DIM, n_classes)), "c": np.zeros(n_classes)}
        p = {k: v.astype(np.float32) for k, v in p.items()}
        return cls(p, {k: np.zeros_like(p[k]) for k in DENSE}, {k: np.zeros_like(v) for k, v in p.items()})

    def copy(self) -> Trainer:
        return Trainer(*({k: v.copy() for k, v in d.items()} for d in (self.p, self.m1, self.m2)), self.t)

    def fit(self, ids: np.ndarray, sizes: np.ndarray, cls: np.ndarray, rng: np.random.Generator) -> None:
        """One pass over concatenated sequences, window by window in random order."""
        starts = np.cumsum(sizes) - sizes
        before = np.concatenate(([BEGIN], ids[:-1]))
        before[starts] = BEGIN
        first, _, of = windows(sizes)
        begin, end, at_step, target = starts[of], (starts + sizes)[of], np.arange(SPAN), cls[ids]
        order = rng.permutation(len(first))
        for s in range(0, len(order), BATCH):
            w = order[s:s + BATCH]
            at = first[w, None] + at_step
            there = at >= begin[w, None]
            inside = there & (at < end[w, None])
            live = inside[:, SKIP:]
            b = before[np.clip(at, 0, len(ids) - 1)]
            self.step(b, target[at[:, SKIP:][live]], live, there)
            self.seen += np.bincount(b[inside], minlength=len(self.seen))
            self.n += int(live.sum())

    def step(self, b: np.ndarray, y: np.ndarray, live: np.ndarray, there: np.ndarray) -> None:
        """One update from windows of ids: only their scored ids ask, all of them that are there are seen."""
        p, scale = self.p, np.float32(1 / math.sqrt(DIM))
        flat = lambda m: m.reshape(-1, m.shape[-1])
        times = lambda m, w: (flat(m) @ w).reshape(m.shape)
        x = p["e"][b] + p["p"]
        own = np.ascontiguousarray(x[:, SKIP:])
        q, k, v = times(own, p["q"]), times(x, p["k"]), times(x, p["v"])
        a = np.matmul(q, k.transpose(0, 2, 1))
        a *= scale
        np.exp(np.clip(a, -30, 30, out=a), out=a)
        a *= _mask()
        early = np.flatnonzero(~there[:, 0])
        a[early] *= there[early][:, None]
        a /= a.sum(2, keepdims=True)
        o = np.matmul(a, v)
        r = (own + times(o, p["o"]))[live]
        below = 1 + np.abs(r)
        h = r / below
        dz = h @ p["u"]
        dz += p["c"]
        dz -= dz.max(1, keepdims=True)
        np.exp(dz, out=dz)
        dz /= dz.sum(1, keepdims=True)
        dz[np.arange(len(y)), y] -= 1
        dz /= len(y)
        dr = np.zeros_like(own)
        dr[live] = dz @ p["u"].T / below ** 2
        do = times(dr, p["o"].T)
        da = np.matmul(do, v.transpose(0, 2, 1))
        da -= (da * a).sum(2, keepdims=True)
        da *= a
        da *= scale
        dq, dk, dv = np.matmul(da, k), np.matmul(da.transpose(0, 2, 1), q), np.matmul(a.transpose(0, 2, 1), do)
        dx = times(dk, p["k"].T) + times(dv, p["v"].T)
        dx[:, SKIP:] += dr + times(dq, p["q"].T)
        grad = {"p": dx.sum(0), "q": flat(own).T @ flat(dq), "k": flat(x).T @ flat(dk), "v": flat(x).T @ flat(dv),
                "o": flat(o).T @ flat(dr), "u": h.T @ dz, "c": dz.sum(0)}
        self.t += 1
        for key, g in grad.items():
            self.m1[key] += 0.1 * (g - self.m1[key])
            self.m2[key] += 0.001 * (g * g - self.m2[key])
            p[key] -= RATE * (self.m1[key] / (1 - 0.9 ** self.t)) / (np.sqrt(self.m2[key] / (1 - 0.999 ** self.t)) + 1e-8)
        rows, inverse = np.unique(b, return_inverse=True)
        inverse = inverse.ravel()
        order = np.argsort(inverse, kind="stable")
        g = np.add.reduceat(flat(dx)[order], np.searchsorted(inverse[order], np.arange(len(rows))), axis=0)
        self.m2["e"][rows] += g * g
        p["e"][rows] -= 0.1 * g / (np.sqrt(self.m2["e"][rows]) + 1e-8)


def stacked(p: dict) -> np.ndarray:
    """All parameters as rows of DIM numbers, the embeddings first."""
    c = np.zeros(-(-len(p["c"]) // DIM) * DIM, np.float32)
    c[:len(p["c"])] = p["c"]
    return np.concatenate([p["e"], *(p[k] for k in "pqkvo"), p["u"].T, c.reshape(-1, DIM)])


def unstacked(rows: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in ("e", "p", "q", "k", "v", "o", "u", "c"):
        n = -(-like[k].size // DIM)
        part = rows[at:at + n]
        out[k] = part.T if k == "u" else part.ravel()[:like[k].size].reshape(like[k].shape)
        at += n
    return out


def train(sequences: list[np.ndarray], cls: np.ndarray, seed: int = 5) -> Trainer:
    """A model of the sequences, after EPOCHS passes over them."""
    out, rng = Trainer.new(len(cls), int(cls.max()) + 1, seed), np.random.default_rng(seed)
    if sequences:
        ids, sizes = np.concatenate(sequences), np.array([len(s) for s in sequences])
        for _ in range(EPOCHS):
            out.fit(ids, sizes, cls, rng)
    return out


def moves(start: Trainer, cls: np.ndarray, parts: Iterator[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sum, in whole numbers, of what each part of (part, sequence) moves the parameters by, and the weights.

    An embedding's weight is how often its id was seen, that of the others the number of ids trained on.
    """
    origin, n_ids = stacked(start.p).astype(np.float64), len(cls)
    moved, weight = np.zeros(origin.shape, np.int64), np.zeros(len(origin), np.int64)
    for part, of_part in groupby(parts, key=lambda x: x[0]):
        own, rng, held, room = start.copy(), np.random.default_rng(part), [], TRAINED
        for _, s in of_part:
            held.append(s)
            room -= len(s)
            if room <= 0:
                own.fit(np.concatenate(held), np.array([len(x) for x in held]), cls, rng)
                held, room = [], TRAINED
        if held:
            own.fit(np.concatenate(held), np.array([len(x) for x in held]), cls, rng)
        w = np.concatenate((own.seen, np.full(len(origin) - n_ids, own.n)))
        at = np.flatnonzero(w)
        moved[at] += np.rint((stacked(own.p)[at] - origin[at]) * (w[at, None] * FIXED)).astype(np.int64)
        weight += w
    return moved, weight


def trained(encoded: DataFrame, parts: int, cls: np.ndarray, kind: type) -> dict:
    """The parameters after a pass over all documents of (h, ids): the parts' moves from the common start, averaged."""
    spark = encoded.sparkSession
    dealt = encoded.select(F.pmod("h", F.lit(parts)).cast("int").alias("part"), "h", "ids")
    first = dealt.where("part = 0").orderBy("h").select("ids").toArrow()["ids"].to_pylist()
    start = train([np.frombuffer(x, kind).astype(np.int64) for x in first], cls)
    sent = spark.sparkContext.broadcast((start, cls))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, classes = sent.value
        pairs = ((part, np.frombuffer(x, kind).astype(np.int64)) for b in batches for part, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        moved, weight = moves(begun, classes, pairs)
        at = np.flatnonzero(weight)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weight[at]), *(pa.array(moved[at, i]) for i in range(DIM))], names=names)

    names = ["key", "weight", *(f"m{i}" for i in range(DIM))]
    got = dealt.repartition("part").sortWithinPartitions("part", "h").select("part", "ids").mapInArrow(run, ", ".join(f"{n} long" for n in names))
    got = got.groupBy("key").agg(*(F.sum(n).alias(n) for n in names[1:])).toArrow()
    rows = stacked(start.p).astype(np.float64)
    moved = np.stack([got[n].to_numpy() for n in names[2:]], 1)
    rows[got["key"].to_numpy()] += moved / (got["weight"].to_numpy()[:, None] * FIXED)
    return unstacked(rows, start.p) | {"cls": cls}


class Words:
    """A task's words: piece ids, all in one array, and base log probability of each; emptied when CACHE are kept."""

    def __init__(self, model: PieceModel, head: dict[bytes, float]):
        self.many, self.head = ManyWords(model), head
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.ids, self.start, self.size, self.base = array("q"), array("q"), array("q"), array("d")

    def of(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Numbers of the words of every text."""
        if len(self.at) > CACHE:
            self.clear()
        at, get = self.at, self.at.get
        out = [[get(w) for w in words] for words in texts]
        open_ = [k for k, numbers in enumerate(out) if None in numbers]
        self._add(list(dict.fromkeys(w for k in open_ for w, i in zip(texts[k], out[k], strict=True) if i is None)))
        for k in open_:
            out[k] = [at[w] if i is None else i for w, i in zip(texts[k], out[k], strict=True)]
        return [np.array(numbers, np.int64) for numbers in out]

    def _add(self, words: list[bytes]) -> None:
        ids, size = self.many.encode([w.decode("utf-8") for w in words])
        first = len(self.ids) + np.cumsum(size) - size
        self.at.update(zip(words, range(len(self.start), len(self.start) + len(words)), strict=True))
        self.ids.frombytes(ids.astype(np.int64).tobytes())
        self.start.frombytes(first.astype(np.int64).tobytes())
        self.size.frombytes(size.astype(np.int64).tobytes())
        self.base.extend(self.head.get(w, math.nan) for w in words)

    def logs(self, numbers: np.ndarray) -> np.ndarray:
        """Base log probabilities, nan for words that aren't frequent."""
        return np.frombuffer(self.base)[numbers] if len(numbers) else np.empty(0)

    def pieces(self, numbers: np.ndarray) -> np.ndarray:
        """Piece ids of the words, one after the other, and END."""
        out = np.array([END], np.int64)
        if len(numbers):
            size = np.frombuffer(self.size, np.int64)[numbers]
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) + np.repeat(np.frombuffer(self.start, np.int64)[numbers] - ends + size, size)
            out = np.append(np.frombuffer(self.ids, np.int64)[at], END)
        return out


def scores(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    training = rows.where(~held_out(F.col("doc_id"), folds))
    blob = _blob(docs, model_path)
    counts = written(word_counts(training), "lm-counts")
    ends = training.count()
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, distinct = tokens + ends, distinct + (ends > 0)
    below = tokens + ALPHA * (distinct + 1)
    # the least count whose words, with all more frequent ones, are at most HEAD
    least = counts.groupBy("c").agg(F.count("*").alias("n")).selectExpr("c", "sum(n) over (order by c desc) as upto").where(f"upto <= {HEAD}").agg(F.min("c")).first()[0]
    head = {} if least is None else {bytes(r["word"]): math.log10((r["c"] + ALPHA) / below) for r in counts.where(F.col("c") >= least).toLocalIterator()}
    model = _model(blob.value)
    steps = written(transitions(counts, blob), "lm-steps")
    pieces = np.zeros(len(model.pieces))
    for r in steps.where(F.col("b") != END).groupBy("b").agg(F.sum("n").alias("n")).collect():  # at most a row per id
        pieces[r["b"]] = r["n"]
    kind = np.uint16 if len(model.pieces) <= 1 << 16 else np.int32
    known = spark.sparkContext.broadcast(head)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(_model(blob.value), known.value)
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, len(whole), 256)):
                size, head_sum, head_n, rare, times, seqs = [], [], [], [], [], []
                texts = [lower_words(t.as_py()) for t in b.column(3)]
                for w, at in zip(texts, words.of(texts), strict=True):
                    lp = words.logs(at)
                    out = np.isnan(lp)
                    size.append(len(w) + 1)
                    head_sum.append(float(np.where(out, 0, lp).sum()))
                    head_n.append(len(w) - int(out.sum()))
                    left = Counter([w[i] for i in np.flatnonzero(out)])
                    rare.append(list(left))
                    times.append(list(left.values()))
                    seqs.append(words.pieces(at).astype(kind).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(2), pa.array(size, pa.int64()), pa.array(head_n, pa.int64()), pa.array(head_sum, pa.float64()),
                     pa.array(seqs, pa.binary()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                    names=["row", "doc_id", "h", "n_tokens", "head_n", "head_sum", "ids", "rare", "times"])

    schema = "row long, doc_id long, h long, n_tokens long, head_n long, head_sum double, ids binary, rare array<binary>, times array<long>"
    table = written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("doc_id", "text").alias("h"), "text")
                    .mapInArrow(encode, schema), "lm-encoded")
    learned = table.where(~held_out(F.col("doc_id"), folds)).select("h", "ids")
    cls, share = classes_of(pieces, ends, grouped(*neighbours(learned, pieces, kind), pieces))
    slot, column = layout(cls, pieces)
    follows = following(cls, share, slot, column, *gathered(steps, slot, column))
    sent = spark.sparkContext.broadcast(trained(learned, max(1, -(-tokens // PART)), cls, kind) | follows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            score = [scorer.log10(*x) for x in sequences_of(b.column(5), kind)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(np.concatenate(score) if score else [], pa.float64())],
                                             names=["row", "doc_id", "n_tokens", "head_n", "head_sum", "score"])

    scored = table.select("row", "doc_id", "n_tokens", "head_n", "head_sum", "ids").mapInArrow(
        run, "row long, doc_id long, n_tokens long, head_n long, head_sum double, score double")
    tail = table.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("k"))
    tail = tail.join(counts if least is None else counts.where(F.col("c") < least), "word", "left")
    lp = F.log10((F.coalesce("c", F.lit(0)) + ALPHA) / below)
    tail = tail.groupBy("row").agg(F.sum(F.col("k") * lp).alias("tail_sum"), F.sum(F.when(F.col("c") > 0, F.col("k"))).alias("tail_n"))
    end = math.log10((ends + ALPHA) / below)
    return scored.join(tail, "row", "left").select(
        "doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "n_tokens",
        (F.col("head_n") + F.coalesce("tail_n", F.lit(0)) + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) + end).alias("base_score"), "score")
