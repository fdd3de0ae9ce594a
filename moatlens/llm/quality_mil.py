"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded
from the mean of its words' learned embeddings (a lower-cased word's hash picks
one of ``BUCKETS``), its characters and word repetitions; gated attention weighs
the passages and the weighted representation is scored. Only document labels are
known, so embeddings, encoder, attention and score are learned together, in
numpy, from a bounded sample of labelled documents (``SAMPLE``, the least by hash
of the id), each with all its passages; the scores cover every passage of every
document. Embeddings start at zero: a word not learned from says nothing.

Defined cases: a null or blank text is one empty passage; of several labels of
one id the mean counts, 0.5 and more as 1; without labels, or with labels of
one class, every score is the smoothed share of label 1; repeated rows score
alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE = 64
SAMPLE = 6000
HIDDEN, GATE = 24, 12
BUCKETS, DIM = 1 << 13, 8
EPOCHS, RATE, DECAY = 40, 0.01, 1e-4
FOLDS = 5
THRESHOLD = 0.3

#: Byte classes: lower case, upper case, digits, space, line feed, other white space, stops, commas and
#: the like, exclamation, bars, symbols, quotes and brackets, first bytes of other characters, their rest, else.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\v\f\r", ".", ",;:?-_/", "!", "|", "#*$%&<>@^~=+\\", "'\"`()[]{}")
_CLASS = np.full(256, len(CLASSES) + 2, np.uint8)
for _i, _s in enumerate(CLASSES):
    _CLASS[list(_s.encode())] = _i
_CLASS[0xC0:0x100] = len(CLASSES)
_CLASS[0x80:0xC0] = len(CLASSES) + 1
N_CLASSES = len(CLASSES) + 3
_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
FEATURES = N_CLASSES + 4
#: Passages whose word embeddings are looked up at once.
POOLED = 2048


def passages(text: str | None) -> np.ndarray:
    """(passages, FEATURES + PASSAGE): shares of byte classes, size, word length, words equal to the one before,
    distinct words; then every word's bucket from 1 on, 0 past the last word."""
    raw = (text or "").encode("utf-8").lower()
    b = np.frombuffer(raw, np.uint8)
    blank = _BLANK[b]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1]))) if len(b) else np.empty(0, np.int64)
    if not len(starts):
        return np.zeros((1, FEATURES + PASSAGE), np.float32)
    first = starts[::PASSAGE].copy()
    first[0] = 0
    n = len(first)
    where = np.repeat(np.arange(n), np.diff(np.append(first, len(b))))
    counts = np.bincount(where * N_CLASSES + _CLASS[b], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    words = np.fromiter(map(xxhash.xxh64_intdigest, raw.split()), np.uint64, len(starts))
    of = np.arange(len(words)) // PASSAGE
    same = np.concatenate(([False], words[1:] == words[:-1]))
    order = np.lexsort((words, of))
    fresh = np.concatenate(([True], (words[order][1:] != words[order][:-1]) | (of[order][1:] != of[order][:-1])))
    size = np.bincount(of, minlength=n)
    total = counts.sum(1)
    out = np.zeros((n, FEATURES + PASSAGE), np.float32)
    out[:, :N_CLASSES] = counts / total[:, None]
    out[:, N_CLASSES] = np.log1p(size)
    out[:, N_CLASSES + 1] = np.log1p(total / size)
    out[:, N_CLASSES + 2] = np.bincount(of, same, n) / size
    out[:, N_CLASSES + 3] = np.bincount(of[order], fresh, n) / size
    out[of, FEATURES + np.arange(len(words)) % PASSAGE] = words % np.uint64(BUCKETS) + np.uint64(1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def pooled(e: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Mean embedding of every passage's words; row 0 of ``e`` is no word's."""
    e, ids = np.concatenate([np.zeros((1, e.shape[1])), e[1:]]), buckets.astype(np.int32)
    total = [e[ids[i:i + POOLED]].sum(1) for i in range(0, len(ids), POOLED)]
    return np.concatenate(total) / np.maximum((ids > 0).sum(1), 1)[:, None]


def forward(p: dict, x: np.ndarray, at: np.ndarray) -> dict:
    """Bags of passages: row ``at[i]`` is the first of bag i."""
    n = np.diff(np.append(at, len(x)))
    bag = np.repeat(np.arange(len(at)), n)
    z = np.concatenate([(x[:, :FEATURES] - p["mean"]) / p["std"], pooled(p["e"], x[:, FEATURES:])], 1)
    h = np.tanh(z @ p["w"] + p["b"])
    t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
    e = (t * g) @ p["a"]
    e = np.exp(e - np.maximum.reduceat(e, at)[bag])
    att = e / np.add.reduceat(e, at)[bag]
    m = np.add.reduceat(att[:, None] * h, at)
    return {"bag": bag, "z": z, "h": h, "t": t, "g": g, "att": att, "m": m, "score": _sigmoid(m @ p["o"] + p["c"])}


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> dict:
    """Parameters fitted by Adam on the whole sample in mini-batches."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    if not len(labels) or labels.min() == labels.max():
        return {"share": float(share)}
    rng = np.random.default_rng(seed)
    every = np.concatenate([b[:, :FEATURES] for b in bags])
    dim = FEATURES + DIM
    p = {"e": np.zeros((BUCKETS + 1, DIM)), "w": rng.normal(0, dim ** -0.5, (dim, HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, 0.3, (HIDDEN, GATE)),
         "u": rng.normal(0, 0.3, (HIDDEN, GATE)), "a": rng.normal(0, 0.3, GATE), "o": rng.normal(0, 0.3, HIDDEN),
         "c": np.log(share / (1 - share))}
    fixed = {"mean": every.mean(0), "std": every.std(0) + 1e-3}
    m1, m2, step = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for s in range(0, len(order), 256):
            chosen = order[s:s + 256]
            x = np.concatenate([bags[i] for i in chosen])
            at = np.concatenate(([0], np.cumsum([len(bags[i]) for i in chosen])[:-1]))
            f = forward(p | fixed, x, at)
            err = (f["score"] - labels[chosen]) / len(chosen)
            dm = err[:, None] * p["o"]
            bag, h, att = f["bag"], f["h"], f["att"]
            datt = (dm[bag] * h).sum(1)
            de = att * (datt - np.add.reduceat(att * datt, at)[bag])
            gate = de[:, None] * p["a"]
            dt, dg = gate * f["g"] * (1 - f["t"] ** 2), gate * f["t"] * f["g"] * (1 - f["g"])
            dh = att[:, None] * dm[bag] + dt @ p["v"].T + dg @ p["u"].T
            dz = dh * (1 - h ** 2)
            ids = x[:, FEATURES:].astype(np.int32)
            held = ids > 0
            dpool = dz @ p["w"][FEATURES:].T / np.maximum(held.sum(1), 1)[:, None]
            of = np.nonzero(held)[0]
            de_words = np.stack([np.bincount(ids[held], dpool[of, j], BUCKETS + 1) for j in range(DIM)], 1)
            grad = {"e": de_words, "w": f["z"].T @ dz, "b": dz.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (f["t"] * f["g"]).T @ de, "o": f["m"].T @ err, "c": err.sum()}
            step += 1
            for k in p:
                g = grad[k] + DECAY * p[k] * (k != "c")
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
    return {k: np.asarray(v, np.float64) for k, v in (p | fixed).items()}


def held_out(id_: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> dict:
    """A model from the labelled documents outside the held-out fold."""
    known = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        (F.avg(label_col) >= 0.5).cast("int").alias("label"))
    known = known.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)  # a row per label, no texts
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).join(F.broadcast(known), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [passages(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([g.tobytes() for g in got], pa.binary())], names=["id", "label", "bag"])

    got = rows.select("id", "text", "label").mapInArrow(run, "id long, label int, bag binary").orderBy("id", "bag").limit(2 * SAMPLE).toArrow()
    bags = [np.frombuffer(x.as_buffer(), np.float32).reshape(-1, FEATURES + PASSAGE) for x in got["bag"]]
    return train(bags, got["label"].to_numpy().astype(np.float64))


def scored(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_passages, attention) with the largest attention weight of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for whole in batches:
            for b in (whole.slice(i, 128) for i in range(0, len(whole), 128)):
                bags = [passages(t.as_py()) for t in b.column(1)]
                n = np.array([len(x) for x in bags])
                at = np.concatenate(([0], np.cumsum(n)[:-1]))
                if "share" in p:
                    score, most = np.full(len(n), p["share"]), 1 / n
                else:
                    f = forward(p, np.concatenate(bags), at)
                    score, most = f["score"], np.maximum.reduceat(f["att"], at)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(n.astype(np.int64)), pa.array(most)],
                                                 names=["doc_id", "score", "n_passages", "attention"])

    df = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return df.mapInArrow(run, "doc_id long, score double, n_passages long, attention double")
