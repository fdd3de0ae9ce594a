"""Removal of word sequences that already stand in another document.

A window is ``window`` consecutive words. Words covered by a window whose
sequence also starts in a document of smaller id are removed.

Candidates are found level by level, doubling the length: at a level shorter
than the window a document gives, for every window still in question, the
least hash of the level's sequences inside it. Equal windows give equal least
hashes, so a window whose least hash no other document gives is out; what is
left is looked at again at twice the length, until the full length is
reached or nothing is left. Most text is out after the first level, whose
sample is about 2 / (window - level) of all positions.

At the full length the two halves' hashes name a window, as in prefix
doubling. Within each batch of documents a window is decided where a smaller
document of the batch holds it, and only one row per batch and sequence is
sent on under the sequence's name, so a passage shared by a third of all
documents is no hot key. Documents that equal a smaller one as a whole are
removed whole and take no part in the levels.

Defined cases: null and blank texts have no words; rows with a null id are
returned unchanged and take no part; rows that repeat an id are not "smaller"
than each other and each keeps its own text's result; an empty table gives no
rows; extra columns pass through ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moatlens.llm.common import anti, is_small, semi, written

WINDOW = 50
START = 25
#: A text's tag among the texts of one id stands above its positions.
TAG = 40
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_31, _29 = np.uint64(31), np.uint64(29)


def levels(window: int = WINDOW, start: int = START) -> list[int]:
    """Lengths from at most ``start`` to ``window``, each at most twice the one before."""
    out = [window]
    while out[0] > start:
        out.insert(0, -(-out[0] // 2))
    return out


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _31)) * _B
    return x ^ (x >> _29)


def word_hashes(w: list[bytes]) -> np.ndarray:
    return np.array(list(map(xxhash.xxh64_intdigest, w)), np.uint64)


def sequence_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each position on, by doubling."""
    done, out, power, size = 0, None, _mix(h), 1
    while length:
        if length & 1:
            if out is None:
                out = power
            else:
                n = len(power) - done
                out = _mix(out[:n] * _A) + power[done:]
            done += size
        length >>= 1
        if length:
            power = _mix(power[:-size] * _C) + power[size:]
            size *= 2
    return _mix(out * _A)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if width > size else x


def least_hashes(h: np.ndarray, level: int, window: int) -> np.ndarray:
    """For every window position the least hash of the level's sequences inside."""
    return sliding_min(sequence_hashes(h, level), window - level + 1)


def tag_of(digest: str) -> int:
    return int(digest[:5], 16)


def _longs(x: pa.ListScalar) -> np.ndarray:
    return x.values.to_numpy() if x.is_valid else np.empty(0, np.int64)


def _wholes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, digest): SHA-256 of the words joined by one space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, d = [], []
            for t in b.column(1):
                w = split(t.as_py())
                n.append(len(w))
                d.append(hashlib.sha256(b" ".join(w)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(d, pa.string())], names=["doc_id", "n_words", "digest"])

    return docs.mapInArrow(run, "doc_id long, n_words long, digest string")


def _local(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (key, doc): order by (key, doc), and whether a row is its key's first in that order."""
    order = np.lexsort((docs, keys))
    first = np.ones(len(order), bool)
    first[1:] = keys[order][1:] != keys[order][:-1]
    return order, first


def _anchors(docs: DataFrame, level: int, window: int) -> DataFrame:
    """(hash, salt, doc_id) of the least hashes; salt is 0 for the row of a batch that stands for its hash.

    ``known`` marks rows whose hash another document of the batch gives too.
    ``docs`` may have a column ``hashes``, the hashes that survived the level before.
    """
    before = "hashes" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids = [], []
            for i, t in enumerate(b.column(1)):
                w = split(t.as_py())
                if len(w) < window:
                    continue
                h = word_hashes(w)
                low = least_hashes(h, level, window)
                if before:
                    old = least_hashes(h, -(-level // 2), window)
                    low = low[np.isin(old, _longs(b.column(2)[i]).view(np.uint64))]
                keys.append(np.unique(low))
                ids.append(np.full(len(keys[-1]), b.column(0)[i].as_py(), np.int64))
            if not keys:
                continue
            k, d = np.concatenate(keys), np.concatenate(ids)
            order, first = _local(k, d)
            k, d = k[order], d[order]
            lead = np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
            end = np.append(np.flatnonzero(first)[1:], len(k))[np.cumsum(first) - 1] - 1
            known = d[lead] != d[end]
            salt = np.where(first, 0, 1 + (d & 1023))
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(d), pa.array(known)],
                                             names=["hash", "salt", "doc_id", "known"])

    return docs.mapInArrow(run, "hash long, salt int, doc_id long, known boolean")


def _survivors(anchors: DataFrame) -> DataFrame:
    """(doc_id, hashes) of the hashes that several documents give."""
    seen = anchors.selectExpr("hash", "doc_id", "known",
                              "min(doc_id) over (partition by hash, salt) <> max(doc_id) over (partition by hash, salt) as shared")
    # a document may have its hash known only through the row that stands for its batch
    kept = seen.where("known or shared")
    return kept.groupBy("doc_id").agg(F.collect_set("hash").alias("hashes"))


def _full(docs: DataFrame, level: int, window: int) -> DataFrame:
    """(a, b, doc_id, at, known) of the windows still in question; a and b name the window."""
    half = -(-window // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for i, t in enumerate(b.column(1)):
                w = split(t.as_py())
                if len(w) < window:
                    continue
                h = word_hashes(w)
                at = np.arange(len(w) - window + 1)
                if level < window:
                    alive = _longs(b.column(2)[i]).view(np.uint64)
                    at = np.flatnonzero(np.isin(least_hashes(h, level, window), alive))
                s = sequence_hashes(h, half)
                tag = tag_of(hashlib.sha256(b" ".join(w)).hexdigest()) << TAG
                one, two = s[at], s[at + window - half]
                parts.append((_mix(one * _C) + two, (_mix(two * _A) ^ one).astype(np.uint32), np.full(len(at), b.column(0)[i].as_py(), np.int64), at + tag))
            if not parts:
                continue
            a, c, d, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, first = _local(a, d)
            a, c, d, at = a[order], c[order], d[order], at[order]
            lead = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
            known = (d > d[lead]) & (c == c[lead])
            # decided rows are spread evenly; they are asked nothing more
            a = np.where(known, _mix(a + d.view(np.uint64) * _B + at.astype(np.uint64)), a)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int32)), pa.array(d), pa.array(at.astype(np.int64)), pa.array(known)],
                                             names=["a", "b", "doc_id", "at", "known"])

    return docs.mapInArrow(run, "a long, b int, doc_id long, at long, known boolean")


def _with(docs: DataFrame, per_doc: DataFrame) -> DataFrame:
    """Documents (doc_id, text, ...) that have a row in the written table ``per_doc``, with its columns.

    Few ids are first broadcast as a filter, so that only those texts are shuffled.
    """
    ids = per_doc.select("doc_id")
    some = docs.join(F.broadcast(ids), "doc_id", "left_semi") if is_small(ids) else docs
    return some.join(per_doc, "doc_id")


def _plan(docs: DataFrame, window: int, start: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Written tables: every document's whole digest, ids of whole copies, and (doc_id, at[]) of windows to remove."""
    rows = docs.select("doc_id", "text")
    whole = written(_wholes(rows), "substring-whole")
    real = whole.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    first = real.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = written(real.join(first, "digest").where("doc_id > first").select("doc_id", "digest").distinct(), "substring-copies")
    # an id is left out only if all its texts are copies
    out = copies.select("doc_id").join(real.join(copies, ["doc_id", "digest"], "left_anti"), "doc_id", "left_anti").distinct()
    own = anti(rows.where("doc_id is not null"), written(out, "substring-out"), "doc_id")
    steps, source = levels(window, start), own
    for level in steps[:-1]:
        alive = written(_survivors(_anchors(source, level, window)), "substring-alive")
        if alive.isEmpty():
            return whole, copies, None
        source = _with(own, alive).select("doc_id", "text", "hashes")
    asked = _full(source, steps[-2] if len(steps) > 1 else window, window)
    judged = asked.selectExpr("doc_id", "at", "known or min(doc_id) over (partition by a, b) < doc_id as gone")
    gone = judged.where("gone").groupBy("doc_id").agg(F.collect_list("at").alias("at"))
    return whole, copies, written(gone, "substring-gone")


def covered(n: int, at: np.ndarray, window: int) -> np.ndarray:
    """Which of n words the windows at these positions cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return np.cumsum(step[:n]) > 0


def _kept(text: str | None, where: np.ndarray, window: int) -> tuple[list[bytes], list[bytes], str]:
    """Words, kept words and the whole digest of a text, given the positions of its id."""
    w = split(text)
    digest = hashlib.sha256(b" ".join(w)).hexdigest()
    where = where[where >> TAG == tag_of(digest)] & ((1 << TAG) - 1)
    if not len(where) or where.max() + window > len(w):
        return w, w, digest
    gone = covered(len(w), np.unique(where), window)
    return w, [w[i] for i in np.flatnonzero(~gone)], digest


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, start: int = START) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    whole, copies, gone = _plan(docs, window, start)
    empty = hashlib.sha256(b"").hexdigest()
    out = whole.join(copies.withColumn("copy", F.lit(True)), ["doc_id", "digest"], "left")
    if gone is not None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [_kept(t.as_py(), _longs(a), window) for t, a in zip(b.column(1), b.column(2), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([g[2] for g in got], pa.string()), pa.array([len(g[0]) - len(g[1]) for g in got], pa.int64()),
                     pa.array([hashlib.sha256(b" ".join(g[1])).hexdigest() for g in got], pa.string())], names=["doc_id", "digest", "cut", "kept"])

        cut = _with(docs, gone).select("doc_id", "text", "at").mapInArrow(run, "doc_id long, digest string, cut long, kept string")
        out = out.join(cut.dropDuplicates(["doc_id", "digest"]), ["doc_id", "digest"], "left")
    else:
        out = out.withColumn("cut", F.lit(None).cast("long")).withColumn("kept", F.lit(None).cast("string"))
    return out.select("doc_id", "n_words",
                      F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
                      F.when(F.col("copy"), F.lit(empty)).otherwise(F.coalesce("kept", "digest")).alias("kept_sha256"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars",
                    window: int = WINDOW, start: int = START) -> DataFrame:
    """Documents with the removed words cut from their texts (kept words joined by one space).

    Texts that lose nothing stay as they are; documents left without words are dropped.
    """
    _, copies, gone = _plan(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), window, start)
    whole_copies = copies.select("doc_id").distinct()
    hit = whole_copies.withColumn("at", F.array().cast("array<bigint>"))
    if gone is not None:
        hit = hit.join(gone, "doc_id", "left_anti").unionByName(gone)
    copy_of = copies.groupBy("doc_id").agg(F.collect_set("digest").alias("digests"))
    hit = written(hit.join(copy_of, "doc_id", "left").select(F.col("doc_id").alias("__id"), F.col("at").alias("__at"), F.col("digests").alias("__whole")), "substring-hit")
    ids = written(hit.select(F.col("__id").alias(id_col)), "substring-ids")
    same = anti(docs, ids, id_col)
    touched = semi(docs, ids, id_col)
    touched = touched.join(hit, touched[id_col] == hit["__id"]).drop("__id")
    k, cols, schema = docs.columns.index(text_col), docs.columns, docs.schema
    c = cols.index(chars_col) if chars_col in cols else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, live = [], []
            for t, at, whole in zip(b.column(k).to_pylist(), b.column(len(cols)), b.column(len(cols) + 1).to_pylist(), strict=True):
                w, kept, digest = _kept(t, _longs(at), window)
                kept = [] if digest in (whole or ()) else kept
                texts.append(t if len(kept) == len(w) else b" ".join(kept).decode("utf-8"))
                live.append(bool(kept) or not w)
            arrays = [b.column(i) for i in range(len(cols))]
            arrays[k] = pa.array(texts, pa.string())
            if c is not None:
                arrays[c] = pa.array([None if t is None else len(t) for t in texts], arrays[c].type)
            yield pa.RecordBatch.from_arrays(arrays, names=cols).filter(pa.array(live, pa.bool_()))

    return same.select(*cols).unionByName(touched.select(*cols, "__at", "__whole").mapInArrow(run, schema))
