"""N-gram Jaccard join by parity sketches.

A document's set are its distinct 4-word shingles, hashed to 64 bits. For a
band of sizes, two linked sets differ in at most d shingles, so of m > d
segments of the hash space at least m - d hold the same shingles on both
sides. A sketch keeps the XOR of each segment's hashes; documents meet where a
segment's XOR is equal (pigeonhole). A bit sketch, in which every shingle
flips one bit, rejects pairs whose Hamming distance, a lower bound of the
symmetric difference, exceeds what the sizes allow. That sketch has one length
and is full for sets much larger than it; pairs that pass are then held against
wide sketches, of two bits a shingle or more, and what is left is verified on
the whole sets.

An empty segment says nothing and is not joined. m leaves room for ``spare``
empty ones; a set with more also joins on its first hashes in hash order (a
prefix that linked sets must share), so no link is lost.

Links are needed only between components: in the first rounds each segment's
members are compared with one leader, whose component most of them join; then
only pairs of different components in a common segment are left, and all of
these are formed. Equal sets are one class from the start.

Defined cases: null and blank texts have the empty set and link with nothing;
rows with a null id are returned with a null component and link with nothing;
rows that repeat an id with the same text share its component; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moatlens.llm.common import anti, semi, written
from moatlens.llm.components import components

N = 4
PCT = 85
BITS = 512
LONGS = BITS // 64
RATIO = 1.5
#: Rounds with one leader a segment after the first, before all pairs between components are formed.
STARS = 3
#: Leaders that a member is verified against in such a round.
BEST = 1
#: Bytes of a shingle's hash that verification compares: 2**-48 is the chance that two differ unseen.
HASH_BYTES = 6
#: Rows that a task turns into sketches or sets, or compares, at a time.
ROWS = 256
MASK = (1 << 64) - 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_32, _29, _31 = np.uint64(32), np.uint64(29), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _32)) * _A
    x = (x ^ (x >> _29)) * _B
    return x ^ (x >> _31)


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ROWS rows, so that a task holds the results of so many only."""
    for b in batches:
        for s in range(0, len(b), ROWS):
            yield b.slice(s, ROWS)


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; the whole sequence if it has fewer words."""
    w = (text or "").encode("utf-8").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.array(list(map(xxhash.xxh64_intdigest, w)), np.uint64)
    if len(w) < n:
        x = np.full(1, len(w), np.uint64)
        for i in range(len(w)):
            x = mix(x + h[i:i + 1])
        return x
    x = h[:len(h) - n + 1]
    for k in range(1, n):
        x = mix(x) + h[k:len(h) - n + 1 + k]
    return np.unique(mix(x))


class Bands:
    """Size bands [lo, hi) of the smaller set of a pair: its largest symmetric difference, segments, spare segments."""

    def __init__(self, pct: int = PCT, ratio: float = RATIO):
        self.pct, self.ratio = pct, ratio
        self.edges, self.params = [1], []

    def _grow(self, n: int) -> None:
        while self.edges[-1] <= n:
            lo = self.edges[-1]
            hi = max(lo + 1, int(lo * self.ratio))
            top = hi - 1
            d = (top + top * 100 // self.pct) * (100 - self.pct) // (100 + self.pct)
            m = d + 1
            empty = m * math.exp(-lo / m)
            spare = math.ceil(empty + math.sqrt(empty)) if d else 0
            self.edges.append(hi)
            self.params.append((top * 100 // self.pct, d, d + 1 + spare, spare))

    def of(self, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(band, d, m, spare) of every band in which a set of n meets partners."""
        self._grow(n)
        k = next(i for i in range(len(self.params) - 1, -1, -1) if self.edges[i] <= n)
        while k >= 0 and n <= self.params[k][0]:
            yield k, *self.params[k][1:]
            k -= 1


def sketch_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """Join keys of a sorted set: a hash of (band, segment, XOR) of every segment that isn't empty, or of the prefix too."""
    out, t = [], mix(s)
    for band, d, m, spare in bands.of(len(s)):
        if d == 0:
            continue  # only equal sets link, and these are one class
        seg = ((s >> _32) * np.uint64(m)) >> _32
        at = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
        tag = np.uint64((band + 1) * int(_A) & MASK)
        out.append(mix(mix(np.bitwise_xor.reduceat(t, at)) + tag + seg[at] * _B))
        if m - len(at) > spare:
            n = len(s)
            out.append(mix(mix(s[:n - -(-n * bands.pct // 100) + 1] ^ _B) + tag))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def wide_sketch(s: np.ndarray) -> np.ndarray:
    """Bytes of a sketch with at least two bits a shingle, a power of two of them and BITS at least."""
    bits = max(BITS, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((mix(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """The sketch of ``size`` bytes of the set that ``x`` is a longer sketch of."""
    return np.bitwise_xor.reduce(x.reshape(-1, size))


def bit_sketch(s: np.ndarray) -> np.ndarray:
    return folded(wide_sketch(s), BITS // 8).view(np.int64)


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """Hamming distance of two wide sketches at the length of the shorter: at most the sets' symmetric difference."""
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def class_id(s: np.ndarray) -> int:
    """64-bit id of a set: equal for equal sets."""
    t = mix(s)
    x = np.array([np.bitwise_xor.reduce(t) ^ mix(t.sum(keepdims=True))[0]], np.uint64) + np.uint64(len(s) * int(_A) & MASK)
    return int(mix(x).view(np.int64)[0])


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, pct: int = PCT) -> DataFrame:
    """(doc_id, n, cid, bits, wide, keys) per document; the last four are null for the empty set, wide also where it is no longer than bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(pct)
        for b in few(batches):
            size, cid, bits, wide, keys = [], [], [], [], []
            for text in b.column(1):
                s = shingles(text.as_py(), n)
                size.append(len(s))
                cid.append(class_id(s) if len(s) else None)
                w = wide_sketch(s) if len(s) else None
                bits.append(folded(w, BITS // 8).view(np.int64) if len(s) else None)
                wide.append(w.tobytes() if 2 * len(s) > BITS else None)
                keys.append(sketch_keys(s, bands).view(np.int64) if len(s) else None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(cid, pa.int64()), pa.array(bits, longs),
                                              pa.array(wide, pa.binary()), pa.array(keys, longs)], names=["doc_id", "n", "cid", "bits", "wide", "keys"])

    df = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return df.mapInArrow(run, "doc_id long, n long, cid long, bits array<long>, wide binary, keys array<long>")


def sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """(cid, members): the upper HASH_BYTES of the hashes of every set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            got = [s for t in b.column(0) if len(s := shingles(t.as_py(), n))]
            yield pa.RecordBatch.from_arrays([pa.array([class_id(s) for s in got], pa.int64()), pa.array([_packed(s) for s in got], pa.binary())],
                                             names=["cid", "members"])

    return docs.select(text_col).mapInArrow(run, "cid long, members binary")


def _packed(s: np.ndarray) -> bytes:
    return np.ascontiguousarray(s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES:]).tobytes()


def _unpacked(b: pa.Buffer) -> np.ndarray:
    out = np.zeros((b.size // HASH_BYTES, 8), np.uint8)
    out[:, 8 - HASH_BYTES:] = np.frombuffer(b, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u8").ravel()


def _far() -> Column:
    """Hamming distance of the bit sketches of a pair (a_*, b_*)."""
    bits = [F.bit_count(F.col("a_bits")[i].bitwiseXOR(F.col("b_bits")[i])) for i in range(LONGS)]
    return reduce(lambda x, y: x + y, bits)


def _possible(pct: int) -> Column:
    """Whether sizes and bit sketches of a pair allow a link."""
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    return (small * 100 >= large * pct) & (_far() * (100 + pct) <= (small + large) * (100 - pct))


def _near(pairs: DataFrame, facts: DataFrame, pct: int) -> DataFrame:
    """Pairs (a, b) of classes whose wide sketches allow a link; bits have told already about sets without one."""
    j = pairs.join(facts.select(F.col("cid").alias("a"), F.col("n").alias("u"), F.col("wide").alias("x")), "a")
    j = j.join(facts.select(F.col("cid").alias("b"), F.col("n").alias("v"), F.col("wide").alias("y")), "b").select("a", "b", "u", "v", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            keep = []
            for both, x, y in zip((batch.column(2).to_numpy() + batch.column(3).to_numpy()).tolist(), batch.column(4), batch.column(5), strict=True):
                far = apart(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) if x.is_valid and y.is_valid else 0
                keep.append(far * (100 + pct) <= both * (100 - pct))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return j.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, n: int, pct: int) -> DataFrame:
    """Pairs (a, b) of classes whose sets link, by their whole sets."""
    ids = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    wanted = written(reps.join(ids, "cid", "left_semi").select(F.col("doc_id").alias(id_col)).distinct(), "join-ids")
    s = written(sets(semi(docs, wanted, id_col), id_col, text_col, n), "join-sets")
    j = pairs.join(s.select(F.col("cid").alias("a"), F.col("members").alias("x")), "a")
    j = j.join(s.select(F.col("cid").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = _unpacked(x.as_buffer()), _unpacked(y.as_buffer())
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= pct * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return j.mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, pct: int = PCT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    table = written(sketches(docs, "doc_id", "text", n, pct), "join-sketches")
    members = table.select("doc_id", "n", "cid")
    classes = written(members.where("cid is not null and doc_id is not null").groupBy("cid").agg(F.min("doc_id").alias("doc_id")), "join-classes")
    # copies are the rows that aren't their class's first; their keys are left out
    copies = written(members.where("cid is not null and doc_id is not null").join(classes.withColumnRenamed("doc_id", "first"), "cid")
                     .where("doc_id <> first").select("doc_id", "cid").distinct(), "join-copies")
    own = table.where("cid is not null and doc_id is not null")
    reps = anti(own, copies, ["doc_id", "cid"])
    rows = reps.select("cid", F.explode("keys").alias("key"))
    met = rows.selectExpr("key", "cid", "min(struct(xxhash64(cid) as h, cid as cid)) over (partition by key) as lead",
                          "min(cid) over (partition by key) as lo", "max(cid) over (partition by key) as hi")
    met = written(met.where("lo <> hi").select("key", "cid", F.col("lead.cid").alias("lead")), "join-met")
    facts = reps.select("cid", "n", "bits", "wide").join(met.select("cid").distinct(), "cid", "left_semi").dropDuplicates(["cid"])
    facts = written(facts, "join-facts")

    def side(name: str) -> DataFrame:
        return facts.select(F.col("cid").alias(name), F.col("n").alias(f"{name}_n"), F.col("bits").alias(f"{name}_bits"))

    def judged(pairs: DataFrame, best: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Written pairs (a < b) that sizes and sketches allow, and those of them that link.

        ``best`` keeps, for each member a, its nearest leaders b by sketch; one link
        is enough to join a leader's component, and the last round leaves no pair out.
        """
        p = pairs.distinct().join(side("a"), "a").join(side("b"), "b").withColumn("far", _far()).where(_possible(pct))
        if best is not None:
            p = p.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("far", "b"))).where(F.col("r") <= best)
        p = written(p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "join-pairs")
        near = written(_near(p, facts, pct), "join-near")
        return p, written(_verified(near, docs, classes, "doc_id", "text", n, pct).distinct(), "join-links")

    def parted(links: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Components, and the written (key, cid, comp) of those segments of ``rows`` where several of them meet."""
        comp = components(links)
        placed = rows.select("key", "cid").join(comp.withColumnRenamed("node", "cid"), "cid", "left").select(
            "key", "cid", F.coalesce("comp", "cid").alias("comp"))
        several = placed.selectExpr("key", "cid", "comp", "min(comp) over (partition by key) as lo", "max(comp) over (partition by key) as hi")
        return comp, written(several.where("lo <> hi").select("key", "cid", "comp"), "join-mixed")

    tested, links = judged(met.where("cid <> lead").select(F.col("cid").alias("a"), F.col("lead").alias("b")), BEST)
    comp, mixed = parted(links, met)
    for r in range(STARS):  # other leaders, another one in each segment
        lead = f"min(struct(xxhash64(key, cid, {r}) as h, cid as cid, comp as comp)) over (partition by key) as lead"
        star = mixed.selectExpr("cid", "comp", lead).where("comp <> lead.comp").select(F.col("cid").alias("a"), F.col("lead.cid").alias("b"))
        pairs, more = judged(star, BEST)
        tested = tested.unionByName(pairs)
        if more.isEmpty():
            break
        links = links.unionByName(more)
        comp, mixed = parted(links, mixed)
    # what is left: all pairs of different components that meet in a segment
    mixed = mixed.join(facts, "cid")
    a = mixed.select("key", *[F.col(c).alias(f"a_{c}") for c in ("cid", "comp", "n", "bits")])
    b = mixed.select("key", *[F.col(c).alias(f"b_{c}") for c in ("cid", "comp", "n", "bits")])
    rest = a.join(b, "key").where((F.col("a_cid") < F.col("b_cid")) & (F.col("a_comp") != F.col("b_comp")) & _possible(pct))
    rest = rest.select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    more = judged(rest)[1]
    if not more.isEmpty():
        comp = components(links.unionByName(more))
    label = classes.join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "doc_id", F.coalesce("comp", "cid").alias("comp"))
    smallest = label.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_class = label.select("cid", "comp").join(smallest, "comp").select("cid", "component_id")
    out = members.join(of_class, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def first_of_groups(docs: DataFrame, n: int = N, pct: int = PCT) -> DataFrame:
    """Documents without those that a document of smaller id in their component stands for."""
    gone = jaccard_components(docs, n=n, pct=pct).where("doc_id <> component_id").select("doc_id").distinct()
    return anti(docs, written(gone, "join-gone"), "doc_id").select(*docs.columns)
