"""Hard negatives, sharding and fill-in-middle on small tables, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from moatlens.llm import fill_in_middle as fim
from moatlens.llm import hard_negatives as hn
from moatlens.llm import sharding
from tests.llm.test_operators import ODD, docs

# -- hard negatives

VECTORS = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("m,k,n", [(1, 1, 1), (3, 5, 7), (16, 16, 16), (33, 64, 70), (130, 65, 129), (0, 5, 4), (4, 0, 3)])
def test_strassen_is_exact(m, k, n):
    rng = np.random.default_rng(m + k + n)
    for top in (300, 1 << 27):  # the second does not fit doubles
        a, b = rng.integers(-top, top, (m, k)), rng.integers(-top, top, (k, n))
        assert (hn.multiply(a, b, 8) == a @ b).all()


def test_heaps_merge_tiles_with_ties():
    rng = np.random.default_rng(1)
    score, ids = rng.integers(0, 6, (9, 400)), rng.permutation(400)
    score[4] = hn.NONE
    heaps = hn.Heaps(9, 7)
    for part in np.array_split(np.arange(400), 13):
        for lines in (np.arange(5), np.arange(5, 9)):
            heaps.offer(lines, score[lines][:, part], ids[part])
    for i in range(9):
        want = sorted((-s, d) for s, d in zip(score[i], ids, strict=True) if s > hn.NONE)[:7]
        assert [(-s, d) for s, d in zip(heaps.score[i], heaps.id[i], strict=True) if s > hn.NONE] == want


def mined_by_force(rows, every):
    seen = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        seen.setdefault(i, []).append((label, [int(np.floor(256 * x)) for x in v]))
    seen = {i: min(r) for i, r in seen.items()}
    out = []
    for a, (la, va) in seen.items():
        if a % every:
            continue
        order = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, (label, v) in seen.items() if i != a)  # noqa: B905
        for sp, p, _ in [r for r in order if r[2] == la][:5]:
            inside = [(s, i) for s, i, label in order if label != la and -30 * sp <= -100 * s <= -90 * sp][:10]
            out += [(a, p, rank, i, -sp, -s) for rank, (s, i) in enumerate(inside, 1)]
    return sorted(out)


def test_mining_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1, 1]) * rng.randint(0, 5) / 7 for _ in range(9)], rng.choice([0, 0, 0, 1, 2])) for i in range(240)]
    rows += [(i + 1000, rows[3][1], i % 2) for i in range(60)]  # one very common vector
    rows += [(None, [1.0] * 9, 1), (2000, None, 1), (2010, [1.0] * 9, None), (2020, [None] * 9, 0), (2030, [float("nan")] * 9, 0),
             (2040, [float("inf")] + [0.0] * 8, 0), (2050, [], 0), (2060, [1.0, 2.0], 1), (40, [9.0] * 9, 0), (40, [9.0] * 9, 0), (2070, [0.0] * 9, 2)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("x")).withColumn("rank", F.lit(0)).repartition(5)
    want = mined_by_force(rows, 10)
    anchors = F.col("id") % 10 == 0
    assert len(want) > 300 and sorted(map(tuple, hn.mine(df, anchors=anchors).collect())) == want
    monkeypatch.setattr(hn, "CHUNK_BYTES", 500)
    monkeypatch.setattr(hn, "ROW_TILE", 90)
    monkeypatch.setattr(hn, "ANCHOR_TILE", 30)
    assert sorted(map(tuple, hn.mine(df, anchors=anchors).collect())) == want


def test_mining_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hn.mine(empty).collect() == []
    huge = [(0, [1e300], 1), (100, [1e14], 1), (200, [2.0], 1), (300, [2.0], 1), (301, [1.0], 2)]
    got = hn.mine(spark.createDataFrame(huge, VECTORS)).collect()
    assert sorted(map(tuple, got)) == [(200, 300, 1, 301, 512 * 512, 512 * 256), (300, 200, 1, 301, 512 * 512, 512 * 256)]
    below = [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.5], 2)]  # a negative positive: its window is empty
    assert hn.mine(spark.createDataFrame(below, VECTORS)).collect() == []


# -- sharding

def shards(df, weights):
    return {r["doc_id"]: r["shard"] for r in df.select("doc_id", sharding.choose(F.md5(F.col("doc_id").cast("string")), weights).alias("shard")).collect()}


def test_shards_follow_weights_and_move_little(spark):
    ids = spark.range(8000).withColumnRenamed("id", "doc_id")
    weights = [1.0, 2.0, 0.0, 5.0]
    old = shards(ids, weights)
    n = Counter(old.values())
    for s, w in enumerate(weights):
        assert abs(n[s] - 1000 * w) < 150
    assert n[2] == 0
    new = shards(ids, [*weights, 2.0])
    assert all(new[i] in (s, 4) for i, s in old.items()) and 1400 < Counter(new.values())[4] < 1800
    less = shards(ids, [1.0, 2.0, 0.0, 4.0])  # a lighter shard only gives records away
    assert all(less[i] == s or s == 3 for i, s in old.items())
    for bad in ([], [0.0], [1.0, -1.0]):
        with pytest.raises(ValueError):
            sharding.choose(F.lit("x"), bad)


def test_slots_have_no_gaps_however_often_a_record_repeats(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 16)
    monkeypatch.setattr(sharding, "REPEATS", 7)
    texts = [(i, f"text {i}") for i in range(300)] + [(7, "same")] * 150 + [(None, f"no id {i}") for i in range(50)] + [(None, None)] * 20
    got = sharding.slots(sharding.assigned(docs(spark, texts, ["n", "bucket"])), ["doc_id", "n", "bucket"]).collect()
    assert Counter((r["doc_id"], r["shard_size"], r["shard_crc32"]) for r in got) == Counter(
        (i, len(t or "") + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["shard_slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) == 1
    assert len({r["shard"] for r in got if r["doc_id"] is None}) > 4


def test_slots_do_not_depend_on_partitions(spark):
    texts = [(i % 90, f"text {i % 100}") for i in range(400)]
    got = [sorted(map(tuple, sharding.slots(sharding.assigned(docs(spark, texts).repartition(n)), ["doc_id"]).collect())) for n in (1, 6)]
    assert got[0] == got[1]


def test_sharding_odd_rows_and_files(spark, tmp_path):
    df = docs(spark, ODD, ["shard", "shard_size", "law"])
    out = sharding.assigned(df).collect()
    assert len(out) == len(ODD)
    assert {r["doc_id"]: (r["shard_size"], r["shard_crc32"]) for r in out}[1] == (1, 0)
    assert sharding.slots(sharding.assigned(df.limit(0))).collect() == []
    sharding.write(docs(spark, ODD), str(tmp_path / "shards"), [1.0, 1.0])
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(back.columns) == sorted([*df.columns[:5], "shard"]) and back.count() == len(ODD)


# -- fill in the middle

def by_force(i, text):
    t = text or ""
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    x, y = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if not t or any(c in t for c in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, t
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_rows(df):
    out = fim.transformed(df)
    text = fim.restored(F.col("fim_output"), F.col("fim_form"))
    return out.withColumn("again", text).collect()


def test_fim_equals_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    alphabet = ["\n", "\n", "a", "<", "P", ">", "é", "語", "😀", "\r", "\x0b", " ", " "]
    texts = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    texts += [(1000 + i, t) for i, t in enumerate(["a<P>\nb", "<S>", "x\n<M>\n", "\n", "\n\n\n", "no end", "<<S", "<P\n>", "P>\n<S\n>"])]
    for step in (fim.STEP, 40):
        monkeypatch.setattr(fim, "STEP", step)
        got = fim_rows(docs(spark, texts).repartition(3))
        assert len(got) == len(texts)
        want = dict(texts)
        for r in got:
            assert (r["fim_lines"], r["fim_form"], r["fim_prefix_chars"], r["fim_middle_chars"], r["fim_output"]) == by_force(r["doc_id"], want[r["doc_id"]])
            assert r["again"] == want[r["doc_id"]]
    forms = Counter(r["fim_form"] for r in got)
    assert min(forms.values()) > 3 and len(forms) == 3


def test_fim_odd_rows(spark):
    long = "".join(f"line {i} é\n" for i in range(200_000))
    df = docs(spark, [*ODD, (8, long), (9, long + "rest")], ["fim_form", "fim_key", "n"])
    got = fim_rows(df)
    assert set(got[0].asDict()) == {*df.columns, *[n for n, _ in fim.OWN], "again"} - {"fim_key"}
    assert sorted((str(r["doc_id"]), r["fim_lines"], r["fim_form"]) for r in got) == sorted((str(i), *by_force(i, t)[:2]) for i, t in [*ODD, (8, long), (9, long + "rest")])
    for r in got:
        assert r["again"] == (r["text"] or "") and r["n"] == "x"
        assert r["fim_output"] == by_force(r["doc_id"], r["text"])[4]
    assert fim.transformed(df.limit(0)).collect() == []


def test_fim_rate_and_forms_are_parameters(spark):
    df = docs(spark, [(i, "a\nb\nc\n") for i in range(400)])
    n = Counter(r["fim_form"] for r in fim.transformed(df, rate=50, spm=0).collect())
    assert n["spm"] == 0 and 150 < n["plain"] < 250


def test_select_finds_every_mark():
    rng = np.random.default_rng(4)
    for n in (0, 1, 7, 8, 9, 500):
        data = rng.choice(np.array([10, 11, 9, 138, 0, 255], np.uint8), n)
        padded = np.zeros((n // 8 + 1) * 8, np.uint8)
        padded[:n] = data
        marks = fim.Marks(fim.equal_bytes(padded.view("<u8"), 10))
        at = np.flatnonzero(data == 10)
        assert (marks.select(np.arange(len(at))) == at).all()
        assert (marks.rank(np.arange(n + 1)) == np.concatenate(([0], np.cumsum(data == 10)))).all()
