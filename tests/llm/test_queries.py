"""The registered queries against their SQL, a brute-force version, a round trip or held-out accuracy, over whole tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from moatlens.llm.queries import ORACLES, QUERIES, vocabulary
from tests.compare import _rows
from tests.conftest import SF01, SF001


def lower_words(text):
    return (text or "").encode().lower().split()


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_equals_sql(spark, duck, key):
    df = QUERIES[key](spark, SF01)
    got = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLES[key])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert got and _rows(df.columns, got) == _rows(cols, res.fetchall())


def test_every_numbered_query_is_there():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_entry_lists_them():
    import __spark_entry__ as e
    assert set(QUERIES) | {"pipeline"} <= set(e.queries())
    assert set(ORACLES) <= set(e.oracle_sql())


def test_op2_finds_every_planted_line(spark, duck):
    got = {(r["doc_id"], r["template"], r["start"]) for r in QUERIES["op2_license_scan"](spark, SF01).collect()}
    from moatlens.llm.license_scan import TEMPLATES
    want = set()
    for i, text in duck.execute("select doc_id, text from documents").fetchall():
        for name, line in TEMPLATES[:4]:
            at = text.find(line)
            while at >= 0:
                want.add((i, name, at))
                at = text.find(line, at + 1)
    assert want and got == want


def test_op4_recall_and_scores(spark, duck):
    rows = duck.execute("select vec_id, embedding from embeddings order by vec_id").fetchall()
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    got = {}
    for r in QUERIES["op4_posting_lists"](spark, SF01).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == [int(i) for i in ids if i % 20 == 0]
    hits = []
    for q, found in got.items():
        assert sorted(found) == list(range(1, 21))
        s = x @ x[ids == q][0]
        for v, score in found.values():
            assert v != q and abs(score - s[ids == v][0]) < 1e-12
        order = [(-score, v) for _, (v, score) in sorted(found.items())]
        assert order == sorted(order)
        best = [int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hits.append(len({v for v, _ in found.values()} & set(best)) / 20)
    assert np.mean(hits) >= 0.9


def test_op6_base_equals_brute_force_and_model_is_a_probability(spark, duck):
    docs = dict(duck.execute(f"select doc_id, text from '{SF001}/documents.parquet'").fetchall())
    tokens = {i: [*lower_words(t), None] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n = sum(c.values())
    below = n + 0.1 * (len(c) + 1)
    got = QUERIES["op6_lm_scoring"](spark, SF001).collect()
    assert len(got) == len(docs)
    for r in got:
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), n)
        assert r["n_known"] == sum(c[w] > 0 for w in ws)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / below) for w in ws), rel_tol=1e-9)
        assert -8 * len(ws) < r["score"] < 0


def test_op7_held_out_accuracy(spark, duck):
    quality = dict(duck.execute("select doc_id, quality from labels").fetchall())
    got = QUERIES["op7_quality_classifier"](spark, SF01).collect()
    assert len(got) == 1000
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    judged = [(r["score"], quality[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in quality]
    good, bad = [s for s, q, _ in judged if q], [s for s, q, _ in judged if not q]
    assert np.mean([g > b for g in good for b in bad]) >= 0.95
    assert np.mean([p == q for _, q, p in judged]) >= 0.9


def test_op8_equals_the_library(spark, duck):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    docs = dict(duck.execute(f"select doc_id, text from '{SF001}/documents.parquet'").fetchall())
    got = QUERIES["op8_sentencepiece"](spark, SF001).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = sp.encode(docs[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_op12_equals_brute_force(spark, duck):
    docs = dict(duck.execute("select doc_id, text from documents").fetchall())

    def best(i, n):
        key = hashlib.md5(f"i{i}".encode()).hexdigest()
        u = [(int(hashlib.md5(f"shard-1:{s}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52 for s in range(n)]
        return max(range(n), key=lambda s: (1 / -math.log(u[s]), -s))
    got = QUERIES["op12_sharding"](spark, SF01).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    slots = {}
    for r in got:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert (r["shard"], r["grown_shard"]) == (best(r["doc_id"], 8), best(r["doc_id"], 9))
        assert r["grown_shard"] in (r["shard"], 8)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(slots) == list(range(8))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
