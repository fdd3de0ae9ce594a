"""The pipeline against a plain version of its stages on a small table."""

import hashlib

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from moatlens.llm import mixing
from moatlens.llm import quality_rules as qr
from moatlens.llm.queries import vocabulary
from tests.conftest import SF001
from tests.llm.test_operators import components_by_force, removed_by_force


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF001).columns == docs.columns
        assert stage(spark, docs.limit(0), SF001).collect() == []


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    kept = {r["doc_id"]: r for r in qr.keep(docs).collect()}  # held against SQL elsewhere
    texts = [(i, r["text"]) for i, r in kept.items()]
    label = components_by_force(texts, 5, 80)
    texts = [(i, t) for i, t in texts if label[i][1] == i]
    after = {}
    for (i, t), (_, n, gone, rest) in zip(texts, removed_by_force(texts, 50), strict=True):
        if rest or not n:
            after[i] = rest if gone else t
    rows = [(i, t, kept[i]["lang"], kept[i]["source"], len(t)) for i, t in after.items()]
    copies = {r["doc_id"]: r["mix_copies"] for r in mixing.mix(spark.createDataFrame(rows, docs.schema)).collect()}  # held against SQL elsewhere
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    want = []
    for i, t in after.items():
        ids = sp.encode(t)
        want += [(i, kept[i]["source"], len(t), ids, hashlib.sha256(sp.decode(ids).encode()).hexdigest())] * copies[i]
    got = corpus_pipeline.run(spark, SF001).collect()
    assert all(len(r["ids"]) == len(r["starts"]) == len(r["ends"]) and (not r["ids"] or r["ends"][-1] == len(after[r["doc_id"]].encode())) for r in got)
    assert sorted((r["doc_id"], r["source"], r["n_chars"], r["ids"], r["decoded_sha256"]) for r in got) == sorted(want)


def test_stages_take_nulls_repeats_and_clashing_names(spark):
    base = spark.read.parquet(f"{SF001}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "web", 0), (1, "", "en", None, 0), (None, "a b c", "en", "web", 5),
                                 (7, "word " * 3000, "en", "web", 15000), (7, "word " * 3000, "en", "web", 15000)], base.schema)
    docs = base.unionByName(odd)
    for c in ("ids", "n_tokens", "component_id", "cid", "keys", "qr_kept", "key"):
        docs = docs.withColumn(c, F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.columns == docs.columns
        assert out.count() > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF001)
    assert last.count() == docs.count() and last.where("doc_id is null and n_tokens > 0").count() >= 1
