"""Small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moatlens.llm import attention_lm, chat, components, license_scan, mixing, ngram_join, posting_lists, quality_mil, substring_dedup
from moatlens.llm import quality_rules as qr
from moatlens.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=None):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    for c in extra or ():
        df = df.withColumn(c, F.lit("x"))
    return df


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id here"), (5, "w " * 40_000)]


# -- quality rules

def repeats(w, n=5):
    grams = [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(n)})


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice("abc#|") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))) + rng.choice(["", "\nx\nx", "\n\n"])) for i in range(150)]
    got = {r["doc_id"]: r for r in qr.features(docs(spark, texts)).collect()}
    for i, t in texts:
        w = t.split()
        lines = [x for x in t.split("\n") if x.split()]
        assert got[i]["qr_n_words"] == len(w) and got[i]["qr_word_chars"] == sum(map(len, w))
        assert got[i]["qr_n_symbols"] == sum(t.count(c) for c in "#*$%&|<>")
        assert got[i]["qr_n_dup_lines"] == len(lines) - len(set(lines))
        assert got[i]["qr_n_repeat_words"] == repeats(w), t


def test_quality_odd_rows(spark):
    df = docs(spark, ODD, ["qr_kept2", "n_words", "rule"]).withColumn("lang", F.when(F.col("doc_id") > 3, F.col("lang")))
    out = qr.judge(qr.features(df), qr.limits_of(df)).collect()
    assert len(out) == len(ODD)
    assert all(r["qr_base_failed"] and not r["qr_kept"] for r in out)
    assert qr.keep(df.limit(0)).collect() == []
    assert qr.keep(df).columns == df.columns


def test_quality_threshold_adapts_to_the_group(spark):
    def text(rng, k):
        return " ".join(rng.choice(["aaa", "bbbb", "ccc", "dddd"]) + str(rng.randint(0, 999)) + "#" * k for _ in range(50))
    rng = random.Random(5)
    rows = [(i, text(rng, 1), "en", "code", 1) for i in range(80)] + [(100 + i, text(rng, 0), "en", "web", 1) for i in range(80)]
    rows += [(500, text(rng, 1), "en", "web", 1), (501, text(rng, 4), "en", "code", 1)]
    kept = {r["doc_id"] for r in qr.keep(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == set(range(80)) | set(range(100, 180))


def test_bucket_and_its_value(spark):
    v = [0, 1, 63, 64, 65, 127, 128, 1000, 123456, 10**12]
    got = spark.createDataFrame([(x,) for x in v], "v long").select("v", qr.bucket_value(qr.bucket(F.col("v"))).alias("low")).collect()
    for r in got:
        assert r["low"] <= r["v"] <= r["low"] * 33 / 32 + 1
        assert r["v"] >= 64 or r["low"] == r["v"]


# -- chat

def test_branches_of_trees(spark):
    rows = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "a"), (1, 3, 1, 2.0, "assistant", "b"), (1, 4, 2, 5.0, "user", "c"),
            (1, 5, 3, 4.0, "user", "d"), (2, 1, 9, None, None, None), (3, 1, 2, 1.0, "user", "x"), (3, 2, 1, 1.0, "user", "y"), (3, 2, 1, 1.0, "user", "y")]
    m = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, score double, role string, text string").withColumn("node", F.lit(1))
    all_ = {(r["conv_id"], r["leaf_id"]): r for r in chat.formatted(m, keep=None).collect()}
    assert sorted(all_) == [(1, 4), (1, 5), (2, 1)]  # conversation 3 is a cycle
    assert all_[1, 4]["branch_score"] == all_[1, 5]["branch_score"] == 6.0
    best = {r["conv_id"]: r for r in chat.formatted(m).collect()}
    assert best[1]["leaf_id"] == 4  # a tie goes to the smaller leaf
    assert best[1]["formatted"] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert best[2]["formatted"] == "<|im_start|>\n<|im_end|>\n"
    assert chat.formatted(m.limit(0)).collect() == []


@pytest.mark.parametrize("text", ["<|im_end|>", "<\\|x|>", "<\\\\|<|", "a\nb\\", "<|nl|>", "<", "|", "", None, "<<||"])
def test_escape_round_trip(spark, text):
    turns = spark.createDataFrame([(1, 0, f"r\n{text}", text), (1, 1, "assistant", text), (1, 2, "assistant", "z")], "conv_id long, turn long, role string, text string")
    out = chat.formatted(chat.thread(turns)).select(chat.parsed(F.col("formatted")).alias("p"), chat.loss_text(F.col("segments")).alias("loss")).first()
    assert [tuple(x) for x in out["p"]] == [(f"r\n{text}", text or ""), ("assistant", text or ""), ("assistant", "z")]
    assert out["loss"] == (text or "") + "z"


def test_long_thread(spark):
    turns = spark.range(300).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    out = chat.formatted(chat.thread(turns)).select("n_turns", chat.loss_text(F.col("segments")).alias("loss")).collect()
    assert [(r["n_turns"], r["loss"]) for r in out] == [(300, "".join(map(str, range(300))))]


# -- mixing

def test_targets_equal_repeated_sharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 3, None: 500, "e": 0, "d": 40}
    df = spark.createDataFrame(list(sizes.items()), "mix_source string, mix_source_size long")
    got = {r["mix_source"]: r["mix_target"] for r in mixing.targets(df).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, free = float(sum(sizes.values())), set(order)
    while left > 1e-9 and free:
        total, spill = sum(weight[s] for s in free), 0.0
        for s in list(free):
            target[s] += left * weight[s] / total
        for s in list(free):
            if target[s] > 3 * sizes[s]:
                spill += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                free.discard(s)
        left = spill
    assert got == pytest.approx(target)


def test_mix_odd_rows_and_reruns(spark):
    df = docs(spark, ODD, ["size", "rate", "copies"]).withColumn("source", F.when(F.col("doc_id") != 2, F.col("source")))
    out = mixing.mix(df)
    a, b = (sorted(map(str, out.select("doc_id", "mix_size", "mix_copies").collect())) for _ in range(2))
    assert a == b and len(a) == len(ODD)
    assert out.where("mix_copies > 3 or mix_copies < 0").count() == 0
    assert mixing.emit(out).columns == df.columns
    assert mixing.emit(out).count() == out.agg(F.sum("mix_copies")).first()[0]
    assert mixing.mix(df.limit(0)).collect() == []


def test_mix_comes_near_its_targets(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 3).cast("int")).alias("text"),
                                  F.concat(F.lit("s"), F.col("id") % 4).alias("source"))
    out = mixing.mix(df).withColumn("f", F.col("mix_rate") - F.floor("mix_rate")).groupBy("source").agg(
        F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.first("mix_target").alias("target"),
        F.sum(F.col("f") * (1 - F.col("f")) * F.col("mix_size") ** 2).alias("variance")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 4 * r["variance"] ** 0.5 + 1e-6 for r in out)
    assert abs(sum(r["taken"] for r in out) / sum(r["target"] for r in out) - 1) < 0.05


# -- n-gram join

def components_by_force(texts, n=4, pct=85):
    sets = {}
    for i, t in texts:
        w = (t or "").lower().split()
        if w:
            sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}
    label = {i: i for i, _ in texts}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= pct * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(sets.get(i, ())), label[i]) for i, _ in texts}


def test_join_equals_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(40)]
    texts = []
    for base in range(14):
        w = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 8, 14, 20, 33, 60, 110, 260]))]
        for _ in range(9):
            v = list(w)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                k = rng.randrange(len(v)) if v else 0
                if not v:
                    break
                v[k:k + 1] = rng.choice([[rng.choice(words)], [], [v[k], "Extra"]])
            texts.append((len(texts) * 3 % 997, " ".join(v)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs(spark, texts)).collect()}
    assert got == components_by_force(texts)


def test_join_groups_around_the_threshold(spark):
    rng = random.Random(12)
    base = [f"v{k}" for k in range(120)]
    texts = [(i, " ".join(w if rng.random() > 0.025 else f"n{rng.randrange(9)}" for w in base)) for i in range(120)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs(spark, texts)).collect()}
    assert got == components_by_force(texts)


def test_join_odd_rows(spark):
    df = docs(spark, [*ODD, (6, "ONE"), (7, "é one"), (8, "É one")], ["n", "cid", "key", "keys"])
    got = ngram_join.jaccard_components(df).collect()
    assert len(got) == len(ODD) + 3
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3)
    assert by[4] == (1, 4) and by[6] == (1, 4)  # A-Z are lowered
    assert by[7] == (1, 7) and by[8] == (1, 8)  # other letters are not
    assert by[None] == (1, None) and by[5] == (1, 5)
    assert ngram_join.jaccard_components(df.limit(0)).collect() == []
    kept = ngram_join.first_of_groups(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 5, None, 7, 8}


def test_sketch_bounds(spark):
    rng = np.random.default_rng(0)
    bands = ngram_join.Bands()
    for n in (7, 20, 100, 700):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop = rng.integers(0, max(1, int(0.07 * n)) + 1)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, drop).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            far = len(a) + len(b) - 2 * both
            bits = sum(int(x).bit_count() for x in (ngram_join.bit_sketch(a) ^ ngram_join.bit_sketch(b)).view(np.uint64))
            assert bits <= far
            if far and 100 * both >= 85 * (len(a) + len(b) - both):
                assert len(np.intersect1d(ngram_join.sketch_keys(a, bands), ngram_join.sketch_keys(b, bands)))


def test_wide_sketches_are_a_lower_bound(spark):
    rng = np.random.default_rng(4)
    for n, m in ((3, 4), (255, 257), (300, 290), (900, 1100), (5000, 4200)):
        for share in (0.0, 0.5, 0.9, 1.0):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[:int(share * min(n, m))], rng.integers(0, 2**63, m - int(share * min(n, m))).astype(np.uint64)]))
            x, y = ngram_join.wide_sketch(a), ngram_join.wide_sketch(b)
            assert 8 * len(x) >= 2 * len(a) and ngram_join.apart(x, y) == ngram_join.apart(y, x) <= len(np.setxor1d(a, b))
            assert (ngram_join.folded(x, ngram_join.BITS // 8).view(np.int64) == ngram_join.bit_sketch(a)).all()


def test_join_takes_few_rows_at_a_time(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(ngram_join, "shingles", lambda text, n: taken.append(text) or np.arange(1, 4, dtype=np.uint64))
    frame = type("Frame", (), {"__getitem__": lambda self, c: F.col(c), "select": lambda self, *c: self, "mapInArrow": lambda self, run, schema: run})()
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": ["t"] * 1000})
    first = next(ngram_join.sketches(frame)(iter([batch])))
    assert len(first) == len(taken) == ngram_join.ROWS < 1000


def test_join_verifies_only_long_texts_that_are_near(spark, monkeypatch):
    rng = random.Random(5)
    half = " ".join(f"h{rng.randrange(10**6)}" for _ in range(2000))
    texts = [(i, f"{half} " + " ".join(f"p{rng.randrange(10**6)}" for _ in range(1400))) for i in range(12)]  # half their shingles are common
    texts += [(20 + i, texts[i][1] + " one more word or two" * i) for i in range(3)]
    verified, seen = ngram_join._verified, []

    def counted(pairs, *rest):
        seen.extend((r["a"], r["b"]) for r in pairs.collect())
        return verified(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs(spark, texts), n=5, pct=80).collect()}
    assert got == components_by_force(texts, 5, 80) and len({c for _, c in got.values()}) == 12
    assert len(seen) == 2  # a text and the one with more words; the equal one is its class


def test_components_of_a_long_chain(spark):
    edges = spark.range(40).select((F.col("id") + 1).alias("a"), F.col("id").alias("b")).unionByName(spark.createDataFrame([(100, 102), (102, 101), (7, 7)], "a long, b long"))
    got = {r["node"]: r["comp"] for r in components.components(edges).collect()}
    assert got == dict.fromkeys(range(41), 0) | {100: 100, 101: 100, 102: 100}
    assert components.components(edges.limit(0)).collect() == []


# -- substring dedup

def removed_by_force(texts, n):
    first = {}
    for i, t in sorted((x for x in texts if x[0] is not None), key=lambda x: x[0]):
        w = (t or "").split()
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k:k + n]), i)
    out = []
    for i, t in texts:
        w = (t or "").split()
        gone = {k + j for k in range(len(w) - n + 1) if i is not None and first[tuple(w[k:k + n])] < i for j in range(n)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize(("window", "start"), [(50, 25), (8, 4), (8, 2), (7, 3), (6, 6), (5, 1)])
def test_removals_equal_brute_force(spark, window, start):
    import hashlib
    rng = random.Random(window)
    passages = [[f"p{rng.randrange(12)}" for _ in range(rng.randint(window - 2, window * 2))] for _ in range(8)]
    texts = []
    for i in range(70):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(passages) if rng.random() < 0.6 else [f"u{rng.randrange(30)}" for _ in range(rng.randint(0, window))]
        texts.append((rng.randrange(10_000) if i % 9 else i, " ".join(w)))
    texts = list({i: (i, t) for i, t in texts}.values())
    texts += [(20_000 + k, texts[k][1]) for k in range(5)]
    got = sorted(tuple(r) for r in substring_dedup.removals(docs(spark, texts), window=window, start=start).collect())
    assert got == sorted((i, n, k, hashlib.sha256(kept.encode()).hexdigest()) for i, n, k, kept in removed_by_force(texts, window))
    out = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(docs(spark, texts), window=window, start=start).collect()}
    for i, n, k, kept in removed_by_force(texts, window):
        assert out.get(i, "").split() == kept.split() and (i in out or (n and not kept))


def test_removals_odd_rows(spark):
    run = " ".join(f"x{k}" for k in range(60))
    texts = [*ODD, (None, run), (8, run), (8, run), (9, "a " + run), (9, "other text of the same id"), (6, "w " * 55)]
    df = docs(spark, texts, ["at", "hash", "digest", "__x"])
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring_dedup.removals(df).collect())
    assert got == sorted([("1", 0, 0), ("2", 0, 0), ("3", 0, 0), ("4", 1, 0), ("4", 1, 0), ("None", 3, 0), ("5", 40000, 0), ("None", 60, 0), ("8", 60, 0),
                          ("8", 60, 0), ("9", 61, 60), ("9", 6, 0), ("6", 55, 55)])
    assert substring_dedup.removals(df.limit(0)).collect() == []
    out = substring_dedup.without_repeats(df)
    assert out.columns == df.columns
    by = sorted((str(r["doc_id"]), (r["text"] or "")[:5], r["n_chars"]) for r in out.collect())
    assert ("9", "a", 1) in by and ("9", "other", 25) in by and not [x for x in by if x[0] == "6"] and ("1", "", None) in by
    assert substring_dedup.without_repeats(df.limit(0)).collect() == []


# -- licences

def test_alignment_reports_coverage_and_spans(spark):
    line = license_scan.TEMPLATES[5][1]
    words = line.split()
    bent = " ".join(words[:20] + ["INSERTED"] + words[20:40] + words[42:])
    texts = [(1, f"intro é\n{line} outro"), (2, bent), (3, " ".join(words[:15])), (4, None), (5, ""), (6, line.upper() + "\n" + line)]
    got = [r for r in license_scan.scan(docs(spark, texts, ["template", "start"])).collect() if r["template_id"] == 5]
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert sorted(by) == [1, 2, 6] and len(by[6]) == 2
    one = by[1][0]
    text = texts[0][1]
    assert one["coverage"] == 1.0 and text[one["start"]:one["end"]] == line[:-1] and [(s["start"], s["end"]) for s in one["spans"]] == [(one["start"], one["end"])]
    two = by[2][0]
    assert 0.95 < two["coverage"] < 1 and len(two["spans"]) == 2 + 0 and two["matched_words"] < two["template_words"]
    assert "INSERTED" not in "".join(bent[s["start"]:s["end"]] for s in two["spans"])
    assert license_scan.scan(docs(spark, texts).limit(0)).collect() == []
    assert license_scan.scan(docs(spark, texts), []).collect() == []


def test_alignment_equals_full_table():
    rng = random.Random(4)
    for _ in range(60):
        t = [rng.choice("abcdef") for _ in range(rng.randint(3, 14))]
        w = [x for x in t if rng.random() > 0.15]
        for _ in range(rng.randint(0, 2)):
            w.insert(rng.randrange(len(w) + 1), "z")
        best = [[0] * (len(w) + 1) for _ in range(len(t) + 1)]
        for i in range(len(t)):
            for j in range(len(w)):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (t[i] == w[j]))
        pairs = license_scan.align(t, w, 0)
        assert len(pairs) == best[-1][-1]  # the band holds all of so short a table
        assert all(t[i] == w[j] for i, j in pairs) and pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs)


def test_close_repeats_and_interrupted_notices():
    index = license_scan.Index([(t, license_scan.tokens(x)) for t, (_, x) in enumerate(license_scan.TEMPLATES)])
    line = license_scan.TEMPLATES[1][1]
    for n in (1, 2, 10, 40):
        text = "\n".join([line] * n)
        got = sorted((m["start"], m["end"]) for m in license_scan.matches(text, index) if m["template_id"] == 1)
        assert got == [(k * (len(line) + 1), k * (len(line) + 1) + len(line) - 1) for k in range(n)]
    words = license_scan.TEMPLATES[5][1].split()
    for gap in (20, 50):
        text = " ".join(words[:40] + [f"foreign{k}" for k in range(gap)] + words[40:])
        got = [m for m in license_scan.matches(text, index) if m["template_id"] == 5]
        assert len(got) == 1 and got[0]["coverage"] == 1.0 and len(got[0]["spans"]) == 2


def test_other_licences_are_not_reported():
    names = [n for n, _ in license_scan.TEMPLATES]
    index = license_scan.Index([(t, license_scan.tokens(x)) for t, (_, x) in enumerate(license_scan.TEMPLATES)])

    def found(text):
        return [names[m["template_id"]] for m in sorted(license_scan.matches(text, index), key=lambda m: m["start"])]

    assert found("Released under the BSD License.") == ["BSD line"]
    assert found("Released under the ZZZ License.") == []
    assert found("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0 line"]
    assert found("This work is licensed under the GNU Lesser General Public License, version 3.") == []
    assert found("Licensed under CC BY-SA 4.0.") == ["CC-BY-SA-4.0 short line"]
    assert found("Licensed under CC BY-NC-SA 4.0.") == []
    assert found("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.") == ["CC-BY-SA-4.0 line"]
    assert found("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.") == []
    for name, text in license_scan.TEMPLATES:  # every template is found as itself, alone
        assert [x for x in found(f"before it\n{text}\nafter it") if not (name == "Apache-2.0 notice" and x == "Apache-2.0 line")] == [name]
    both = "Released under the BSD License.\nReleased under the MIT License.\nReleased under the BSD License."
    assert found(both) == ["BSD line", "MIT line", "BSD line"]
    assert found("Released under the BSD or MIT License.").count("MIT line") == 1
    long = "filler words " * 60_000 + "Released under the MIT License. " + "more filler " * 60_000
    assert found(long) == ["MIT line"]


def test_repeated_rows_are_scanned_alike(spark):
    text = "Released under the MIT License."
    got = license_scan.scan(docs(spark, [(1, text), (1, text), (None, text), (2, None)], ["coverage"])).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "None"] and {r["template"] for r in got} == {"MIT line"}


def test_many_templates_take_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "MAX_POSTINGS", 12)
    texts = [(i, t) for i, (_, t) in enumerate(license_scan.TEMPLATES)]
    got = {(r["doc_id"], r["template_id"]) for r in license_scan.scan(docs(spark, texts)).collect()}
    assert {(i, i) for i, _ in texts} <= got


# -- nearest neighbours

def test_vectors_that_take_no_part_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(30)]
    rows += [(40, None), (60, [0.0] * 4), (80, [1.0, None, 0.0, 0.0]), (100, [float("nan")] * 4), (120, [float("inf"), 0.0, 0.0, 0.0]), (140, [1.0, 2.0]), (None, [1.0] * 4)]
    rows += [(200 + k, [3.0, 1.0, 2.0, 0.5]) for k in range(30)] + [(200, [3.0, 1.0, 2.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit(0))
    got = {}
    for r in posting_lists.nearest(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [0, 20, 200, 220]
    x = dict((i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 4 and None not in v and np.isfinite(v).all() and any(v))
    for q, found in got.items():
        found.sort()
        s = sorted((-float((v * x[q]).sum()), i) for i, v in x.items() if i != q)[:20]
        assert [i for _, i, _ in found] == [i for _, i in s]
        assert np.allclose([c for _, _, c in found], [-c for c, _ in s])
    assert [i for _, i, _ in got[200]] == list(range(201, 221))
    few = posting_lists.nearest(df.where("vec_id < 5")).collect()
    assert sorted(r["rank"] for r in few) == [1, 2, 3, 4]
    assert posting_lists.nearest(df.where("vec_id = 40")).collect() == []
    assert posting_lists.nearest(df.limit(0)).collect() == []


def test_lists_grow_and_cells_are_fitted_apart(spark, monkeypatch):
    assert [posting_lists.n_lists(n) for n in (0, 47, 480, 10**6, 10**8, 10**10)] == [1, 1, 10, 4096, 40_000, 400_000]
    for name, value in (("LIST", 8), ("SAMPLE_PER_LIST", 4), ("FINE", 8), ("BLOCK", 16), ("QUERY_BLOCK", 4), ("SCORED", 3), ("SEEN", 1 << 12), ("LEAST", 200)):
        monkeypatch.setattr(posting_lists, name, value)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 6))
    x[:400] = x[0]  # a third of all rows is one vector
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = posting_lists.usable(df)
    c = posting_lists.centroids(rows, 1200, float(np.sqrt((x * x).sum(1)).max()))
    assert 100 < len(c) < 200 and (posting_lists.centroids(rows.repartition(7), 1200, float(np.sqrt((x * x).sum(1)).max())) == c).all()
    assert (posting_lists.linked(spark, c) == posting_lists.neighbours(c, np.arange(len(c)))).all()
    got = {}
    for r in posting_lists.nearest(df).collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 1200, 20)) and all(len(v) == 20 for v in got.values())
    hits = 0
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        hits += sum(score >= np.sort(s)[-20] - 1e-9 for _, score in found)
    assert hits >= 0.9 * 20 * len(got)


def test_graph_search_finds_the_nearest():
    rng = np.random.default_rng(2)
    c = rng.normal(size=(500, 8)).astype(np.float32)
    g = posting_lists.Graph(c)
    x = rng.normal(size=(200, 8))
    ids, d = g.search(x, 20)
    real = np.argsort(((x[:, None] - c) ** 2).sum(2), 1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(ids, real, strict=True)]) > 0.95
    assert (np.diff(d, axis=1) >= 0).all()


# -- models

def test_language_model_odd_rows(spark):
    df = docs(spark, [(i, t if i != 5 else "w " * 3000) for i, t in ODD], ["row", "score", "word"])
    out = attention_lm.scores(df, vocabulary("piece_bpe_32k.model")).collect()
    assert len(out) == len(ODD)
    assert all(r["n_tokens"] == 1 for r in out if r["doc_id"] in (1, 2, 3)) and all(r["score"] < 0 and r["base_score"] < 0 for r in out)
    assert len({(r["base_score"], r["score"]) for r in out if r["doc_id"] == 4}) == 1
    assert attention_lm.scores(df.limit(0), vocabulary("piece_bpe_32k.model")).collect() == []


def test_language_model_without_frequent_words(spark, monkeypatch):
    df = docs(spark, [(i, "a b c d a a " * (i % 3 + 1)) for i in range(1, 40)])
    path = vocabulary("piece_bpe_32k.model")
    want = sorted(tuple(r) for r in attention_lm.scores(df, path).collect())
    monkeypatch.setattr(attention_lm, "HEAD", 1)
    got = sorted(tuple(r) for r in attention_lm.scores(df, path).collect())
    assert [g[:5] for g in got] == [w[:5] for w in want] and np.allclose([g[5:] for g in got], [w[5:] for w in want])


def test_windows_score_every_id_once():
    sizes = np.array([1, 5, 16, 17, 28, 29, 100])
    first, skip, of = attention_lm.windows(sizes)
    seen = np.zeros(sizes.sum(), int)
    ends = np.cumsum(sizes)
    for f, s, k in zip(first, skip, of, strict=True):
        at = np.arange(f + s, f + attention_lm.SPAN)
        np.add.at(seen, at[at < ends[k]], 1)
    assert (seen == 1).all()


def test_windows_leave_half_a_span_of_context():
    first, skip, of = attention_lm.windows(np.array([5, 40, 1000]))
    assert attention_lm.CLASSES >= 64 and (skip[np.flatnonzero(np.diff(of) == 0) + 1] >= max(8, attention_lm.SPAN // 2)).all()


def test_next_id_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, 1500).astype(float)
    seqs = [np.append(rng.integers(3, 1500, 40), 2) for _ in range(30)]
    cls, share = attention_lm.classes_of(counts, 30, attention_lm.groups_of(seqs, counts))
    slot, column = attention_lm.layout(cls, counts)
    table = rng.integers(0, 3, (int(slot.max()) + 1, int(column.max()) + 1)).astype(float)
    table[:, ~np.isin(np.arange(table.shape[1]), column)] = 0
    f = attention_lm.following(cls, share, slot, column, table, table[0], table[:, 0])
    for before in (0, 7, 1400):
        p = np.exp(f["follow"][slot[before], column] + f["rest"])
        assert np.allclose(np.bincount(cls, p), 1, atol=1e-6)


def test_attention_model_learns_from_every_training_document(spark):
    rng = np.random.default_rng(1)
    texts = [rng.integers(3, 60, rng.integers(1, 90)).astype(np.uint16) for _ in range(200)]
    texts.append(np.append(np.full(5000, 3), 61).astype(np.uint16))  # an id that only the end of a long text holds
    texts = [np.append(t, 2).astype(np.uint16) for t in texts]
    rows = [(i * 7919, t.tobytes()) for i, t in enumerate(texts)]
    cls, parts = np.arange(70) % 9, 6
    got = [attention_lm.trained(spark.createDataFrame(rows, "h long, ids binary").repartition(n), parts, cls, np.uint16) for n in (1, 5)]
    assert all((got[0][k] == got[1][k]).all() for k in got[0])
    start = attention_lm.train([t.astype(np.int64) for (h, _), t in zip(rows, texts, strict=True) if h % parts == 0], cls)
    moved, weight = attention_lm.moves(start, cls, ((h % parts, t.astype(np.int64)) for (h, _), t in sorted(zip(rows, texts, strict=True), key=lambda x: (x[0][0] % parts, x[0][0]))))
    assert weight[-1] == sum(len(t) for t in texts)
    assert np.allclose(attention_lm.unstacked(attention_lm.stacked(start.p) + moved / (np.maximum(weight, 1)[:, None] * attention_lm.FIXED), start.p)["u"], got[0]["u"])
    assert weight[61] > 0 and (got[0]["e"][61] != start.p["e"][61]).any()
    key, n = attention_lm.neighbours(spark.createDataFrame(rows, "h long, ids binary").repartition(4), np.arange(70.0), np.uint16)
    want = Counter(k for t in texts for k in attention_lm.neighbour_keys(t.astype(np.int64), np.array([len(t)]), attention_lm.neighbour_columns(np.arange(70.0))))
    assert dict(zip(key, n, strict=True)) == want


def test_language_model_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(attention_lm, "PART", 300, raising=False)
    rng = random.Random(6)
    df = docs(spark, [(i, " ".join(rng.choice("the cat sat on a mat and dog ran".split()) for _ in range(rng.randint(1, 60)))) for i in range(60)])
    got = [{r["doc_id"]: r["score"] for r in attention_lm.scores(df.repartition(n), vocabulary("piece_bpe_32k.model")).collect()} for n in (1, 5)]
    assert got[0] == got[1]


def test_classifier_odd_rows_and_labels(spark):
    df = docs(spark, ODD, ["label", "score"])
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_mil.scored(df, quality_mil.fit(df, none)).collect()
    assert len(out) == len(ODD) and all(r["score"] == 0.5 for r in out)
    one = spark.createDataFrame([(1, 1), (2, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert all(0.5 <= r["score"] < 1 for r in quality_mil.scored(df, quality_mil.fit(df, one)).collect())
    assert quality_mil.scored(df.limit(0), {"share": 0.5}).collect() == []


def test_classifier_gradient():
    rng = np.random.default_rng(3)
    bags = [np.pad(rng.normal(size=(rng.integers(1, 5), quality_mil.FEATURES)), ((0, 0), (0, quality_mil.PASSAGE))).astype(np.float32) for _ in range(300)]
    labels = np.array([float(b[:, 0].max() > 0.5) for b in bags])  # one passage decides
    p = quality_mil.train(bags, labels)
    at = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1]))
    score = quality_mil.forward(p, np.concatenate(bags), at)["score"]
    assert ((score > 0.5) == labels).mean() > 0.9


def test_classifier_learns_words():
    rng = random.Random(5)
    common, good, bad = ([f"{a}{i:03}" for i in range(200)] for a in "xyz")  # alike in every class of bytes
    texts = [" ".join(rng.choices(common, k=180) + rng.choices(bad if i % 2 else good, k=8)) for i in range(600)]
    bags = [quality_mil.passages(t) for t in texts]
    for b in bags:
        b[:, :quality_mil.FEATURES] = 0  # words alone
    labels = np.array([i % 2 for i in range(600)], float)
    p = quality_mil.train(bags[:400], labels[:400])
    at = np.concatenate(([0], np.cumsum([len(b) for b in bags[400:]])[:-1]))
    score = quality_mil.forward(p, np.concatenate(bags[400:]), at)["score"]
    assert ((score > 0.5) == labels[400:]).mean() > 0.9


def test_word_buckets_of_a_passage():
    got = quality_mil.passages(" ".join(["Word"] * 64 + ["word", "other"]))[:, quality_mil.FEATURES:]
    assert got.shape == (2, quality_mil.PASSAGE) and (got[0] == got[1, 0]).all() and (got[1, 2:] == 0).all()
    assert got[1, 1] > 0 and (quality_mil.passages("")[:, quality_mil.FEATURES:] == 0).all()


def test_bags_of_long_texts_are_whole(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "house", "river"]
    clean = [" ".join(rng.choice(words) for _ in range(36_000)) for _ in range(4)]
    noise = " ".join("#%&!!" for _ in range(2_000))
    texts = [(i, clean[i % 4][:-20 * i - 1] + (noise if i % 2 else "")) for i in range(40)]  # the noise begins after word 34,000
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, float(i % 2)) for i, _ in texts], "doc_id long, quality double")
    score = {r["doc_id"]: r["score"] for r in quality_mil.scored(df, quality_mil.fit(df, labels)).collect()}
    assert min(score[i] for i in score if i % 2) > max(score[i] for i in score if not i % 2)
