"""Polarity rules one by one, names by likeness, and limits that can be lifted."""

import math

import pytest
from pyspark.sql import functions as F

from moatlens.functions import lexicons as L
from moatlens.operators import complaints, identity, messaging, sentiment


def said(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", sentiment.compound(F.col("t")).alias("c")).collect()
    return [r.c for r in sorted(rows, key=lambda r: r.i)]


def norm(s):
    return s / math.sqrt(s * s + 15)


CASES = [
    ("good", 1.9), ("Good,", 1.9), ("bad", -2.5), ("the house", 0.0), ("", 0.0), (None, 0.0), ("good bad", -0.6),
    ("very good", 1.9 + 0.293), ("very bad", -2.5 - 0.293), ("slightly good", 1.9 - 0.293), ("slightly bad", -2.5 + 0.293),
    ("very a good", 1.9 + 0.95 * 0.293), ("very a a good", 1.9 + 0.9 * 0.293), ("very a a a good", 1.9),
    ("not good", 1.9 * -0.74), ("isn't good", 1.9 * -0.74), ("not a a good", 1.9 * -0.74), ("not a a a good", 1.9),
    ("not very good", (1.9 + 0.293) * -0.74), ("very not good", 1.9 * -0.74 - 0.95 * 0.293),
    ("GOOD house", 1.9 + 0.733), ("BAD house", -2.5 - 0.733), ("GOOD HOUSE", 1.9), ("VERY good", 1.9 + 0.293 + 0.733),
    ("good but bad", 0.5 * 1.9 - 1.5 * 2.5), ("but good", 1.5 * 1.9), ("good but", 0.5 * 1.9),
    ("good!", 1.9 + 0.292), ("bad!!!", -2.5 - 3 * 0.292), ("good!!!!!!", 1.9 + 4 * 0.292), ("house!!", 0.0),
    ("good?", 1.9), ("good??", 1.9 + 0.36), ("bad?????", -2.5 - 0.96),
]


def test_each_rule(spark):
    got = said(spark, *[t for t, _ in CASES])
    for (text, want), c in zip(CASES, got, strict=True):
        assert c == pytest.approx(norm(want), abs=1e-12), text


def test_long_texts_and_tables(spark):
    assert said(spark, "house " * 100_000 + "good")[0] == pytest.approx(norm(1.9))
    t = spark.createDataFrame([("a", "good", 1), ("a", None, 2), ("a", "good", 3), (None, "bad", 4)], "k string, text string, c int")
    got = {r.k: (r.compound_score, r.sample_size, r.lines_with_polarity) for r in sentiment.polarity_mean(t, "k", counted=True).collect()}
    assert got == {"a": (round(2 * norm(1.9) / 3, 6), 3, 2), None: (round(norm(-2.5), 6), 1, 1)}
    assert sentiment.polarity_mean(t.limit(0), "k").collect() == []


def test_most_review_companies_have_a_polarity(spark):
    from moatlens.plans import QUERIES
    from tests.conftest import SF01
    rows = QUERIES["polarity_rules"](spark, SF01).collect()
    assert sum(r.compound_score != 0 for r in rows) > len(rows) / 2


def registry(spark, names):
    return spark.createDataFrame([(i, n, "x", "y", None) for i, n in enumerate(names)], "lei long, legal_name string, jurisdiction string, status string, city string")


def test_misspelt_names(spark):
    reg = registry(spark, ["Acme Holdings", "Acne Holdings", "Globex", None, "", "Initech Corp", "initech corp", "Globexx"])
    q = spark.createDataFrame([("acme holdngs",), ("Axme Holdings",), ("globex",), ("Gloxbe",), ("initehc corp",), ("inintech corp",), (None,), ("zzz",), ("acme holdings inc",)], "query string")
    one = {r.query: (r.lei, r.distance) for r in identity.legal_entity_lookup(q, reg, edits=1).collect()}
    assert one == {"acme holdngs": (0, 1), "Axme Holdings": (0, 1), "globex": (2, 0), "Gloxbe": (None, None), "initehc corp": (None, None), "inintech corp": (5, 1),
                   None: (None, None), "zzz": (None, None), "acme holdings inc": (None, None)}
    two = {r.query: (r.lei, r.distance) for r in identity.legal_entity_lookup(q, reg, edits=2).collect()}
    assert two == one | {"Gloxbe": (2, 2), "initehc corp": (5, 2)}
    plain = {r.query: r.lei for r in identity.legal_entity_lookup(q, reg).collect()}
    assert plain == {k: v if d == 0 else None for k, (v, d) in one.items()}
    assert identity.legal_entity_lookup(q.limit(0), reg, edits=1).collect() == []
    assert {r.lei for r in identity.legal_entity_lookup(q, reg.limit(0), edits=1).collect()} == {None}


def test_nearest_names_equal_brute_force(spark):
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(5)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(120)]
    asked = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    reg, q = registry(spark, names), spark.createDataFrame([(a,) for a in asked], "query string")
    for k in (1, 2):
        got = {r._q: (r.distance, r.lei) for r in identity.nearest_names(q, reg, edits=k).collect()}
        want = {a: min((distance(a, n), i) for i, n in enumerate(names)) for a in asked}
        assert got == {a: w for a, w in want.items() if w[0] <= k}


def test_a_name_held_by_a_third_of_the_registry(spark):
    reg = spark.range(30_000).select(F.col("id").alias("lei"), F.when(F.col("id") % 3 == 0, "Shell Company").otherwise(F.concat(F.lit("Firm "), F.col("id"))).alias("legal_name"),
                                     F.lit("x").alias("jurisdiction"), F.lit("y").alias("status"), F.lit(None).cast("string").alias("city"))
    q = spark.createDataFrame([("shell compny",), ("firn 12346",)], "query string")
    assert {r.query: (r.lei, r.distance) for r in identity.legal_entity_lookup(q, reg, edits=1).collect()} == {"shell compny": (0, 1), "firn 12346": (12346, 1)}


def test_limits_can_be_lifted(spark):
    md = "\n".join([f"## Sub {i}" for i in range(12)] + [f"### Small {i}" for i in range(9)] + [f"{i}0,000+ customers" for i in range(1, 9)])
    r = messaging.extract_messaging(spark.createDataFrame([(md,)], "markdown string")).first()
    assert len(r.subheadlines_all) == 12 and r.subheadlines == r.subheadlines_all[:L.N_SUBHEADLINES]
    assert len(r.h3_messages_all) == 9 and r.h3_messages == r.h3_messages_all[:L.N_H3]
    assert len(r.proof_points_all) >= 8 and r.proof_points == r.proof_points_all[:L.N_PROOF_POINTS]
    word = L.COMPLAINT_CATEGORIES[0][1][0]
    lines = F.array(*[F.lit(f"line {i} {word}") for i in range(9)])
    one = spark.range(1).select(complaints.sample_lines(lines).alias("cut"), complaints.sample_lines(lines, first=None).alias("whole")).first()
    assert len(one.cut[0].lines) == L.N_SAMPLE_LINES and len(one.whole[0].lines) == 9
