"""Encoding against the library, spans, and the compiled character map."""

import hashlib
import random
import struct

import pytest
import sentencepiece

from moatlens.llm.pieces import CharMap, PieceModel, digests, encoded, tokenised
from moatlens.llm.queries import vocabulary


@pytest.fixture(scope="module")
def model():
    with open(vocabulary("piece_bpe_32k.model"), "rb") as f:
        return PieceModel(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


def texts():
    rng = random.Random(1)
    chars = "ab é▁ \n\t<0x>日🙂.,1"
    fixed = ["", " ", "  a  b ", " \n\n x\t\ty", "▁▁ a▁b", "<s> </s> <unk> <0x41>", "a" * 500 + "b" * 300, " " * 300, "0123456789" * 30, "x" * 70 + " " + "ab" * 900]
    return fixed + ["".join(rng.choice(chars) for _ in range(rng.randint(0, 150))) for _ in range(400)]


def test_same_ids_text_and_covering_spans(model, library):
    for t in texts():
        ids = library.encode(t)
        assert model.encode(t)[0] == ids
        assert model.decode(ids) == library.decode(ids)
        got, starts, ends = model.spans(t)
        assert got == ids
        if ids:  # the spans are the text's bytes, in order, without gaps
            assert starts[0] == 0 and ends[-1] == len(t.encode()) and (starts[1:] == ends[:-1]).all()


def test_spans_are_the_librarys(model, library):
    for t in [*texts(), "日本 🙂🙂 é" * 50]:
        ids, starts, ends = model.spans(t)
        for i, a, b, p in zip(ids, starts, ends, library.encode_as_proto(t).pieces, strict=True):
            assert i == p.id
            if i not in model.raw:  # the library gives a character's bytes to the last of its byte pieces
                assert (a, b) == (p.begin, p.end)


def test_decoding_of_any_ids(model, library):
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(32000) if rng.random() < 0.6 else rng.randrange(3, 259) for _ in range(rng.randint(0, 30))]
        assert model.decode(ids) == library.decode(ids)


def compiled(entries: dict[bytes, str]) -> bytes:
    """A character map with a double-array trie, built the slow way."""
    strings, place = b"", {}
    for k in sorted(entries):
        place[k] = len(strings)
        strings += entries[k].encode() + b"\0"
    units, used = {0: 0}, {0}

    def put(prefix: bytes, at: int) -> None:
        labels = sorted({k[len(prefix)] for k in entries if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in entries
        base = next(b for b in range(1, 1 << 16) if all(b ^ c not in used for c in [0] * leaf + labels) and at ^ b < 1 << 21)
        units[at] = units.get(at, 0) | ((at ^ base) << 10) | (256 if leaf else 0)
        used.update(base ^ c for c in [0] * leaf + labels)
        if leaf:
            units[base] = place[prefix] | 1 << 31
        for c in labels:
            units[base ^ c] = c
        for c in labels:
            put(prefix + bytes([c]), base ^ c)

    put(b"", 0)
    size = max(used) + 1
    blob = struct.pack(f"<{size}I", *[units.get(i, 0x80000000) for i in range(size)])
    return struct.pack("<I", len(blob)) + blob + strings


def test_longest_prefix_wins_and_is_traced_back():
    m = CharMap(compiled({"ﬁ".encode(): "fi", b"a": "A", b"ab": "X", "①".encode(): "1"}))
    assert m.longest(b"abc", 0) == (2, "X")
    assert m.longest(b"ac", 0) == (1, "A")
    assert m.longest(b"zab", 0) is None
    assert m.longest("ﬁx".encode(), 0) == (3, "fi")


def test_normalised_characters_point_to_their_bytes(model):
    import copy
    m = copy.copy(model)
    m.map = CharMap(compiled({"ﬁ".encode(): "fi", b"ab": "X"}))
    normal, at = m.normalise("ﬁ ab é")
    assert normal == "▁fi▁X▁é"
    assert at == [0, 0, 0, 3, 4, 6, 7, 9]
    m.cache = {}
    ids, starts, ends = m.spans("ﬁ ab é")
    assert starts[0] == 0 and ends[-1] == 9 and all(a <= b for a, b in zip(starts, ends, strict=True))


def test_tables(spark):
    path = vocabulary("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "ab cd", 5), (3, "ab cd", 5)], "doc_id long, text string, ids int")
    out = {r["id"]: r for r in digests(df, path).collect()}
    assert out[1]["n_tokens"] == 0 == out[2]["n_tokens"] and out[1]["ids_sha256"] == out[2]["ids_sha256"]
    assert digests(df, path).count() == 4
    assert digests(df.limit(0), path).count() == 0
    spans = {r["id"]: r for r in encoded(df, path).collect()}
    assert spans[3]["starts"][0] == 0 and spans[3]["ends"][-1] == 5
    assert out[3]["covered_bytes"] == 5 and out[1]["covered_bytes"] == 0
    at = struct.pack(f"<{2 * len(spans[3]['ids'])}q", *spans[3]["starts"], *spans[3]["ends"])
    assert out[3]["spans_sha256"] == hashlib.sha256(at).hexdigest()


def test_clashing_columns_give_way(spark):
    path = vocabulary("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, None, 5, "x", None), (None, "ab cd", None, "y", 1)], "doc_id long, text string, IDS int, `a.b` string, starts int")
    got = tokenised(df, path)
    assert got.columns == ["doc_id", "a.b", "n_tokens", "ids", "starts", "ends", "decoded_sha256"]
    rows = {r["a.b"]: r for r in got.collect()}
    assert rows["x"]["n_tokens"] == 0 and rows["x"]["ids"] == [] and rows["y"]["ends"][-1] == 5 and rows["y"]["doc_id"] is None
    assert tokenised(df.limit(0), path).collect() == []


def test_many_words_merge_as_one_does(model):
    from moatlens.llm.merges import ManyWords
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshr,.é日🙂▁<0") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    words += ["the", "a" * 500, "!!!!", "", "ab" * 40]
    ids, size = ManyWords(model).encode(words)
    at = 0
    for w, n in zip(words, size, strict=True):
        assert list(ids[at:at + n]) == model.encode(w or "")[0] or not w
        at += n
    assert at == len(ids)
    assert [len(x) for x in ManyWords(model).encode([])] == [0, 0]
