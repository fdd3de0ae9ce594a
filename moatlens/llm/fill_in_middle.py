r"""Fill-in-middle transformation with cuts between units, by word-parallel select.

A unit is a line with its end (the rest after the last end is one too). A
batch's texts are viewed as one run of uint64 words. Arithmetic on words marks
the bytes that end a unit and the bytes inside a code point, bitwise_count
counts marks per word, and one running sum serves all texts of the batch: the
k-th end of a text is found by searching the sum for its word, then by clearing
marks within that word. Texts are neither split nor decoded.

Where a text is cut depends on its id alone: four numbers from a hash give two
cuts, whether it is transformed, and in which form. ``psm`` is prefix, suffix,
middle; ``spm`` suffix, prefix, middle; ``plain`` the text as it is.

Defined cases: a null or empty text is plain, with no units; so is a text that
holds a sentinel, which keeps ``restored`` exact; texts without ends are one
unit, so a part may be empty; a null id hashes like an empty one; repeated rows
are cut alike; an empty table gives no rows; extra columns pass through, the
operator's own are prefixed ``fim_`` and replace columns of that name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "7:"
#: Percent of texts that are transformed, and of those in form spm.
RATE, SPM = 100, 50
#: Bytes of text whose words are held at once (one text at least).
STEP = 8 << 20

_ONES = np.uint64(0x0101010101010101)
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_HIGH = np.uint64(0x8080808080808080)

OWN = [("fim_lines", T.LongType()), ("fim_form", T.StringType()), ("fim_prefix_chars", T.LongType()),
       ("fim_middle_chars", T.LongType()), ("fim_output", T.StringType())]


def equal_bytes(words: np.ndarray, byte: int) -> np.ndarray:
    """The high bit of every byte that equals ``byte``."""
    x = words ^ (_ONES * np.uint64(byte))
    return ~(((x & _LOW) + _LOW) | x | _LOW)


def inner_bytes(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that continues a code point (10xxxxxx)."""
    return words & ~(words << np.uint64(1)) & _HIGH


class Marks:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before each byte offset (which may lie right behind the last word but one)."""
        word, inside = at >> 3, (np.uint64(1) << ((at & 7) * 8).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.marks[word] & inside)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte offset of the k-th mark of all, from 0."""
        word = np.searchsorted(self.before, k, "right") - 1
        left, m = k - self.before[word], self.marks[word]
        for i in range(7):
            m = np.where(left > i, m & (m - np.uint64(1)), m)
        lowest = m & (~m + np.uint64(1))
        return word * 8 + (np.bitwise_count(lowest - np.uint64(1)) >> 3)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[Marks, Marks, np.ndarray]:
    """Marks of line ends and of inner bytes, and how many lines each text ``offsets[i]:offsets[i + 1]`` has."""
    padded = np.zeros((len(data) // 8 + 1) * 8, np.uint8)  # one byte of padding at least: offsets may lie behind the text
    padded[:len(data)] = data
    words = padded.view("<u8")
    ends, inner = Marks(equal_bytes(words, 10)), Marks(inner_bytes(words))
    first, last = offsets[:-1], offsets[1:]
    open_ = (last > first) & (padded[np.maximum(last - 1, 0)] != 10)
    return ends, inner, ends.rank(last) - ends.rank(first) + open_


def cut(ends: Marks, offsets: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Byte offsets behind the first ``units`` lines of every text."""
    first, last = offsets[:-1], offsets[1:]
    seen = ends.rank(first)
    out = np.where(units == 0, first, last)
    at = np.flatnonzero((units > 0) & (seen + units <= ends.rank(last)))
    out[at] = ends.select(seen[at] + units[at] - 1) + 1
    return out


def numbers(keys: list[str], seed: str = SEED) -> np.ndarray:
    """Four 32-bit numbers of every key."""
    digests = b"".join(hashlib.sha256((seed + k).encode()).digest()[:16] for k in keys)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def _transformed(texts: pa.Array, keys: list[str], seed: str, rate: int, spm: int) -> list[pa.Array]:
    """The columns OWN of a run of texts."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    ends, inner, n = lines(data, offsets)
    h = numbers(keys, seed)
    c = np.sort(h[:, :2] % (n + 1)[:, None], 1)
    a, b = cut(ends, offsets, c[:, 0]), cut(ends, offsets, c[:, 1])
    chars = lambda x, y: y - x - (inner.rank(y) - inner.rank(x))
    plain = (np.diff(offsets) == 0) | (h[:, 2] % 100 >= rate)
    for s in (PREFIX, SUFFIX, MIDDLE):
        plain |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    form = np.where(plain, "plain", np.where(h[:, 3] % 100 < spm, "spm", "psm"))
    view, out = memoryview(data), []
    for i, f in enumerate(form):
        first, x, y, last = offsets[i], a[i], b[i], offsets[i + 1]
        if f == "plain":
            out.append(bytes(view[first:last]))
            continue
        prefix, middle, suffix = view[first:x], view[x:y], view[y:last]
        parts = (PREFIX, prefix, SUFFIX, suffix) if f == "psm" else (SUFFIX, suffix, PREFIX, prefix)
        out.append(b"".join([parts[0].encode(), parts[1], parts[2].encode(), parts[3], MIDDLE.encode(), middle]))
    return [pa.array(n), pa.array(form.tolist()), pa.array(chars(offsets[:-1], a), mask=plain), pa.array(chars(a, b), mask=plain),
            pa.array(out, pa.binary()).cast(pa.string(), safe=False)]


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """Every row with its number of lines, form, prefix and middle lengths in code points and output."""
    own = [n for n, _ in OWN]
    docs = docs.drop(*own, "fim_key", "fim_text")
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in OWN]])
    kept = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # runs of at most STEP bytes, so that a batch of long texts is not held several times over
            size = np.concatenate(([0], np.cumsum(pc.binary_length(whole.column("fim_text")).to_numpy(zero_copy_only=False))))
            first = 0
            while first < len(whole):
                last = max(first + 1, int(np.searchsorted(size, size[first] + STEP, "right")) - 1)
                b = whole.slice(first, last - first)
                cols = _transformed(b.column("fim_text"), b.column("fim_key").to_pylist(), seed, rate, spm)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *cols], names=[*kept, *own])
                first = last

    key, text = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    return docs.select("*", key.alias("fim_key"), text.alias("fim_text")).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The exact text rebuilt from an output and its form: no part holds a sentinel, so each is found by its first occurrence."""
    body = F.substring(output, len(PREFIX) + 1, 1 << 30)
    middle = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    one, rest = F.split_part(body, middle, F.lit(1)), F.split_part(body, middle, F.lit(2))
    two, three = F.split_part(rest, F.lit(MIDDLE), F.lit(1)), F.split_part(rest, F.lit(MIDDLE), F.lit(2))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))
