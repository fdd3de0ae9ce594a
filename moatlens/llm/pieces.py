"""SentencePiece encoding and decoding (BPE models) with original byte spans.

A text is normalised by longest-prefix matches in the model's compiled
character map; every normalised character remembers the original bytes it came
from, so each piece is projected back to a byte span. Pieces come from merging
adjacent symbols by score. Texts are cut where no piece of the vocabulary
could cross, and the parts' pieces are kept in a bounded cache per worker.

Defined cases: null and empty texts have no pieces and decode to an empty
text; texts of any length are encoded whole (long parts merge through a heap);
repeated rows are encoded alike; an empty table gives no rows; extra columns
are not read, or, where the documents are returned, carried along: those named
like a result (in any case) give way to it.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SPACE = "▁"
# Piece types of the model file: fixed values.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Entries of a worker's cache of parts; it is emptied when full.
CACHE = 700_000
#: Parts of more characters than this merge through a heap and aren't kept.
LONG = 64


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = buf[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, buf[at:at + n]
        at += n


class CharMap:
    """Longest-prefix replacement through a compiled character map (a double-array trie and its strings)."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{n // 4}I", blob, 4) if n else ()
        self.strings = blob[4 + n:]

    def longest(self, text: bytes, at: int) -> tuple[int, str] | None:
        """(bytes matched, replacement) of the longest entry that starts at ``at``."""
        units, node, found, i = self.units, 0, None, at
        node ^= (units[0] >> 10) << ((units[0] & 512) >> 6)
        while i < len(text):
            c = text[i]
            node ^= c
            if node >= len(units) or units[node] & 0x800000FF != c:
                break
            i += 1
            unit = units[node]
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found = (i - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.strings.index(b"\0", found[1])
        return found[0], self.strings[found[1]:end].decode("utf-8", "replace")


class PieceModel:
    def __init__(self, blob: bytes):
        self.pieces: list[str] = []
        self.types: list[int] = []
        scores: list[float] = []
        trainer, spec = {}, {}
        for field, value in _fields(blob):
            if field == 1:
                f = dict(_fields(value))
                self.pieces.append(f[1].decode("utf-8"))
                scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.types.append(f.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                spec = dict(_fields(value))
        if trainer.get(3, 1) != 2 or UNUSED in self.types or trainer.get(24, 0):
            raise ValueError("only BPE models without unused pieces and with white space as prefix")
        self.map = CharMap(spec.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.unk = self.types.index(UNKNOWN)
        self.unk_text = trainer[44].decode("utf-8") if 44 in trainer else " ⁇ "
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        self.fallback = bool(trainer.get(35, 0))
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] in (NORMAL, USER_DEFINED)}
        self.cost = {p: -scores[i] for p, i in self.ids.items()}
        own = sorted((p for i, p in enumerate(self.pieces) if self.types[i] == USER_DEFINED), key=len, reverse=True)
        self.own = re.compile("(" + "|".join(map(re.escape, own)) + ")") if own else None
        self.part = _parts([p for p in self.ids if len(p) > 1])
        self.cache: dict[str, tuple[tuple[int, ...], str, tuple[int, ...]]] = {}
        # decoding: text of each id; a byte piece holds its byte value in raw
        self.text_of = ["" if t == CONTROL else self.unk_text if t == UNKNOWN else p.replace(SPACE, " ")
                        for p, t in zip(self.pieces, self.types, strict=True)]
        self.raw = {i: b for b, i in self.bytes.items()}

    # -- normalisation

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """The normalised text and, per character of it and for its end, the original byte offset (None: the identity map)."""
        if not text:
            return "", []
        if not self.map.units and not self.squeeze and self.own is None:
            out = text.replace(" ", SPACE) if self.escape else text
            return (SPACE + out if self.dummy else out), None
        raw, at, chars, starts = text.encode("utf-8"), 0, [], []
        while at < len(raw):
            found = self.map.longest(raw, at) if self.map.units else None
            if found:
                n, to = found
            else:
                n = 1 if raw[at] < 128 else 2 if raw[at] < 224 else 3 if raw[at] < 240 else 4
                to = raw[at:at + n].decode("utf-8")
            chars.extend(to)
            starts.extend([at] * len(to))
            at += n
        ends = [*starts[1:], len(raw)]
        for i in range(len(chars) - 2, -1, -1):  # characters of one replacement end together
            if starts[i] == starts[i + 1]:
                ends[i] = ends[i + 1]
        keep = list(range(len(chars)))
        if self.squeeze:
            keep = [i for i in keep if chars[i] != " " or (i and chars[i - 1] != " ")]
            while keep and chars[keep[-1]] == " ":
                keep.pop()
        if not keep:
            return "", []
        space = SPACE if self.escape else " "
        body = "".join(space if chars[i] == " " else chars[i] for i in keep)
        at = [starts[i] for i in keep] + [ends[keep[-1]]]
        return (space + body, [at[0], *at]) if self.dummy else (body, at)

    # -- merging

    def _merge_short(self, s: list[str]) -> list[str]:
        cost, none = self.cost, float("inf")
        c = [cost.get(a + b, none) for a, b in zip(s, s[1:])]  # noqa: B905
        while c:
            m = min(c)
            if m == none:
                break
            i = c.index(m)
            s[i:i + 2] = [s[i] + s[i + 1]]
            del c[i]
            if i:
                c[i - 1] = cost.get(s[i - 1] + s[i], none)
            if i < len(c):
                c[i] = cost.get(s[i] + s[i + 1], none)
        return s

    def _merge_long(self, s: list[str]) -> list[str]:
        cost, left, right = self.cost, list(range(-1, len(s) - 1)), list(range(1, len(s) + 1))
        heap = [(c, i, s[i], s[i + 1]) for i in range(len(s) - 1) if (c := cost.get(s[i] + s[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if s[i] else len(s)
            if j >= len(s) or s[i] != a or s[j] != b:
                continue
            s[i], s[j] = a + b, ""
            right[i] = right[j]
            if right[i] < len(s):
                left[right[i]] = i
            for k in (left[i], i):
                if 0 <= k and right[k] < len(s) and (c := cost.get(s[k] + s[right[k]])) is not None:
                    heapq.heappush(heap, (c, k, s[k], s[right[k]]))
        return [x for x in s if x]

    def _symbols(self, part: str) -> list[str]:
        if self.own is not None and self.own.fullmatch(part):
            return [part]
        return self._merge_short(list(part)) if len(part) <= LONG else self._merge_long(list(part))

    def _part(self, part: str) -> tuple[tuple[int, ...], str, tuple[int, ...]]:
        """Ids of a part, as text too, and 4 * first character + byte of it where each begins; kept if the part is short."""
        ids: list[int] = []
        begin: list[int] = []
        k = 0
        for s in self._symbols(part):
            i = self.ids.get(s)
            if i is not None:
                ids.append(i)
                begin.append(4 * k)
            elif self.fallback:  # one character: its first byte piece begins it
                own = s.encode("utf-8")
                ids.extend([self.bytes[b] for b in own])
                begin.extend(range(4 * k, 4 * k + len(own)))
            elif not ids or ids[-1] != self.unk:
                ids.append(self.unk)
                begin.append(4 * k)
            k += len(s)
        got = tuple(ids), ",".join(map(str, ids)), tuple(begin)
        if len(part) <= LONG:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[part] = got
        return got

    def parts(self, normal: str) -> list[str]:
        if self.own is None:
            return self.part.findall(normal)
        out = []
        for k, x in enumerate(self.own.split(normal)):
            out += [x] if k % 2 else self.part.findall(x)
        return out

    # -- whole texts

    def encode(self, text: str) -> tuple[list[int], str]:
        ids: list[int] = []
        said = []
        get, make, say = self.cache.get, self._part, said.append
        for p in self.parts(self.normalise(text)[0]):
            got = get(p) or make(p)
            ids += got[0]
            say(got[1])
        return ids, ",".join(said)

    def spans(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids with the original bytes [start, end) of each; a byte piece of an unchanged character has its one byte.

        Spans follow each other without gaps: a piece ends where the next begins.
        """
        normal, at = self.normalise(text)
        if not normal:
            return [], np.empty(0, np.int64), np.empty(0, np.int64)
        ids: list[int] = []
        begin: list[int] = []
        sizes, lengths = [], []
        get, make = self.cache.get, self._part
        for p in self.parts(normal):
            got = get(p) or make(p)
            ids += got[0]
            begin += got[2]
            sizes.append(len(got[0]))
            lengths.append(len(p))
        at = self._offsets(text) if at is None else np.array(at, np.int64)
        code, length = np.array(begin, np.int64), np.array(lengths, np.int64)
        char = (code >> 2) + np.repeat(np.cumsum(length) - length, sizes)
        starts = np.minimum(at[char] + (code & 3), at[char + 1])
        if not self.fallback:  # unknown pieces side by side are one
            a = np.array(ids)
            keep = np.append(True, (a[1:] != self.unk) | (a[:-1] != self.unk))
            ids, starts = a[keep].tolist(), starts[keep]
        return ids, starts, np.append(starts[1:], at[-1])

    def _offsets(self, text: str) -> np.ndarray:
        """Original byte offset of every character of an unchanged text, and its end."""
        if text.isascii():
            at = np.arange(len(text) + 1)
        else:
            c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            at = np.append(0, np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)))
        return np.append(0, at) if self.dummy else at

    def decode(self, ids: list[int]) -> str:
        text_of, raw = self.text_of, self.raw
        first = next((k for k, i in enumerate(ids) if self.types[i] != CONTROL), None)
        if first is None:
            return ""
        strip = (self.dummy or self.squeeze) and self.types[ids[first]] in (NORMAL, USER_DEFINED) and self.pieces[ids[first]].startswith(SPACE)
        if raw.keys().isdisjoint(ids):
            out = "".join([text_of[i] for i in ids])
        else:
            parts, held = [], bytearray()
            for i in ids:
                if i in raw:
                    held.append(raw[i])
                    continue
                if held:
                    parts.append(_utf8(held))
                    held = bytearray()
                parts.append(text_of[i])
            parts.append(_utf8(held))
            out = "".join(parts)
        return out[1:] if strip else out


def _parts(merged: list[str]) -> re.Pattern:
    """Cuts a text between characters that no piece of several characters holds side by side.

    Characters fall into groups joined by such neighbours; a part is a run of
    one group, with the space marks before it.
    """
    if any(p[i] != SPACE and p[i + 1] == SPACE for p in merged for i in range(len(p) - 1)):
        return re.compile("(?s).+")
    up: dict[str, str] = {}

    def top(c: str) -> str:
        while up.setdefault(c, c) != c:
            c = up[c]
        return c

    for p in merged:
        run = p.lstrip(SPACE)
        for a, b in zip(run, run[1:] or run, strict=False):
            up[top(a)] = top(b)
    groups: dict[str, list[str]] = {}
    for c in list(up):
        groups.setdefault(top(c), []).append(c)
    runs = sorted(groups.values(), key=len, reverse=True)
    runs = runs[:8] + ([sum(runs[8:], [])] if len(runs) > 8 else [])  # joining groups only cuts less
    return re.compile("|".join([f"{SPACE}*[{''.join(map(re.escape, g))}]+" for g in runs] + [f"{SPACE}+", "(?s:.)"]))


def _utf8(held: bytearray) -> str:
    """Bytes as text; every byte of an invalid sequence becomes one replacement character."""
    try:
        return held.decode("utf-8")
    except UnicodeDecodeError as e:
        return held[:e.start].decode("utf-8") + "�" + _utf8(held[e.start + 1:])


_MODELS: dict[str, PieceModel] = {}


def _model(blob: bytes) -> PieceModel:
    """A worker's parsed model; parsed once."""
    key = hashlib.sha256(blob).hexdigest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = PieceModel(blob)
    return _MODELS[key]


def _blob(df: DataFrame, model_path: str):
    """The model file, sent to the executors (a vocabulary file of bounded size)."""
    with open(model_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, starts, ends): piece ids of every text with their original byte spans."""
    sent = _blob(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(sent.value)
        for b in batches:
            got = [m.spans(t or "") for t in b.column(1).to_pylist()]
            kinds = [pa.list_(x) for x in (pa.int32(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([g[k] for g in got], t) for k, t in enumerate(kinds)]], names=["id", "ids", "starts", "ends"])

    df = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return df.mapInArrow(run, "id long, ids array<int>, starts array<long>, ends array<long>")


def decoded(encodings: DataFrame, model_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every id sequence."""
    sent = _blob(encodings, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    df = encodings.select(encodings[id_col].cast("long").alias("id"), encodings[ids_col].alias("ids"))
    return df.mapInArrow(run, "id long, text string")


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, spans_sha256, covered_bytes): each text encoded with its spans and decoded again, in one pass.

    ``spans_sha256`` is the digest of all starts, then all ends, as 64-bit
    little-endian numbers; ``covered_bytes`` what the spans hold of the text.
    """
    sent = _blob(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(sent.value)
        for b in batches:
            n, a, d, at, size = [], [], [], [], []
            for text in b.column(1):
                ids, starts, ends = m.spans(text.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(m.decode(ids).encode("utf-8")).hexdigest())
                at.append(hashlib.sha256(starts.astype("<i8").tobytes() + ends.astype("<i8").tobytes()).hexdigest())
                size.append(int((ends - starts).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *[pa.array(x, pa.string()) for x in (a, d, at)], pa.array(size, pa.int64())],
                                             names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "covered_bytes"])

    df = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return df.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, covered_bytes long")


def tokenised(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """The documents without their text, with n_tokens, ids, the pieces' original bytes (starts, ends) and the digest of the decoded ids."""
    sent = _blob(docs, model_path)
    added = StructType.fromDDL("n_tokens long, ids array<int>, starts array<long>, ends array<long>, decoded_sha256 string")
    rest = [c for c in docs.columns if c != text_col and c.lower() not in added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(sent.value)
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, len(whole), 512)):
                got = [m.spans(t.as_py() or "") for t in b.column(len(rest))]
                back = [hashlib.sha256(m.decode(g[0]).encode("utf-8")).hexdigest() for g in got]
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(k) for k in range(len(rest))], pa.array([len(g[0]) for g in got], pa.int64()), pa.array([g[0] for g in got], pa.list_(pa.int32())),
                     *[pa.array([g[k] for g in got], pa.list_(pa.int64())) for k in (1, 2)], pa.array(back, pa.string())],
                    names=[*rest, *added.names])

    df = docs.select(*[docs[f"`{c}`"] for c in rest], docs[text_col])
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])  # names with dots can't be passed to tasks
    return plain.mapInArrow(run, StructType([*df.schema.fields[:-1], *added.fields]))
