"""Secrets in texts: three plain patterns, and spans that a conditional random field adds.

Plain spans are assignments of a value of eight characters or more to a word such as ``token``, access keys, and long
hexadecimal numbers (``PATTERNS``). From them the field (``crf``) learns how values look and what stands around them: its features are a token's
shape (kinds of characters, length, changes between them), its neighbours, what the file is like as a whole, and hashes of
words. In every second training window the words are hidden, so that shapes alone must do. It then tags every token of every text as the beginning,
the inside or the outside of a secret, by Viterbi's algorithm, and spans of its own are kept where they touch no plain one.

Tokens are runs of letters, digits and ``_+/-`` or of bytes beyond ASCII, and single other marks. A line is a sequence; a line longer than
``SLICE`` is parted at blanks (anywhere, if it has none). Tokens, shapes and hashes come from the bytes of whole Arrow columns (``bytewords``).

Scale: documents aren't shuffled. The field is fitted on windows of ``WINDOW`` tokens of a sample: the texts whose hashes are
the ``SAMPLE`` smallest, and the same number among those with an assignment, key or number; at most ``WINDOWS`` windows, those of the
smallest hashes. What is learned is a table of fixed size, sent to all tasks. The sample doesn't depend on the number of partitions.

Defined cases: a null text is empty; an empty text has no spans. Equal texts have equal spans; rows count one by one. Without plain
spans in the corpus nothing is learned, and there are plain spans only. A field span that touches a plain one goes; plain ones of different
kinds may overlap. Spans are code points from the text's start, the end exclusive. Further columns change nothing."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomatch.llm import bytewords as B
from foliomatch.llm import crf
from foliomatch.llm.common import table, text_slices

# The plain patterns, over bytes with small letters for the first, and the least lengths.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")
LEAST_VALUE, LEAST_ACCESS = 8, 16
#: Texts that may have a plain span.
LIKELY = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]|[0-9a-fA-F]{32}"""

SAMPLE = 1_000
WINDOWS = 3_000
WINDOW = 40
SLICE = 1 << 20
WORD = B.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x5F, 0x5F), (0x2B, 0x2B), (0x2D, 0x2D), (0x2F, 0x2F), (0x80, 0xFF))
SPACE = B.byte_class((0, 0x20), (0x7F, 0x7F))
#: Kinds of bytes, as bits: small letters that hexadecimal numbers have, others, capitals, digits, marks, beyond ASCII.
KIND = np.zeros(256, np.uint8)
for _bit, _ranges in enumerate((((0x61, 0x66),), ((0x67, 0x7A),), ((0x41, 0x5A),), ((0x30, 0x39),), ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)), ((0x80, 0xFF),))):
    KIND |= B.byte_class(*_ranges).astype(np.uint8) << _bit
LETTERS, DIGITS = 0b111, 0b1000
WORD_BITS, MARK_BITS = 14, 12
BEFORE = 4
_SIZES = {"shape": 512, "changes": 64, "digits": 512, "word": 1 << WORD_BITS, "near": 1 << WORD_BITS, "last": 1 << MARK_BITS, "next": 1 << MARK_BITS, "file": 64}
#: Where each group of feature ids begins; 0 is nothing, 1 is every token's.
GROUP = dict(zip(_SIZES, np.cumsum([2, *_SIZES.values()])[:-1].tolist(), strict=True))
N_FEATURES = 2 + sum(_SIZES.values())
#: Columns of feature ids that name words.
WORD_COLUMNS = slice(8, 9 + BEFORE)


def plain_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) of plain spans in bytes, ordered; kind by KINDS."""
    out = []
    if b":" in text or b"=" in text:
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text.lower()) if m.end(2) - m.start(2) >= LEAST_VALUE]
    out += [(*m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(*m.span(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def secret_values(text: bytes) -> list[tuple[int, int, bool]]:
    """(start, end, sure) of the values of plain patterns; not sure are those that are too short."""
    out = [(*m.span(2), m.end(2) - m.start(2) >= LEAST_VALUE) for m in ASSIGN.finditer(text.lower())]
    out += [(*m.span(), m.end() - m.start() >= LEAST_ACCESS) for m in ACCESS.finditer(text)]
    return out + [(*m.span(), True) for m in HEX.finditer(text)]


class Tokens:
    """Tokens of texts (bytes and bounds, see ``bytewords.buffer``) with their feature ids. file: feature ids of each text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, file: np.ndarray) -> None:
        found = B.words(~SPACE[data], bounds, ~(WORD | SPACE)[data])
        self.starts, self.ends, self.text = found
        n = len(self.starts)
        line = np.cumsum(data == 10)[self.starts] if n else np.zeros(0, np.int64)
        self.begins = np.ones(n, bool)
        self.begins[1:] = (line[1:] != line[:-1]) | (self.text[1:] != self.text[:-1])
        self.ids = np.zeros((n, 13 + BEFORE), np.int32)
        if not n:
            return
        size = self.ends - self.starts
        crc = ~B.advance(np.full(n, B.START), B.LOWER[data], self.starts, size)
        kind = KIND[data]
        kinds = np.bitwise_or.reduceat(kind, self.starts)
        coarse = np.where(kind & LETTERS, LETTERS, kind)
        change = np.zeros(len(data), bool)
        change[1:] = (coarse[1:] != coarse[:-1]) & (coarse[1:] > 0) & (coarse[:-1] > 0)
        change[self.starts] = False
        sums = lambda x: np.minimum(np.add.reduceat(x.astype(np.int32), self.starts), size)
        changes, digits = sums(change), sums(kind == DIGITS)
        long = np.minimum(np.log2(size).astype(np.int64) * 2 + (size * 2 >= 3 << np.log2(size).astype(np.int64)), 15)  # two steps a doubling
        put = lambda column, group, ids: self.ids.__setitem__((slice(None), column), GROUP[group] + ids)
        self.ids[:, 0] = 1
        put(1, "shape", (kinds.astype(np.int64) & 31) * 16 + long)
        put(2, "changes", np.minimum(changes, 3) * 16 + long)
        put(3, "digits", (digits * 7 // size) * 64 + kinds)
        for k in range(file.shape[1]):
            self.ids[:, 4 + k] = GROUP["file"] + file[self.text, k]
        put(8, "word", crc >> np.uint32(32 - WORD_BITS))
        run = np.cumsum(self.begins)
        for d in range(1, BEFORE + 1):
            same = run[d:] == run[:-d]
            self.ids[d:, 8 + d][same] = GROUP["near"] + (crc[:-d] >> np.uint32(32 - WORD_BITS))[same].astype(np.int32)
        near = run[1:] == run[:-1]
        self.ids[1:, 9 + BEFORE][near] = GROUP["last"] + (crc[:-1] & np.uint32((1 << MARK_BITS) - 1))[near].astype(np.int32)
        self.ids[:-1, 10 + BEFORE][near] = GROUP["next"] + (crc[1:] & np.uint32((1 << MARK_BITS) - 1))[near].astype(np.int32)


def file_features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Four feature numbers of each whole text: its length, its shares of digits, of ``=`` and ``:``, and of line ends."""
    size = np.diff(bounds)
    share = lambda mask: np.diff(np.append(0, np.cumsum(mask))[bounds]) / np.maximum(size, 1)
    step = lambda x, cuts: np.searchsorted(cuts, x, side="right")
    columns = [step(size, (200, 2_000, 20_000, 200_000)), step(share((data >= 48) & (data <= 57)), (0.001, 0.01, 0.05, 0.2)), step(share((data == 58) | (data == 61)), (0.0001, 0.001, 0.01, 0.05)), step(share(data == 10), (0.0001, 0.005, 0.02, 0.06))]
    return np.stack([c + 16 * k for k, c in enumerate(columns)], 1)


def pieces(data: np.ndarray, size: int = SLICE) -> list[tuple[int, int]]:
    """Places of about `size` bytes of one text: up to a line's end, else a blank, else to where a code point begins."""
    out, at = [], 0
    while len(data) - at > size:
        part = data[at : at + size]
        for stops in (np.flatnonzero(part == 10), np.flatnonzero(SPACE[part])):
            if len(stops):
                end = at + int(stops[-1]) + 1
                break
        else:
            end = at + size
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
        out.append((at, end))
        at = end
    return [*out, (at, len(data))]


def tagged_spans(data: np.ndarray, bounds: np.ndarray, file: np.ndarray, w: crf.Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end in data, and text, of the spans that the field tags."""
    tokens = Tokens(data, bounds, file)
    score = np.zeros((len(tokens.starts), crf.TAGS), np.int64)
    for column in range(tokens.ids.shape[1]):
        score += w.features[tokens.ids[:, column]]
    tags = crf.viterbi(score, tokens.begins, w)
    begin = np.flatnonzero(tags == crf.BEGIN)
    # the last token of a span is the one before the next tag that isn't INSIDE
    others = np.append(np.flatnonzero(tags != crf.INSIDE), len(tags))
    end = others[np.searchsorted(others, begin, side="right")] - 1 if len(begin) else begin
    return tokens.starts[begin], tokens.ends[end], tokens.text[begin]


def slice_spans(texts: pa.Array, w: crf.Weights | None) -> list[list[tuple[int, int, int]]]:
    """(start, end, kind) of all spans of each text (large strings, none null), in code points, ordered by start and kind."""
    data, bounds = B.buffer(texts)
    file = file_features(data, bounds)
    own: list[list[tuple[int, int, int]]] = [plain_spans(data[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    if w is not None:
        parts = [(0, len(data), bounds, file)] if len(texts) > 1 or len(data) <= SLICE else [(a, b, np.array([0, b - a]), file) for a, b in pieces(data)]
        for a, b, inner, of in parts:
            starts, ends, text = tagged_spans(data[a:b], inner, of, w)
            for s, e, i in zip((starts + a).tolist(), (ends + a).tolist(), text.tolist(), strict=True):
                s, e = s - int(bounds[i]), e - int(bounds[i])
                own[i].append((s, e, 3))
    out = []
    for i, spans in enumerate(own):
        if spans:
            points = np.append(0, np.cumsum((data[bounds[i] : bounds[i + 1]] & 0xC0) != 0x80))
            plain = sorted((s, e) for s, e, k in spans if k < 3)
            reach = np.maximum.accumulate([e for _, e in plain]) if plain else np.zeros(0, np.int64)
            begin = np.array([s for s, _ in plain], np.int64)
            # of the plain spans that begin before a span's end, one reaches beyond its start
            touched = lambda s, e: (n := int(np.searchsorted(begin, e))) > 0 and reach[n - 1] > s  # noqa: B023, E731
            spans = sorted((s, k, e) for s, e, k in spans if k < 3 or not touched(s, e))
            spans = [(int(points[s]), int(points[e]), k) for s, k, e in spans]
        out.append(spans)
    return out


def windows(text: bytes, per_text: int = 8) -> Iterator[tuple[int, list[int], list[int], list[bool]]]:
    """Training windows of a text: hash, feature ids, tags (-1 behind the last token) and starts.

    Windows lie around plain values, `per_text` at most, and at two places that the text's hash names. Those with a
    value that is too short for a plain span, or that begin within a value, are left out."""
    data, bounds = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    tokens = Tokens(data, bounds, file_features(data, bounds))
    n = len(tokens.starts)
    if not n:
        return
    tags = np.zeros(n, np.int8)
    doubtful = np.zeros(n, bool)
    centres = []
    for start, end, sure in sorted(secret_values(text)):
        first, last = int(np.searchsorted(tokens.ends, start, side="right")), int(np.searchsorted(tokens.starts, end))
        if sure and first < last:
            if tags[first] != crf.INSIDE:
                tags[first] = crf.BEGIN
            tags[first + 1 : last] = crf.INSIDE
            centres.append(first)
        else:
            doubtful[first:last] = True
    digest = hashlib.sha256(text).digest()
    turn = lambda i: int.from_bytes(hashlib.blake2b(digest, digest_size=7, person=str(i).encode()).digest(), "big")
    chosen = sorted(set(centres), key=turn)[:per_text]
    for centre in dict.fromkeys([*chosen, turn("a") % n, turn("b") % n]):
        at = max(0, min(centre - turn(centre) % (WINDOW // 2) - WINDOW // 4, n - WINDOW))
        part = slice(at, at + WINDOW)
        if doubtful[part].any() or tags[at] == crf.INSIDE:
            continue
        ids = np.zeros((WINDOW, tokens.ids.shape[1]), np.int32)
        own = np.full(WINDOW, -1, np.int8)
        begins = np.ones(WINDOW, bool)
        k = len(tags[part])
        ids[:k], own[:k], begins[:k] = tokens.ids[part], tags[part], tokens.begins[part]
        key = turn(f"w{at}")
        if key % 2:
            ids[:, WORD_COLUMNS] = 0
        yield key, ids.ravel().tolist(), own.tolist(), begins.tolist()


def train(docs: DataFrame, sample: int = SAMPLE, most: int = WINDOWS) -> crf.Weights | None:
    """Weights in whole units, or None if the sample has no plain value."""
    texts = docs.select(docs["text"].cast("string").alias("text")).filter("text <> ''").withColumn("h", F.xxhash64("text"))
    kinds = {"any": F.lit(True), "likely": F.col("text").rlike(LIKELY)}
    bounds = {}
    for name, kind in kinds.items():
        smallest = texts.filter(kind).select("h").distinct().orderBy("h").limit(sample)
        bounds[name] = smallest.agg(F.max("h")).first()[0]
    if bounds["likely"] is None:
        return None
    chosen = texts.filter((F.col("h") <= bounds["any"]) | ((F.col("h") <= bounds["likely"]) & kinds["likely"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                if h in seen:  # copies
                    continue
                seen.add(h)
                if rows := list(windows(text.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())), strict=True)], names=["key", "ids", "tags", "starts"])

    made = chosen.select("h", "text").mapInArrow(run, "key long, ids array<int>, tags array<int>, starts array<boolean>")
    rows = made.dropDuplicates(["key"]).orderBy("key").limit(most).toPandas()
    if not len(rows):
        return None
    tags = np.stack(rows["tags"]).astype(np.int64)
    if not (tags == crf.BEGIN).any():
        return None
    ids, starts = np.stack(rows["ids"]).reshape(len(rows), WINDOW, -1), np.stack(rows["starts"]).astype(bool)
    used, ids = np.unique(np.append(0, ids.ravel()), return_inverse=True)
    w = crf.fit(ids[1:].reshape(len(rows), WINDOW, -1), tags, starts, len(used))
    features = np.zeros((N_FEATURES, crf.TAGS))
    features[used] = w.features
    return crf.Weights(features, w.steps, w.first).whole()


def scan(docs: DataFrame, w: crf.Weights | None) -> DataFrame:
    """doc_id, spans (start, end, kind) of every document, ordered by start, then kind as in KINDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches, SLICE):
            spans = [[{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in x] for x in slice_spans(texts, w)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])))], names=["doc_id", "spans"])

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, spans array<struct<start:long,end:long,kind:string>>")


def op11_secrets(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(docs))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    plain = F.filter("spans", lambda s: s["kind"] != "crf")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(said(plain), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
