"""Each operator against brute force, an exact round trip or held-out accuracy, and its edge cases."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliomatch.llm import ann, chat, lm, matroska, mixing, packing, pii, quality, simhash, warc, wordids
from foliomatch.llm.queries import ORACLES, QUERIES
from tests.test_queries import compare

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, rank int, p0 int, label int, score int, rep int, count int, _n int"
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(300)]
LONG = " ".join(rng.choice(WORDS) for _ in range(30_000))
NEAR = " ".join(w if i % 97 else "changed" for i, w in enumerate(LONG.split()[:2000]))
TEXTS = [(None, None, None), (None, "no id here", "a"), (1, "", "a"), (2, " \t\n", "b"), (3, "word", None), (4, LONG, "a"), (5, LONG, "b"), (5, LONG, "b"), (6, "Ties ties TIES", "a"), (7, " ".join(LONG.split()[:2000]), "c"), (8, NEAR, "c"), (9, None, "a"), (10, "é ß 漢字 😀 <|im_end|> &amp;", "é")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "k", 2, 3, 4, 5, 6, 7, 8) for i, t, s in TEXTS], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", ORACLES)
def test_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name])


# 1


def test_warc(spark):
    block = "HTTP/1.0 200 OK\r\nContent-Type: text/html\r\nX-Own: a: b\r\n\r\n<html><title>T &amp; t</title><body>one<br>two &#233;<script>x='</p>'</script><a href=\"/l?a&amp;b\">l</a>\r\n\r\nend"
    rows = [("r1", "u1", "d", block), ("r2", "u2", "d", "HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\na <b>  c"), ("r3", None, None, None), ("r3", None, None, None), (None, "u", "d", "only headers")]
    made = warc.derive(spark.createDataFrame(rows, "record_id string, target_uri string, date string, block string")).collect()
    assert len(made) == 10
    by = {(m.refers_to, m.record_type): m for m in made}
    text = by["r1", "conversion"]
    assert text.block == "T & t\none\ntwo é l\nend"
    payload = block.split("\r\n\r\n", 1)[1]
    assert text.source_payload_digest == "sha256:" + hashlib.sha256(payload.encode()).hexdigest()
    meta = by["r1", "metadata"].block
    assert "http-header: X-Own: a: b\r\n" in meta and "outlink: /l?a&amp;b\r\n" in meta and "title: T & t\r\n" in meta
    assert by["r2", "conversion"].block == "a <b> c" and by["r3", "conversion"].block == ""
    for m in made:
        head, body = m.record.split("\r\n\r\n", 1)
        assert body == m.block + "\r\n\r\n" and f"Content-Length: {len(m.block.encode())}" in head and f"WARC-Refers-To: {m.refers_to}\r\n" in head
    assert warc.derive(spark.createDataFrame([], "record_id string, target_uri string, date string, block string")).count() == 0


LINKS = """<a href="/1">x</a><a href='/2'>y</a><A HREF=/3>z</A><a class=b
 HREF = "/4" href="/no">w</a><a title=" href='/no'" href='/5?a=">"'>v</a><a href="">e</a><a name=href>n</a><a>none</a><area href="/no"><a/href=/6><a href><a data-href="/no" href	=	/7&amp;x target=_blank>
<a href="/no <b>t</b><abbr href="/no">"""


def test_outlinks(spark):
    got = spark.createDataFrame([(LINKS,), ("",)], "html string").select(warc.outlinks(F.col("html"))).collect()
    assert [r[0] for r in got] == [["/1", "/2", "/3", "/4", '/5?a=">"', "", "/6", "", "/7&amp;x"], []]


@pytest.mark.parametrize("piece", ["<p ", "<a ", "&", '<a href="x', "<a href='", "<a b=", '<a b="" ', "</script ", "<title ", "\n ", "&apos;"])
def test_warc_of_hostile_pages(spark, piece):
    n = 3_000_000 // len(piece)
    head = "HTTP/1.1 200 OK\r\n\r\n"
    df = spark.range(1).select(F.lit("r").alias("record_id"), F.lit("u").alias("target_uri"), F.lit("d").alias("date"), F.concat(F.lit(head), F.repeat(F.lit(piece), n)).alias("block"))
    began = time.monotonic()
    assert warc.derive(df).select(F.length("block")).count() == 2
    assert time.monotonic() - began < 60


def test_warc_headers_and_references(spark):
    long = "HTTP/1.1 200 OK" + "".join(f"\r\nX-{i}: v" for i in range(3000)) + "\r\nX-Fold: a\n b\r\n\r\n<p>&apos;&hellip;&ngE;&nosuch;&#x41;&nbsp;x &lt;b&gt;"
    rows = [("r\r\nX: 1", "u\r\nX: 2", "d\nX: 3", long)]
    made = {m.record_type: m for m in warc.derive(spark.createDataFrame(rows, "record_id string, target_uri string, date string, block string")).collect()}
    assert made["conversion"].block == "'\u2026\u2267\u0338&nosuch;A x <b>"
    head = made["metadata"].record.split("\r\n\r\n")[0].split("\r\n")
    assert not any(line.startswith("X: ") for line in head) and made["metadata"].block.count("http-header: ") == 3001
    assert "http-header: X-Fold: a  b\r\n" in made["metadata"].block


# 2


def test_mix(spark, docs, empty):
    out = mixing.mix_sizes(docs).collect()
    assert len(out) == len(TEXTS)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in out) == sorted(size(t) for _, t, _ in TEXTS)
    assert all(r.taken <= 3 * r["size"] for r in out)
    targets = {r.source: r.target for r in out}
    assert sum(targets.values()) == pytest.approx(sum(r["size"] for r in out))
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_sizes(docs.repartition(7)).collect()))
    assert mixing.mix_sizes(empty).count() == 0 and mixing.apply_mix(empty).count() == 0
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out)


def test_mix_keeps_clashing_columns(spark):
    rows = [(i, "one two", "a", i, i, i) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_source int, MIX_LAST int, mix_copy int")
    assert sorted(map(tuple, mixing.apply_mix(docs).collect())) == sorted(rows)


def test_mix_leaves_wordless_sources_out(spark):
    rows = [(i, "one two three", "a") for i in range(8)] + [(i, " ", "b") for i in range(8, 16)] + [(i, None, "a") for i in range(16, 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in mixing.mix_sizes(docs).collect()}
    assert len(out) == 24 and sum(r.taken for r in out.values()) == 24
    assert all(out[i].copies == 1 for i in range(8)) and all((out[i].copies, out[i].target) == (0, 0.0) for i in range(8, 16))
    last = max(mixing.sizes(docs).filter("size > 0").collect(), key=lambda r: r.key).key
    assert all(out[r.doc_id].copies == (r.key <= last) for r in mixing.sizes(docs).filter("source = 'a'").collect())


def test_mix_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 16)
    compare(spark, mixing.op2_mix_sources, mixing.OP2_SQL)


# 3


def test_pack(spark, docs, empty):
    out = packing.pack(docs, packing.word_tokenizer()).collect()
    tokenizer = Tokenizer.from_file(packing.word_tokenizer())
    own = {}
    for i, t, _ in TEXTS:
        own[i] = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    pieces, windows = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id is not None:
            part = np.array(own[r.doc_id][r.start : r.start + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(own[r.doc_id])
    for i, n in {1: 1, 2: 1, 4: 1, 5: 2, 9: 1}.items():
        covered = sorted(itertools.chain.from_iterable(range(a, a + k) for a, k in pieces[i]))
        assert covered == sorted(list(range(len(own[i]))) * n)
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(empty, packing.word_tokenizer()).count() == 0


def test_differencing():
    sizes = [rng.randint(1, 512) for _ in range(2000)]
    found = packing.windows_for(sizes, 4096)
    assert sorted(itertools.chain.from_iterable(found)) == list(range(2000))
    sums = [sum(sizes[i] for i in w) for w in found]
    assert max(sums) <= 4096 and max(sums) - min(sums) <= 64 and len(found) <= 1.01 * sum(sizes) / 4096 + 1
    assert packing.windows_for([]) == [] and packing.windows_for([4096, 4096, 1]) and [len(w) for w in packing.difference([5, 5, 5], 3)] == [1, 1, 1]


def test_encoder_equals_tokenizer(monkeypatch):
    import pyarrow as pa

    path = packing.word_tokenizer()
    texts = ["", " ", "It's. don't! \"x\" (y), a... b--c", "A\x01b", "<|endoftext|> x.", "ÉCOLE. Straße!! 12. 3,4\n", "İ Σς b", LONG[:5000], "x. y. z"]
    for group in ([t] for t in texts), [texts], [texts[:4], texts[5:]]:
        for part in group:
            e = wordids.Encoder(path)
            ids, starts = e.encode(pa.array(part, pa.large_string()))
            assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in part]
    monkeypatch.setattr(wordids, "KEPT", 50)
    e = wordids.Encoder(path)
    for at in range(0, 3000, 300):
        t = " ".join(LONG.split()[at : at + 300])
        assert e.encode(pa.array([t], pa.large_string()))[0].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


# 4


def some_vocabulary(rs, classes=lm.CLASSES):
    own = np.unique(rs.integers(0, 1 << 32, 500).astype(np.uint32))
    n = classes * classes
    return lm.Vocabulary(classes, own, rs.permutation(n)[: len(own)], rs.integers(0, n, n // 8), np.sort(rs.integers(1, 900, n))[::-1], rs.integers(0, 90, 1 << 12).astype(np.uint8))


def test_pseudo_likelihood():
    import pyarrow as pa

    rs = np.random.default_rng(2)
    net, vocab = lm.Network(rs.normal(0, 0.3, lm.Network.length()).astype(np.float32)), some_vocabulary(rs)
    texts = ["", "one", "a b c d e A", " ".join(WORDS[:50]), " \n"]
    words, text_of = lm.word_hashes(pa.array(texts, pa.large_string()))
    assert words.tolist() == [xxhash.xxh32_intdigest(w) for t in texts for w in t.lower().split()]
    n, total = lm.log_likelihoods(net, vocab, words, text_of, len(texts))
    n_ids = lm.CLASSES**2
    for text, count, got in zip(texts, n, total, strict=True):
        hashes = np.array([xxhash.xxh32_intdigest(w) for w in text.lower().split()], np.uint32)
        ids, part = vocab.ids(hashes)
        want = float(part.sum())
        for i, word in enumerate(ids.tolist()):
            hidden = np.zeros(lm.SIZE)
            for k, w in enumerate(lm.WINDOW):
                hidden += net.embed[k][ids[i + w] if 0 <= i + w < len(ids) else n_ids]
            hidden = np.tanh(hidden + net.bias)
            c, j = divmod(word, lm.CLASSES)
            for logits, at in ((hidden @ net.to_class + net.class_bias, c), (hidden @ net.to_word[c] + net.word_bias[c], j)):
                want += logits[at] - np.log(np.exp(logits).sum())
        assert count == len(ids) and got == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_gradient_is_the_numerical_one():
    rs = np.random.default_rng(3)
    classes = 4
    flat = rs.normal(0, 0.5, lm.Network.length(classes))
    ids = np.sort(rs.integers(0, classes**2, 60))
    context = rs.integers(0, classes**2 + 1, (4, 60))
    got = lm.Network(flat.copy(), classes).gradient(context, ids)
    for at in rs.choice(len(flat), 150, replace=False):
        moved = [-lm.Network(np.where(np.arange(len(flat)) == at, flat + d, flat), classes).forward(context, ids)[0].mean() for d in (1e-5, -1e-5)]
        assert got[at] == pytest.approx((moved[0] - moved[1]) / 2e-5, rel=1e-4, abs=1e-7)


def test_vocabulary_against_brute_force(spark):
    words = [w for i, w in enumerate(WORDS) for _ in range(1 + 4000 // (i + 1))] + [f"rare{i}" for i in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(words[i::7])) for i in range(7)], "doc_id long, text string")
    counts = {}
    for w in words:
        counts[xxhash.xxh32_intdigest(w)] = counts.get(xxhash.xxh32_intdigest(w), 0) + 1
    table = lm.written(lm.count_words(lm.encode(docs)), "lm-test")
    assert {r.word: r.n for r in table.collect()} == counts
    vocab, total = lm.vocabulary(table)
    assert total == len(words) and vocab.of_id.sum() == total and (np.diff(vocab.of_id) <= 0).all()
    hashes = np.array(sorted(counts), np.uint32)
    ids, part = vocab.ids(hashes)
    own = set(vocab.own.tolist())
    assert len(own) == lm.CLASSES**2 * 7 // 8 and min(counts[w] for w in own) >= max(n for w, n in counts.items() if w not in own)
    for w, i, p in zip(hashes.tolist(), ids.tolist(), part.tolist(), strict=True):
        same = [v for v in counts if v not in own and v % len(vocab.counts) == w % len(vocab.counts)]
        want = 0.0 if w in own else np.log(sum(counts[v] for v in same) / vocab.of_id[i])
        assert p == pytest.approx(want, abs=0.05) and (w not in own or vocab.of_id[i] == counts[w])
    # probabilities of all words of an id sum to one, but where words share a slot of counts
    sums = np.bincount(ids, np.exp(part), lm.CLASSES**2)
    rest = [w for w in counts if w not in own]
    slots = [w % len(vocab.counts) for w in rest]
    sharing = set(vocab.ids(np.array([w for w, s in zip(rest, slots, strict=True) if slots.count(s) > 1], np.uint32))[0].tolist())
    alone = [i for i in np.unique(ids).tolist() if i not in sharing]
    assert len(alone) > 900 and np.abs(sums[alone] - 1).max() < 0.05 and len(sharing) < 60
    assert lm.class_count(10**6) == 32 and lm.class_count(10**9) == 128 and lm.class_count(10**15) == 256


def test_lm_query(spark, docs, empty):
    rows = lm.encode(docs)
    net, vocab = lm.train(rows, copy_words=20_000)
    out = lm.score(rows, net, vocab).collect()
    assert len(out) == len(TEXTS)
    by = {r.doc_id: r for r in out}
    assert by[1].n_tokens == 0 and by[1].log_likelihood == 0 and by[2].mean_log_likelihood is None and by[4].n_tokens == 30_000
    # the same whatever the partitions and the order of rows
    other = lm.encode(docs.orderBy(F.rand(3)).repartition(5))
    again, _ = lm.train(other, copy_words=20_000)
    assert (net.flat == again.flat).all()
    none = lm.encode(empty)
    assert lm.score(none, *lm.train(none)).count() == 0


def test_lm_deals_repeated_rows_out(spark):
    """A third of all rows without an id and with one text: every copy gets its share, none is lost, and the network is the
    same for any partitions."""
    hot = "one hot text of six words"
    docs = spark.createDataFrame([(None, hot)] * 500 + [(i, f"words of document {i} and {i % 7}") for i in range(1000)], "doc_id long, text string")
    coded = lm.encode(docs)
    dealt = [(r.copy, bytes(r.words)) for r in lm.deal(coded, 40).collect()]
    assert Counter(w for _, w in dealt) == Counter(bytes(r.words) for r in coded.collect()) and len(dealt) == 1500
    words = Counter(w for _, w in dealt).most_common(1)[0][0]
    assert sorted(Counter(c for c, w in dealt if w == words).values()) == [12] * 20 + [13] * 20
    again = lm.encode(docs.orderBy(F.rand(5)).repartition(7))
    assert (lm.train(coded, copy_words=300)[0].flat == lm.train(again, copy_words=300)[0].flat).all()


def test_lm_learns(spark):
    rows = lm.encode(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    n = np.array([r.n for r in lm.count_words(rows).collect()])
    unigram = (n / n.sum() * np.log(n / n.sum())).sum()
    found = lm.score(rows, *lm.train(rows)).collect()
    assert sum(r.log_likelihood for r in found) / sum(r.n_tokens for r in found) > unigram + 0.3


# 5


@pytest.mark.parametrize("n", [64, 1024, 8192, 8256, 255 * 1024, 600_000 // 64 * 64])
def test_matroska_round_trip(n):
    payload = random.Random(n).randbytes(n)
    data = matroska.mux(payload)
    back, media = matroska.demux(data)
    assert back == payload and media.complete and media.tracks[1]["codec"] == "A_PCM/INT/LIT" and media.tracks[1]["bits"] == 8
    clusters = {p.cluster for p in media.packets}
    assert len(media.cues) == len(clusters) and all(data[at : at + 4] == b"\x1f\x43\xb6\x75" for _, _, at in media.cues)
    cut = matroska.parse(data[: media.packets[-1].offset + 5])
    assert not cut.complete and not matroska.parse(data[:-3]).complete
    assert cut.packets == [p for p in media.packets if p.offset + p.length <= cut.packets[-1].offset + cut.packets[-1].length] if cut.packets else n < 16_384


@pytest.mark.parametrize("kind", [0, 1, 2, 3])
def test_lacings(kind):
    frames = [b"x"] if kind == 0 else [b"a" * 300] * 4 if kind == 2 else [b"a" * 255, b"b" * 3, b"", b"c" * 700, b"d" * 5]
    block = matroska.block_bytes(frames, 7, kind)
    group = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, block))
    body = matroska.uint(matroska.TIMESTAMP, 100) + matroska.element(0xEC, b"void") + matroska.element(matroska.SIMPLE_BLOCK, block) + group
    cluster = matroska.element(matroska.CLUSTER, body)
    unknown = matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + body
    data = matroska._EBML_HEAD + matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + unknown + cluster
    packets = matroska.parse(data).packets
    assert [data[p.offset : p.offset + p.length] for p in packets] == frames * 4
    assert {p.timestamp for p in packets} == {107} and {p.lacing for p in packets} == {matroska.LACINGS[kind]}


def test_matroska_keyframes():
    block = matroska.element(matroska.BLOCK, matroska.block_bytes([b"x"], 0)[:3] + b"\x00x")
    plain = matroska.element(matroska.BLOCK_GROUP, block)
    differs = matroska.element(matroska.BLOCK_GROUP, block + matroska.element(matroska.REFERENCE_BLOCK, b"\xff"))
    simple = [matroska.element(matroska.SIMPLE_BLOCK, b"\x81\x00\x00" + flags + b"x") for flags in (b"\x80", b"\x00")]
    cluster = matroska.element(matroska.CLUSTER, matroska.uint(matroska.TIMESTAMP, 0) + plain + differs + b"".join(simple))
    packets = matroska.parse(matroska._EBML_HEAD + matroska.element(matroska.SEGMENT, cluster)).packets
    assert [p.keyframe for p in packets] == [True, False, True, False]


def test_media_columns(spark):
    data = matroska.mux(b"ab" * 32)
    out = matroska.packet_table(spark.createDataFrame([(1, data), (1, data), (2, None), (3, b"junk"), (4, b"")], "id long, file binary"), "id", "file").collect()
    assert [(r.id, r.length) for r in out] == [(1, 64), (1, 64)]
    assert matroska.stored(b"")[:2] == (0, 64) and matroska.stored(b"x" * 64)[:2] == (64, 64) and matroska.stored(b"x" * 65)[1] == 128
    payload = b"x" * 65 + bytes(63)
    assert matroska.stored(b"x" * 65)[2:4] == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_packet_table_of_many_clusters(spark):
    payload = random.Random(9).randbytes(600_000)
    data = matroska.mux(payload)
    out = sorted(matroska.packet_table(spark.createDataFrame([(7, data)], "id long, file binary"), "id", "file").collect(), key=lambda r: r.packet)
    assert b"".join(data[r.offset : r.offset + r.length] for r in out) == payload
    assert [r.timestamp for r in out] == [i * 128 for i in range(len(out))] and len({r.cluster for r in out}) > 2


def test_frame_times_and_header_stripping():
    settings = matroska.uint(matroska.COMPRESSION_ALGORITHM, 3) + matroska.element(matroska.COMPRESSION_SETTINGS, b"HEAD")
    encodings = matroska.element(matroska.ENCODINGS, matroska.element(matroska.ENCODING, matroska.element(matroska.COMPRESSION, settings)))
    track = lambda n, more: matroska.element(matroska.TRACK_ENTRY, matroska.uint(matroska.TRACK_NUMBER, n) + more)
    tracks = matroska.element(matroska.TRACKS, track(1, matroska.uint(matroska.DEFAULT_DURATION, 20_000_000)) + track(2, encodings))
    simple = matroska.element(matroska.SIMPLE_BLOCK, matroska.block_bytes([b"a", b"bb", b"c"], 5))
    group = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, matroska.block_bytes([b"x", b"y"], 9, None, 2)) + matroska.uint(matroska.BLOCK_DURATION, 30))
    cluster = matroska.element(matroska.CLUSTER, matroska.uint(matroska.TIMESTAMP, 100) + simple + group)
    data = matroska._EBML_HEAD + matroska.element(matroska.SEGMENT, tracks + cluster)
    media = matroska.parse(data)
    assert [(p.track, p.timestamp) for p in media.packets] == [(1, 105), (1, 125), (1, 145), (2, 109), (2, 124)]
    assert matroska.demux(data, 2)[0] == b"HEADxHEADy" and matroska.demux(data, 1)[0] == b"abbc"


def test_media_feature_and_hash_against_brute_force():
    text = ("Some Text, again and again. " * 500).encode()
    row = matroska.stored(text)
    payload = text + bytes(-len(text) % 64)
    found = dict(x.split("=") for x in row[6].split(";"))
    p = np.array([payload.count(bytes([b])) for b in set(payload)]) / len(payload)
    assert float(found["mean"]) == pytest.approx(sum(payload) / len(payload), abs=1e-3) and int(found["entropy"]) == round(-1000 * sum(x * np.log2(x) for x in p))
    assert float(found["power"]) == pytest.approx(sum((b - 128) ** 2 for b in payload) / len(payload), abs=1e-3)
    assert int(found["packets"]) == -(-len(payload) // 1024) and int(found["ms"]) == len(payload) // 8
    assert row[4:6] == (len(matroska.mux(payload)), hashlib.sha256(matroska.mux(payload)).hexdigest())


@pytest.mark.parametrize("name", ["op4_pseudo_likelihood", "op5_matroska", "op6_quality", "op8_simhash", "op9_format_chat", "op10_pseudonyms"])
def test_queries_over_odd_tables(spark, docs, empty, name, tmp_path):
    """Null and empty texts, ties, repeated rows, clashing names and empty tables through the registered queries."""
    for kind, rows in (("odd", docs), ("none", empty)):
        rows.write.parquet(str(tmp_path / kind / "documents.parquet"))
        rows.selectExpr("doc_id", "1 as quality", "0 as toxic", "1 as score").write.parquet(str(tmp_path / kind / "labels.parquet"))
        chat_rows = rows.selectExpr("doc_id as conv_id", "p0 as turn", "source as role", "text", "lang as body", "rank as seq")
        chat_rows.write.parquet(str(tmp_path / kind / "conversations.parquet"))
        got = QUERIES[name](spark, str(tmp_path / kind)).count()
        if name == "op9_format_chat":
            assert got == (len({i for i, _, _ in TEXTS}) + 1 if kind == "odd" else 1)
        else:
            assert got == (len(TEXTS) if kind == "odd" else 0)


# 6


def test_quality_fit_against_plain_ascent():
    """Newton's weights against plain gradient ascent on the same Bradley-Terry likelihood, written anew."""
    rs = np.random.default_rng(8)
    x = rs.normal(size=(120, 5))
    y = (x @ [1.0, -2, 0.5, 0, 0] + rs.normal(size=120) > 0).astype(int)
    model = quality.fit(x, y)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-9), -6, 6)
    again = np.random.default_rng(1)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    k = quality.PAIRS_PER_DOCUMENT
    left = [(g, b) for g, b in zip(np.repeat(good, k), again.choice(bad, len(good) * k))]
    right = list(zip(again.choice(good, len(bad) * k), np.repeat(bad, k)))
    d = np.array([z[g] - z[b] for g, b in left + right])
    w = np.zeros(5)
    for _ in range(20_000):
        w += 0.5 * ((d * (1 / (1 + np.exp(d @ w)))[:, None]).mean(0) - 1e-3 * w)
    assert model.weights == pytest.approx(w, abs=1e-4)
    raw = z @ model.weights
    share = lambda t: (raw[bad] < t).mean() + (raw[good] >= t).mean()
    assert share(model.threshold) == max(share(t) for t in raw)


def test_quality_features_against_brute_force():
    text = "One two TWO, three! $x$ | y.\n\nOne two TWO, three! $x$ | y.\nÉté #42 " + "z" * 30
    f = dict(zip(quality.FEATURES, quality.features(text.encode()), strict=True))
    raw, words, lines = text.encode(), text.encode().split(), [x.strip() for x in text.encode().split(b"\n") if x.strip()]
    letters = [b for b in raw if chr(b).isascii() and chr(b).isalpha()]
    assert f["letters"] == pytest.approx(len(letters) / len(raw)) and f["upper"] == pytest.approx(sum(65 <= b <= 90 for b in letters) / len(letters))
    assert f["word_length"] == pytest.approx(np.mean([len(w) for w in words])) and f["length_spread"] == pytest.approx(np.std([len(w) for w in words]))
    assert f["distinct_words"] == pytest.approx(len(set(words)) / len(words) ** 0.8) and f["repeated_lines"] == pytest.approx(1 - len(set(lines)) / len(lines))
    assert f["top_word"] == pytest.approx(max(words.count(w) for w in words) / len(words)) and f["long_words"] == pytest.approx(1 / len(words))
    assert f["non_ascii"] == pytest.approx(sum(b > 127 for b in raw) / len(raw)) and f["bangs"] == pytest.approx(raw.count(b"!") / len(raw))


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [r for r in quality.op6_quality(spark, sf).collect() if r.doc_id in labels and r.held_out]
    right = lambda q: np.mean([r.predicted == q for r in out if labels[r.doc_id] == q])
    assert right(1) > 0.98 and right(0) > 0.95
    assert all(r.held_out == quality.is_held_out(r.doc_id) for r in out)


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (3, None, 0), (None, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert quality.score(docs, model).count() == len(TEXTS)
    assert all(0 <= r.score <= 1 for r in quality.score(docs, model).collect())
    none = quality.train(docs, labels.filter("quality = 1"))
    assert not none.trained and quality.keep(docs, none).count() == len(TEXTS)
    assert quality.keep(docs, model).columns == docs.columns
    assert quality.score(empty, quality.train(empty, labels)).count() == 0


# 7


def test_ann(spark):
    rs = np.random.default_rng(4)
    x = rs.normal(size=(1500, 8)).astype(np.float32)
    x[200:700] = x[0]  # a vector that fills a third
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5100, [0.0] * 8), (5200, []), (5300, [1.0, float("nan")] + [1.0] * 6), (5400, [None] + [1.0] * 7), (None, [1.0] * 8), (5500, [1.0, 2.0]), (5600, [float("inf")] * 8)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    out = ann.nearest(table, table.filter("vec_id % 100 = 0"), shard=400).collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        best = sorted((d[i], i) for i in range(len(x)) if i != q)[:10]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert all(s == pytest.approx(d[i], abs=1e-12) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in best})
        if q in range(200, 700, 100) or q == 0:
            assert [i for _, i, _ in sorted(found)] == [i for _, i in best]
    assert hits >= 0.9 * 10 * len(got)
    few = table.filter("vec_id < 4")
    assert ann.nearest(few, few.filter("vec_id = 0")).count() == 3
    assert ann.nearest(few.limit(0), few.limit(0)).count() == 0


def test_ann_of_repeated_rows(spark):
    """Twelve rows of the query's own id, k + 1 rows of another, an equal vector under one id."""
    rs = np.random.default_rng(6)
    x = {i: rs.normal(size=4).tolist() for i in range(100, 130)}
    x[101] = x[100]
    rows = [(100, x[100])] * 12 + [(105, x[105])] * 11 + [(i, v) for i, v in x.items() if i not in (100, 105)]
    table = spark.createDataFrame([(i, v, "s", 1) for i, v in rows], "vec_id long, embedding array<double>, shard string, rank int")
    out = ann.nearest(table, table.filter("vec_id % 100 = 0")).orderBy("rank").collect()
    want = sorted((float(np.linalg.norm(np.array(v) - x[100])), i) for i, v in rows if i != 100)[:10]
    assert [(r.vec_id, round(r.score, 9)) for r in out] == [(i, round(s, 9)) for s, i in want] and out[0].vec_id == 101


def test_ann_visits_few_points():
    """Recall and the share of points visited, on clustered points like the test table's."""
    rs = np.random.default_rng(7)
    n = ann.BEAM_NODES
    centres = rs.normal(size=(10, 64))
    x = centres[rs.integers(0, 10, n)] + rs.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    edges, asked = ann.build(ann._single(x)), x[::100]
    seen = []
    ids = ann.search(x, edges, asked, visited=seen)
    best = [set(np.argsort(((x - v) ** 2).sum(1))[:11].tolist()) for v in asked]
    recall = np.mean([len(b & set(i.tolist())) / 11 for b, i in zip(best, ids, strict=True)])
    print(f"recall {recall:.3f}, visited {np.mean(seen):.3f}")
    assert recall >= 0.95 and np.mean(seen) < 0.2


# 8


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(ids, prints, radius, meets=lambda a, b: True):
    group = {i: i for i in ids if i is not None}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for (i, a), (j, b) in itertools.combinations(list(zip(ids, prints, strict=True)), 2):
        if None not in (i, j) and sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True)) <= radius and meets(a, b):
            x, y = top(i), top(j)
            group[max(x, y)] = min(x, y)
    return {i: top(i) for i in group}


def test_simhash(spark, docs, empty):
    out = simhash.groups(docs).collect()
    assert len(out) == len(TEXTS)
    prints = {i: brute_fingerprint(t) for i, t, _ in TEXTS if i}
    assert all(r.p0 % 2**64 == prints[r.doc_id] for r in out if r.doc_id)
    want = brute_groups(list(prints), [[p] for p in prints.values()], 4)
    assert {r.doc_id: r.component_id for r in out if r.doc_id} == want
    assert want[2] == want[9] == 1
    assert simhash.groups(empty).count() == 0 and simhash.without_copies(empty).count() == 0


@pytest.mark.parametrize("bucket", [8, 64, 10_000])
def test_simhash_large_buckets(spark, bucket):
    base = rng.getrandbits(64)
    prints = [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 8))) for _ in range(300)] + [rng.getrandbits(64) for _ in range(50)]
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    reps = spark.createDataFrame(list(enumerate(signed)), "rep long, p0 long")
    labels = {r.v: r.label for r in simhash.components(simhash.linked(reps, 1, 4, simhash.exact_blocks(4), bucket)).collect()}
    want = brute_groups(range(350), [[p] for p in prints], 4)
    assert {i: labels.get(i, i) for i in range(350)} == want


def test_blocks_miss_no_link():
    for m in (5, 6, 7, 8):
        masks = simhash.exact_blocks(4, 64, m)
        for _ in range(300):
            a, n = rng.getrandbits(64), rng.randint(0, 4)
            b = a ^ sum(1 << i for i in rng.sample(range(64), n))
            assert any(a & k == b & k for k in masks)


def test_comparisons_per_document_stay_flat():
    """By calculation to 100 thousand million documents, and counted on random fingerprints at three sizes."""
    per = []
    for n in (256_000, 25_000_000, 10**9, 10**11):
        m = simhash.block_count(n)
        per.append(sum(n / 2 ** mask.bit_count() for mask in simhash.exact_blocks(4, 64, m)))
    assert max(per) < 70 * simhash.KEY_ROWS
    counted = []
    for n in (1 << 14, 1 << 17, 1 << 20):
        prints = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        pairs = sum(float((c.astype(float) ** 2).sum()) for mask in simhash.exact_blocks(4, 64, simhash.block_count(n)) for c in [np.unique(prints & np.uint64(mask), return_counts=True)[1]])
        counted.append(pairs / n)
    assert max(counted) < 16 * simhash.KEY_ROWS


def test_near_copies(spark, docs):
    kept = simhash.without_copies(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    # 2 and 9 are as empty as 1, 5 is 4; 8 has 90 % of 7's shingles; rows without an id stay
    assert ids == sorted([None, None, 1, 3, 4, 6, 7, 10], key=str)


# 9


def test_chat_parts(spark):
    part = lambda t, text=None, ref=None, n=0: (t, text, ref, n)
    rows = [
        (1, 2, "assistant", [part("text", "see <|im_end|> & &lt;|"), part("image", None, "b.png", 7)]),
        (1, 1, "user", [part("image", None, "a.png", 5), part("text", "what?"), part("audio", None, "c.wav", 11), part("document", None, "d.pdf", 13)]),
        (None, None, None, None), (2, 1, "odd\nrole|>", []),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PART}")
    out = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    one = out[1]
    assert one.formatted.startswith("<|im_start|>user\n<|image:0|>what?<|audio:1|><|document:2|><|im_end|>\n<|im_start|>assistant\n")
    assert [(a.number, a.kind, a.ref, a.tokens) for a in one.attachments] == [(0, "image", "a.png", 5), (1, "audio", "c.wav", 11), (2, "document", "d.pdf", 13), (3, "image", "b.png", 7)]
    assert one.expanded_tokens == 36 and out[None].expanded_tokens == 0
    (span,) = one.loss_spans
    assert one.formatted[span.start : span.start + span.length] == "see &lt;|im_end|> &amp; &amp;lt;|<|image:3|>"
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert back[1].loss_text == "see <|im_end|> & &lt;|<|image:3|>" and back[2].back[0].role == "odd\nrole|>" and back[None].back[0].text == ""
    assert chat.format_conversations(df.limit(0)).count() == 0


# 10


def brute_string(s, kind, key=pii.TEST_KEY):
    left, right = s[: len(s) // 2], s[len(s) // 2 :]
    for i in range(1, pii.ROUNDS + 1):
        digest = hashlib.sha512(f"{key}|{kind}|{i}|{right}".encode()).hexdigest()
        moved = ""
        for j, c in enumerate(left):
            for low, n in (("a", 26), ("A", 26), ("0", 10), (pii.EIGHT[0], 8)):
                if 0 <= ord(c) - ord(low) < n:
                    c = chr((ord(c) - ord(low) + int(digest[4 * j : 4 * j + 4], 16)) % n + ord(low))
                    break
            moved += c
        left, right = right, moved
    return left + right


def brute_pair(a, b, size_a, size_b, kind, key=pii.TEST_KEY):
    f = lambda i, x: int(hashlib.sha256(f"{key}|{kind}|{i}|{x}".encode()).hexdigest()[:15], 16)
    for i in range(1, pii.ROUNDS + 1):
        a, b = ((a + f(i, b)) % size_a, b) if i % 2 else (a, (b + f(i, a)) % size_b)
    return a, b


def brute_phone(d):
    code = lambda c: pii.EIGHT[int(c) - 2] if c > "1" else c
    made = brute_string(code(d[0]) + d[1:3] + code(d[3]) + d[4:], "phone")
    return "".join(str(pii.EIGHT.index(c) + 2) if c in pii.EIGHT else c for c in made)


def brute_day(n):
    side = lambda m: (np.datetime64(pii.EPOCH) + m).item().day > 12
    m = n
    while True:
        a, b = brute_pair(m // 4297, m % 4297, 17, 4297, "date")
        m = a * 4297 + b
        if side(m) == side(n):
            return np.datetime64(pii.EPOCH) + m


def luhn(d):
    return sum(n if i % 2 == 0 else n * 2 - 9 * (n > 4) for i, n in enumerate(map(int, reversed(d)))) % 10 == 0


def test_pseudonyms(spark):
    cards = ["4111 1111 1111 1111", "4785380592391139", "4785380592391130"]
    ips = ["10.0.0.1", "256.1.1.1", "1.2.3.4.5"]
    rest = ["+1 (743) 555-3824", "a.b@x.org", "2001-12-31", "31.12.2001", "12/31/2001", "31/12/2001", "2001-02-30", "123-45-6789", "000-45-6789", "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33"]
    text = " | ".join(cards + ips + rest)
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "none"), (5, "4785380592391139, again 4785380592391139."), (6, "10.0.0.1")], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymise(df, pii.TEST_KEY, "n").collect()}
    new = dict(zip(cards + ips + rest, out[1].text.split(" | "), strict=True))
    assert out[2].text is None and out[3].text == "" and out[4].text == "none" and out[4].n == 0
    assert out[5].text == "{0}, again {0}.".format(new["4785380592391139"]) and out[6].text == new["10.0.0.1"]
    for same in ("4785380592391130", "256.1.1.1", "1.2.3.4.5", "2001-02-30", "000-45-6789", "GB82 WEST 1234 5698 7654 33"):
        assert new[same] == same
    assert out[1].n == 11
    own = brute_string("478538059239113", "card")
    assert new["4785380592391139"][:-1] == own and luhn(new["4785380592391139"]) and luhn(new["4111 1111 1111 1111"].replace(" ", ""))
    a, b = brute_pair(10 * 256, 1, 65536, 65536, "ip")
    assert new["10.0.0.1"] == f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    d = brute_phone("7435553824")
    assert d[0] > "1" and d[3] > "1"
    assert new["+1 (743) 555-3824"] == f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}"
    assert new["a.b@x.org"] == brute_string("a.b", "email") + "@x.org"
    iban = new["GB82 WEST 1234 5698 7654 32"].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", new["2001-12-31"]) and new["31.12.2001"] == ".".join(reversed(new["2001-12-31"].split("-")))
    y, m, day = new["2001-12-31"].split("-")
    assert new["12/31/2001"] == f"{m}/{day}/{y}" and new["31/12/2001"] == f"{day}/{m}/{y}" and new["2001-12-31"] == str(brute_day(37254))
    a, b = brute_pair(122, 44 * 9999 + 6788, 898, 99 * 9999, "ssn")
    assert new["123-45-6789"] == f"{a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"


def test_pseudonyms_inside_runs(spark):
    """Numbers before or after other groups, two in a row, and phones of other notations."""
    cards = {"4111 1111 1111 1111 123": [(0, 19)], "4111 1111 1111 1111 12/25": [(0, 19)], "2024 4111 1111 1111 1111": [(5, 24)], "12 3782 822463 10005 7": [(3, 20)], "4242-4242-4242-4242 4111 1111 1111 1111": [(0, 19), (20, 39)]}
    others = ["1234 123-45-6789", "ES91 2100 0418 4502 0005 1332 USD", "ES91 2100 0418 4502 0005 1332 PLEASE", "+1 555 123 4567", "+7 495 123-45-67", "1234 5678 9012 3456"]
    df = spark.createDataFrame(list(enumerate([*cards, *others])), "doc_id long, text string")
    out = [r.text for r in pii.pseudonymise(df, pii.TEST_KEY).orderBy("doc_id").collect()]
    digits = lambda t: re.sub("[^0-9]", "", t)
    for (was, spans), now in zip(cards.items(), out, strict=False):
        want = list(was)
        for a, b in spans:
            own = brute_string(digits(was[a:b])[:-1], "card")
            own += next(c for c in "0123456789" if luhn(own + c))
            places = [i for i in range(a, b) if was[i].isdigit()]
            for i, c in zip(places, own, strict=True):
                want[i] = c
        assert now == "".join(want)
    ssn, euro, words, home, moscow, none = out[len(cards) :]
    assert ssn.startswith("1234 ") and ssn[5:] != "123-45-6789" and euro[:29] == words[:29] != others[1][:29] and euro.endswith(" USD") and words.endswith(" PLEASE")
    assert digits(home) == "1" + brute_phone("5551234567") and digits(moscow) == "7" + brute_string("4951234567", "phone") and none == others[-1]


def test_pseudonyms_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "a@x.org", 5, "w", "n")], "doc_id long, text string, pii_values int, pii_parts string, PII_NEW string")
    (row,) = pii.pseudonymise(df, "k").collect()
    assert (row.doc_id, row.pii_values, row.pii_parts, row.PII_NEW) == (1, 5, "w", "n") and row.text != "a@x.org"
    assert pii.configured_key(spark) == pii.TEST_KEY


@pytest.mark.parametrize("piece, n", [("b.", 2_500_000), ("1", 5_000_000), ("a@", 1_000_000), ("1.", 1_000_000), ("A0", 1_000_000), ("1 ", 20_000)])
def test_pseudonyms_of_hostile_texts(spark, piece, n):
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("a@"), F.repeat(F.lit(piece), n), F.lit("com")).alias("text"))
    began = time.monotonic()
    assert pii.pseudonymise(df, "k").select(F.length("text")).first()[0] == len(piece) * n + 5
    assert time.monotonic() - began < 60


def test_pseudonyms_are_permutations(spark):
    days = spark.range(0, pii.DAYS, 1, 4).select(F.date_format(F.date_add(F.lit(pii.EPOCH).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("v"))
    assert days.select(pii._date(F.col("v"), "k").alias("p")).distinct().count() == pii.DAYS
    two = spark.range(0, 1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    assert two.select(pii.permute_string(F.col("v"), "k", "x").alias("p")).distinct().count() == 1000
    ssn = spark.range(1, 2000).select(F.concat(F.lit("66"), F.lpad((F.col("id") % 10).cast("string"), 1, "0"), F.lit("-01-"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("v"))
    assert ssn.select(pii._ssn(F.col("v"), "k").alias("p")).distinct().count() == 1999


def test_native_queries_have_no_python(spark):
    for name in ("op2_mix_sources", "op9_format_chat", "op10_pseudonyms"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
