"""The ten operators against brute force on small tables with nulls, ties, repeats, empties and clashing columns."""

import gzip
import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftstone.llm import bit_sliced, byte_bpe, components, language_id, line_dedup, packing, queries, simhash, substring_dedup, suffix_dedup, transport_stream, warc
from siftstone.llm.common import merge_spans

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tag string, row string, spans string, key string, kept string"


def made_texts():
    rnd = random.Random(5)
    words = [rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") + rnd.choice("bcdlmnr") + rnd.choice(["", "a", "en", "ing"]) for _ in range(120)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = line(30)
    out = [None, "", " \n\t ", "é", "x", "a b c", "The  DOG\x0bran", "naïve 中文 text 🙂 " * 3]
    base = [line(rnd.randrange(1, 60)) + "\n" + line(rnd.randrange(1, 20)) for _ in range(14)]
    out += base + base[:4]
    out += [base[5] + "\n" + passage, passage + " " + line(9), line(4) + " " + passage + "\n" + passage]
    near = base[7].split(" ")
    near[len(near) // 2] = "changed"
    out += [" ".join(near), base[7] + " tail", "ab " * 400, "ab " * 390 + "c", "z" * 300, "\n".join(["same line here now again"] * 3)]
    out.append(" ".join(words) * 40)
    return out


TEXTS = made_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], "s", 0, "t", "r", "s", "k", "k") for i, t in enumerate(TEXTS)]
    rows.append((None, TEXTS[10], None, None, None, None, None, None, None, None))
    rows.append(rows[12])
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def given(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def test_transport_stream(docs, empty):
    got = transport_stream.read(transport_stream.store(docs)).collect()
    want = []
    for i, t in given(docs):
        p = transport_stream.padded(t.encode())
        assert len(p) % 192 == 0 and len(p) > 0 and p.rstrip(b" ") == t.encode().rstrip(b" ")
        want.append((str(i), len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted((str(r[0]), *r[1:5]) for r in got) == sorted(want)
    assert all("continuity_errors=0 damaged=0" in r["feature"] and r["access_points"][0]["pts"] == 0 for r in got)
    assert transport_stream.read(transport_stream.store(empty)).collect() == []


def test_transport_stream_faults():
    p = bytes(range(256)) * 60
    media = transport_stream.mux(p)
    s = transport_stream.demux(media)
    assert s.payload() == p and s.programs == {1: {0x101: 6}} and [u.pts for u in s.units] == [i * 6144 * 90000 // 48000 for i in range(len(s.units))]
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    assert transport_stream.demux(b"".join(packets[:9] + packets[10:])).continuity_errors == 1
    assert transport_stream.demux(b"".join(packets[:9] + packets[8:9] + packets[9:])).payload() == p
    assert transport_stream.demux(b"\x00" + media[1:]).damaged >= 1
    for n in (192, 384, 6144, 6336, 18432):
        assert transport_stream.demux(transport_stream.mux(b"q" * n)).payload() == b"q" * n


def test_warc(spark, docs):
    rows = [(1, None, None), (2, "http://a/\r\nX: y", "x" * 100), (3, "u", "x" * 100), (4, "u", "x" * 99), (5, "u", "x" * 99), (6, "u", "é" * 40_000), (7, "u", "é" * 40_000), (None, "u", "x" * 100), (9, "u", ""), (2, "again", "x" * 100)]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, first long")
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows) and all(r["complete"] for r in got)
    kinds = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == sorted([("1", 0, "response", None), ("2", 100, "response", None), ("2", 100, "response", None), ("3", 100, "revisit", 2), ("4", 99, "response", None), ("5", 99, "response", None), ("6", 80000, "response", None), ("7", 80000, "revisit", 6), ("None", 100, "revisit", 2), ("9", 0, "response", None)])
    assert next(r for r in got if r["page_id"] == 6)["segments"] > 2
    assert {r["payload_digest"] for r in got if r["page_id"] in (6, 7)} == {hashlib.sha256(("é" * 40_000).encode()).hexdigest()}
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_warc_repeated_long(spark):
    a, b = "é" * 40_000, "b" * 50_000
    rows = [(1, "u", a), (1, "u", a), (1, "u", b), (2, "u", a), (None, "u", "c" * 30_000), (None, "u", "c" * 30_000), (None, "v", "d" * 20_000), (3, "u", b + "e"), (4, "u", b + "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = warc.write(pages)
    got = warc.read(spark, folder).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, len(t.encode()), sha(t), "response", None) for i, _, t in rows if (i, t) not in [(2, a), (4, b + "e")]]
    want += [(2, 80_000, sha(a), "revisit", 1), (4, 50_001, sha(b + "e"), "revisit", 3)]
    assert sorted(map(str, want)) == sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    assert all(r["complete"] and (r["segments"] > 1) == (r["record_type"] == "response") for r in got)
    fields = [f for r in spark.read.format("binaryFile").load(folder).collect() for f, _ in warc.parse(gzip.decompress(r["content"]))]
    ids = [f["warc-record-id"] for f in fields]
    assert len(set(ids)) == len(ids)
    assert [f["warc-refers-to"] in ids for f in fields if "warc-refers-to" in f] == [True]


def test_warc_segments():
    assert warc.dechunked(b"4;x=y\r\nabcd\r\n0\r\nT: v\r\n\r\n") == b"abcd"
    with pytest.raises(ValueError):
        warc.dechunked(b"3\r\nabcd\r\n0\r\n\r\n")
    block = warc.HTTP + b"\r\n" + warc.chunked(b"body")
    parts = [{"number": 2, "total": len(block), "block": block[9:]}, {"number": 1, "total": None, "block": block[:9]}]
    assert warc.reassemble(parts)[1:] == (b"body", True) and not warc.reassemble(parts[:1])[2]
    assert warc.page_of(warc.record_id(-5)) == -5 and warc.page_of(warc.record_id(None)) is None


def test_byte_bpe(docs, empty):
    path = queries.TOKENIZERS["bytes"]
    tokens = byte_bpe.read_ranks(open(path, "rb").read())
    truth = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: r for r, t in enumerate(tokens)}, special_tokens={})
    want = sorted((str(i), len(ids := truth.encode_ordinary(t)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in given(docs))
    assert sorted((str(r[0]), *r[1:]) for r in byte_bpe.digest(docs, path, public_tokenizers.PATTERN).collect()) == want
    back = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    assert sorted((str(r["doc_id"]), bytes(r["decoded"])) for r in back) == sorted((str(i), t.encode()) for i, t in given(docs))
    assert byte_bpe.digest(empty, path, public_tokenizers.PATTERN).collect() == []


def test_language_id(spark, docs, empty):
    model = language_id.train(docs)
    found = language_id.predict(docs, model)
    assert found.columns[: len(docs.columns)] == docs.columns
    for r in found.collect():
        assert 0 <= r["lang_score"] <= 1 and (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or ""))
        assert sum(s["words"] for s in r["lang_spans"]) == len(re.findall(r"[^\W\d_]+", (r["text"] or "").lower()))
    none = language_id.train(empty)
    assert {r["lang_pred"] for r in language_id.predict(docs, none).collect()} == {"und"} and language_id.predict(empty, model).collect() == []
    assert language_id.keep_known(docs).columns == docs.columns


def test_language_spans():
    counts = {x: language_id.count(language_id.read_words([t])) for x, t in (("en", "the house and the garden with water " * 20), ("ru", "дом и сад у воды в городе " * 20), ("de", "das haus und der garten mit wasser " * 20))}
    model = language_id.fit(counts)
    lang, score, spans = language_id.label(["the house and the garden дом и сад das haus und der garten mit wasser"], model)[0]
    assert [s[0] for s in spans] == ["en", "ru", "de"] and 0 < score < 1 and lang == "de"


@pytest.mark.parametrize("seed", range(8))
def test_viterbi(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 300)), int(rng.integers(2, 5))
    score, doc = (rng.normal(size=(n, k)) * 6).astype(np.float32), np.sort(rng.integers(0, 3, n))
    path = language_id.viterbi(score, doc, 8.0)
    for q in np.unique(doc):
        z, p = score[doc == q].astype(float), path[doc == q]
        v = z[0].copy()
        for row in z[1:]:
            v = np.maximum(v, v.max() - 8) + row
        assert z[np.arange(len(z)), p].sum() - 8 * np.count_nonzero(np.diff(p)) == pytest.approx(v.max(), abs=1e-2)


def test_packing(docs, empty):
    rows = packing.pack(docs, queries.TOKENIZERS["words"]).collect()
    tokenizer = Tokenizer.from_file(queries.TOKENIZERS["words"])
    tokenizer.encode_special_tokens = True
    ids = defaultdict(list)
    for i, t in given(docs):
        ids[i].append(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], np.uint32))
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert any(r["doc_tokens"] == len(x) and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
        covered[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {i: sorted(c) for i, c in covered.items()} == {i: sorted(k for x in xs for k in range(len(x))) for i, xs in ids.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    assert packing.pack(empty, queries.TOKENIZERS["words"]).collect() == []


def test_packing_plan():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(6, 1, 30_000).astype(int) + 1, 2047)
    weights, demand = np.unique(packing.sizes(lengths), return_counts=True)
    weights, demand = weights[weights < 2048], demand[weights < 2048]
    basis, x = packing.solve(weights, demand)
    assert np.allclose(basis @ x, demand) and (x >= 0).all() and (weights @ basis <= 2048).all()
    used = np.zeros(len(weights), np.int64)
    for p, times in packing.plan(weights, demand):
        assert packing.FILL * 2048 <= sum(int(weights[i]) * n for i, n in p.items()) <= 2048
        for i, n in p.items():
            used[i] += n * times
    assert (used <= demand).all() and used @ weights > 0.9 * (demand @ weights)
    assert packing.powers(13) == [8, 4, 1]
    assert packing.plan(np.zeros(0, np.int64), np.zeros(0, np.int64)) == []


def lines_by_force(rows):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    first, lines = {}, []
    for i, t in sorted(rows):
        for k, x in enumerate(t.split("\n")):
            w = frozenset(re.findall(r"[^\x20\x09-\x0D]+", low(x)))
            lines.append((i, k, w))
            if w:
                first.setdefault(w, (i, k))
    like = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    links = {a: [b for b in first if b != a and like(a, b)] for a in first}
    gone = {(i, k) for i, k, w in lines if w and ((i, k) != first[w] or any(first[b] < first[w] for b in links[w]))}
    count = defaultdict(int)
    for i, _, w in lines:
        count[i] += len(links.get(w, []))
    return gone, count


def test_line_dedup(docs, empty):
    known = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = given(known)
    gone, count = lines_by_force(rows)
    assert gone and any(count.values())
    got = {r["doc_id"]: r for r in line_dedup.dedup(known).collect()}
    for i, t in rows:
        kept = "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        r = got[i]
        assert (r["n_lines"], r["n_removed"], r["n_links"], r["kept_sha256"]) == (t.count("\n") + 1, sum(g[0] == i for g in gone), count[i], hashlib.sha256(kept.encode()).hexdigest())
        assert r["class_id"] <= i
    assert line_dedup.dedup(docs).count() == docs.count() and line_dedup.dedup(empty).collect() == []
    cut = line_dedup.remove(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count() and line_dedup.remove(empty).collect() == []


def test_line_dedup_of_hot_keys(docs):
    known = docs.where("doc_id is not null")
    plain = sorted(map(tuple, line_dedup.verdicts(known).collect()))
    assert plain and plain == sorted(map(tuple, line_dedup.verdicts(known, heavy=2, room=150).collect()))


def test_partnered():
    rnd = random.Random(8)
    heads = np.array([0, 1, 3, 9, 40, 300])
    meta = np.array([(n << 20) | (rnd.randrange(2) << 10) | rnd.randrange(n) for n in (rnd.randrange(3, 40) for _ in range(700))], np.uint32)
    meta[3] = meta[310] = 0xFFFFFFFF
    sketch = np.array([rnd.getrandbits(12) for _ in meta], np.uint64)
    got = line_dedup.partnered(heads, meta, sketch, line_dedup.THRESHOLD)
    parts = [(m >> 20, m & 1023, (m >> 20) - (m >> 10 & 1023) - (m & 1023)) for m in meta.tolist()]
    group = np.searchsorted(heads, np.arange(700), "right").tolist()

    def near(i, j):
        (n, a, b), (m, c, d) = parts[i], parts[j]
        return 9 * (min(a, c) + min(b, d)) >= 4 * (n + m) and (int(sketch[i]) ^ int(sketch[j])).bit_count() <= n + m - 2 * -(-4 * (n + m) // 9)

    free = (3, 310)
    assert got.tolist() == [any(i != j and group[i] == group[j] and (i in free or j in free or near(i, j)) for j in range(700)) for i in range(700)]
    assert line_dedup.partnered(heads, meta, sketch, line_dedup.THRESHOLD, most=50).tolist()[300:] == [True] * 400


def test_compare():
    rnd = random.Random(1)
    for m in (2, 5, 12, 13, 40, 70) * 8:
        words = [" ".join(rnd.choice("abcdefghijklmno"[: rnd.choice([6, 15])]) for _ in range(rnd.randrange(1, 14))).encode() for _ in range(m)]
        smaller = [sorted({rnd.randrange(9) for _ in range(rnd.randrange(4))}) for _ in range(m)]
        side = [2] * m if rnd.random() < 0.5 else [rnd.randrange(2) for _ in range(m)]
        links, first = [0] * m, [-1] * m
        for i in range(m):
            for j in range(i):
                a, b = set(words[i].split()), set(words[j].split())
                if (side[i] == 2 or side[i] != side[j]) and not set(smaller[i]) & set(smaller[j]) and 5 * len(a & b) >= 4 * len(a | b):
                    links[i], links[j], first[i] = links[i] + 1, links[j] + 1, j if first[i] < 0 else first[i]
        assert line_dedup.compare(side, smaller, words, line_dedup.THRESHOLD) == (links, first)


def test_needed():
    rnd = random.Random(3)
    for m in (1, 2, 9, 64, 65, 130) * 4:
        smaller = [sorted({rnd.choice([1, 1, 1, 2, 3, 4, 5]) for _ in range(rnd.choice([0, 1, 2, 3, 3, 3]))}) for _ in range(m)]
        batch = pa.RecordBatch.from_arrays([pa.array([7] * m, pa.int64()), pa.array(range(m), pa.int64()), pa.array(smaller, pa.list_(pa.int64()))], ["key", "id", "smaller"])
        got = sorted(i for b in line_dedup._needed()([batch.slice(0, m // 2), batch.slice(m // 2)]) for i in b.column("id").to_pylist())
        assert got == [i for i in range(m) if any(j != i and not set(smaller[i]) & set(smaller[j]) for j in range(m))]


def test_line_of_many_words(spark):
    words = [f"{i:x}" for i in range((1 << 20) + 1_000)]
    rows = [(1, " ".join(words[:-2_000])), (2, " ".join(words))]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["n_links"], r["class_id"]) for r in got) == [(1, 0, 1, 1), (2, 1, 1, 1)]


def test_prefix_lengths():
    p = line_dedup.prefix_lengths(np.array([3, 4, 5, 40, 10]), np.array([0, 0, 0, 0, 3]), line_dedup.THRESHOLD)
    assert p.tolist() == [2, 3, 4, 18, 0]


def windows_by_force(rows, size):
    first, marks = {}, []
    for i, s in sorted(rows, key=lambda r: r[0]):
        for p in range(len(s) - size + 1):
            first.setdefault(s[p : p + size], i)
    for i, s in rows:
        m = [False] * len(s)
        for p in range(len(s) - size + 1):
            if first[s[p : p + size]] < i:
                m[p : p + size] = [True] * size
        marks.append((i, s, m))
    return marks


def test_suffix_dedup(docs, empty):
    known = docs.where("doc_id is not null")
    want = []
    for i, s, m in windows_by_force([(i, t.encode()) for i, t in given(known)], 50):
        spans = sum(m[k] and (k == 0 or not m[k - 1]) for k in range(len(m)))
        want.append((i, len(s), sum(m), spans, hashlib.sha256(bytes(b for b, x in zip(s, m, strict=True) if not x)).hexdigest()))
    assert any(w[2] for w in want)
    assert sorted(map(tuple, suffix_dedup.digest(suffix_dedup.dedup(known)).collect())) == sorted(want)
    assert suffix_dedup.dedup(docs).count() == docs.count() and suffix_dedup.digest(suffix_dedup.dedup(empty)).collect() == []
    cut = suffix_dedup.remove(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count() and cut.where("text is null").count() == 1


def test_pieces_of_a_gram():
    """A gram that comes in pieces gives the same spans as in one."""
    rnd = random.Random(5)
    base = bytes(rnd.choice(b"abcd") for _ in range(90))
    rows = []
    for d in range(60):
        a = rnd.randrange(0, 30)
        rows.append((d // 2, 0, 7 * d, rnd.choice([5, 5, 9]), base[a : a + rnd.randrange(50, 61)] if d % 3 else bytes(rnd.choice(b"abcd") for _ in range(55))))
    rows.sort(key=lambda r: (r[3], r[0]))
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "tag", "low", "gram", "content"])
    spans = lambda limit: sorted(tuple(r.values()) for b in suffix_dedup._closer(50, limit)([batch.slice(0, 25), batch.slice(25)]) for r in b.to_pylist())
    assert spans(1 << 20) and spans(1 << 20) == spans(200) == spans(1) == spans(1500)


def test_substring_dedup(docs, empty):
    known = docs.where("doc_id is not null")
    want = []
    for i, s, m in windows_by_force([(i, tuple(t.encode().split())) for i, t in given(known)], 13):
        want.append((i, len(s), sum(m), hashlib.sha256(b" ".join(b for b, x in zip(s, m, strict=True) if not x)).hexdigest()))
    assert any(w[2] for w in want)
    assert sorted(map(tuple, substring_dedup.digest(substring_dedup.dedup(known)).collect())) == sorted(want)
    assert substring_dedup.dedup(docs).count() == docs.count() and substring_dedup.digest(substring_dedup.dedup(empty)).collect() == []
    assert substring_dedup.remove(docs).columns == docs.columns


def test_suffix_automaton():
    rnd = random.Random(2)
    seen = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 14))) for _ in range(12)]
    a = substring_dedup.SuffixAutomaton()
    for s in seen:
        a.begin()
        for c in s:
            a.add(c)
    probe = "".join(rnd.choice("abc") for _ in range(80))
    want = [max((n for n in range(e + 1) if any(probe[e - n : e] in s for s in seen)), default=0) for e in range(1, len(probe) + 1)]
    assert list(a.matches(probe)) == want


def fingerprint_by_force(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    known = docs.where("doc_id is not null")
    rows = [(i, fingerprint_by_force(t)) for i, t in given(known)]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in rows:
        for j, b in rows:
            if (a ^ b).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert sorted(map(tuple, simhash.classes(known).collect())) == sorted((i, f"{a:016x}", find(i)) for i, a in rows)
    assert simhash.classes(docs).count() == docs.count() and simhash.classes(empty).collect() == []


def test_golay_keys():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = np.uint64(rng.integers(0, 1 << 63)) * np.uint64(2) + np.uint64(rng.integers(0, 2))
        y = x
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            y ^= np.uint64(1) << np.uint64(b)
        assert set(simhash.stored_keys(np.array([x]))[0].tolist()) & set(simhash.probe_keys(np.array([y]))[1].tolist())


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}


def test_bit_sliced(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(400, 16)).round(1)
    rows = [(i, [float(x) for x in v], 1, "v") for i, v in enumerate(m)] + [(1000 + i, [1.0, 2.0], 0, "v") for i in range(3)]
    rows += [(2000, None, 0, "v"), (2100, [float("nan")] * 16, 0, "v"), (2200, [None] + [1.0] * 15, 0, "v"), (None, [0.5] * 16, 0, "v"), (3000, [], 0, "v"), (5, [float(x) for x in m[5]], 0, "v")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, v string").repartition(3)
    got = bit_sliced.top_k(df, F.col("id") % 100 == 0).collect()
    q = np.floor(1024 * m).astype(np.int64)
    ids, vectors = [*range(400), 5], np.concatenate((q, q[5:6]))
    want = []
    for a in (0, 100, 200, 300):
        s = vectors @ q[a]
        order = sorted((-int(s[k]), ids[k]) for k in range(len(ids)) if ids[k] != a)[:10]
        want += [(a, n, i, -x) for n, (x, i) in enumerate(order, 1)]
    two = np.floor(1024 * np.array([1.0, 2.0])).astype(np.int64)
    want += [(1000, n, 1000 + n, int(two @ two)) for n in (1, 2)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert bit_sliced.top_k(df.limit(0), F.col("id") % 100 == 0).collect() == []


def test_bit_sliced_range(spark):
    with pytest.raises(OverflowError):
        bit_sliced.quantise(np.array([[1e300]]))
    block = bit_sliced.Block.of(np.arange(2), np.array([[1 << 50], [3]]))
    with pytest.raises(OverflowError):
        block.top(9, np.array([1 << 20]), 1)


@pytest.mark.parametrize("seed", range(6))
def test_block(seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(-900, 900, size=(int(rng.integers(1, 300)), 8))
    block = bit_sliced.Block.read(*bit_sliced.Block.of(np.arange(len(values)), values).row())
    query = rng.integers(-50, 50, 8)
    ids, scores = block.top(3, query, 5)
    s = values @ query
    assert list(zip(scores.tolist(), ids.tolist(), strict=True)) == [(-x, i) for x, i in sorted((-int(v), i) for i, v in enumerate(s) if i != 3)[:5]]


def test_spans():
    a, b = merge_spans(np.array([5, 0, 9, 2]), np.array([7, 3, 12, 5]))
    assert a.tolist() == [0, 9] and b.tolist() == [7, 12]


@pytest.mark.parametrize("name", ["op2_warc", "op7_suffix_dedup", "op9_bit_sliced", "op10_substring_dedup"])
def test_sql(spark, name):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = queries.QUERIES[name](spark, d)
    q = c.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in q.description]
    got = df.select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, q.fetchall()))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, step(spark, docs, "")
        if name != "packing":
            assert docs.columns == columns and docs.count() <= before.count()
    assert docs.count() > 0 and docs.where("length > 2048 or offset + length > 2048").count() == 0


def near_by_force(rows):
    """Rows that stay of (id, text): the first, by id with nulls last, of each component at a similarity of 0.8."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = [re.findall(r"[^\x20\x09-\x0D]+", low(t)) for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in words]
    part = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if part[i] != part[j] and 5 * len(a & b) >= 4 * len(a | b):
                part = [part[j] if p == part[i] else p for p in part]
    best = {}
    for p, (i, _) in zip(part, rows, strict=True):
        best.setdefault(p, []).append((i is None, i or 0))
    return sorted((None if unknown else i for unknown, i in map(min, best.values())), key=str)


def near_texts():
    rnd = random.Random(9)
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    out = []
    for n in (12, 40, 100, 300):
        for _ in range(6):
            base = fresh(n)
            out.append(" ".join(base))
            for changes in (1, 2, 3, 5, 8):
                near = list(base)
                for i in rnd.sample(range(n), min(changes, n // 10)):
                    near[i] = fresh(1)[0]
                out.append(" ".join(near))
    return out


def test_pipeline_near_copies(spark):
    import corpus_pipeline

    rows = list(enumerate(near_texts() + TEXTS))
    got = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == near_by_force(rows)


def test_near_pairs():
    h, t = simhash.shingles([b"A b c d e f", b"", b"a b", b"a B c d e", b"a b a b a b a"])
    assert np.bincount(t, minlength=5).tolist() == [2, 0, 1, 1, 2] and h[t == 3][0] in h[t == 0]


def test_pipeline_near_copies_ids(spark):
    import corpus_pipeline

    a, b, c, d = near_texts()[60:78:6] + ["only here " * 9]
    rows = [(None, a), (None, b), (5, b), (5, b), (3, b + " tail"), (7, c), (7, "other words of the same id"), (None, d), (None, d), (8, None), (None, "")]
    got = corpus_pipeline.one_of_each(spark, spark.createDataFrame([(x, t, "en") for x, t in rows], "doc_id long, text string, row string").repartition(3), "")
    assert got.columns == ["doc_id", "text", "row"]
    want = [(None, a), (3, b + " tail"), (7, c), (7, "other words of the same id"), (None, d), (8, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_pipeline_stages_by_force(spark):
    import corpus_pipeline

    step = dict(corpus_pipeline.STAGES)
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(3)
    kept = lambda name: sorted(map(tuple, step[name](spark, docs, "").collect()))
    gone, _ = lines_by_force([(i, t or "") for i, t, _ in rows])
    lines = [(i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t, _ in rows]
    assert kept("line_dedup") == [(i, t, len(t or "")) for i, t in lines]
    passages = []
    for i, s, m in windows_by_force([(i, (t or "").encode()) for i, t, _ in rows], 50):
        runs, at = [], 0
        for k in range(1, len(s) + 1):
            if k == len(s) or m[k] != m[at]:
                runs += [s[at:k].decode("utf-8", "ignore")] if not m[at] else []
                at = k
        passages.append((i, None if rows[i][1] is None else "".join(runs)))
    assert kept("suffix_array_dedup") == sorted((i, t, len(t or "")) for i, t in passages)


def test_pipeline_known_language(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    letters = {r["doc_id"]: r["text"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    base = max(r["doc_id"] for r in docs.select("doc_id").collect())
    bare = docs.limit(4).withColumn("doc_id", F.lit(base + 1) + F.monotonically_increasing_id()).withColumn("text", F.lit("123 456 --"))
    got = corpus_pipeline.known_language(spark, docs.union(bare), "").collect()
    assert len(got) == len(letters) and {r["doc_id"]: r["text"] for r in got} == letters


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_language_held_out(spark, sf):
    """Accuracy on the fold that training never sees, and the fold itself."""
    import zlib

    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    got = queries.op4_language_id(spark, f"/root/testdata/{sf}").collect()
    assert len(got) == len(known) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    tested = [r["lang_pred"] == known[r["doc_id"]] for r in got if r["held_out"] and known[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(tested) > 20 and sum(tested) >= 0.98 * len(tested)


def test_viterbi_of_scripts():
    """Blocks decoded among the candidates of their scripts give the best path over all languages."""
    rnd = np.random.default_rng(4)
    candidate = np.zeros((4, 300), bool)
    candidate[1, :3] = candidate[2, 2:260] = candidate[3, 299] = candidate[0] = True
    script = np.repeat(rnd.integers(1, 4, 60), rnd.integers(1, 30, 60))
    doc = np.sort(rnd.integers(0, 7, len(script)))
    score = np.where(candidate[script], rnd.normal(0, 6, (len(script), 300)), -1e6).astype(np.float32)

    def total(path, a, b):
        return sum(float(score[i, path[i]]) for i in range(a, b)) - 8.0 * sum(path[i] != path[i - 1] for i in range(a + 1, b))

    path = language_id.viterbi(score, doc, 8.0, candidate, script)
    assert candidate[script, path].all()
    for d in range(7):
        a, b = np.searchsorted(doc, [d, d + 1])
        if a == b:
            continue
        best = score[a].astype(float)
        for i in range(a + 1, b):
            best = np.maximum(best, best.max() - 8.0) + score[i]
        assert abs(total(path, a, b) - best.max()) < 1e-2


def test_sample_of_many_rows():
    """The share of hashes that is read never rounds to none."""
    for n in (20_001, 10**9, 10**12, 10**18):
        share = (language_id.SAMPLE << 64) // n
        assert share > 0 and -(1 << 63) + share < 1 << 63


def test_stages_on_odd_rows(spark, docs, empty):
    import corpus_pipeline

    for name, step in corpus_pipeline.STAGES:
        got = step(spark, docs, "")
        if name == "packing":
            assert got.where("doc_id is null").count() > 0 and step(spark, empty, "").collect() == []
            continue
        assert got.columns == docs.columns and step(spark, empty, "").collect() == []
        rows = got.collect()
        assert 0 < len(rows) <= docs.count() and all(r["tag"] in ("t", None) and r["key"] in ("k", None) for r in rows)
        if name in ("line_dedup", "suffix_array_dedup"):
            assert len(rows) == docs.count() and sum(r["text"] is None for r in rows) == 1


def test_no_language_to_learn(spark, docs):
    with pytest.raises(ValueError):
        language_id.keep_known(docs.withColumn("lang", F.lit(None).cast("string")))


def test_long_texts(spark):
    """A text of more than one stretch, and one line that holds it all: equal to the same windows cut by force."""
    rnd = random.Random(11)
    long = " ".join(rnd.choice(["ab", "cde", "fghi", "jk"]) + str(rnd.randrange(10**6)) for _ in range(70_000))
    rows = [(1, long), (2, long[300_000:420_000]), (3, "x" + long[100:200_000] + "y"), (4, "own words only")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.digest(suffix_dedup.dedup(df)).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3, 4)] == [0, 120_000, len(rows[2][1]) - 2, 0] and got[2]["n_spans"] == got[3]["n_spans"] == 1
    words = {r["doc_id"]: r for r in substring_dedup.digest(substring_dedup.dedup(df)).collect()}
    assert words[1]["n_removed"] == 0 and words[2]["n_words"] - words[2]["n_removed"] <= 2 and words[3]["n_words"] - words[3]["n_removed"] <= 2
    lines = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup(df).collect()}
    assert lines == {1: 0, 2: 0, 3: 0, 4: 0}
    langs = language_id.train(spark.createDataFrame([(1, long, "en")], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in language_id.predict(df, langs).collect()} == {"en"}


def test_simhash_probes_are_never_broadcast(spark):
    nodes = line_dedup.stage(spark.range(50).select(F.xxhash64("id").alias("fp")), "nodes")
    found = simhash.links(nodes)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    prints = [r["fp"] for r in nodes.collect()]
    assert {tuple(r) for r in found.collect()} == {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}


def test_lines_of_all_bytes():
    r = random.Random(5)
    parts = [bytes(r.choice(b"aAzZ@[`{ \t\n\x08\x0b\x0d\x0e\x00\xff") for _ in range(n)) for n in (0, 400, 1, 900, 0)] + [bytes(range(256)), b"x" * 40 + b" " + b"X" * 40]
    x = line_dedup.Lines(parts, np.zeros(line_dedup.COUNTERS, np.uint8))
    lines = [line.lower().split() for part in parts for line in part.split(b"\n")]
    assert x.words.tolist() == [len(set(words)) for words in lines]
    known = {}
    for words, chk in zip(lines, x.check.tolist(), strict=True):
        assert known.setdefault(frozenset(words), chk) == chk
    assert len(set(known.values())) == len(known)
    assert len(line_dedup.Lines(parts).hashes) == sum(map(len, lines))
