"""SimHash near-dedup: fingerprints that a Golay code hashes fuzzily.

A 64-bit fingerprint is cut into three segments of 21, 21 and 22 bits, each a
word of the perfect [23, 12, 7] Golay code with leading zeros.  If two
fingerprints differ in at most three bits, at most one segment has two or more
errors, so in at least two segments the words differ by one bit at most
(pigeonhole).  The codeword nearest to one word is then within distance four of
the other.  So each fingerprint is stored once for every pair of segments under
its two nearest codewords, and looked up under all pairs of codewords within
distance four; what meets is verified bit by bit.

`classes` links texts by their fingerprints alone, `near_classes` by the
similarity of their shingles, for which fingerprints only give candidates.
"""

from __future__ import annotations

import functools
import itertools
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import buffers, stage, texts
from siftstone.llm.components import components
from siftstone.llm.line_dedup import word_hashes
from siftstone.llm.repeats import word_bounds
from siftstone.llm.windows import mix

SHINGLE = 3
RADIUS = 3
SEED = 42
WORDS = 5  #: words of a shingle where texts are linked by the similarity of their sets
THRESHOLD = Fraction(4, 5)
BANDS, ROWS = 32, 4
# Generator polynomial of the binary Golay code, and the segments (shift, bits).
GENERATOR, LENGTH, CHECKS = 0xC75, 23, 11
SEGMENTS = ((0, 21), (21, 21), (42, 22))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SMALL = np.frombuffer(_LOWER, np.uint8)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles; zero if it has no words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        hashes = [xxhash.xxh64_intdigest(flat, SEED)]
    else:
        ends = list(itertools.accumulate(map(len, words), lambda a, b: a + 1 + b))
        starts = [0, *(e + 1 for e in ends)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(flat[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    return _vote(np.array(hashes, "<u8"))


def _vote(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * count > len(hashes)).tolist()))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of all words in two halves, leaders by syndrome, and the errors of weight four."""

    def syndrome(word: int) -> int:
        for i in range(LENGTH - 1, CHECKS - 1, -1):
            if word >> i & 1:
                word ^= GENERATOR << (i - CHECKS)
        return word

    bit = [syndrome(1 << i) for i in range(LENGTH)]
    leader = np.zeros(1 << CHECKS, np.int64)
    further: list[list[int]] = [[] for _ in range(1 << CHECKS)]
    for weight in range(1, 5):
        for at in itertools.combinations(range(LENGTH), weight):
            s, e = functools.reduce(int.__xor__, (bit[i] for i in at)), sum(1 << i for i in at)
            if weight < 4:
                leader[s] = e
            else:
                further[s].append(e)
    most = max(map(len, further))
    four = np.array([x + [-1] * (most - len(x)) for x in further], np.int64)
    low = np.array([functools.reduce(int.__xor__, (bit[i] for i in range(12) if w >> i & 1), 0) for w in range(1 << 12)], np.int64)
    high = np.array([functools.reduce(int.__xor__, (bit[12 + i] for i in range(11) if w >> i & 1), 0) for w in range(1 << 11)], np.int64)
    return np.concatenate((low, high)), leader, four


def nearest(word: np.ndarray) -> np.ndarray:
    """The codeword within distance three of each word."""
    syndromes, leader, _ = _tables()
    return word ^ leader[syndromes[word & 0xFFF] ^ syndromes[(1 << 12) + (word >> 12)]]


def nearby(word: np.ndarray) -> np.ndarray:
    """All codewords within distance four of each word, a row each; -1 fills."""
    syndromes, leader, four = _tables()
    s = syndromes[word & 0xFFF] ^ syndromes[(1 << 12) + (word >> 12)]
    errors = np.concatenate((leader[s][:, None], four[s]), axis=1)
    return np.where(errors < 0, -1, word[:, None] ^ errors)


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    return [((prints >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]


def _key(pair: int, a, b):
    return (np.int64(pair) << 46) | (a << 23) | b


def stored_keys(prints: np.ndarray) -> np.ndarray:
    near = [nearest(s) for s in _segments(prints)]
    return np.stack([_key(k, near[i], near[j]) for k, (i, j) in enumerate(itertools.combinations(range(3), 2))], axis=1)


def probe_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every look-up."""
    near = [nearby(s) for s in _segments(prints)]
    rows, keys = [], []
    for k, (i, j) in enumerate(itertools.combinations(range(3), 2)):
        key = np.where((near[i][:, :, None] < 0) | (near[j][:, None, :] < 0), -1, _key(k, near[i][:, :, None], near[j][:, None, :])).reshape(len(prints), -1)
        row, col = np.nonzero(key >= 0)
        rows.append(row)
        keys.append(key[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints(df: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of each whole text; null and empty texts have fingerprint zero."""

    def go(batches):
        for batch in batches:
            fp = [fingerprint(t.as_py().encode(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return texts(df, id_col, text_col).mapInArrow(go, "doc_id long, fp long")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: distinct fingerprints that differ in at most `radius` bits (three at most)."""
    if not 0 <= radius <= 3:
        raise ValueError("the code finds links of at most three bits")

    def store(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            keys = stored_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fp, 3))], ["key", "a"])

    def probe(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for at in range(0, len(fp), 4096):
                rows, keys = probe_keys(fp[at : at + 4096].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[at : at + 4096][rows])], ["key", "b"])

    stored = nodes.select("fp").mapInArrow(store, "key long, a long")
    probes = nodes.select("fp").mapInArrow(probe, "key long, b long")
    # Both come out of Python, where the optimiser's sizes are guesses: a probe side of 85 rows a node must not be broadcast.
    near = stored.hint("merge").join(probes, (stored["key"] == probes["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    return near.select("a", "b").distinct()


def classes(df: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row.

    Rows of equal fingerprints are one node before anything is joined, so a
    group of copies of any size costs one node.  component_id is the smallest
    doc_id reachable over links.  Null texts count as empty; rows with a null
    doc_id keep their place and never name a component unless they are alone
    (then it is null); repeated rows share a component; an empty table gives an
    empty table; other columns are ignored.
    """
    prints = stage(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(stage(links(nodes, radius), "links"))
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(ids.hint("shuffle_hash"), "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


_TIMES = np.uint64(0x9E3779B97F4A7C15)
_SALTS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _TIMES)


def shingles(parts: list[bytes], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct shingles of each text, sorted by text and hash."""
    data = _SMALL[np.frombuffer(b"\n".join(parts), np.uint8)]
    start, stop = word_bounds(data)
    words = word_hashes(data, start, stop)
    text = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), start, "right")
    n = np.bincount(text, minlength=len(parts))
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    hashes, of = [], []
    for k in range(1, size + 1):  # a shingle of k words: all of a shorter text, or each stretch of `size`
        at = np.flatnonzero(text[: max(len(words) - size + 1, 0)] == text[size - 1 :]) if k == size else first[n == k]
        h = np.full(len(at), k, np.uint64)
        for i in range(k):
            h = mix(h * _TIMES + words[at + i])
        hashes.append(h)
        of.append(text[at])
    h, t = np.concatenate(hashes), np.concatenate(of)
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (t[1:] != t[:-1]))) if len(h) else np.zeros(0, bool)
    return h[new], t[new]


def band_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """BANDS keys of each set of shingles; the sets begin at `at`."""
    keys = np.empty((len(at), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(at), b, np.uint64)
        for salt in _SALTS[b * ROWS : (b + 1) * ROWS]:
            key = mix(key * _TIMES + np.minimum.reduceat(mix(h ^ salt), at))
        keys[:, b] = key
    return keys


def _sets(batch: pa.RecordBatch, limit: int = 1 << 19):
    """(rows, hashes, first hash of each row) of stretches of a batch with about `limit` bytes; rows without words have no hash."""
    data, offsets = buffers(batch.column("text"))
    whole = data.tobytes()
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        h, t = shingles([whole[offsets[i] : offsets[i + 1]] for i in range(a, b)])
        yield a, b, h, np.searchsorted(t, np.arange(b - a + 1))
        a = b


def _signed(batches):
    """(doc_id, node, fp, keys): the hash of each text's set, its SimHash and its band keys."""
    for batch in batches:
        for a, b, h, at in _sets(batch):
            node = np.array([xxhash.xxh3_64_intdigest(h[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)], np.uint64)
            prints = np.array([_vote(h[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], np.uint64)
            have = at[1:] > at[:-1]
            keys = band_keys(h, at[:-1][have]) if have.any() else np.zeros((0, BANDS), np.uint64)
            ends = np.concatenate(([0], np.cumsum(have * BANDS))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(node.view(np.int64)), pa.array(prints.view(np.int64)), lists], ["doc_id", "node", "fp", "keys"])


def _listed(batches):
    """(node, shingles): the set of each text."""
    for batch in batches:
        for a, b, h, at in _sets(batch):
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), lists], ["node", "shingles"])


def _alike(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the threshold."""
    p, q = threshold.numerator, threshold.denominator
    pairs = stage(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    of = nodes.join(wanted.hint("shuffle_hash"), "node", "left_semi").select("node", "least")
    sets = stage(docs.join(of.hint("shuffle_hash"), F.col("doc_id") == F.col("least")).select("node", "text").mapInArrow(_listed, "node long, shingles array<long>"), "sets")
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return stage(pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(common * (p + q) >= p * (F.size("sa") + F.size("sb"))).select("a", "b"), "alike")


def _print_keys(prints: DataFrame) -> DataFrame:
    """(node, key): nodes of one fingerprint share it, and nodes of two that are linked share a key of the pair."""
    met = stage(links(prints.select("fp").distinct()), "print_links")
    pair = F.xxhash64("a", "b").alias("key")
    ends = met.select(F.col("a").alias("fp"), pair).union(met.select(F.col("b").alias("fp"), pair))
    return prints.select("node", F.xxhash64("fp").alias("key")).union(prints.join(ends.hint("shuffle_hash"), "fp").select("node", "key"))


def near_classes(df: DataFrame, threshold: Fraction = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of each row; ids are those of rows, so none is null or stands twice.

    Two texts are linked if the Jaccard similarity of their sets of 5-word
    shingles (ASCII letters lower-cased; a shorter text is one shingle) reaches
    the threshold.  Candidates are fingerprints of those shingles that the Golay
    keys link; three bits are some 0.97 of similarity, so texts that share one
    of BANDS keys of ROWS minima each are candidates too.  A pair of similarity
    s is in neither with probability (1 - s^ROWS)^BANDS at most: 5e-8 at 0.8.
    All candidates are verified on their sets.

    Equal sets are one node.  Of a key's nodes the first is held against each
    other one; after that, only pairs that these links leave in different
    components are compared.  component_id is the smallest id reachable over
    links.  Null texts count as empty, and texts without words are one
    component; an empty table gives an empty table; other columns are ignored.
    """
    docs = texts(df, id_col, text_col)
    signed = stage(docs.mapInArrow(_signed, "doc_id long, node long, fp long, keys array<long>"), "signed")
    nodes = stage(signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp")), "nodes")
    keys = signed.select("node", F.explode("keys").alias("key")).union(_print_keys(nodes)).distinct()
    shared = keys.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1")
    met = stage(keys.join(shared.hint("shuffle_hash"), "key").select("key", "head", "node"), "met")
    stars = _alike(met.where("head <> node").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), docs, nodes, threshold)
    parts = met.join(components(stars), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    x, y = parts.alias("x"), parts.alias("y")
    apart = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root")))
    apart = apart.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    apart = apart.join(met.where("head <> node").select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct(), ["a", "b"], "left_anti")
    linked = stars.union(_alike(apart, docs, nodes, threshold))
    named = nodes.join(components(linked), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = stage(named.select("node", "root").join(least, "root").select("node", "component_id"), "near_classes")
    return signed.select("doc_id", "node").join(ids.hint("shuffle_hash"), "node", "left").select("doc_id", "component_id")
