"""Packing by cutting-stock column generation.

A document's ids are cut at multiples of the capacity; whole stretches fill a
sequence each.  The rests are pieces of 1 to capacity - 1 ids.  Their length
histogram, which has at most `capacity` entries at any scale, goes to the
driver.  There a linear program chooses how often to use each *pattern* (a
multiset of lengths that fits a sequence); its columns are generated by a
knapsack dynamic program over the dual prices.  Multiplicities are rounded down,
what is left over is packed greedily, and pieces, ranked within their length by
partial counts, take the places of the patterns.

Pieces of patterns that would leave too much room are split into powers of two
instead.  Those fill sequences exactly, and the last ones are themselves powers
of two, which need no padding.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.common import stage, texts

CAPACITY = 2_048
END = 1  #: id that ends every document
FILL = 0.985  #: a pattern must fill so much of a sequence, else its pieces are split
SALTS = 256  #: parts of a length in which pieces are ranked apart
ROUNDS = 120  #: knapsack rounds at most; any number gives a valid packing
COLUMNS = 48  #: patterns that a round adds
_CACHE = 500_000
_CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed: the vocabulary's own pre-tokens


class Tokenizer:
    """Ids by a tokenizers file, with a memory for what stands between white space.

    The file's normaliser composes, lower-cases and joins white space, and its
    pre-tokens never hold white space, so a text's ids are those of its parts.
    Special tokens' strings are ordinary text.
    """

    def __init__(self, data: bytes):
        import regex
        from tokenizers import Tokenizer as Loaded
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Loaded.from_buffer(data)
        self.whole.encode_special_tokens = True
        self.find = regex.compile(_CONTRACTIONS).findall
        self.bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain = regex.compile(r"[\x21-\x7eÀ-ɏ]+").fullmatch
        self.odd = regex.compile(r"[\x1c-\x1fΣİ]").search
        self._pieces: dict[str, bytes] = {}
        self._parts: dict[str, bytes] = {}

    def _piece(self, p: str) -> bytes:
        got = self._pieces.get(p)
        if got is None:
            mapped = p if p.isascii() else self.bytes.pre_tokenize_str(p)[0][0]
            got = self._pieces[p] = np.array([t.id for t in self.whole.model.tokenize(mapped)], np.uint32).tobytes()
        return got

    def _part(self, part: str) -> bytes:
        if self.plain(part):
            return b"".join(map(self._piece, self.find(part)))
        return np.array(self.whole.encode(part, add_special_tokens=False).ids, np.uint32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if self.odd(text):  # letters and controls that Python lower-cases or parts otherwise
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(self._parts) > _CACHE:
            self._parts.clear()
        if len(self._pieces) > _CACHE:
            self._pieces.clear()
        parts = unicodedata.normalize("NFC", text).lower().split()
        seen = self._parts
        try:
            return np.frombuffer(b"".join([seen[p] for p in parts]), np.uint32)
        except KeyError:
            for p in parts:
                if p not in seen:
                    seen[p] = self._part(p)
        return np.frombuffer(b"".join([seen[p] for p in parts]), np.uint32)


@functools.lru_cache(2)
def _tokenizer(data: bytes) -> Tokenizer:
    return Tokenizer(data)


def powers(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def cut(ids: np.ndarray, capacity: int = CAPACITY):
    """(start, length, crc, crcs of its powers of two) of each piece of a document."""
    raw = ids.astype("<u4").tobytes()
    for at in range(0, len(ids), capacity):
        n = min(capacity, len(ids) - at)
        piece = raw[4 * at : 4 * (at + n)]
        crcs, done = [], 0
        if n < capacity:
            for p in powers(n):
                crcs.append(zlib.crc32(piece[4 * done : 4 * (done + p)]))
                done += p
        yield at, n, zlib.crc32(piece), crcs


# The plan, on the driver: lengths of the histogram only.


def sizes(lengths: np.ndarray) -> np.ndarray:
    """The class of each length: exact to 128, then steps of 1/64 of the power of two below."""
    step = np.maximum(1, 1 << np.maximum(0, np.floor(np.log2(np.maximum(lengths, 1))).astype(np.int64) - 6))
    return -(-lengths // step) * step


def knapsack(weights: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value within each capacity, and the last item taken (-1: none); items may repeat."""
    order = np.argsort(weights, kind="stable")
    w, v = weights[order], values[order]
    best, item = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(w, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        k = upto[c]
        best[c] = best[c - 1]
        if k:
            x = best[c - w[:k]] + v[:k]
            j = x.argmax()
            if x[j] > best[c] + 1e-12:
                best[c], item[c] = x[j], order[j]
    return best, item


def _pattern(weights: np.ndarray, item: np.ndarray, room: int, first: int, m: int) -> np.ndarray:
    out = np.zeros(m)
    out[first] += 1
    while room > 0:
        i = item[room]
        if i < 0:
            room -= 1
        else:
            out[i] += 1
            room -= int(weights[i])
    return out


def solve(weights: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, multiplicities) of the linear relaxation of cutting stock.

    Revised simplex with column generation: a knapsack round prices, for every
    length, the best pattern that holds it, and the best of these enter.
    """
    m = len(weights)
    each = np.maximum(1, capacity // weights).astype(float)
    basis = np.diag(each)
    inverse = np.diag(1 / each)
    x = demand / each
    for _ in range(rounds):
        dual = inverse.sum(axis=0)
        worth = np.maximum(dual, 0)
        used = np.flatnonzero(worth > 1e-12)
        if not len(used):
            break
        best, item = knapsack(weights[used], worth[used], capacity)
        back = np.where(item >= 0, used[item], -1)
        value = worth[used] + best[capacity - weights[used]]
        if value.max() < 1 + 1e-5:
            break
        better = used[np.argsort(-value)[:COLUMNS]]
        pool = np.unique(np.stack([_pattern(weights, back, int(capacity - weights[i]), int(i), m) for i in better], axis=1), axis=1)
        for _ in range(2 * COLUMNS):
            gain = inverse.sum(axis=0) @ pool - 1
            j = int(gain.argmax())
            if gain[j] < 1e-6:
                break
            d = inverse @ pool[:, j]
            able = d > 1e-9
            if not able.any():
                break
            ratio = np.full(m, np.inf)
            ratio[able] = x[able] / d[able]
            r = int(ratio.argmin())
            least = ratio[r]
            x = np.maximum(x - least * d, 0)
            x[r] = least
            row = inverse[r] / d[r]
            inverse -= np.outer(d, row)
            inverse[r] = row
            basis[:, r] = pool[:, j]
    return basis, x


def plan(weights: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, fill: float = FILL) -> list[tuple[Counter, int]]:
    """(pattern as counts by class, how often): rounded down, then the rest greedily."""
    if not len(weights):
        return []
    patterns, x = solve(weights, demand, capacity)
    out: list[tuple[Counter, int]] = []
    left = demand.astype(np.int64).copy()
    for p, times in zip(patterns.T.round().astype(np.int64), np.floor(x + 1e-6).astype(np.int64), strict=True):
        have = p > 0
        times = int(min(times, *(left[have] // p[have]))) if times and have.any() else 0
        if times and p @ weights >= fill * capacity:
            out.append((Counter({int(i): int(p[i]) for i in np.flatnonzero(p)}), times))
            left -= p * times
    # The rest is at most a pattern for each class, and classes whose patterns are wasteful.
    order = np.argsort(-weights)
    while left.any():
        p, room = np.zeros_like(left), capacity
        for i in order:
            n = min(int(left[i]), room // int(weights[i]))
            p[i], room = n, room - n * int(weights[i])
        if capacity - room < fill * capacity:
            first = order[np.flatnonzero(left[order])[0]]
            left[first] = 0  # no way to fill a sequence around it: these pieces are split
            continue
        have = p > 0
        times = int((left[have] // p[have]).min())
        out.append((Counter({int(i): int(p[i]) for i in np.flatnonzero(p)}), times))
        left -= p * times
    return out


class Places:
    """Where the pieces of each class go, by rank: intervals of ranks for each use of a pattern."""

    def __init__(self, weights: np.ndarray, patterns: list[tuple[Counter, int]]):
        self.first: dict[int, list[int]] = {}
        self.rows: dict[int, list[tuple[int, int, int]]] = {}
        used: Counter = Counter()
        sequence = 0
        for pattern, times in patterns:
            slot = 0
            for i, n in sorted(pattern.items(), key=lambda x: -int(weights[x[0]])):
                w = int(weights[i])
                self.first.setdefault(w, []).append(used[i])
                self.rows.setdefault(w, []).append((sequence, times, slot))
                used[i] += n * times
                slot += n
            sequence += times
        self.used = {int(weights[i]): n for i, n in used.items()}
        self.sequences = sequence

    def of(self, weight: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, slot) of each rank; sequence -1 where the pieces are to be split."""
        if weight not in self.first:
            return np.full(len(rank), -1), np.zeros(len(rank), np.int64)
        first, rows = np.array(self.first[weight]), np.array(self.rows[weight])
        k = np.searchsorted(first, rank, "right") - 1
        base, times, slot = rows[k].T
        within = rank - first[k]
        out = rank < self.used[weight]
        return np.where(out, base + within % times, -1), np.where(out, slot + within // times, 0)


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, crcs array<long>"


def pieces(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document, before they have a place."""
    with open(tokenizer_path, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, some megabytes

    def go(batches):
        tokenizer = _tokenizer(data.value)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(tokenizer.encode(text.as_py()), np.uint32(end))
                out += [(doc, at, n, crc, len(ids), crcs) for at, n, crc, crcs in cut(ids, capacity)]
            types = (*[pa.int64()] * 5, pa.list_(pa.int64()))
            columns = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "crcs"])

    return texts(df, id_col, text_col).mapInArrow(go, _PIECE)


def _ranked(df: DataFrame, key: str) -> DataFrame:
    """df with `rank`, from 0 without gaps within each value of `key`.

    Rows are numbered within a value and salt, and what smaller salts hold is
    added; a value with a third of all rows is SALTS groups, not one.
    """
    salted = df.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy(key, "salt").agg(F.count("*").alias("n"))
    before = counts.select(key, "salt", (F.sum("n").over(Window.partitionBy(key).orderBy("salt")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy(key, "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    # At most SALTS rows for each of some hundred values: small at any scale.
    return salted.withColumn("local", local).join(F.broadcast(before), [key, "salt"]).withColumn("rank", F.col("local") + F.col("before")).drop("salt", "local", "before")


def pack(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    Each id of a document lies in exactly one piece.  Null and empty texts are
    the end id alone.  Rows with a null id, and repeated rows, are documents of
    their own.  Sequences hold at most `capacity` ids (a power of two); offsets
    are gapless from 0.  An empty table gives an empty one; other columns are
    ignored.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    made = stage(pieces(df, tokenizer_path, capacity, end, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    whole = histogram.pop(capacity, 0)
    lengths = np.array(sorted(histogram), np.int64)
    # A class is as wide as its longest member, so that a hot length wastes nothing.
    top: dict[int, int] = {}
    for n in lengths.tolist():
        top[int(sizes(np.array([n]))[0])] = n
    class_of = {n: top[int(sizes(np.array([n]))[0])] for n in lengths.tolist()} | {capacity: capacity}
    demand = Counter()
    for n, times in histogram.items():
        demand[class_of[n]] += times
    weights = np.array(sorted(demand), np.int64)
    patterns = plan(weights, np.array([demand[int(w)] for w in weights], np.int64), capacity)
    if whole:
        weights = np.append(weights, capacity)
        patterns.append((Counter({len(weights) - 1: 1}), whole))
    places = Places(weights, patterns)
    table = made.sparkSession.createDataFrame(sorted(class_of.items()), "length long, width long")
    ranked = _ranked(made.join(F.broadcast(table), "length"), "width")

    def place(batches):
        for batch in batches:
            width, rank = batch.column("width").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = np.full(len(width), -1), np.zeros(len(width), np.int64)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                sequence[at], slot[at] = places.of(int(w), rank[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "crcs")), pa.array(sequence), pa.array(slot)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "crcs", "sequence_id", "slot"])

    placed = stage(ranked.mapInArrow(place, _PIECE + ", sequence_id long, slot long"), "placed")
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot")
    split = _split(placed.where("sequence_id < 0"), capacity, places.sequences)
    order = Window.partitionBy("sequence_id").orderBy("slot")
    both = placed.where("sequence_id >= 0").select(*columns).unionByName(split.select(*columns))
    offset = (F.sum("length").over(order) - F.col("length")).alias("offset")
    return both.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset)


def _split(rest: DataFrame, capacity: int, first: int) -> DataFrame:
    """Pieces as powers of two, capacity / power to a sequence; what is over fills sequences of powers of two."""

    def go(batches):
        for batch in batches:
            out = []
            for doc, start, length, tokens, crcs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "crcs")), strict=True):
                for p, crc in zip(powers(length), crcs, strict=True):
                    out.append((doc, start, p, crc, tokens))
                    start += p
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    parts = stage(rest.mapInArrow(go, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "parts")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row for each power
    rows, base = [], first
    for p in sorted(counts):
        n, each, rank = counts[p], capacity // p, 0
        rows.append((p, rank, n // each * each, each, base))
        rank, base = n // each * each, base + n // each
        for k in powers(n - rank):
            rows.append((p, rank, rank + k, k, base))
            rank, base = rank + k, base + 1
    table = parts.sparkSession.createDataFrame(rows, "power long, low long, high long, each long, base long")
    ranked = _ranked(parts, "length")
    met = ranked.join(F.broadcast(table), (F.col("length") == F.col("power")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    within = F.col("rank") - F.col("low")
    return met.withColumn("sequence_id", F.col("base") + F.floor(within / F.col("each")).cast("long")).withColumn("slot", within % F.col("each"))
