"""Line dedup by an exact set-similarity join.

A line is the set of its words, ASCII letters lower-cased.  Two lines match if
the Jaccard similarity of their sets reaches the threshold; a line goes if an
earlier line (by doc_id, then line number) matches it.

The join orders the words of a line by rarity and reads only a prefix, as
prefix filters do.  Its keys are not single words but neighbours in that order:
of a matching pair, each word that one side lacks can part one pair of
neighbours at most, so some two common words are neighbours on both sides
within the first 2a + b + 2 words, where a and b are what the sides may lack.
Such a key is far more selective than a word, and lists of partners stay short
though the corpus grows.  Words that occur once in the corpus match nothing;
they shorten the prefix, and a line with too many of them has no partner.
Length, position and bitmap filters cut the rest before the sets are compared.

Equal sets are one node, so copies of a line cost nothing beyond themselves.
The sets that share a key and pass the filters form a group; equal groups are
one.  Each set travels once to each of its groups, is compared there, and gives
one row: how many others it matches, and the earliest one before it.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import buffers, partitions, rows_by, stage, stretches, texts
from siftstone.llm.repeats import word_bounds
from siftstone.llm.windows import mix

THRESHOLD = Fraction(4, 5)
COUNTERS = 1 << 22  #: rarity counters, a byte each: all that is broadcast of the corpus
SLICES = 64
HEAVY = 1 << 18  #: lines of a key beyond which several tasks share it
ROOM = 8 << 20  #: bytes of text of a group that one task compares
FILTER = 1 << 23  #: bits of the filter that fetches candidate lines
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, from their first and last eight bytes and length; long words are hashed whole."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    n = stop - start
    head = eight[start] & _MASK[np.minimum(n, 8)]
    tail, long = head.copy(), np.flatnonzero(n >= 8)
    tail[long] = eight[stop[long] - 8]
    h = mix(head * np.uint64(0x9E3779B97F4A7C15) ^ mix(tail + n.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    for i in np.flatnonzero(n > 16).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : stop[i]].tobytes())
    return h


def _by_line_and_rarity(hashes: np.ndarray, rank: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The order by line, rank and hash, from one sort of 64-bit keys where these tell the words apart."""
    if len(line) and line[-1] < 1 << 20:
        key = (line.astype(np.uint64) << np.uint64(44)) | (rank.astype(np.uint64) << np.uint64(36)) | (hashes >> np.uint64(28))
        order = np.argsort(key)
        key, sorted_ = key[order], hashes[order]
        if not ((key[1:] == key[:-1]) & (sorted_[1:] != sorted_[:-1])).any():
            return order
    return np.lexsort((hashes, rank, line))


class Lines:
    """The lines of a few texts: their distinct words, ordered by line and rarity."""

    def __init__(self, parts: list[bytes], counters: np.ndarray | None = None):
        whole = b"\n".join(parts)
        data = np.frombuffer(whole, np.uint8)
        start, stop = word_bounds(data)
        hashes = word_hashes(np.frombuffer(whole.translate(_LOWER), np.uint8), start, stop)
        if counters is None:
            self.hashes = hashes
            return
        ends = np.concatenate((np.flatnonzero(data == 10), [len(data)]))
        self.begins = np.concatenate(([0], ends[:-1] + 1))
        self.ends = ends
        # Which text a line belongs to: texts end where their lengths say, not at any line end.
        stops = np.cumsum([len(p) + 1 for p in parts])
        self.text = np.searchsorted(stops, self.begins, "right")
        self.number = np.arange(len(ends)) - np.searchsorted(self.text, self.text)
        self.data = data
        line = np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(start, ends), prepend=0))
        count = counters[(hashes >> np.uint64(64 - 22)).view(np.int64)]
        order = _by_line_and_rarity(hashes, count, line)
        hashes, line, count = hashes[order], line[order], count[order]
        new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1]))) if len(line) else np.zeros(0, bool)
        self.hashes, self.line, self.rank = hashes[new], line[new], count[new]
        self.once = self.rank == 1
        n = len(ends)
        self.words = np.bincount(self.line, minlength=n)
        self.lonely = np.bincount(self.line[self.once], minlength=n)
        sums = []
        for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
            total = np.concatenate(([np.uint64(0)], np.cumsum(mix(self.hashes ^ np.uint64(salt)))))
            at = np.concatenate(([0], np.cumsum(self.words)))
            sums.append(mix(total[at[1:]] - total[at[:-1]] + self.words.astype(np.uint64)))
        self.set, self.check = sums
        # A bitmap of 64 bits for each line: two lines differ in no more bits than in words.
        self.sketch = np.zeros(n, np.uint64)
        have = np.flatnonzero(self.words)
        if len(have):
            self.sketch[have] = np.bitwise_or.reduceat(np.uint64(1) << (self.hashes & np.uint64(63)), at[:-1][have])

    def keys(self, threshold: Fraction):
        """(key, set, words, lonely words, position, sketch, lines at most) of the neighbours in every line's prefix."""
        prefix = prefix_lengths(self.words, self.lonely, threshold)
        at = ~self.once
        h, line = self.hashes[at], self.line[at]
        first = np.searchsorted(line, np.arange(len(self.words)))
        place = np.arange(len(line)) - first[line]
        ok = np.flatnonzero((line[1:] == line[:-1]) & (place[:-1] + 2 <= prefix[line[:-1]])) if len(line) else np.zeros(0, np.int64)
        key = mix(h[ok] * np.uint64(0x9E3779B97F4A7C15) ^ mix(h[ok + 1]))
        of = line[ok]
        return key, self.set[of], self.words[of], self.lonely[of], place[ok], self.sketch[of], count_of(self.rank[at][ok])


def prefix_lengths(words: np.ndarray, lonely: np.ndarray, threshold: Fraction) -> np.ndarray:
    """How many of a line's other words its keys must cover; 0 if it can have no partner.

    With t = p/q, a line of n words, h of them lonely, and a partner that lacks
    h + a words of it and has b more, match only if q(a + h) + p b <= (q - p) n.
    """
    p, q = threshold.numerator, threshold.denominator
    room = (q - p) * words - q * lonely
    a = np.maximum(room, 0) // q
    b = (room - q * a) // p
    return np.where(room < 0, 0, 2 * a + b + 2)


def _groups(batch: pa.RecordBatch, limit: int = 1 << 19):
    """(first row, texts) of stretches of a batch with about `limit` bytes."""
    data, offsets = buffers(batch.column("text"))
    whole = data.tobytes()
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, [whole[offsets[i] : offsets[i + 1]] for i in range(a, b)]
        a = b


def rank_of(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes that keep their order: exact below 64, then 8 steps for each doubling."""
    wide = 64 + np.floor(8 * (np.log2(np.maximum(counts, 64)) - 6))
    return np.where(counts < 64, counts, np.minimum(wide, 255)).astype(np.uint8)


def count_of(rank: np.ndarray) -> np.ndarray:
    """The largest count of a rank, but for the last one, which has no bound."""
    rank = rank.astype(np.float64)
    return np.where(rank < 64, rank, 64 * np.exp2((rank - 63) / 8))


def rarity(docs: DataFrame) -> np.ndarray:
    """Ranks of the counts of all words of all texts, by COUNTERS buckets of their hash.

    Each task sends its counters as SLICES rows; slices are summed on the
    executors and the driver receives COUNTERS bytes, whatever the input.
    """
    each = COUNTERS // SLICES

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            found = [(Lines(parts).hashes >> np.uint64(64 - 22)).view(np.int64) for _, parts in _groups(batch)]
            total += np.bincount(np.concatenate(found), minlength=COUNTERS) if found else 0
        for s in range(SLICES):
            mine = total[s * each : (s + 1) * each]
            at = np.flatnonzero(mine).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([mine[at].astype(np.uint32).tobytes()], pa.binary())], ["slice", "at", "counts"])

    def add(batches):
        for s, parts in rows_by(batches, "slice"):
            total = np.zeros(each, np.int64)
            for part in parts:
                for at, counts in zip(part.column("at"), part.column("counts"), strict=True):
                    total[np.frombuffer(at.as_py(), np.uint32)] += np.frombuffer(counts.as_py(), np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([rank_of(total).tobytes()], pa.binary())], ["slice", "ranks"])

    sent = docs.select("text").mapInArrow(count, "slice int, at binary, counts binary")
    rows = sent.repartition(partitions(docs.sparkSession), "slice").sortWithinPartitions("slice").mapInArrow(add, "slice int, ranks binary").collect()
    out = np.zeros(COUNTERS, np.uint8)
    for r in rows:
        out[r["slice"] * each : (r["slice"] + 1) * each] = np.frombuffer(r["ranks"], np.uint8)
    return out


_KEYS = "bucket int, kind int, a binary, b binary, c binary, d binary"
_FOUND = "kind int, key long, id long, chk long, doc_id long, line int"
_KEY, _LINE, _LATER, _HEAVY = range(4)
_PLAIN = np.array([1 << 12, 1 << 10, 1 << 10])  # words, lonely words and position below these are packed in 32 bits
_ANY = np.uint32(0xFFFFFFFF)  # the mark of a line with more of them, which the filters let pass


def _packed(meta: np.ndarray) -> np.ndarray:
    n, h, place = meta
    return np.where((meta < _PLAIN[:, None]).all(axis=0), (n << 20) | (h << 10) | place, int(_ANY)).astype(np.uint32)


def _emit(counters, threshold: Fraction, bits: int, heavy: int):
    """Rows of four kinds: prefix keys; first lines of each set in a batch; its later lines; keys that may stand in over `heavy` lines."""

    def go(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            keys, lines = [], []
            for a, parts in _groups(batch):
                x = Lines(parts, counters.value)
                key, set_, n, h, place, sketch, most = x.keys(threshold)
                keys.append((key, set_, _packed(np.stack((n, h, place))), sketch, most))
                have = np.flatnonzero(x.words)
                lines.append((x.set[have], x.check[have], ids[a + x.text[have]].astype(np.int64), x.number[have].astype(np.int64)))
            if not keys:
                continue
            out = []
            key, set_, meta, sketch, most = map(np.concatenate, zip(*keys, strict=True))
            order = np.argsort(key)
            key, set_, meta, sketch, most = key[order], set_[order], meta[order], sketch[order], most[order]
            one = np.concatenate(([True], (key[1:] != key[:-1]) | (set_[1:] != set_[:-1]))) if len(key) else np.zeros(0, bool)
            key, set_, meta, sketch, most = key[one], set_[one], meta[one], sketch[one], most[one]
            # A key of which no task may hold all rows is dealt by its sets too, over buckets of its own.
            wide = most > heavy
            salt = set_[wide] % np.ceil(most[wide] / heavy).astype(np.uint64)
            spot = ((mix(key[wide] + salt * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)) + (1 << bits)
            order = np.argsort(spot, kind="stable")
            for b, s in stretches(spot[order]):
                at = np.flatnonzero(wide)[order[s]]
                out.append((b, _HEAVY, key[at].tobytes(), set_[at].tobytes(), b"", b""))
            key, set_, meta, sketch = key[~wide], set_[~wide], meta[~wide], sketch[~wide]
            key >>= np.uint64(32 - bits)  # the bucket, and 32 bits more: a chance match costs a verification
            for b, s in stretches((key >> np.uint64(32)).astype(np.int64)):
                out.append((b, _KEY, (key[s] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), set_[s].tobytes(), sketch[s].tobytes(), meta[s].tobytes()))
            set_, check, doc, number = map(np.concatenate, zip(*lines, strict=True))
            order = np.lexsort((number, doc, check, set_))
            set_, check, doc, number = set_[order], check[order], doc[order], number[order].astype(np.uint32)
            first = np.concatenate(([True], (set_[1:] != set_[:-1]) | (check[1:] != check[:-1]))) if len(set_) else np.zeros(0, bool)
            for kind, which in ((_LINE, first), (_LATER, ~first)):
                mine = [v[which] for v in (doc, set_, check, number)]
                # A later line is known to go: it need not meet the set's other lines in one place.
                spot = mine[1] if kind == _LINE else mix(mine[0].view(np.uint64))
                order = np.argsort(spot, kind="stable") if kind == _LATER else np.arange(len(spot))
                for b, s in stretches((spot[order] >> np.uint64(64 - bits)).astype(np.int64)):
                    out.append((b, kind, *(v[order[s]].tobytes() for v in mine)))
            types = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
            for i in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out[i : i + 64], strict=True), types, strict=True)], ["bucket", "kind", "a", "b", "c", "d"])

    return go


def _met(kind: int, key=None, id_=None, chk=None, doc=None, line=None) -> pa.RecordBatch:
    n = len(id_)
    zero = np.zeros(n, np.int64)
    long = lambda v: pa.array(zero if v is None else np.ascontiguousarray(v).view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), long(key), long(id_), long(chk), long(doc), pa.array((zero if line is None else line).astype(np.int32))], ["kind", "key", "id", "chk", "doc_id", "line"])


def _near(meta, sketch, i, j, threshold: Fraction) -> np.ndarray:
    """Whether the sets i and j (index arrays) pass the length, position and bitmap filters."""
    p, q = threshold.numerator, threshold.denominator
    n, place = meta >> 20, meta & 1023
    rest = n - ((meta >> 10) & 1023) - place
    words = n[i] + n[j]
    common = np.minimum(place[i], place[j]) + np.minimum(rest[i], rest[j])
    ok = (common * (p + q) >= p * words) & (np.bitwise_count(sketch[i] ^ sketch[j]) <= words - 2 * -(-p * words // (p + q)))
    return ok | (meta[i] == int(_ANY)) | (meta[j] == int(_ANY))


def partnered(heads: np.ndarray, meta: np.ndarray, sketch: np.ndarray, threshold: Fraction, small: int = 48, most: int = 4096) -> np.ndarray:
    """Which sets pass the filters with another one of their key; all of a key with over `most` sets.

    The sets of a key stand together and begin at `heads`.  Keys of at most
    `small` sets are all compared at once, at one distance after another.
    """
    meta = meta.astype(np.int64)
    ends = np.concatenate((heads[1:], [len(meta)]))
    size = ends - heads
    found = np.repeat(size > most, size)
    each, left = np.repeat(size, size), np.repeat(ends, size) - np.arange(len(meta))
    for d in range(1, min(small, int(size.max(initial=1)))):
        i = np.flatnonzero((each <= small) & (left > d))
        ok = _near(meta, sketch, i, i + d, threshold)
        found[i[ok]] = found[i[ok] + d] = True
    for a, b in zip(heads[(size > small) & (size <= most)].tolist(), ends[(size > small) & (size <= most)].tolist(), strict=True):
        for x in range(a, b, 256):
            todo, near = a + np.flatnonzero(~found[a:b]), np.arange(x, min(x + 256, b))
            ok = _near(meta, sketch, todo[:, None], near, threshold) & (todo[:, None] != near)
            found[todo] = ok.any(axis=1)
    return found


def _meet(threshold: Fraction):
    """Groups of sets that may match (kind _KEY), the first line of each set (_LINE), and all later lines (_LATER).

    A group's key is the hash of its members, so that keys which the same sets
    share make one group.
    """

    def go(batches):
        for bucket, parts in rows_by(batches, "bucket"):
            got, lines = [], []
            for part in parts:
                for kind, a, b, c, d in zip(*(part.column(x) for x in ("kind", "a", "b", "c", "d")), strict=True):
                    kind, a, b, c, d = kind.as_py(), a.as_buffer(), b.as_buffer(), c.as_buffer(), d.as_buffer()
                    if kind == _KEY:
                        got.append((np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint64), np.frombuffer(c, np.uint64), np.frombuffer(d, np.uint32)))
                    elif kind == _HEAVY:
                        yield _met(_KEY, np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))
                    else:
                        mine = np.frombuffer(a, np.int64), np.frombuffer(b, np.uint64), np.frombuffer(c, np.uint64), np.frombuffer(d, np.uint32)
                        if kind == _LINE:
                            lines.append(mine)
                        else:
                            yield _met(_LATER, None, *mine[1:3], mine[0], mine[3])
            if lines:
                doc, set_, check, number = map(np.concatenate, zip(*lines, strict=True))
                order = np.lexsort((number, doc, check, set_))
                doc, set_, check, number = doc[order], set_[order], check[order], number[order]
                first = np.concatenate(([True], (set_[1:] != set_[:-1]) | (check[1:] != check[:-1])))
                for kind, which in ((_LINE, first), (_LATER, ~first)):
                    yield _met(kind, None, set_[which], check[which], doc[which], number[which])
            if not got:
                continue
            key, set_, sketch, meta = map(np.concatenate, zip(*got, strict=True))
            del got, lines
            order = np.argsort((key.astype(np.uint64) << np.uint64(32)) | (set_ >> np.uint64(32)))
            key, set_, sketch, meta = key[order], set_[order], sketch[order], meta[order]
            one = np.concatenate(([True], (key[1:] != key[:-1]) | (set_[1:] != set_[:-1])))
            key, set_, sketch, meta = key[one], set_[one], sketch[one], meta[one]
            heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            group = np.repeat(np.arange(len(heads)), np.diff(np.concatenate((heads, [len(key)]))))
            live = partnered(heads, meta, sketch, threshold)
            if not live.any():
                continue
            members, group = set_[live], group[live]
            heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            sizes = np.diff(np.concatenate((heads, [len(group)])))
            names = mix(np.add.reduceat(mix(members ^ np.uint64(0xA4093822299F31D0)), heads) + sizes.astype(np.uint64))
            _, one = np.unique(names, return_index=True)
            kept = np.repeat(np.isin(np.arange(len(heads)), one), sizes)
            yield _met(_KEY, np.repeat(names, sizes)[kept], members[kept])

    return go


def _contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, line, id, chk, w) of the lines in `wanted` and a few others: what passes a filter of FILTER bits."""
    spot = F.pmod(F.xxhash64("doc_id", "line"), F.lit(FILTER))
    bits = wanted.select((spot / 64).cast("long").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id, line), {FILTER}) % 64 as int))").alias("bit"))
    words = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # FILTER / 64 rows at most
    blocks = docs.sparkSession.createDataFrame(words) if words.num_rows else docs.sparkSession.createDataFrame([], "word long, bits long")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    hit = F.expr(f"(shiftright(bits, cast(pmod(xxhash64(doc_id, line), {FILTER}) % 64 as int)) & 1) = 1")
    kept = lines.withColumn("word", (spot / 64).cast("long")).join(F.broadcast(blocks), "word").where(hit)
    low = F.translate("content", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return kept.select("doc_id", "line", low.alias("content")).mapInArrow(_known, "doc_id long, line int, id long, chk long, w binary")


def _known(batches):
    """(doc_id, line, id, chk, w): the set of each line and its text, packed before it is shuffled."""
    for batch in batches:
        text = [w.encode() for w in batch.column("content").to_pylist()]
        x = Lines(text, np.zeros(COUNTERS, np.uint8)) if text else None
        sets = (x.set.view(np.int64), x.check.view(np.int64)) if text else (np.zeros(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("line"), *map(pa.array, sets), pa.array([zlib.compress(w, 1) for w in text], pa.binary())], ["doc_id", "line", "id", "chk", "w"])


class _Lists:
    """Lists of small integers, end to end; each begins with a 0 that nothing else is."""

    def __init__(self, lists: list[list[int]]):
        self.at = np.concatenate(([0], np.cumsum([len(x) + 1 for x in lists])))
        self.flat = np.zeros(self.at[-1], np.int64)
        for a, x in zip(self.at.tolist(), lists, strict=False):
            self.flat[a + 1 : a + 1 + len(x)] = x
        self.mark = np.zeros(int(self.flat.max(initial=0)) + 1, np.int32)

    def common(self, mine: list[int], n: int) -> np.ndarray:
        """How many of `mine` each of the first n lists holds."""
        known = [x for x in mine if x < len(self.mark)]
        self.mark[known] = 1
        found = np.add.reduceat(self.mark[self.flat[: self.at[n]]], self.at[:n])
        self.mark[known] = 0
        return found


def compare(side: list[int], smaller: list[list[int]], words: list[bytes], threshold: Fraction) -> tuple[list[int], list[int]]:
    """(links, earliest earlier match or -1) of each row of a group, whose rows are in order of place.

    Rows of side 2 meet each other, rows of side 0 meet those of side 1.  A
    pair counts in the least of the groups that it shares, and in no other:
    only pairs that share none of their `smaller` groups are compared.
    """
    p, q = threshold.numerator, threshold.denominator
    m = len(side)
    links, first = [0] * m, [-1] * m
    sets: list[set | None] = [None] * m

    def of(i: int) -> set:
        found = sets[i]
        if found is None:
            found = sets[i] = set(words[i].split())
        return found

    def found(i: int, j: int) -> None:
        links[i] += 1
        links[j] += 1
        later, earlier = (i, j) if i > j else (j, i)
        if first[later] < 0 or earlier < first[later]:
            first[later] = earlier

    def alike(i: int, j: int) -> bool:
        a, b = of(i), of(j)
        n = p * (len(a) + len(b))
        return n <= (p + q) * min(len(a), len(b)) and len(a & b) * (p + q) >= n

    both = all(x == 2 for x in side)
    refs = list(range(m)) if both else [i for i in range(m) if side[i] == 0]
    asks = range(m) if both else [i for i in range(m) if side[i] == 1]
    if m == 1:
        return links, first
    if m <= 12:
        below = [frozenset(x) for x in smaller]
        for i in asks:
            for j in refs[:i] if both else refs:
                if below[i].isdisjoint(below[j]) and alike(i, j):
                    found(i, j)
        return links, first
    number: dict = {}
    below = [[number.setdefault(k, len(number) + 1) for k in x] for x in smaller]
    kept, held = _Lists([below[j] for j in refs]), None
    for i in asks:
        n = i if both else len(refs)
        open_ = np.flatnonzero(kept.common(below[i], n) == 0) if n and below[i] else np.arange(n)
        if held is None and len(open_) > 12:
            of_word: dict = {}
            numbered = [[of_word.setdefault(w, len(of_word) + 1) for w in of(j)] for j in range(m)]
            held, sizes = _Lists([numbered[j] for j in refs]), np.array([len(of(j)) for j in refs], np.int64)
        if len(open_) > 12:
            near = open_[(held.common(numbered[i], n) * (p + q) >= p * (sizes[:n] + len(of(i))))[open_]].tolist()
        else:
            near = [j for j in open_.tolist() if alike(i, refs[j])]
        for j in near:
            found(i, refs[j])
    return links, first


def _needed(most: int = 1 << 16):
    """The rows (id, key) of sets that must be compared in a group: some other one of it shares no smaller group with them.

    Rows come sorted by key.  Of a group of over `most` sets all are needed.
    """

    def needed(smaller: list) -> list[bool]:
        m = len(smaller)
        out = [False] * m
        if m > 64:
            number: dict = {}
            below = [[number.setdefault(k, len(number) + 1) for k in x] for x in smaller]
            lists = _Lists(below)
            # Sets that share the most common smaller group are not apart: one of two that are lacks it.
            lacks = np.ones(m, bool)
            if number:
                usual = np.bincount(lists.flat)[1:].argmax() + 1
                lacks = np.add.reduceat((lists.flat == usual).astype(np.int32), lists.at[:-1]) == 0
            for i in np.flatnonzero(lacks).tolist():
                apart = np.flatnonzero(lists.common(below[i], m) == 0)
                apart = apart[apart != i].tolist()
                for j in apart:
                    out[j] = True
                out[i] |= bool(apart)
            return out
        sets = [frozenset(x) for x in smaller]
        for i in range(m):
            for j in range(m) if not out[i] else ():
                if j != i and sets[i].isdisjoint(sets[j]):
                    out[i] = out[j] = True
                    break
        return out

    def go(batches):
        key, ids, smaller, wide = None, [], [], False
        for batch in batches:
            done_id, done_key = [], []

            def close():
                if not wide and len(ids) > 1:
                    mine = [i for i, x in zip(ids, needed(smaller), strict=True) if x]
                    done_id.extend(mine)
                    done_key.extend([key] * len(mine))

            for k, i, s in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "smaller")), strict=True):
                if k != key:
                    close()
                    key, ids, smaller, wide = k, [], [], False
                if not wide:
                    ids.append(i)
                    smaller.append(s)
                    if len(ids) > most:
                        done_id.extend(ids)
                        done_key.extend([key] * len(ids))
                        ids, smaller, wide = [], [], True
                else:
                    done_id.append(i)
                    done_key.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(done_id, pa.int64()), pa.array(done_key, pa.int64())], ["id", "key"])
        if not wide and len(ids) > 1:
            mine = [i for i, x in zip(ids, needed(smaller), strict=True) if x]
            yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int64()), pa.array([key] * len(mine), pa.int64())], ["id", "key"])

    return go


def _verify(threshold: Fraction):
    """Compares the sets of each group; one row for each set and group in which it has a link."""

    def go(batches):
        group: list = []
        for batch in batches:
            out: list = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("grp", "side", "id", "chk", "doc_id", "line", "smaller", "w")), strict=True):
                if group and group[0][0] != row[0]:
                    out += settled(group)
                    group = []
                group.append(row)
            yield made(out)
        if group:
            yield made(settled(group))

    def settled(group):
        if len(group) > 1:  # a repeated row has its set twice
            group = list({(r[1], r[2], r[3]): r for r in reversed(group)}.values())[::-1]
        _, side, id_, chk, doc, line, smaller, w = zip(*group, strict=True)
        links, first = compare(side, smaller, [zlib.decompress(x) for x in w], threshold)
        return [(id_[i], chk[i], n, doc[f] if f >= 0 else None, line[f] if f >= 0 else None) for i, (n, f) in enumerate(zip(links, first, strict=True)) if n]

    def made(out):
        columns = zip(*out, strict=True) if out else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["id", "chk", "n", "doc_id", "line"])

    return go


def links(docs: DataFrame, threshold: Fraction = THRESHOLD, heavy: int = HEAVY, room: int = ROOM) -> tuple[DataFrame, DataFrame]:
    """(sets, later): each distinct set with its first line and its links, and every line that an equal one precedes.

    sets: id, chk, doc_id and line of the first line, n_links (distinct other
    sets that match), and `before`, the place of the earliest matching line
    that precedes it (null: none).  later: id, chk, doc_id, line.

    No row stands for a pair: a set travels once to each group of candidates,
    and one row for each set and group comes back.  Keys that may stand in more
    than `heavy` lines are dealt over several tasks; groups of more than `room`
    bytes are cut into parts, and each two parts meet in a task.
    """
    if not Fraction(2, 3) < threshold <= 1:
        raise ValueError("neighbours are complete keys for thresholds over 2/3 only")
    spark = docs.sparkSession
    counters = spark.sparkContext.broadcast(rarity(docs))
    n = partitions(spark)
    bits = max(4, int(np.ceil(np.log2(4 * n))))
    met = docs.where("doc_id is not null").mapInArrow(_emit(counters, threshold, bits, heavy), _KEYS).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(threshold), _FOUND)
    found = stage(met, "found", release=True)
    sets = found.where(F.col("kind") == _LINE).select("id", "chk", "doc_id", "line")
    groups = stage(found.where(F.col("kind") == _KEY).groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys")), "groups")
    placed = groups.select("id", F.posexplode("keys").alias("pos", "key"), "keys").select("id", "key", F.slice("keys", F.lit(1), F.col("pos")).alias("smaller"))
    need = placed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_needed(), "id long, key long").groupBy("id").agg(F.collect_list("key").alias("need"))
    wanted = stage(sets.join(groups.join(need.hint("shuffle_hash"), "id"), "id"), "wanted", release=True)
    # Rows of one doc_id may hold several texts: the line is that whose words are the set's.
    full = stage(wanted.join(_contents(docs, wanted), ["doc_id", "line", "id", "chk"]), "candidates", release=True)
    large = stage(full.select(F.explode("need").alias("key"), (2 * F.octet_length("w")).alias("n")).groupBy("key").agg((F.sum("n") / room).cast("long").alias("more")).where("more > 0"), "large_groups")
    rows = full.select(F.explode("need").alias("key"), "*").withColumn("smaller", F.filter("keys", lambda k: k < F.col("key"))).drop("keys", "need")
    if large.isEmpty():
        dealt = rows.withColumns({"grp": F.col("key"), "side": F.lit(2)})
    else:
        parted = rows.join(large, "key", "left").withColumn("more", F.coalesce("more", F.lit(0))).withColumn("part", F.pmod(F.xxhash64("id", "chk"), F.col("more") + 1))
        each = parted.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "more")))
        grp = F.when(F.col("more") == 0, F.col("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
        dealt = each.withColumns({"grp": grp, "side": F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1)})
    dealt = dealt.select("grp", "side", "id", "chk", "doc_id", "line", "smaller", "w").repartition(n, "grp").sortWithinPartitions("grp", "doc_id", "line")
    place = "id long, chk long, n long, doc_id long, line int"
    per = stage(dealt.mapInArrow(_verify(threshold), place).groupBy("id", "chk").agg(F.sum("n").alias("n_links"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "line"))).alias("before")), "set_links", release=True)
    joined = sets.join(per.hint("shuffle_hash"), ["id", "chk"], "left")
    return joined.withColumn("n_links", F.coalesce("n_links", F.lit(0))), found.where(F.col("kind") == _LATER).select("id", "chk", "doc_id", "line")


def verdicts(docs: DataFrame, threshold: Fraction = THRESHOLD, heavy: int = HEAVY, room: int = ROOM) -> DataFrame:
    """(doc_id, gone array<int>, n_links, match) for documents with a matched line."""
    sets, later = links(docs, threshold, heavy, room)
    first = sets.where("n_links > 0").select("doc_id", F.when(F.col("before").isNotNull(), F.col("line")).alias("line"), "n_links", F.col("before.doc_id").alias("match"))
    of = sets.select("id", "chk", "n_links", F.coalesce("before.doc_id", "doc_id").alias("match"), F.col("doc_id").alias("first_doc"), F.col("line").alias("first_line"))
    again = (F.col("doc_id") == F.col("first_doc")) & (F.col("line") == F.col("first_line"))  # a repeated row's line is no later line
    rest = later.join(of, ["id", "chk"]).where(~again).select("doc_id", "line", "n_links", "match")
    return first.unionByName(rest).groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("gone"), F.sum("n_links").alias("n_links"), F.min("match").alias("match"))


def _kept(text: str, gone) -> str:
    if not gone:
        return text
    gone = set(gone)
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def dedup(df: DataFrame, threshold: Fraction = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, n_links, class_id, kept_sha256) of each row.

    Lines are parted by line feeds.  n_links counts, over the document's lines,
    the distinct other word sets that match; class_id is the smallest doc_id
    that holds an earlier match of one of its lines, else its own.  A line
    without words matches nothing and stays.  Null texts are empty (one line).
    Rows with a null id neither lose nor remove lines.  Rows that share an id
    are one document: a line number removed in one is removed in all of them.
    An empty table gives an empty one; other columns are ignored.
    """
    docs = texts(df, id_col, text_col)
    joined = docs.join(verdicts(docs, threshold).hint("shuffle_hash"), "doc_id", "left")

    def go(batches):
        for batch in batches:
            out = []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                n = text.count("\n") + 1
                out.append((n, sum(g < n for g in gone or ()), hashlib.sha256(_kept(text, gone).encode()).hexdigest()))
            n, r, sha = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_links", "class_id")), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_links", "class_id", "n_lines", "n_removed", "kept_sha256"])

    found = joined.select("doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.least("match", "doc_id").alias("class_id"), "text", "gone")
    return found.mapInArrow(go, "doc_id long, n_links long, class_id long, n_lines long, n_removed long, kept_sha256 string")


def remove(df: DataFrame, threshold: Fraction = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without matched lines in their texts; all columns stay."""
    docs = texts(df, id_col, text_col)
    gone = verdicts(docs, threshold).where(F.size("gone") > 0).select(F.col("doc_id").alias("_of"), "gone")
    base = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).cast("long").alias("_id"))
    joined = base.join(gone.hint("shuffle_hash"), F.col("_id") == F.col("_of"), "left")
    lines = F.split(F.col("row")[text_col], "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row")[text_col]).otherwise(left)
    return joined.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns])
