"""The distributed search for windows that an earlier document also holds.

Used by suffix-array dedup (windows of bytes) and substring dedup (windows of
words).  Passes, most significant digit first:

1. Every window enters at its anchor (see `windows`).  The leading bits of the
   anchor gram's hash route its run to a bucket, the next 32 order it there.
   Runs of one stretch of text that are equal throughout are settled before the shuffle:
   only those of the smallest document travel, so a passage that stands in a
   third of all rows costs one run per stretch and anchor.
2. Inside a bucket, runs are sorted by the rest of the gram's hash and by the
   hash of all bytes that the run's windows cover.  A run whose equal stands in
   a smaller document is removed as a whole.  A run whose gram no other
   document shares is done.
3. The few others, at the edges of repeats, fetch their bytes, travel by gram
   again, and a `closer` compares their windows symbol by symbol.

All traffic is linear in the input; no pass emits pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import buffers, merge_spans, partitions, rows_by, stage, stretches, texts
from siftstone.llm.windows import Rolling, mix, runs

_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word of a byte array."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = (data - np.uint8(9) > 4) & (data != 32)  # bytes below 9 wrap round
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _stretches(data: np.ndarray, unit: str, size: int, limit: int = 1 << 18):
    """(first symbol, symbols) of stretches that hold each window of a text once.

    A long text is read in stretches, so that memory does not follow its length.
    A run that a stretch ends is cut in two; its windows are then compared one
    by one where the whole run's hash finds no equal.
    """
    if unit == "byte":
        for a in range(0, max(len(data) - size + 1, 0), limit):
            yield a, _BYTE[data[a : a + limit + size - 1]]
        return
    start, stop = word_bounds(data)
    for a in range(0, max(len(start) - size + 1, 0), limit):
        s, e = start[a : a + limit + size - 1], stop[a : a + limit + size - 1]
        yield a, _hashed(data, s, e)


def _hashed(data: np.ndarray, start: np.ndarray, stop: np.ndarray, limit: int = 1 << 20) -> np.ndarray:
    """Hashes of words from all their bytes, a stretch of about `limit` bytes at a time."""
    out, a = np.empty(len(start), np.uint64), 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(stop, start[a] + limit, "right")))
        h = Rolling(_BYTE[data[start[a] : stop[b - 1]]]).of(start[a:b] - start[a], stop[a:b] - start[a])
        out[a:b] = mix(h + (stop[a:b] - start[a:b]).astype(np.uint64))
        a = b
    return out


_RUNS = "bucket int, kind int, ids binary, digit binary, body binary, at binary"
_SETTLED = "kind int, doc_id long, tag int, low int, n int, gram long"


def _firsts(key: np.ndarray, body: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sort order, where a new gram and a new run begin, and each row's smallest document."""
    order = np.lexsort((doc, body, key))
    key, body, doc = key[order], body[order], doc[order]
    new_key = np.concatenate(([True], key[1:] != key[:-1]))
    new_body = new_key | np.concatenate(([True], body[1:] != body[:-1]))
    return order, new_key, new_body, doc[np.flatnonzero(new_body)][np.cumsum(new_body) - 1]


def _parts(batch: pa.RecordBatch, limit: int = 8 << 20):
    """Stretches of a batch with about `limit` bytes of text."""
    _, offsets = buffers(batch.column("text"))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def _scan(unit: str, size: int, gram: int, bits: int):
    def scan(batches):
        for batch in batches:
            for part in _parts(batch):
                yield from settle(part)

    def settle(batch):
        ids, tags = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        data, offsets = buffers(batch.column(1))
        keys, bodies, ats, rows = [], [], [], []
        for i in range(len(ids)):
            if offsets[i + 1] - offsets[i] < size:
                continue
            for first, v in _stretches(data[offsets[i] : offsets[i + 1]], unit, size):
                rolling = Rolling(v)
                low, high, anchor, h = runs(rolling, len(v), size, gram)
                bodies.append(mix(rolling.of(low, high + size)) ^ mix((anchor - low + 1).astype(np.uint64)))
                keys.append(h)
                ats.append(((low + first).astype(np.uint64) << np.uint64(32)) | np.uint64(int(tags[i]) << 8) | (high - low).astype(np.uint64))
                rows.append(np.full(len(h), ids[i]))
        if not keys:
            return
        key, body, at, doc = map(np.concatenate, (keys, bodies, ats, rows))
        key >>= np.uint64(32 - bits)
        order, _, _, least = _firsts(key, body, doc)
        key, body, at, doc = key[order], body[order], at[order], doc[order]
        gone = doc > least
        out = []
        for kind, rows_of in ((1, ~gone), (0, gone)):
            k, b, a, d = (x[rows_of] for x in (key, body, at, doc))
            whole = kind == 1
            for bucket, s in stretches((k >> np.uint64(32)).astype(np.int64)):
                digit = (k[s] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() if whole else b""
                out.append((bucket, kind, d[s].tobytes(), digit, b[s].tobytes() if whole else b"", a[s].tobytes()))
        names = ("bucket", "kind", "ids", "digit", "body", "at")
        types = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
        for x in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[x : x + 64], strict=True), types, strict=True)], names)

    return scan


def _settled(kind: int, doc, at, key) -> pa.RecordBatch:
    n = len(doc)
    columns = [
        pa.array(np.full(n, kind, np.int32)), pa.array(doc.astype(np.int64)), pa.array(((at >> np.uint64(8)) & np.uint64(0xFFFFFF)).astype(np.int32)),
        pa.array((at >> np.uint64(32)).astype(np.int32)), pa.array((at & np.uint64(255)).astype(np.int32)), pa.array(key.astype(np.int64)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["kind", "doc_id", "tag", "low", "n", "gram"])


def _settle(batches):
    for bucket, parts in rows_by(batches, "bucket"):
        got = {0: [], 1: []}
        for part in parts:
            for kind, ids, digit, body, at in zip(*(part.column(c).to_pylist() for c in ("kind", "ids", "digit", "body", "at")), strict=True):
                got[kind].append((np.frombuffer(ids, np.int64), np.frombuffer(digit, np.uint32), np.frombuffer(body, np.uint64), np.frombuffer(at, np.uint64)))
        for ids, _, _, at in got[0]:
            yield _settled(0, ids, at, np.zeros(len(ids)))
        if not got[1]:
            continue
        doc, digit, body, at = (np.concatenate(x) for x in zip(*got[1], strict=True))
        order, new_key, new_body, least = _firsts(digit, body, doc)
        doc, digit, body, at = doc[order], digit[order], body[order], at[order]
        gone = doc > least
        heads = np.flatnonzero(new_key)
        group = np.cumsum(new_key) - 1
        shared = (np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)) & (np.add.reduceat(new_body.astype(np.int64), heads) > 1)
        yield _settled(0, doc[gone], at[gone], np.zeros(int(gone.sum())))
        open_ = ~gone & shared[group]
        yield _settled(1, doc[open_], at[open_], (digit[open_].astype(np.int64) | (bucket << 32)))


def _fetch(unit: str, size: int):
    """Cuts the bytes of open runs out of their documents."""

    def fetch(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            ids, tags = batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist()
            runs_of = batch.column("runs").to_pylist()
            out = {k: [] for k in ("doc_id", "tag", "low", "gram", "content")}
            for i, mine in enumerate(runs_of):
                text = data[offsets[i] : offsets[i + 1]]
                start, stop = word_bounds(text) if unit == "word" else (None, None)
                whole = text.tobytes()
                for run in mine:
                    a, b = run["low"], run["low"] + run["n"] + size
                    a, b = (int(start[a]), int(stop[b - 1])) if unit == "word" else (a, b)
                    for k, v in (("doc_id", ids[i]), ("tag", tags[i]), ("low", run["low"]), ("gram", run["gram"]), ("content", whole[a:b])):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["tag"], pa.int32()), pa.array(out["low"], pa.int32()), pa.array(out["gram"], pa.int64()), pa.array(out["content"], pa.binary())], list(out))

    return fetch


def tagged(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tag): the tag tells rows of one doc_id apart."""
    return docs.withColumn("tag", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFF)).cast("int"))


def repeated_spans(docs: DataFrame, unit: str, size: int, gram: int, closer) -> DataFrame:
    """(doc_id, tag, spans array<struct<low, high>>) of stretches to remove.

    `closer` is an Arrow map over (bucket, doc_id, tag, low, gram, content),
    sorted by gram and doc_id, giving (doc_id, tag, low, high).
    """
    spark = docs.sparkSession
    n = partitions(spark)
    bits = min(30, max(4, int(np.ceil(np.log2(4 * n)))))  # buckets grow with the partitions
    if not 0 < gram <= size or size - gram > 255:
        raise ValueError("a gram is no longer than a window, and shorter by 255 symbols at most")
    base = tagged(docs).where("doc_id is not null")
    found = base.mapInArrow(_scan(unit, size, gram, bits), _RUNS).repartition(n, "bucket").sortWithinPartitions("bucket")
    settled = stage(found.mapInArrow(_settle, _SETTLED), "settled", release=True)
    opened = settled.where("kind = 1").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("low", "n", "gram")).alias("runs"))
    content = base.join(opened.hint("shuffle_hash"), ["doc_id", "tag"]).mapInArrow(_fetch(unit, size), "doc_id long, tag int, low int, gram long, content binary")
    edges = stage(content.repartition(n, "gram").sortWithinPartitions("gram", "doc_id").mapInArrow(closer, "doc_id long, tag int, low int, high int"), "edges", release=True)
    whole = settled.where("kind = 0").select("doc_id", "tag", "low", (F.col("low") + F.col("n") + size).alias("high"))
    return whole.unionByName(edges).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every row of docs with the spans to remove from it (null: none)."""
    return tagged(docs).join(spans.hint("shuffle_hash"), ["doc_id", "tag"], "left")


def union_of(spans) -> tuple[np.ndarray, np.ndarray]:
    if not spans:
        z = np.zeros(0, np.int64)
        return z, z
    low = np.fromiter((s["low"] for s in spans), np.int64, len(spans))
    return merge_spans(low, np.fromiter((s["high"] for s in spans), np.int64, len(spans)))


def prepared(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts(df, id_col, text_col)


def cut_rows(df: DataFrame, spans: DataFrame, left, id_col: str, text_col: str) -> DataFrame:
    """df with `left(text, spans)` in place of each text that has spans."""
    whole = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*df.columns).alias("row"))
    joined = with_spans(whole, spans)

    def go(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            kept = [None if s is None else left(data[offsets[i] : offsets[i + 1]].tobytes(), s).decode() for i, s in enumerate(batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string())], ["row", "kept"])

    row = joined.schema["row"].dataType.simpleString()
    cut = joined.select("text", "spans", "row").mapInArrow(go, f"row {row}, kept string")
    return cut.select(*[F.coalesce("kept", F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns])
