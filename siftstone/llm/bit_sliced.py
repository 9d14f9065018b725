"""Exact top-k by inner product over a bit-sliced index.

The index is a stored table of blocks.  A block of vectors keeps, for each
component, its quantised values as bit slices: one bitmap over the block's rows for every binary digit.  A query adds
the slices of all components, each weighted by the query's component, with
bitmap full adders; the sum is again a set of slices.  Rows are selected from
the most significant slice of the sum downward.  Quantisation moves a score by
a known amount at most, so the rows within that margin of the k-th one are
resolved by their exact scores, and the result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.common import partitions, stage

K = 10
SCALE = 1024
BITS = 6  #: slices of a quantised component
ROWS = 1 << 16  #: rows of a block at most
QUERIES = 4_096  #: queries of a block of queries at most


def quantise(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component; an error where that leaves 62 bits."""
    levels = np.floor(scale * vectors.astype(np.float64))
    if levels.size and np.abs(levels).max() >= 2.0**62:
        raise OverflowError("a component's level does not fit 62 bits")
    return levels.astype(np.int64)


def _pack(bits: np.ndarray) -> np.ndarray:
    """(..., rows) booleans as 64-bit words."""
    return np.ascontiguousarray(np.packbits(bits, axis=-1, bitorder="little")).view(np.uint64)


class Block:
    """Up to ROWS vectors of one length: their slices, and the values that resolve boundary rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, slices: np.ndarray, shift: int):
        self.ids, self.values, self.slices, self.shift = ids, values, slices, shift
        self.rows, self.dims = values.shape
        self.bits = slices.shape[1]
        self.all = _pack(np.arange(64 * slices.shape[2]) < self.rows)
        self.most = int(np.abs(values).max(initial=0))

    @classmethod
    def of(cls, ids: np.ndarray, values: np.ndarray, bits: int = BITS) -> Block:
        """Slices the values: each component's distance from its least one, without the lowest digits beyond `bits`."""
        n, dims = values.shape
        base = values.min(axis=0)
        width = int((values.max(axis=0) - base).max()).bit_length()
        shift = max(0, width - bits)
        level = np.zeros((-(-n // 64) * 64, dims), np.int64)
        level[:n] = (values - base) >> shift
        return cls(ids, values, _pack(((level.T[:, None, :] >> np.arange(max(1, min(bits, width)))[:, None]) & 1).astype(bool)), shift)

    def row(self) -> tuple:
        return self.dims, self.rows, self.shift, self.bits, self.ids.tobytes(), self.slices.tobytes(), self.values.tobytes()

    @classmethod
    def read(cls, dims: int, rows: int, shift: int, bits: int, ids: bytes, slices: bytes, values: bytes) -> Block:
        return cls(np.frombuffer(ids, np.int64), np.frombuffer(values, np.int64).reshape(rows, dims), np.frombuffer(slices, np.uint64).reshape(dims, bits, -1), shift)

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of the sum over components of |q| times the level (its complement where q < 0)."""
        columns: list[list[np.ndarray]] = []

        def put(weight: int, bitmap: np.ndarray) -> None:
            while len(columns) <= weight:
                columns.append([])
            columns[weight].append(bitmap)

        for d, q in enumerate(query.tolist()):
            slices = self.slices[d] if q > 0 else ~self.slices[d]
            m, k = abs(q), 0
            while m:
                if m & 1:
                    for j in range(self.bits):
                        put(k + j, slices[j])
                m >>= 1
                k += 1
        out, at = [], 0
        while at < len(columns):
            column = columns[at]
            while len(column) > 2:  # a full adder: three bitmaps to a sum here and a carry above
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                column.append(half ^ c)
                put(at + 1, (a & b) | (half & c))
            if len(column) == 2:
                a, b = column.pop(), column.pop()
                column.append(a ^ b)
                put(at + 1, a & b)
            out.append(column[0] if column else np.zeros_like(self.all))
            at += 1
        return out

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows, ties to the smaller id; rows of the query's own id are out."""
        if self.most * int(np.abs(query).sum()) >= 1 << 63:
            raise OverflowError("a score does not fit 64 bits")
        alive = self.all.copy()
        own = np.flatnonzero(self.ids == query_id)
        for r in own:
            alive[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        if self.rows - len(own) > k:
            slices = self.sums(query)
            greater, equal, floor = np.zeros_like(alive), alive, 0
            for w in range(len(slices) - 1, -1, -1):
                up = equal & slices[w]
                if int(np.bitwise_count(greater | up).sum()) >= k:
                    equal, floor = up, floor | 1 << w
                else:
                    greater, equal = greater | up, equal & ~slices[w]
            # The k-th sum is `floor`; a row this far below it may still win once the dropped digits count.
            margin = (((1 << self.shift) - 1) * int(np.abs(query).sum())) >> self.shift
            alive = self._at_least(slices, alive, floor - margin - 1)
        rows = np.flatnonzero(np.unpackbits(alive.view(np.uint8), bitorder="little"))
        scores = self.values[rows] @ query
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][best], scores[best]

    @staticmethod
    def _at_least(slices: list[np.ndarray], alive: np.ndarray, bound: int) -> np.ndarray:
        if bound <= 0:
            return alive
        greater, equal = np.zeros_like(alive), alive
        for w in range(len(slices) - 1, -1, -1):
            if bound >> w & 1:
                equal = equal & slices[w]
            else:
                greater, equal = greater | (equal & slices[w]), equal & ~slices[w]
        return greater | equal


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of vectors that take part: not null, no null and only finite components."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)


def _arrays(batch: pa.RecordBatch):
    """(ids, matrix) for each length of vector in a batch."""
    ids, v = batch.column("id").to_numpy(), batch.column("v")
    flat, at = v.values.to_numpy(), v.offsets.to_numpy()
    n = np.diff(at)
    for length in np.unique(n):
        rows = np.flatnonzero(n == length)
        yield ids[rows], flat[at[rows][:, None] + np.arange(length)]


_BLOCK = "dims int, rows int, shift int, bits int, ids binary, slices binary, levels binary"
_NAMES = ["dims", "rows", "shift", "bits", "ids", "slices", "levels"]
_TYPES = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())


def _blocks(made, most: int, scale: int, names: list[str], types: tuple):
    """An Arrow map that gathers vectors by length, and gives a row made(ids, levels) for up to `most` of them."""

    def go(batches):
        held: dict[int, list] = {}

        def flush(length: int):
            parts = held.pop(length)
            row = made(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

        for batch in batches:
            for ids, matrix in _arrays(batch):
                levels, length = quantise(matrix, scale), matrix.shape[1]
                for a in range(0, len(ids), most):
                    part = ids[a : a + most], levels[a : a + most]
                    if length in held and sum(len(p[0]) for p in held[length]) + len(part[0]) > most:
                        yield flush(length)
                    held.setdefault(length, []).append(part)
        for length in list(held):
            yield flush(length)

    return go


def index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The stored index: a row for up to ROWS vectors of one length, with their slices."""
    made = _blocks(lambda ids, levels: Block.of(ids, levels).row(), ROWS, scale, _NAMES, _TYPES)
    return stage(valid(df, id_col, vector_col).mapInArrow(made, _BLOCK), "bit_sliced_index")


def top_k(df: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query.

    `is_query` is a condition on the columns (id, v).  Queries are gathered in
    blocks too; every block of the index is dealt to one of as many slots as
    there are partitions, every block of queries to each of them, and one
    equi-join on length and slot brings them together, so neither the driver
    nor a broadcast holds what grows with the table.  Vectors that are null,
    empty, or hold a null or non-finite component take no part; vectors of
    another length than the query's are no candidates of it; rows of the
    query's own id are no candidates either.  Of repeated query rows of one id
    the least vector counts.  Fewer candidates than k: all.  An empty table: no
    rows.  A component whose level leaves 62 bits, or a score that may leave 64
    bits, is an error.
    """
    n = partitions(df.sparkSession)
    slots = F.sequence(F.lit(0), F.lit(n - 1))
    blocks = index(df, id_col, vector_col, scale).withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int"))
    asked = valid(df, id_col, vector_col).where(is_query).groupBy(F.size("v").alias("dims"), "id").agg(F.min("v").alias("v")).select("id", "v")
    made = _blocks(lambda ids, levels: (levels.shape[1], ids.tobytes(), levels.tobytes()), QUERIES, scale, ["dims", "asked", "queries"], (pa.int32(), pa.binary(), pa.binary()))
    queries = stage(asked.mapInArrow(made, "dims int, asked binary, queries binary"), "bit_sliced_queries").withColumn("slot", F.explode(slots))
    met = blocks.join(queries.hint("shuffle_hash"), ["dims", "slot"]).select(*_NAMES, "asked", "queries")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(k: int):
    """The best rows of each block for each query that it meets."""

    def go(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(c)[i] for c in range(batch.num_columns)]
                block = Block.read(*(x.as_py() for x in row[:4]), *(x.as_buffer() for x in row[4:7]))
                ids, queries = np.frombuffer(row[7].as_buffer(), np.int64), np.frombuffer(row[8].as_buffer(), np.int64).reshape(-1, block.dims)
                best = [block.top(int(q), v, k) for q, v in zip(ids, queries, strict=True)]
                asked = np.repeat(ids, [len(b[0]) for b in best])
                yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]))], ["query_id", "vec_id", "score"])

    return go
