"""Byte-level BPE through a sentencepiece model made from a rank file.

The model is written directly as a protocol buffer: each token of the rank file
is a piece, its bytes mapped one to one to printable characters, its score the
negative rank; normalisation is the identity and nothing is added.  A BPE model
of sentencepiece joins the neighbours whose piece scores highest, leftmost
first, which is the rule of the rank file, so pre-tokens encode to the same ids
and the inverse mapping decodes them.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siftstone.llm.common import texts

#: Code point of the character that stands for byte 0; the others follow it.
#: A private range: no normaliser or pre-tokenizer gives its characters a meaning.
FIRST = 0xE000
_FROM_BYTE = {b: chr(FIRST + b) for b in range(256)}
_CACHE = 600_000  #: pre-tokens that a worker remembers
_TOGETHER = 128  #: texts whose new pre-tokens go to the model together


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def read_ranks(data: bytes) -> list[bytes]:
    """Tokens of a rank file in the order of their ranks, which must be dense."""
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in data.splitlines() if line))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks are not dense")
    return [t for _, t in pairs]


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(_FROM_BYTE)


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model; a piece's id is its rank, the last id is <unk>."""
    # Field numbers and enumerators of sentencepiece_model.proto.
    piece, score, kind, unknown = 1, 2, 3, 2
    pieces = b"".join(_field(1, _field(piece, mapped(t).encode()) + _field(score, float(-r))) for r, t in enumerate(tokens))
    pieces += _field(1, _field(piece, b"<unk>") + _field(score, 0.0) + _field(kind, unknown))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes pre-tokens to ranks and decodes ranks to bytes."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.tokens))
        self.find = regex.compile(pattern).findall
        self.ranks = {t: r for r, t in enumerate(self.tokens)}
        to_byte = {FIRST + b: b for b in range(256)}
        self.back = [self.model.id_to_piece(r).translate(to_byte).encode("latin-1") for r in range(len(self.tokens))]
        self._seen: dict[str, bytes] = {}
        self._parts: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        """A pre-token that is itself a token is that token; the others are merged by the model."""
        rest = []
        for w in words:
            raw = w.encode()
            if (r := self.ranks.get(raw)) is not None:
                self._seen[w] = np.uint32(r).tobytes()
            else:
                rest.append((w, mapped(raw)))
        for (w, _), ids in zip(rest, self.model.encode([m for _, m in rest], num_threads=1) if rest else [], strict=True):
            self._seen[w] = np.array(ids, np.uint32).tobytes()

    def _pieces(self, text: str) -> list[str] | None:
        """The text's parts between spaces, or None where a run of white space forbids to part it.

        Where a space stands alone, it belongs to the pre-token after it, so
        the parts can be matched (and remembered) one by one.
        """
        first, *rest = text.split(" ")
        if rest and first[-1:].isspace():
            return None
        for w in rest:
            if w not in self._parts and (not w or w[0].isspace() or w[-1].isspace() and w is not rest[-1]):
                return None
        return [first, *rest]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; pre-tokens not met before go to the model in one call."""
        if len(self._parts) > _CACHE:
            self._parts.clear()
        if len(self._seen) > _CACHE:
            self._seen.clear()
        seen, parts = self._seen, self._parts
        split = [self._pieces(t) for t in texts]
        whole = {i: self.find(t) for i, (t, p) in enumerate(zip(texts, split, strict=True)) if p is None}
        heads = {p[0]: self.find(p[0]) for p in split if p}
        new = {w: self.find(" " + w) for p in split if p for w in p[1:] if w not in parts}
        self._learn({w for found in (whole, heads, new) for words in found.values() for w in words if w not in seen})
        together = lambda words: b"".join([seen[w] for w in words])
        last = {w: together(words) for w, words in new.items()}
        parts.update((w, ids) for w, ids in last.items() if not w[-1].isspace())
        out = []
        for i, p in enumerate(split):
            if p is None:
                ids = together(whole[i])
            else:
                ids = together(heads[p[0]]) + b"".join([parts[w] if w in parts else last[w] for w in p[1:]])
            out.append(np.frombuffer(ids, np.uint32))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.back.__getitem__, ids.tolist()))


@functools.lru_cache(2)
def _codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each whole text.

    `ranks_path` is read once by the driver and its bytes travel with the task
    (a vocabulary file, under a megabyte).  Null texts are empty and give no
    ids; null ids stay; repeated rows repeat; an empty table gives an empty
    one; other columns are left out.
    """
    spark = df.sparkSession
    ranks = _vocabulary(spark, ranks_path)

    def go(batches):
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, _TOGETHER):
                part = batch.slice(a, _TOGETHER)
                ids = codec.encode_many(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(ids)], ["doc_id", "ids"])

    return texts(df, id_col, text_col).mapInArrow(go, "doc_id long, ids array<int>")


def decode(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded binary): the inverse mapping of `encode`'s ids."""
    ranks = _vocabulary(df.sparkSession, ranks_path)

    def go(batches):
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            ids = _arrays(batch.column("ids"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array([codec.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return df.select("doc_id", "ids").mapInArrow(go, "doc_id long, ids array<int>, decoded binary")


def digest(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, decodes the ids, and gives counts and hashes of both."""
    ranks = _vocabulary(df.sparkSession, ranks_path)

    def go(batches):
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for at in range(0, batch.num_rows, _TOGETHER):
                for ids in codec.encode_many(batch.column("text").slice(at, _TOGETHER).to_pylist()):
                    n.append(len(ids))
                    a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    b.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(df, id_col, text_col).mapInArrow(go, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _vocabulary(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _arrays(column) -> list[np.ndarray]:
    flat, at = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
