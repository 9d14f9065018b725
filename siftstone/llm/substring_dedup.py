"""Substring dedup: suffix automata of reference shards, read by streams of words.

A shard is what earlier documents hold around one anchor gram.  Its suffix
automaton is grown in doc_id order: a document's words are first streamed
through the automaton, whose state gives at every word the longest match that
ends there (the matching statistics); every stretch where that reaches the
threshold is removed; then the document's own words join the automaton.

The shards are not broadcast.  The reference here is the corpus itself, so a
broadcast would grow with it; instead the stretches that could match are routed
to the shard of their anchor (see `repeats`), which is the same comparison with
a bounded part in each task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftstone.llm.common import buffers
from siftstone.llm.repeats import cut_rows, prepared, repeated_spans, union_of, with_spans, word_bounds

SIZE = 13
GRAM = 6


class SuffixAutomaton:
    """All factors of the sequences added so far; symbols are any hashables."""

    def __init__(self):
        self.length, self.link, self.to = [0], [-1], [{}]
        self.last = 0

    def begin(self) -> None:
        self.last = 0

    def add(self, symbol) -> None:
        to, length, link = self.to, self.length, self.link
        p = self.last
        if symbol in to[p]:
            q = to[p][symbol]
            self.last = q if length[p] + 1 == length[q] else self._clone(p, q, symbol)
            return
        new = len(length)
        length.append(length[p] + 1)
        link.append(0)
        to.append({})
        while p >= 0 and symbol not in to[p]:
            to[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = to[p][symbol]
            link[new] = q if length[p] + 1 == length[q] else self._clone(p, q, symbol)
        self.last = new

    def _clone(self, p: int, q: int, symbol) -> int:
        to, length, link = self.to, self.length, self.link
        copy = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        to.append(dict(to[q]))
        link[q] = copy
        while p >= 0 and to[p].get(symbol) == q:
            to[p][symbol] = copy
            p = link[p]
        return copy

    def matches(self, sequence):
        """For each symbol, the length of the longest factor that ends there."""
        state, have = 0, 0
        to, link, length = self.to, self.link, self.length
        for symbol in sequence:
            while state and symbol not in to[state]:
                state = link[state]
                have = length[state]
            if symbol in to[state]:
                state = to[state][symbol]
                have += 1
            else:
                have = 0
            yield have


def _closer(size: int):
    def close(batches):
        gram, automaton, doc, waiting = None, None, None, []
        for batch in batches:
            out = []
            for g, d, tag, low, content in zip(*(batch.column(c).to_pylist() for c in ("gram", "doc_id", "tag", "low", "content")), strict=True):
                if g != gram:
                    gram, automaton, doc, waiting = g, SuffixAutomaton(), d, []
                if d != doc:
                    for words in waiting:
                        automaton.begin()
                        for w in words:
                            automaton.add(w)
                    doc, waiting = d, []
                words = content.split()
                if words not in waiting:
                    waiting.append(words)
                high = -1
                for end, have in enumerate(automaton.matches(words), 1):
                    if have >= size:
                        if end - size > high:
                            if high >= 0:
                                out.append((d, tag, low + begin, low + high))
                            begin = end - size
                        high = end
                if high >= 0:
                    out.append((d, tag, low + begin, low + high))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "tag", "low", "high"])

    return close


def dedup(df: DataFrame, size: int = SIZE, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, tag, spans): each row with the word spans to remove.

    A word goes if it lies in a window of `size` words that also starts in a
    document with a smaller id; all windows are judged on the input.

    Null and empty texts, and texts of fewer words, get no span.  Rows with a
    null id have no place in the order: they neither lose nor remove anything.
    Rows that share an id count as one document and never remove from each
    other.  An empty table gives an empty table; other columns are ignored.
    """
    docs = prepared(df, id_col, text_col)
    return with_spans(docs, repeated_spans(docs, "word", size, gram, _closer(size)))


def _cut(data: np.ndarray, spans) -> tuple[int, int, bytes]:
    """Words, words removed, and the rest joined by single spaces."""
    start, stop = word_bounds(data)
    low, high = union_of(spans)
    keep = np.ones(len(start), bool)
    for a, b in zip(low, high, strict=True):
        keep[a:b] = False
    words = data.tobytes().split()
    return len(words), int((high - low).sum()), b" ".join(words) if keep.all() else b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def digest(kept: DataFrame) -> DataFrame:
    """Counts and the hash of what is left of each row of `dedup`."""

    def go(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            out = []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                n, gone, left = _cut(data[offsets[i] : offsets[i + 1]], spans)
                out.append((n, gone, hashlib.sha256(left).hexdigest()))
            n, gone, sha = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return kept.select("doc_id", "text", "spans").mapInArrow(go, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(df: DataFrame, size: int = SIZE, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df with repeated passages cut out of their texts; all columns stay."""
    spans = repeated_spans(prepared(df, id_col, text_col), "word", size, gram, _closer(size))
    return cut_rows(df, spans, lambda whole, s: _cut(np.frombuffer(whole, np.uint8), s)[2], id_col, text_col)
