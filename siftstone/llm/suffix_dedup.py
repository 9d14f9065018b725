"""Suffix-array dedup: a radix sort of suffixes that stops at the threshold.

A suffix array orders suffixes to their ends; to find repeats of `size` bytes
it is enough to order them through `size` bytes.  Passes go from the most
significant digit down, and suffixes alone in their group, or in a group of one
document, leave after each pass.  What is left after the last pass are exactly
the windows that several documents hold.

The first digits are hash prefixes of the anchor inside the window (equal
windows have equal anchors; see `repeats`), so whole runs of suffixes take the
first passes together; the last passes compare the bytes themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftstone.llm.common import buffers
from siftstone.llm.repeats import cut_rows, prepared, repeated_spans, union_of, with_spans

SIZE = 50
GRAM = 25
PIECE = 4 << 20  #: bytes that are sorted together, and of one gram at a time


def repeated(data: np.ndarray, start: np.ndarray, group: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """Indices of the windows at `start` that a smaller document of their group holds.

    Most-significant-digit passes of eight bytes; a group that has one document
    only is dropped as soon as it appears.
    """
    live = np.arange(len(start))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    least = doc
    for depth in range(0, size, 8):
        if not len(live):
            return live
        digit = np.ascontiguousarray(eight[start[live] + depth]).view(">u8")[:, 0].astype(np.uint64)
        if size - depth < 8:
            digit >>= np.uint64(8 * (8 - size + depth))
        order = np.lexsort((doc[live], digit, group))
        live, digit, group = live[order], digit[order], group[order]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])))
        heads = np.flatnonzero(new)
        ends = np.concatenate((heads[1:], [len(live)])) - 1
        number = np.cumsum(new) - 1
        several = (doc[live[heads]] != doc[live[ends]])[number]
        least = doc[live[heads]][number][several]
        live, group = live[several], number[several]
    return live[doc[live] > least]


def _closer(size: int, limit: int = PIECE):
    def close(batches):
        seen: np.ndarray | None = None  # distinct windows of the gram that the last piece left unfinished
        seen_doc, seen_gram = np.zeros(0, np.int64), None
        for table, goes_on in _pieces(batches, limit):
            data, offsets = buffers(table.column("content"))
            doc, gram = table.column("doc_id").to_numpy(), table.column("gram").to_numpy()
            n = np.diff(offsets) - size + 1
            run = np.repeat(np.arange(len(n)), n)
            within = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
            start, group, of = offsets[run] + within, gram[run], doc[run]
            before = len(seen) if seen is not None and gram[0] == seen_gram else 0
            if before:  # what the gram's earlier pieces held comes first
                start = np.concatenate((np.arange(before) * size, start + before * size))
                data = np.concatenate((seen.ravel(), data))
                group, of = np.concatenate((np.full(before, gram[0]), group)), np.concatenate((seen_doc, of))
            hit = np.sort(repeated(data, start, group, of, size))
            if goes_on:
                fresh = np.ones(len(start), bool)
                fresh[hit] = False
                windows = np.lib.stride_tricks.sliding_window_view(data, size)[start[fresh]]
                _, first = np.unique(np.ascontiguousarray(windows).view(np.dtype((np.void, size)))[:, 0], return_index=True)
                seen, seen_doc, seen_gram = windows[first], of[fresh][first], gram[-1]
            else:
                seen = None
            hit = hit[hit >= before] - before
            if not len(hit):
                continue
            first = np.concatenate(([True], (np.diff(hit) != 1) | (run[hit[1:]] != run[hit[:-1]])))
            head, tail = hit[first], hit[np.concatenate((first[1:], [True]))]
            low = table.column("low").to_numpy()[run[head]] + within[head]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[run[head]]), pa.array(table.column("tag").to_numpy()[run[head]]), pa.array(low.astype(np.int32)), pa.array((low + within[tail] - within[head] + size).astype(np.int32))],
                ["doc_id", "tag", "low", "high"],
            )

    return close


def _pieces(batches, limit: int):
    """(rows, whether their last gram goes on) of rows sorted by gram and document.

    Rows are gathered up to about `limit` bytes and cut where a gram ends; a
    gram of more bytes is given in pieces of its own.
    """
    kept: list[pa.RecordBatch] = []
    held = 0

    def joined():
        return pa.Table.from_batches(kept).combine_chunks().to_batches()[0]

    for whole in batches:
        at = 0
        while at < whole.num_rows:
            size = whole.column("content").slice(at).nbytes // max(whole.num_rows - at, 1) + 1
            batch = whole.slice(at, max(1, (limit - held) // size))
            at += batch.num_rows
            kept.append(batch)
            held += batch.column("content").nbytes
            if held < limit:
                continue
            all_ = joined()
            gram = all_.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))
            if cut:
                yield all_.slice(0, cut), False
                kept, held = [all_.slice(cut)], all_.slice(cut).column("content").nbytes
            else:
                yield all_, True
                kept, held = [], 0
    if kept:
        yield joined(), False


def dedup(df: DataFrame, size: int = SIZE, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, tag, spans): each row with the byte spans to remove.

    A byte goes if it lies in a window of `size` bytes that also starts in a
    document with a smaller id; all windows are judged on the input.

    Null and empty texts hold no window and get no span.  Rows with a null id
    have no place in the order: they neither lose nor remove anything.  Rows
    that share an id count as one document and never remove from each other.
    Texts of any length are read whole.  An empty table gives an empty table;
    other columns are ignored.
    """
    docs = prepared(df, id_col, text_col)
    return with_spans(docs, repeated_spans(docs, "byte", size, gram, _closer(size)))


def digest(kept: DataFrame) -> DataFrame:
    """Counts and the hash of what is left of each row of `dedup`."""

    def go(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                whole = data[offsets[i] : offsets[i + 1]]
                low, high = union_of(spans)
                h, at = hashlib.sha256(), 0
                for a, b in zip(low, high, strict=True):
                    h.update(whole[at:a])
                    at = b
                h.update(whole[at:])
                for k, v in (("n_bytes", len(whole)), ("n_removed", int((high - low).sum())), ("n_spans", len(low)), ("kept_sha256", h.hexdigest())):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, pa.int64() if k[0] == "n" else pa.string()) for k, v in out.items())], ["doc_id", *out])

    return kept.select("doc_id", "text", "spans").mapInArrow(go, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _left(whole: bytes, spans) -> bytes:
    """What stays of a text; a character that lost a byte goes whole."""
    left, at = [], 0
    for a, b in zip(*union_of(spans), strict=True):
        left.append(whole[at:a].decode("utf-8", "ignore"))
        at = b
    return ("".join(left) + whole[at:].decode("utf-8", "ignore")).encode()


def remove(df: DataFrame, size: int = SIZE, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df with repeated passages cut out of their texts; all columns stay."""
    spans = repeated_spans(prepared(df, id_col, text_col), "byte", size, gram, _closer(size))
    return cut_rows(df, spans, _left, id_col, text_col)
