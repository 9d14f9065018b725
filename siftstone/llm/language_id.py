"""Language identification with spans for mixed-language text.

The scripts of a word's letters narrow its candidate languages; the letters'
trigrams and the whole word give it a log-likelihood in each candidate; Viterbi
decoding with a penalty for every switch labels spans of words.  A document's
language is the label of most of its letters.

Decoding is exact and vectorised: words are cut into blocks, the best path
between every first and last state of a block is found for all blocks together,
and blocks are then chained document by document.  The states of a block are
the candidate languages of its words' scripts, so the trellis does not grow
with the languages of other scripts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf


SAMPLE = 20_000  #: about as many labelled rows are read to fit the model, all if there are fewer
BUCKETS = 1 << 15  #: hash buckets of trigrams, and as many of words
PENALTY = 8.0  #: nats a switch of language costs
SHARE = 0.02  #: a script is a language's own if so much of its letters are in it
MIN_SCORE = 0.5  #: share of letters below which a filter rejects a document
UNKNOWN = "und"
BLOCK = 64
TOGETHER = 1 << 19  #: words decoded at once

# Unicode ranges of scripts (first, last).
SCRIPTS = {
    "Latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)),
    "Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "Armenian": ((0x530, 0x58F),),
    "Hebrew": ((0x590, 0x5FF),),
    "Arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "Devanagari": ((0x900, 0x97F),),
    "Bengali": ((0x980, 0x9FF),),
    "Gurmukhi": ((0xA00, 0xA7F),),
    "Gujarati": ((0xA80, 0xAFF),),
    "Tamil": ((0xB80, 0xBFF),),
    "Telugu": ((0xC00, 0xC7F),),
    "Kannada": ((0xC80, 0xCFF),),
    "Malayalam": ((0xD00, 0xD7F),),
    "Thai": ((0xE00, 0xE7F),),
    "Georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF)),
    "Hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "Ethiopic": ((0x1200, 0x137F),),
    "Hiragana": ((0x3040, 0x309F),),
    "Katakana": ((0x30A0, 0x30FF),),
    "Han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)),
}


@functools.cache
def _script_of() -> np.ndarray:
    """0 for what is no letter, else 1 + the script's place; letters of no listed script come last."""
    table = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.uint8).astype(np.uint8) * np.uint8(len(SCRIPTS) + 1)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            table[a : b + 1][table[a : b + 1] > 0] = k
    return table


@dataclass
class Words:
    """Letters of a batch of texts: features per letter, and the words they form."""

    feature: np.ndarray  # trigram bucket of each letter
    start: np.ndarray  # first letter of each word, among letters
    whole: np.ndarray  # bucket of each word
    script: np.ndarray  # script of each word's first letter
    letters: np.ndarray  # letters of each word
    doc: np.ndarray  # text of each word


def read_words(batch: list[str]) -> Words:
    joined = "\n".join(batch).lower() if len(batch) > 1 else (batch[0].lower() if batch else "")
    code = np.frombuffer(("\n" + joined + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    script = _script_of()[code]
    is_letter = script > 0
    # A text ends at the separators put in; count those, not the line ends of the texts.
    lengths = np.fromiter((len(t.lower()) for t in batch), np.int64, len(batch))
    ends = np.cumsum(lengths + 1)
    c = code.astype(np.uint64) * is_letter
    at = np.flatnonzero(is_letter)
    tri = (c[at - 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[at] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[at + 1] * np.uint64(0x165667B19E3779F9))
    first = ~is_letter[at - 1]
    start = np.flatnonzero(first)
    place = (at - at[start][np.cumsum(first) - 1]).astype(np.uint64) if len(at) else at.astype(np.uint64)
    mixed = (c[at] + np.uint64(1)) * (np.uint64(2) * place + np.uint64(0xD6E8FEB86659FD93))
    mixed ^= mixed >> np.uint64(31)
    whole = np.add.reduceat(mixed * np.uint64(0xA0761D6478BD642F), start) if len(start) else np.zeros(0, np.uint64)
    bucket = lambda h: ((h * np.uint64(0xD1342543DE82EF95)) >> np.uint64(64 - 15)).astype(np.int32)
    n = np.diff(np.concatenate((start, [len(at)])))
    return Words(bucket(tri), start, bucket(whole) + BUCKETS, script[at[start]].astype(np.int64), n, np.searchsorted(ends, at[start] - 1, "right"))


@dataclass
class Model:
    languages: list[str]
    weight: np.ndarray  # (2 * BUCKETS, languages): log-likelihoods
    candidate: np.ndarray  # (scripts + 2, languages)

    def scores(self, w: Words) -> np.ndarray:
        """Log-likelihood of each word in each language; languages without its script are out."""
        if not len(w.start):
            return np.zeros((0, len(self.languages)), np.float32)
        s = np.add.reduceat(self.weight[w.feature], w.start, axis=0) + self.weight[w.whole]
        return np.where(self.candidate[w.script], s, np.float32(-1e6))


def fit(counts: dict[str, np.ndarray]) -> Model:
    """Smoothed log-likelihoods from counts of features, and of letters by script, per language."""
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((2 * BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS) + 2, 0), bool))
    c = np.stack([counts[x] for x in languages], axis=1).astype(np.float64)
    weight = []
    for part in (c[:BUCKETS], c[BUCKETS : 2 * BUCKETS]):
        weight.append(np.log((part + 0.1) / (part.sum(axis=0) + 0.1 * BUCKETS)))
    letters = c[2 * BUCKETS :]
    own = letters / np.maximum(letters.sum(axis=0), 1) >= SHARE
    own[~own.any(axis=1)] = True
    return Model(languages, np.concatenate(weight).astype(np.float32), own)


def count(w: Words) -> np.ndarray:
    """Counts of trigrams, words, and letters by script."""
    return np.concatenate((
        np.bincount(w.feature, minlength=BUCKETS), np.bincount(w.whole - BUCKETS, minlength=BUCKETS),
        np.bincount(w.script, weights=w.letters, minlength=len(SCRIPTS) + 2).astype(np.int64),
    ))


def _paths(score: np.ndarray, penalty: float, first: np.ndarray | None = None):
    """Best paths through blocks of words, score (block, step, state).

    Without `first`: (block, first state, last state), the score of the best
    path between them.  With it: (step, block, state), the state before each
    state on the best path from the block's first state.
    """
    n, steps, k = score.shape
    if first is None:
        v = np.where(np.eye(k, dtype=bool), score[:, 0, :, None], np.float32(-1e30))
    else:
        v = np.where(np.arange(k) == first[:, None], score[:, 0], np.float32(-1e30))[:, None, :]
        back = np.zeros((steps, n, k), np.uint16)
    states = np.arange(k, dtype=np.uint16)
    for t in range(1, steps):
        top = v.argmax(axis=2)
        leap = np.take_along_axis(v, top[:, :, None], 2) - np.float32(penalty)
        stay = v >= leap
        if first is not None:
            back[t] = np.where(stay[:, 0], states, top.astype(np.uint16))
        v = np.where(stay, v, leap) + score[:, t, None, :]
    return v if first is None else back


def viterbi(score: np.ndarray, doc: np.ndarray, penalty: float = PENALTY, candidate: np.ndarray | None = None, script: np.ndarray | None = None) -> np.ndarray:
    """The best label of each word; `doc` (sorted) tells which words form one sequence.

    A block of words is decoded among the candidate languages of its scripts
    alone; `candidate` (script, language) and the words' `script` name them.
    """
    n, k = score.shape
    if n == 0 or k <= 1:
        return np.zeros(n, np.int64)
    heads = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    sizes = np.diff(np.concatenate((heads, [n])))
    blocks = -(-sizes // BLOCK)
    of = np.repeat(np.arange(len(heads)), blocks)
    ordinal = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = heads[of] + ordinal * BLOCK
    length = np.minimum(sizes[of] - ordinal * BLOCK, BLOCK)
    # The scripts of each block, as bits; blocks of the same scripts have the same trellis.
    scripts = np.bitwise_or.reduceat(np.uint64(1) << script.astype(np.uint64), begin) if candidate is not None else np.zeros(len(of), np.uint64)
    trellises, which = np.unique(scripts, return_inverse=True)
    states = [np.flatnonzero(candidate[[i for i in range(len(candidate)) if int(x) >> i & 1]].any(axis=0)) if candidate is not None else np.arange(k) for x in trellises]

    def padded(mine: np.ndarray, own: np.ndarray) -> np.ndarray:
        index = begin[mine][:, None] + np.arange(int(length[mine].max()))
        inside = index < (begin + length)[mine][:, None]
        return np.where(inside[:, :, None], score[np.minimum(index, n - 1)[:, :, None], own], np.float32(0))

    def portions():
        """(trellis, blocks) of a few blocks each: their paths take some 32 MB."""
        for x, own in enumerate(states):
            mine = np.flatnonzero(which == x)
            each = max(1, (1 << 21) // max(len(own) ** 2, len(own) * BLOCK))
            for a in range(0, len(mine), each):
                yield x, mine[a : a + each]

    path, place = [np.empty((int((which == x).sum()), len(own), len(own)), np.float32) for x, own in enumerate(states)], np.empty(len(of), np.int64)
    for x in range(len(states)):
        place[which == x] = np.arange(int((which == x).sum()))
    for x, mine in portions():
        path[x][place[mine]] = _paths(padded(mine, states[x]), penalty)
    # Chain the blocks of each document: all documents' first blocks, then their second ones, and so on.
    enter = np.empty((len(of), k), np.uint16)  # state before, for each first state
    begin_state = np.empty((len(of), k), np.uint16)  # first state, for each last state
    reach = np.full((len(of), k), -np.inf)
    order = np.lexsort((which, ordinal))
    cut = np.flatnonzero(np.diff(ordinal[order]) | np.diff(which[order])) + 1
    groups = np.split(order, cut)
    for group in groups:
        x = which[group[0]]
        own = states[x]
        if ordinal[group[0]] == 0:
            base = np.zeros((len(group), len(own)))
        else:
            before = reach[group - 1]
            top = before.argmax(axis=1)
            leap = before[np.arange(len(group)), top][:, None] - penalty
            stay = before[:, own] >= leap
            enter[group[:, None], own] = np.where(stay, own, top[:, None])
            base = np.where(stay, before[:, own], leap)
        total = base[:, :, None] + path[x][place[group]]
        begin_state[group[:, None], own] = own[total.argmax(axis=1)]
        reach[group[:, None], own] = total.max(axis=1)
    last = np.empty(len(of), np.int64)
    final = np.concatenate((ordinal[1:] == 0, [True]))
    for group in reversed(groups):
        ends = final[group]
        last[group[ends]] = reach[group[ends]].argmax(axis=1)
        go_on = group[~ends]
        last[go_on] = enter[go_on + 1, begin_state[go_on + 1, last[go_on + 1]]]
    first = begin_state[np.arange(len(of)), last]
    out = np.empty(n, np.int64)
    for x, mine in portions():
        own = states[x]
        back = _paths(padded(mine, own), penalty, np.searchsorted(own, first[mine]))
        state, rows = np.searchsorted(own, last[mine]), np.arange(len(mine))
        for t in range(len(back) - 1, -1, -1):
            inside = t < length[mine]
            out[(begin[mine] + t)[inside]] = own[state[inside]]
            if t:
                state = back[t, rows, state].astype(np.int64)
    return out


def _chunks(values: list[str], limit: int):
    """Parts of a list whose texts hold about `limit` characters together."""
    at = held = 0
    for i, t in enumerate(values):
        held += len(t)
        if held >= limit:
            yield values[at : i + 1]
            at, held = i + 1, 0
    if at < len(values):
        yield values[at:]


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fits the model on about `sample` of the labelled rows, chosen by a hash of the id.

    Rows with a null text or language are left out.  The driver receives at
    most 2 * BUCKETS counts for each language.  No labelled row: a model
    without languages, which answers `und` for every text.
    """
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    n = rows.count()
    if n > sample:  # a share of all 64-bit hashes, which does not round to none however many rows there are
        rows = rows.where(F.xxhash64("id") < -(1 << 63) + (sample << 64) // n)

    def go(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for t, x in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                by.setdefault(x, []).append(t)
            for x, mine in by.items():
                for part in _chunks(mine, 1 << 21):
                    total[x] = total.get(x, 0) + count(read_words(part))
        for x, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], ["lang", "bucket", "n"])
            # A language without any letter in the sample is still a language.
            if not len(at):
                yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([0], pa.int32()), pa.array([0], pa.int64())], ["lang", "bucket", "n"])

    found = rows.mapInArrow(go, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, np.ndarray] = {}
    langs = found.column("lang").to_pylist()
    for x, b, m in zip(langs, found.column("bucket").to_pylist(), found.column("n").to_pylist(), strict=True):
        counts.setdefault(x, np.zeros(2 * BUCKETS + len(SCRIPTS) + 2, np.int64))[b] += m
    return fit(counts)


def label(batch: list[str], model: Model, penalty: float = PENALTY):
    """For each text: (language, score, spans as (language, first word, words))."""
    out: list = []
    k = len(model.languages)
    for part in _chunks(batch, TOGETHER * 4):
        w = read_words(part)
        path = viterbi(model.scores(w), w.doc, penalty, model.candidate, w.script) if k else np.zeros(len(w.start), np.int64)
        share = np.zeros((len(part), max(k, 1)))
        np.add.at(share, (w.doc, path), w.letters)
        total = share.sum(axis=1)
        best = share.argmax(axis=1)
        change = np.flatnonzero(np.concatenate(([True], (w.doc[1:] != w.doc[:-1]) | (path[1:] != path[:-1])))) if len(path) else np.zeros(0, np.int64)
        widths = np.diff(np.concatenate((change, [len(path)])))
        first = np.searchsorted(w.doc, np.arange(len(part)))
        spans: list[list] = [[] for _ in part]
        if k:
            for d, x, a, n in zip(w.doc[change].tolist(), path[change].tolist(), (change - first[w.doc[change]]).tolist(), widths.tolist(), strict=True):
                spans[d].append((model.languages[x], a, n))
        for i in range(len(part)):
            known = k and total[i] > 0
            out.append((model.languages[best[i]] if known else UNKNOWN, float(share[i, best[i]] / total[i]) if known else 0.0, spans[i]))
    return out


def predict(df: DataFrame, model: Model, text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """All columns of df with (lang_pred, lang_score, lang_spans); these names replace columns of df.

    Null texts and texts without a letter get `und` and score 0.  The score is
    the share of the letters whose spans carry the predicted language.  Ties go
    to the language that sorts first.  Texts of any length are read whole.
    """
    model_ = df.sparkSession.sparkContext.broadcast(model)  # 2 * BUCKETS floats a language

    @arrow_udf("struct<lang: string, score: double, spans: array<struct<lang: string, first: int, words: int>>>")
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        spans = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))
        for batch in texts:
            lang, score, mine = zip(*label(batch.to_pylist(), model_.value, penalty), strict=True) if len(batch) else ((), (), ())
            mine = [[{"lang": x, "first": a, "words": n} for x, a, n in s] for s in mine]
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(mine, spans)], ["lang", "score", "spans"])

    # Only the texts go to Python; the other columns stay where they are.
    names = {"lang_pred": "lang", "lang_score": "score", "lang_spans": "spans"}
    row, at = F.struct(*df.columns).alias("row"), F.coalesce(F.col(text_col), F.lit(""))
    out = df.select(row, found.asNondeterministic()(at).alias("found"))  # else a filter on the result would label each text twice
    return out.select(*[F.col("row")[c].alias(c) for c in df.columns if c not in names], *[F.col("found")[v].alias(k) for k, v in names.items()])


def held_out(id_col: str = "doc_id"):
    """The fold that training never sees: crc32(id as text) mod 4 is 2; a null id is not in it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Rows of docs whose language is known; the others (no letters, or no language for half of them) go."""
    model = train(docs.where(~held_out()))
    if not model.languages and not docs.isEmpty():
        raise ValueError("no labelled document to learn a language from: every document would be rejected")
    found = predict(docs, model)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= min_score)).select(*docs.columns)
