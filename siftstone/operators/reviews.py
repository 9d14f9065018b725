"""The dataflow around model reviews: chunks, batches, cache keys, parsing and merging of answers."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions.scalars import cache_key, severity_rank
from siftstone.operators.perfile import per_file

CHUNK = 24_000
BATCH = 48_000
CARDS = 4


def chunks(files: DataFrame, limit: int = CHUNK) -> DataFrame:
    """(path, chunk, first_line, last_line, text): greedy slices of whole lines of at most `limit` characters.

    A line longer than the limit is a slice of its own.  A file's lines are read
    once, in order.
    """
    return per_file(files, ["path"], ["content"], lambda content: _slices(content or "", limit), "chunk int, first_line int, last_line int, text string")


def _slices(content: str, limit: int):
    held: list[str] = []
    size = chunk = 0
    first = 1
    for n, line in enumerate(content.split("\n"), 1):
        if held and size + len(line) + 1 > limit:
            yield chunk, first, n - 1, "\n".join(held)
            chunk, first, size = chunk + 1, n, 0
            held = []
        held.append(line)
        size += len(line) + 1
    yield chunk, first, first + len(held) - 1, "\n".join(held)


def batches(cards: DataFrame, cards_per_batch: int = CARDS, limit: int = BATCH, group: str = "path") -> DataFrame:
    """cards(group, card, size) with `batch`: greedy, in card order, within each group, in one pass."""

    def packed(mine):
        batch = n = held = 0
        for x in sorted(mine, key=lambda x: x["card"]):
            if n and (n >= cards_per_batch or held + x["size"] > limit):
                batch, n, held = batch + 1, 0, 0
            n, held = n + 1, held + x["size"]
            yield x["card"], batch

    groups = cards.groupBy(group).agg(F.collect_list(F.struct("card", "size")).alias("all"))
    return cards.join(per_file(groups, [group], ["all"], packed, "card int, batch int"), [group, "card"])


def uncached(cards: DataFrame, cache: DataFrame, provider: str, model: str, version: int = 1) -> DataFrame:
    """cards(root, path, text) with their key, without those that cache(key) holds."""
    keyed = cards.withColumn("key", cache_key(F.lit(str(version)), F.lit(provider), F.lit(model), F.col("root"), F.col("path"), F.col("text")))
    return keyed.join(cache.select("key").distinct(), "key", "left_anti")


def _objects(text: str):
    """JSON objects in a loose answer: fenced blocks, arrays, single objects, with trailing commas repaired."""
    text = re.sub(r"```(?:json)?", "", text)
    at = 0
    decoder = json.JSONDecoder()
    while (start := min((i for i in (text.find("[", at), text.find("{", at)) if i >= 0), default=-1)) >= 0:
        for candidate in (text[start:], re.sub(r",\s*([\]}])", r"\1", text[start:]), text[start:].replace("“", '"').replace("”", '"')):
            try:
                value, end = decoder.raw_decode(candidate)
            except ValueError:
                continue
            for item in value if isinstance(value, list) else [value]:
                if isinstance(item, dict):
                    inner = next((v for v in item.values() if isinstance(v, list) and v and isinstance(v[0], dict)), None)
                    yield from inner or [item]
            at = start + end
            break
        else:
            at = start + 1


def records(answer: str):
    """(line, category, severity, function, message) of one answer; it reads what it can and skips the rest."""
    for o in _objects(answer or ""):
        low = {str(k).lower(): v for k, v in o.items()}
        try:
            line = int(low.get("line") or low.get("line_number") or 0)
        except (TypeError, ValueError):
            line = 0
        if low.get("category") or low.get("type"):
            yield line, str(low.get("category") or low.get("type")), str(low.get("severity") or ""), str(low.get("function") or ""), str(low.get("message") or low.get("description") or "")


def parse_answers(answers: DataFrame, *keys: str) -> DataFrame:
    """(keys, line, category, severity, function, message) of answers(keys, answer)."""
    return per_file(answers, list(keys), ["answer"], records, "line int, category string, severity string, function string, message string")


def normalised_categories(found: DataFrame, known: DataFrame) -> DataFrame:
    """found with `category` as in known(ord, name): equal ignoring case, else one inside the other, else cut to 60.

    The list of names is the user's and is broadcast; the first in order wins.
    """
    f = found.withColumn("_id", F.monotonically_increasing_id()).withColumn("_c", F.lower(F.trim("category")))
    name = F.lower("name")
    near = f.join(F.broadcast(known), F.col("_c").contains(name) | name.contains(F.col("_c")), "left")
    w = Window.partitionBy("_id").orderBy(F.desc(F.coalesce(F.col("_c") == name, F.lit(False))), "ord")
    top = near.withColumn("_rank", F.row_number().over(w)).where("_rank = 1")
    category = F.when(F.col("_c") == "", "Other").otherwise(F.coalesce("name", F.substring(F.trim("category"), 1, 60)))
    return top.withColumn("category", category).select(*found.columns).withColumn("severity", F.coalesce(severity_rank(F.col("severity")), F.lit(1)))


def attributed(found: DataFrame, cards: DataFrame) -> DataFrame:
    """found(path, card, line, ...) with lines moved into the range of their card(first_line, last_line)."""
    joined = found.join(cards.select("path", "card", "first_line", "last_line"), ["path", "card"])
    return joined.withColumn("line", F.greatest("first_line", F.least("last_line", "line"))).drop("first_line", "last_line")


def triage(answers: DataFrame) -> DataFrame:
    """answers(answer) with `verdict`: INVALID beats VALID; neither is unknown."""
    up = F.upper("answer")
    return answers.withColumn("verdict", F.when(up.contains("INVALID"), "invalid").when(up.contains("VALID"), "valid").otherwise("unknown"))


def snippets(findings: DataFrame, lines: DataFrame, before: int = 20, after: int = 25) -> DataFrame:
    """findings with `snippet`: the lines around each, joined on the path and a range."""
    f = findings.withColumn("_id", F.monotonically_increasing_id()).alias("f")
    near = f.join(lines.alias("l"), (F.col("f.path") == F.col("l.path")) & F.col("l.line").between(F.col("f.line") - before, F.col("f.line") + after), "left")
    text = near.groupBy("f._id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l.line", "l.text"))), lambda x: x["text"]), "\n").alias("snippet"))
    return f.join(text, "_id").drop("_id")
