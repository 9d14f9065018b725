"""The line classifier: naive Bayes over signal tokens, trained from labelled lines or patches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions.scalars import signal_tokens
from siftstone.operators.perfile import per_file
from siftstone.plans.loops import cut


def lines_of(files: DataFrame, text_col: str = "text", *keys: str) -> DataFrame:
    """(keys, line, text): the lines of a text column, numbered from 1."""
    return files.select(*keys, F.posexplode(F.split(text_col, "\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)


def train(labelled: DataFrame) -> DataFrame:
    """(token, bad, good): in how many lines of each class a token stands.

    `labelled` has (bad boolean, text).  Counting is partial before the shuffle,
    so a token that stands in most lines is a row for each task.
    """
    found = labelled.select("bad", F.explode(signal_tokens(F.col("text"))).alias("token"))
    return found.groupBy("token").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))


def totals(labelled: DataFrame, model: DataFrame) -> DataFrame:
    """One row: examples of each class, and the size of the vocabulary."""
    examples = labelled.agg(F.count_if("bad").alias("bad_examples"), F.count_if(~F.col("bad")).alias("good_examples"))
    return examples.crossJoin(model.agg(F.count("*").alias("vocabulary")))  # one row by one row


def merge(models: DataFrame) -> DataFrame:
    """Sums the counts of several models."""
    return models.groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def score(lines: DataFrame, model: DataFrame, meta: DataFrame, *keys: str) -> DataFrame:
    """lines with `prob`, the probability that a line is bad.

    Laplace smoothing over class examples plus vocabulary; 0.5 where a line has
    no signal token or a class has no example.  Tokens meet the model in an
    equi-join; a line's tokens are then one partial sum for each line.
    """
    m = meta.select("bad_examples", "good_examples", "vocabulary")
    exploded = lines.select(*keys, F.explode(signal_tokens(F.col("text"))).alias("token"))
    joined = exploded.join(model, "token", "left").join(F.broadcast(m))
    ratio = F.log((F.coalesce("bad", F.lit(0)) + 1) / (F.col("bad_examples") + F.col("vocabulary"))) - F.log((F.coalesce("good", F.lit(0)) + 1) / (F.col("good_examples") + F.col("vocabulary")))
    sums = joined.groupBy(*keys).agg(F.sum(ratio).alias("odds"))
    prior = F.when((F.col("bad_examples") > 0) & (F.col("good_examples") > 0), F.log(F.col("bad_examples") / F.col("good_examples")))
    out = lines.join(sums, list(keys), "left").join(F.broadcast(m))
    prob = 1 / (1 + F.exp(-(F.col("odds") + prior)))
    return out.withColumn("prob", F.when(prob.isNull(), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), prob)))).drop("odds", "bad_examples", "good_examples", "vocabulary")


def heatmap(scores: DataFrame, threshold: float = 0.8, key: str = "path") -> DataFrame:
    """(key, flagged, intensity): flagged lines of each file, against the hottest file."""
    flagged = cut(scores.where(F.col("prob") >= threshold).groupBy(key).agg(F.count("*").alias("flagged")), "flagged")
    top = flagged.agg(F.max("flagged").alias("most"))
    return flagged.join(F.broadcast(top)).select(key, "flagged", (F.col("flagged") / F.col("most")).alias("intensity"))


def _comments(lines):
    """(line, text, is_comment) of one file's lines, in order.

    Comments that open or close are eaten from the front, as often as one can;
    what follows decides.  Opening after code is not seen.
    """
    inside = False
    for x in sorted(lines, key=lambda x: x["line"]):
        text = x["text"] or ""
        rest = _EATEN.sub("", "/*" + text if inside else text, count=1)
        inside = bool(_OPENED.match(rest))
        yield x["line"], x["text"], inside or rest in ("", "/") or rest.startswith("//")


_EATEN = re.compile(r"^(?:[ \t/]*?/\*(?:[^*]|\*(?!/))*\*/|[ \t])*")
_OPENED = re.compile(r"/*[ \t]*/\*")


def comment_lines(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, line, text, is_comment); blank lines count as comment.

    The state crosses lines, so a file's lines are read in order, in one pass:
    an array of them, which the file's size bounds.
    """
    files = lines.groupBy(*keys).agg(F.collect_list(F.struct("line", "text")).alias("all"))
    return per_file(files, list(keys), ["all"], _comments, "line int, text string, is_comment boolean")


def patch_lines(patches: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """(patch, bad, text): removed lines are bad, added ones good.

    `patches` has (patch, content).  With extensions, only files of these count;
    lines of a file belong to the last `+++` header before them.
    """
    lines = patches.select("patch", F.posexplode(F.split("content", "\n", -1)).alias("n", "raw"))
    header = F.when(F.startswith("raw", F.lit("+++ ")), F.regexp_replace("raw", r"^\+\+\+ (?:b/)?|\t.*$", ""))
    # The old name comes first, so both header lines are read before any line of the file.
    path = F.last(header, ignorenulls=True).over(Window.partitionBy("patch").orderBy("n"))
    body = lines.withColumn("path", path).where(F.col("raw").rlike(r"^[+-]") & ~F.col("raw").rlike(r"^(\+\+\+|---)"))
    if extensions:
        body = body.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))
    return body.select("patch", F.startswith("raw", F.lit("-")).alias("bad"), F.substring("raw", 2, 1 << 30).alias("text")).where(F.trim("text") != "")


MODEL_SCHEMA = "name string, goodTokens map<string,long>, badTokens map<string,long>, goodExamples long, badExamples long"


def read_model(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(tokens, meta) of a model file: one JSON object with a count for each token and class."""
    raw = spark.read.schema(MODEL_SCHEMA).json(path, multiLine=True)
    good = raw.select(F.explode("goodTokens").alias("token", "n")).select("token", F.lit(0).cast("long").alias("bad"), F.col("n").alias("good"))
    bad = raw.select(F.explode("badTokens").alias("token", "n")).select("token", F.col("n").alias("bad"), F.lit(0).cast("long").alias("good"))
    model = merge(good.union(bad))
    meta = raw.select(F.col("badExamples").alias("bad_examples"), F.col("goodExamples").alias("good_examples")).join(F.broadcast(model.agg(F.count("*").alias("vocabulary"))))
    return model, meta


def model_json(name: str, model: DataFrame, meta: DataFrame) -> DataFrame:
    """One row `value`: the model as a JSON object with sorted tokens (a model is a vocabulary, not a corpus)."""
    maps = model.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("good") > 0, F.struct("token", "good"))))).alias("goodTokens"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("bad") > 0, F.struct("token", "bad"))))).alias("badTokens"),
    )
    both = maps.join(F.broadcast(meta))
    return both.select(F.to_json(F.struct(F.col("bad_examples").alias("badExamples"), "badTokens", F.col("good_examples").alias("goodExamples"), "goodTokens", F.lit(name).alias("name")), {"pretty": "true"}).alias("value"))
