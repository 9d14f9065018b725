"""Polls of pull requests as a stream: new ones are announced once, newest first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftstone.functions.scalars import fingerprint

PER_POLL = 5
EVERY = "15 minutes"


def marked(polls: DataFrame) -> DataFrame:
    return polls.withColumn("fingerprint", fingerprint(F.col("repo"), F.col("id"), F.col("sha"), F.col("updated_at")))


def allowed(polls: DataFrame, branches: DataFrame | None = None, ignored: DataFrame | None = None) -> DataFrame:
    """polls(repo, base, ...) of the branches(repo, branch) that are watched (none listed: all), without ignored fingerprints."""
    out = polls
    if branches is not None:
        lists = branches.groupBy("repo").agg(F.collect_set(F.lower("branch")).alias("_b"))
        out = out.join(F.broadcast(lists), "repo", "left").where(F.col("_b").isNull() | F.array_contains("_b", F.lower("base"))).drop("_b")
    if ignored is not None:
        out = out.join(ignored.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return out


def new_in_batch(polls: DataFrame, muted: DataFrame | None = None) -> DataFrame:
    """The first sight of every fingerprint over all polls(poll_ts, repo, id, sha, updated_at).

    A muted repository's first poll is recorded and not announced.
    """
    w = Window.partitionBy("fingerprint").orderBy("poll_ts")
    fresh = marked(polls).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    if muted is None:
        return fresh
    begin = polls.join(muted.select("repo").distinct(), "repo").groupBy("repo").agg(F.min("poll_ts").alias("_begin"))
    return fresh.join(begin, "repo", "left").where(F.col("_begin").isNull() | (F.col("poll_ts") > F.col("_begin"))).drop("_begin")


def announced(fresh: DataFrame, most: int = PER_POLL, carry_over: bool = False) -> DataFrame:
    """The newest `most` of each poll (the limit is the feature); carry_over gives the later ones a later `turn`."""
    w = Window.partitionBy("poll_ts").orderBy(F.desc_nulls_last("updated_at"), "fingerprint")
    ranked = fresh.withColumn("_n", F.row_number().over(w))
    if carry_over:
        return ranked.withColumn("turn", F.floor((F.col("_n") - 1) / most)).drop("_n")
    return ranked.where(F.col("_n") <= most).drop("_n")


def failures(polls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(polls without errors, one error row for each repository that failed)."""
    return polls.where("error is null").drop("error"), polls.where("error is not null").select("poll_ts", "repo", "error").distinct()


def monitor(polls: DataFrame, announce: Callable[[DataFrame, int], None], checkpoint: str, muted: DataFrame | None = None, most: int = PER_POLL, every: str | None = EVERY, horizon: str = "30 days") -> StreamingQuery:
    """Starts the monitor over a stream polls(poll_ts timestamp, repo, id, sha, updated_at).

    The state keeps fingerprints for `horizon` of event time.  Each micro-batch
    announces the newest of every poll; polls never overlap, as micro-batches
    do not.  every=None runs over what there is and stops.
    """
    seen = marked(polls).withWatermark("poll_ts", horizon).dropDuplicatesWithinWatermark(["fingerprint"])

    def emit(batch: DataFrame, number: int) -> None:
        kept = batch
        if muted is not None:
            begin = muted.select("repo", F.col("first_poll").alias("_begin"))
            kept = batch.join(F.broadcast(begin), "repo", "left").where(F.col("_begin").isNull() | (F.col("poll_ts") > F.col("_begin"))).drop("_begin")
        announce(announced(kept, most), number)

    writer = seen.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
