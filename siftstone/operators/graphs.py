"""Graphs over calls: edges, closures, fixpoints, reachability, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.plans.loops import Rounds, cut

# Names that start a program, by language family.
ENTRY_NAMES = ("main", "wmain", "WinMain", "_tmain", "Main", "MainAsync", "handler", "exports", "module.exports")


def call_edges(tokens: DataFrame, functions: DataFrame) -> DataFrame:
    """(path, caller, callee_path, callee): an identifier before `(` that names a function, once for each pair.

    tokens(path, idx, off, kind, text); functions(path, fn, lo, hi).  The call's
    place is given to its innermost function; a function does not call itself.
    """
    from siftstone.operators.findings import enclosing

    w = Window.partitionBy("path").orderBy("idx")
    calls = tokens.withColumn("_next", F.lead("text").over(w)).where((F.col("kind") == "identifier") & (F.col("_next") == "("))
    names = functions.select(F.col("path").alias("callee_path"), F.col("fn").alias("callee"))
    at = enclosing(calls.select("path", "off", "text"), functions).where("fn is not null")
    return at.join(names, at["text"] == names["callee"]).where(F.col("fn") != F.col("callee")).select("path", F.col("fn").alias("caller"), "callee_path", "callee").distinct()


def prefer_same_file(edges: DataFrame) -> DataFrame:
    """Of several definitions of a callee, that in the caller's file, else the first path."""
    w = Window.partitionBy("path", "caller", "callee").orderBy(F.desc(F.col("path") == F.col("callee_path")), "callee_path")
    return edges.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def closure(edges: DataFrame, start: DataFrame, depth: int = 12, most: int | None = 80) -> DataFrame:
    """(root, node, depth): what reaches each root over edges(caller, callee), breadth first.

    start has (root).  The edges are read and made distinct once; every round
    joins the frontier with them, drops what the root has seen, and is written
    once, beside the rounds before.  `most` keeps that many nodes of a root, by
    depth and name (the limit is the feature).
    """
    rounds = Rounds(edges.sparkSession, "closure")
    frontier = rounds.add(start.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())
    back = cut(edges.select(F.col("callee").alias("node"), F.col("caller").alias("next")).distinct(), "edges")
    for d in range(1, depth + 1):
        found = frontier.join(back, "node").select("root", F.col("next").alias("node")).distinct()
        fresh = found.join(rounds.all().select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(d))
        if most is not None:
            held = rounds.all().groupBy("root").agg(F.count("*").alias("_held"))
            w = Window.partitionBy("root").orderBy("node")
            fresh = fresh.join(held, "root").withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") + F.col("_held") <= most).drop("_rank", "_held")
        frontier = rounds.add(fresh)
        if frontier.isEmpty():
            break
    return rounds.all()


def verdict(reached: DataFrame, entries: DataFrame) -> DataFrame:
    """(root, verdict): remote, local or unverified, by the entries(node, origin) among what reaches it."""
    met = reached.join(entries, "node", "left").groupBy("root").agg(F.max((F.col("origin") == "remote").cast("int")).alias("r"), F.max((F.col("origin") == "local").cast("int")).alias("l"))
    return met.select("root", F.when(F.col("r") == 1, "remote").when(F.col("l") == 1, "local").otherwise("unverified").alias("verdict"))


def fixpoint(calls: DataFrame, seeds: DataFrame, rounds: int = 10, blocked: DataFrame | None = None) -> DataFrame:
    """(name, round): functions whose result is tainted, in synchronous rounds.

    calls has (caller, callee); seeds (name).  A caller of a tainted function is
    tainted in the next round, unless it is in blocked(name) (sanitizers).
    """
    known = Rounds(calls.sparkSession, "fixpoint")
    last = known.add(seeds.select("name", F.lit(0).alias("round")).distinct())
    pairs = cut(calls.select(F.col("caller"), F.col("callee").alias("name")).distinct(), "calls")
    for r in range(1, rounds + 1):
        new = pairs.join(last.select("name"), "name").select(F.col("caller").alias("name")).distinct().join(known.all().select("name"), "name", "left_anti")
        if blocked is not None:
            new = new.join(blocked.select("name"), "name", "left_anti")
        last = known.add(new.withColumn("round", F.lit(r)))
        if last.isEmpty():
            break
    return known.all()


def reachable(functions: DataFrame, edges: DataFrame, entries: tuple[str, ...] = ENTRY_NAMES) -> DataFrame:
    """functions(path, fn) with `reachable`: from an entry of the same file; files without an entry: all.

    edges has (path, caller, callee) within files.  All files advance together,
    until a round finds nothing new.
    """
    seen = Rounds(functions.sparkSession, "reachable")
    names = cut(functions.select("path", "fn").distinct(), "names")
    steps = cut(edges.select("path", F.col("caller").alias("fn"), "callee").distinct(), "steps")
    frontier = seen.add(names.where(F.col("fn").isin(*entries)))
    while not frontier.isEmpty():
        found = frontier.join(steps, ["path", "fn"]).select("path", F.col("callee").alias("fn")).distinct()
        frontier = seen.add(found.join(names, ["path", "fn"], "left_semi").join(seen.all(), ["path", "fn"], "left_anti"))
    have = seen.all().select("path").distinct().withColumn("_entry", F.lit(True))
    out = functions.join(seen.all().withColumn("_seen", F.lit(True)), ["path", "fn"], "left").join(have, "path", "left")
    return out.withColumn("reachable", F.coalesce("_seen", F.lit(False)) | F.col("_entry").isNull()).drop("_seen", "_entry")


def occurrences(tokens: DataFrame) -> DataFrame:
    """(path, text, n): how often each identifier stands in its file."""
    return tokens.where(F.col("kind") == "identifier").groupBy("path", "text").agg(F.count("*").alias("n"))


def without_dead(findings: DataFrame, functions: DataFrame, counts: DataFrame) -> DataFrame:
    """Drops findings in static or private functions that nothing in their file names again."""
    hidden = functions.where(F.arrays_overlap("quals", F.array(F.lit("static"), F.lit("private")))).select("path", F.col("fn").alias("function"))
    dead = hidden.join(counts.select("path", F.col("text").alias("function"), "n"), ["path", "function"], "left").where(F.coalesce("n", F.lit(0)) <= 1)
    return findings.join(dead, ["path", "function"], "left_anti")


def overlay(edges: DataFrame) -> DataFrame:
    """(node, callees, topmost): direct callees of each node, and whether nothing calls it."""
    pairs = edges.select("caller", "callee").distinct()
    nodes = pairs.select(F.col("caller").alias("node")).union(pairs.select(F.col("callee").alias("node"))).distinct()
    out = pairs.groupBy(F.col("caller").alias("node")).agg(F.count("*").alias("callees"))
    called = pairs.select(F.col("callee").alias("node")).distinct().withColumn("_called", F.lit(True))
    return nodes.join(out, "node", "left").join(called, "node", "left").select("node", F.coalesce("callees", F.lit(0)).alias("callees"), F.col("_called").isNull().alias("topmost"))


def flow_paths(spark: SparkSession, steps: DataFrame, start: DataFrame, depth: int = 12, most: int = 80) -> DataFrame:
    """(root, path, depth): flows of a value over steps(src, dst), no node twice on a path.

    Paths carry what they passed, so no set of seen nodes is shared; `most`
    paths of a root go on (the limit is the feature), shortest first.
    """
    now = start.select("root", F.array("root").alias("path"), F.lit(0).alias("depth"))
    out = now
    for d in range(1, depth + 1):
        nxt = now.join(steps, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        w = Window.partitionBy("root").orderBy(F.array_join("path", "\u0001"), "dst")
        nxt = nxt.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most)
        now = cut(nxt.select("root", F.concat("path", F.array("dst")).alias("path"), F.lit(d).alias("depth")), "flows")
        if now.isEmpty():
            break
        out = out.unionByName(now)
    return out


def layers(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, rank, settled): the longest way from a topmost node.

    A node on or behind a cycle has no longest way: its rank stops at `rounds`,
    and `settled` is false for every node whose rank still grew in the last one.
    """
    pairs = cut(edges.select("caller", "callee").distinct(), "edges")
    rank = cut(overlay(pairs).select("node", F.lit(0).alias("rank")), "layers")
    moved = rank.select("node").limit(0)
    for _ in range(rounds):
        pushed = pairs.join(rank, F.col("caller") == F.col("node")).groupBy("callee").agg((F.max("rank") + 1).alias("to"))
        new = cut(rank.join(pushed, F.col("node") == F.col("callee"), "left").select("node", F.greatest("rank", F.least(F.coalesce("to", F.lit(0)), F.lit(rounds))).alias("rank")), "layers")
        moved = new.join(rank, ["node", "rank"], "left_anti").select("node")
        rank = new
        if moved.isEmpty():
            break
    return rank.join(moved.withColumn("_moved", F.lit(True)), "node", "left").select("node", "rank", F.col("_moved").isNull().alias("settled"))
