"""Base against head: parses unified diffs, and says which findings a change brings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.operators.findings import first_per


def diff_lines(diffs: DataFrame) -> DataFrame:
    """(diff, n, raw, path): lines of diff texts with the head path they belong to."""
    lines = diffs.select("diff", F.posexplode(F.split("content", "\n", -1)).alias("n", "raw"))
    target = F.when(F.startswith("raw", F.lit("+++ ")), F.when(F.col("raw") == "+++ /dev/null", F.lit("")).otherwise(F.substring("raw", 7, 1 << 30)))
    path = F.last(target, ignorenulls=True).over(Window.partitionBy("diff").orderBy("n"))
    return lines.withColumn("path", path)


def split_by_path(diffs: DataFrame) -> DataFrame:
    """(diff, path, patch): the part of a diff that each file has, from its `diff --git` line on."""
    lines = diffs.select("diff", F.posexplode(F.split("content", "\n", -1)).alias("n", "raw"))
    w = Window.partitionBy("diff").orderBy("n")
    part = F.sum(F.startswith("raw", F.lit("diff --git ")).cast("int")).over(w)
    name = F.regexp_extract("raw", r"^diff --git a/.* b/(.*)$", 1)
    grouped = lines.withColumn("part", part).where("part > 0").groupBy("diff", "part").agg(F.sort_array(F.collect_list(F.struct("n", "raw"))).alias("all"), F.max(F.when(name != "", name)).alias("path"))
    return grouped.select("diff", "path", F.array_join(F.col("all.raw"), "\n").alias("patch"))


def hunks(diffs: DataFrame) -> DataFrame:
    """(diff, path, head_start, head_end, base_start, base_end): half-open line ranges.

    An end is one line beyond what the hunk adds, so a deletion alone covers a
    line; consumers rely on that width.
    """
    lines = diff_lines(diffs)
    w = Window.partitionBy("diff").orderBy("n")
    start = F.startswith("raw", F.lit("@@"))
    number = lambda sign: F.regexp_extract("raw", rf"\{sign}(\d+)", 1).cast("long")
    marked = lines.withColumn("hunk", F.sum(start.cast("int")).over(w)).withColumn("file", F.sum(F.startswith("raw", F.lit("+++ ")).cast("int")).over(w))
    body = marked.where((F.col("hunk") > 0) & (F.col("path") != ""))
    added = F.count_if(F.startswith("raw", F.lit("+")) & ~F.startswith("raw", F.lit("+++")))
    removed = F.count_if(F.startswith("raw", F.lit("-")) & ~F.startswith("raw", F.lit("---")))
    ranges = body.groupBy("diff", "file", "hunk").agg(F.first("path").alias("path"), F.max(F.when(start, number("+"))).alias("h"), F.max(F.when(start, number("-"))).alias("b"), added.alias("plus"), removed.alias("minus")).where("h is not null")
    return ranges.select("diff", "path", F.col("h").alias("head_start"), F.greatest(F.col("h"), F.col("h") + F.col("plus") + 1).alias("head_end"), F.col("b").alias("base_start"), (F.col("b") + F.col("minus") + 1).alias("base_end"))


def changed_files(status: DataFrame) -> DataFrame:
    """(path, old_path, kind) from name-status lines(raw): A, M, D, or R with its old path."""
    f = F.split("raw", "\t")
    kind = F.substring(f[0], 1, 1)
    return status.where(F.col("raw").rlike(r"^[AMD]\t|^[RC]\d*\t")).select(F.coalesce(F.try_element_at(f, F.lit(3)), f[1]).alias("path"), F.when(F.size(f) > 2, f[1]).alias("old_path"), F.when(kind == "C", "A").otherwise(kind).alias("kind"))


def classify(head: DataFrame, base: DataFrame, files: DataFrame, ranges: DataFrame, strict: bool = False) -> DataFrame:
    """Findings of head and base with `awareness`.

    head and base have (path, line, function, category); files (path, old_path,
    kind); ranges (path, head_start, head_end).  In this order: an untouched
    file is preExisting; an added one introduced; the same line at base
    preExisting; a line in a hunk introduced; in a renamed file, the line at the
    old path preExisting; else contextual.  What only base has, in a changed
    file, and no finding of the same path, function and category survived, is
    fixed.  An introduced finding whose path and function (with `strict`, also
    category) had one at base is contextual.
    """
    h = head.withColumn("_id", F.monotonically_increasing_id())
    at_base = base.select("path", "line").distinct().withColumn("_same", F.lit(True))
    old = base.select(F.col("path").alias("old_path"), "line").distinct().withColumn("_old", F.lit(True))
    inside = h.alias("h").join(ranges.alias("r"), (F.col("h.path") == F.col("r.path")) & (F.col("h.line") >= F.col("r.head_start")) & (F.col("h.line") < F.col("r.head_end")), "left_semi").select("_id").withColumn("_in", F.lit(True))
    known = base.select("path", "function", *(["category"] if strict else [])).distinct().withColumn("_known", F.lit(True))
    f = files.select("path", "old_path", "kind")
    joined = h.join(f, "path", "left").join(at_base, ["path", "line"], "left").join(inside, "_id", "left").join(old, ["old_path", "line"], "left")
    first = (
        F.when(F.col("kind").isNull(), "preExisting").when(F.col("kind") == "A", "introduced").when(F.col("_same"), "preExisting")
        .when(F.col("_in"), "introduced").when((F.col("kind") == "R") & F.col("_old"), "preExisting").otherwise("contextual")
    )
    keys = ["path", "function", *(["category"] if strict else [])]
    now = joined.withColumn("awareness", first).join(known, keys, "left")
    now = now.withColumn("awareness", F.when((F.col("awareness") == "introduced") & F.col("_known"), "contextual").otherwise(F.col("awareness")))
    gone = base.join(head.select("path", "line").distinct(), ["path", "line"], "left_anti").join(head.select("path", "function", "category").distinct(), ["path", "function", "category"], "left_anti")
    touched = files.select(F.explode(F.array_compact(F.array("path", "old_path"))).alias("path")).distinct()
    fixed = first_per(gone.join(touched, "path", "left_semi"), ["path", "line", "function", "category"], F.col("line")).withColumn("awareness", F.lit("fixed"))
    columns = ["path", "line", "function", "category", "awareness"]
    return now.select(*columns).unionByName(fixed.select(*columns))
