"""The algebra of findings: de-duplicate, veto, ignore, merge, rank and count.

findings(path, line, function, category, severity, exploitability, engine,
taint_path array<string>, package, seq) is the central table; operators read
only the columns that they name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions.scalars import normalized_path

# Categories that are reported once for a file.
FILE_SCOPE = ("Weak Cryptography", "Weak Randomness", "Hardcoded", "Information Disclosure")


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key; keys are hashed after the top row of each task is known only if Spark can limit groups."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def engine_rank(engine: Column) -> Column:
    """Precise engines come first."""
    return F.when(engine == "AST", 0).when(engine == "Heuristic", 1).otherwise(2)


def dedupe(findings: DataFrame) -> DataFrame:
    """One finding for each path, line and category, AST before others, then in their order."""
    return first_per(findings, ["path", "line", "category"], engine_rank(F.col("engine")), F.col("seq"))


def is_file_scope(category: Column, taint_path: Column) -> Column:
    scoped = F.lit(False)
    for prefix in FILE_SCOPE:
        scoped = scoped | F.startswith(category, F.lit(prefix))
    return scoped & (taint_path.isNull() | (F.size(taint_path) == 0))


def dedupe_file_scope(findings: DataFrame) -> DataFrame:
    """Findings about a file as a whole are kept once for each category; others all stay."""
    scoped = is_file_scope(F.col("category"), F.col("taint_path"))
    once = first_per(findings.where(scoped), ["path", "category"], F.col("seq"))
    return once.unionByName(findings.where(~scoped))


def drop_hygiene(findings: DataFrame, hygiene: list[str]) -> DataFrame:
    """Hygiene categories go from files that have a defect."""
    defects = findings.where(~F.col("category").isin(*hygiene)).select("path").distinct()
    poor = F.col("category").isin(*hygiene)
    return findings.where(~poor).unionByName(findings.where(poor).join(defects, "path", "left_anti"))


def without_ignored(findings: DataFrame, ignored: DataFrame) -> DataFrame:
    """Findings whose `path#line`, or `path#line#package` for packages, is not in ignored(key)."""
    key = F.concat_ws("#", "path", F.col("line").cast("string"), "package")
    return findings.withColumn("_key", key).join(ignored.select(F.col("key").alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def append_missing(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old and the rows of new whose key it lacks, the first of each."""
    fresh = new.join(old.select(key), key, "left_anti").dropDuplicates([key])
    return old.unionByName(fresh, allowMissingColumns=True)


def veto(findings: DataFrame, distance: int = 2) -> DataFrame:
    """Drops heuristic findings of Objective-C files without a precise one near by.

    Near: same path, function (ignoring case, and what is not a letter or digit)
    and category, at most `distance` lines away.  One window over each of these
    groups says so: one shuffle, and no join.
    """
    name = F.regexp_replace(F.lower("function"), "[^a-z0-9]", "")
    objc = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin("m", "mm")
    w = Window.partitionBy("path", name, "category").orderBy("line").rangeBetween(-distance, distance)
    near = F.max((F.col("engine") == "AST").cast("int")).over(w)
    bound = (F.col("engine") == "Heuristic") & objc
    return findings.withColumn("_near", near).where(~F.coalesce(bound, F.lit(False)) | (F.col("_near") == 1)).drop("_near")


def cross_file(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """findings with `cross_file`: the taint path begins at a source that only the project index knows."""
    root = F.try_element_at("taint_path", F.lit(1))
    known = sources.select(F.col("name").alias("_root")).distinct().withColumn("cross_file", F.lit(True))
    return findings.withColumn("_root", root).join(known, "_root", "left").withColumn("cross_file", F.coalesce("cross_file", F.lit(False))).drop("_root")


def ranked(findings: DataFrame) -> DataFrame:
    """Findings in report order: severity first, then place."""
    return findings.orderBy(F.desc("severity"), "path", "line", "category")


def ordered(findings: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """Findings by any columns, (name, descending), with ties broken by place."""
    return findings.orderBy(*[F.desc(k) if down else F.asc(k) for k, down in keys], "path", "line", "category")


def summary(findings: DataFrame) -> DataFrame:
    """Counts by severity and engine with their totals in one pass; null means all."""
    return findings.rollup("severity", "engine").agg(F.count("*").alias("n"))


def merge_reviews(built: DataFrame, reviewed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Credits reviewed findings to built-in ones on the same path and line whose category is alike.

    Alike: one category holds the other, ignoring case.  Every built-in finding
    is credited once, by the first reviewed one, and gains the engine `AI`.
    Returns the built-in findings, and the reviewed ones without a partner.
    Categories of a place are paired, never findings, so a crowded place costs
    its findings once.
    """
    place = ["path", "line"]
    b = built.groupBy(*place, F.lower("category").alias("_b")).agg(F.min("seq").alias("b_seq"))
    reviews = reviewed.select(*place, F.lower("category").alias("_c"), F.col("seq").alias("r_seq"))
    alike = F.col("_b").contains(F.col("_c")) | F.col("_c").contains(F.col("_b"))
    first = reviews.select(*place, "_c").distinct().join(b, place).where(alike).groupBy(*place, "_c").agg(F.min("b_seq").alias("b_seq"))
    pairs = reviews.join(first, [*place, "_c"]).groupBy("r_seq").agg(F.min("b_seq").alias("b_seq")).groupBy("b_seq").agg(F.min("r_seq").alias("r_seq"))
    credited = built.join(pairs.select(F.col("b_seq").alias("seq"), F.lit(True).alias("_met")), "seq", "left")
    merged = credited.withColumn("engine", F.when(F.col("_met"), F.concat_ws(", ", "engine", F.lit("AI"))).otherwise(F.col("engine"))).drop("_met")
    rest = reviewed.join(pairs.select(F.col("r_seq").alias("seq")), "seq", "left_anti")
    return merged, first_per(rest.withColumn("_c", F.lower("category")), ["path", "line", "_c", "function"], F.col("seq")).drop("_c")


def enclosing(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """sites(path, off, ...) with the innermost function(path, fn, lo, hi) around each, null outside.

    The path bounds the range join; the smallest range wins.
    """
    s, f = sites.withColumn("_site", F.monotonically_increasing_id()).alias("s"), functions.alias("f")
    joined = s.join(f, (F.col("s.path") == F.col("f.path")) & (F.col("s.off") >= F.col("f.lo")) & (F.col("s.off") < F.col("f.hi")), "left")
    w = Window.partitionBy("s._site").orderBy(F.col("f.hi") - F.col("f.lo"), "f.lo", "f.fn")
    top = joined.withColumn("_rank", F.row_number().over(w)).where("_rank = 1")
    return top.select(*[F.col(f"s.{c}") for c in sites.columns], F.col("f.fn").alias("fn"))


def types_at(sites: DataFrame, declarations: DataFrame) -> DataFrame:
    """sites(path, off, name) with the type of the declaration(path, name, type, at, lo, hi) they see, or null.

    Of those whose scope holds the site and that come before it, the innermost
    and then the last one counts; path and name bound the range join.
    """
    s, d = sites.withColumn("_site", F.monotonically_increasing_id()).alias("s"), declarations.alias("d")
    seen = (F.col("s.path") == F.col("d.path")) & (F.col("s.name") == F.col("d.name")) & (F.col("s.off") >= F.col("d.at")) & (F.col("s.off") >= F.col("d.lo")) & (F.col("s.off") < F.col("d.hi"))
    w = Window.partitionBy("s._site").orderBy(F.col("d.hi") - F.col("d.lo"), F.desc("d.at"))
    top = s.join(d, seen, "left").withColumn("_rank", F.row_number().over(w)).where("_rank = 1")
    return top.select(*[F.col(f"s.{c}") for c in sites.columns], F.col("d.type").alias("type"))


def normalised(findings: DataFrame) -> DataFrame:
    return findings.withColumn("path", normalized_path(F.col("path")))
