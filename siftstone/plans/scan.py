"""A scan from files to findings and their log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.operators import findings, rules, tables, taint
from siftstone.plans import reports
from siftstone.plans.loops import cut, folder
from siftstone.sources import files as trees


def scan(files: DataFrame, sources: list[str] | None = None, sinks: list[tuple] | None = None, ignored: DataFrame | None = None) -> DataFrame:
    """(path, line, function, category, severity, engine, taint_path, package, seq) of files(path, ext, content).

    Walks of the whole project, secrets of whole files, weak primitives and XML
    parsers of bodies; one finding for each path, line and category, and one for
    each file and category that is about the file as a whole.  ignored has
    (key), as `findings.without_ignored` reads it.  The files are staged once.
    """
    files = cut(files.select("path", "ext", "content"), "files")
    walked = taint.project(files, tables.sources() if sources is None else sources, tables.sinks() if sinks is None else sinks)
    secrets = rules.file_secrets(files.where(F.length("content") <= taint.MOST)).withColumn("function", F.lit(""))
    bodies = rules.body_findings(files.where(F.length("content") <= taint.MOST))
    none = F.lit(None).cast("array<string>")
    columns = ["path", "line", "function", "category", "severity"]
    every = walked.select(*columns, "taint_path").unionByName(secrets.select(*columns, none.alias("taint_path"))).unionByName(bodies.select(*columns, none.alias("taint_path")))
    place = F.concat_ws("#", "path", F.lpad(F.col("line").cast("string"), 9, "0"), "category", "function")
    found = every.withColumns({"engine": F.lit("Heuristic"), "package": F.lit(None).cast("string"), "seq": place})
    out = findings.dedupe_file_scope(findings.dedupe(found))
    return out if ignored is None else findings.without_ignored(out, ignored)


def scan_directory(spark: SparkSession, root: str, **options) -> DataFrame:
    """`scan` of the source files below root."""
    return scan(trees.read_tree(spark, root), **options)


def work(spark: SparkSession):
    """What `jobs.Jobs` does for a job: scans its path, and gives a summary and the folder of the SARIF log."""

    def run(job, report):
        report("scan", 0.1)
        found = cut(scan_directory(spark, job.path), "findings")
        report("log", 0.8)
        at = folder(spark, "sarif")
        reports.write_log(reports.sarif(found.withColumn("message", F.col("category"))), at)
        counts = found.groupBy("severity").agg(F.count("*").alias("n")).collect()  # four rows at most
        return {"findings": sum(r["n"] for r in counts), "by_severity": {r["severity"]: r["n"] for r in counts}}, at

    return run
