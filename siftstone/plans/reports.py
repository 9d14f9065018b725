"""Reports: SARIF documents, markdown, and frames of stack traces."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions.scalars import pascal_case, slug
from siftstone.plans.loops import numbered


def sarif(findings: DataFrame, tool: str = "siftstone") -> DataFrame:
    """(section, n, value): a SARIF 2.1.0 log of findings(path, line, category, message, severity, seq), in pieces.

    Sections 1, 3 and 5 are rules, artifacts and results, one JSON record a row;
    0, 2, 4 and 6 are the text around them.  `write_log` joins them to a file, so
    no task ever holds the log.  Rules are numbered as their categories first
    appear, artifacts as their paths do; equal slugs get -2, -3, ....
    """
    spark = findings.sparkSession
    cats = findings.groupBy("category").agg(F.min("seq").alias("first"))
    base = cats.withColumn("slug", slug(F.col("category")))
    twin = F.row_number().over(Window.partitionBy("slug").orderBy("first"))
    rules = numbered(base.withColumn("id", F.when(twin > 1, F.concat_ws("-", "slug", twin.cast("string"))).otherwise(F.col("slug"))), "first", "rule")
    paths = numbered(findings.groupBy("path").agg(F.min("seq").alias("first")), "first", "artifact")
    level = F.when(F.col("severity") >= 2, "error").when(F.col("severity") == 1, "warning").otherwise("note")
    results = findings.join(rules.select("category", "id", "rule"), "category").join(paths.select("path", "artifact"), "path")
    place = F.struct(F.struct(F.struct(F.col("artifact").alias("index"), F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.col("line"), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("id").alias("ruleId"), F.col("rule").alias("ruleIndex"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    frame = [
        (0, '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":' + json.dumps(tool) + ',"rules":['),
        (2, ']}},"artifacts":['), (4, '],"results":['), (6, "]}]}"),
    ]
    around = spark.createDataFrame([(s, "", v) for s, v in frame], "section int, n string, value string")
    rank = lambda c: F.lpad(F.col(c).cast("string"), 19, "0").alias("n")
    r = rules.select(F.lit(1).alias("section"), rank("rule"), F.to_json(F.struct("id", pascal_case(F.col("category")).alias("name"), F.struct(F.col("category").alias("text")).alias("shortDescription"))).alias("value"))
    a = paths.select(F.lit(3).alias("section"), rank("artifact"), F.to_json(F.struct(F.struct(F.col("path").alias("uri")).alias("location"))).alias("value"))
    found = results.select(F.lit(5).alias("section"), F.col("seq").cast("string").alias("n"), F.to_json(result).alias("value"))
    return around.unionByName(r).unionByName(a).unionByName(found)


def write_log(log: DataFrame, path: str) -> None:
    """Writes the pieces of `sarif` as text files that, one behind the other, are the log.

    A record after the first of its section begins with a comma; the sort is by
    ranges, so the files are as many as the data needs.
    """
    first = log.where(F.col("section") % 2 == 1).groupBy("section").agg(F.min(F.struct("n", "value")).alias("head"))
    marked = log.join(F.broadcast(first), "section", "left")  # three rows at most
    comma = F.when((F.col("section") % 2 == 1) & (F.struct("n", "value") != F.col("head")), ",").otherwise("")
    marked.orderBy("section", "n", "value").select(F.concat(comma, "value")).write.mode("overwrite").text(path)


def assembled(pieces: DataFrame) -> str:
    """The text of `sarif` or `markdown` pieces, for logs and reports that fit the driver."""
    rows = sorted((r["section"], r["n"], r["value"]) for r in pieces.collect())
    records = {1, 3, 5} if any(r[0] == 0 and r[2].startswith("{") for r in rows) else set()
    if not records:
        return "\n".join(r[2] for r in rows) + "\n"
    return "".join(("," if i and rows[i - 1][0] == r[0] and r[0] in records else "") + r[2] for i, r in enumerate(rows))


def markdown(classified: DataFrame, title: str) -> DataFrame:
    """(section, n, value): the lines of a report of findings(path, line, category, severity, awareness) by section.

    Section 0 is the title; the others are heads of two lines and a line for
    each finding, worst first.  `write_report` puts them in order; no task ever
    holds the report.
    """
    label = F.element_at(F.array(*map(F.lit, ("Low", "Medium", "High", "Critical"))), F.col("severity") + 1)
    line = F.concat(F.lit("- **"), label, F.lit("** "), F.col("category"), F.lit(" — `"), F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit("`"))
    sections = {"introduced": "Introduced", "contextual": "Contextual", "fixed": "Fixed", "preExisting": "Pre-existing"}
    order, name = F.lit(9), F.col("awareness")
    for n, (k, v) in enumerate(sections.items()):
        order, name = F.when(F.col("awareness") == k, n).otherwise(order), F.when(F.col("awareness") == k, F.lit(v)).otherwise(name)
    heads = classified.groupBy(order.alias("o"), name.alias("name")).agg(F.count("*").alias("k"))
    first = heads.agg(F.min("o").alias("first"))
    blank = F.when(F.col("o") == F.col("first"), "").otherwise("\n")  # the title ends in a blank line of its own
    head = heads.join(F.broadcast(first)).select((2 * F.col("o") + 1).alias("section"), F.col("name").alias("n"), F.concat(blank, F.lit("## "), "name", F.lit(" ("), F.col("k").cast("string"), F.lit(")\n")).alias("value"))
    rank = F.concat(name, F.lit("#"), (F.lit(9) - F.col("severity")).cast("string"), F.lit("#"), F.col("path"), F.lit("#"), F.lpad(F.col("line").cast("string"), 9, "0"))
    rows = classified.select((2 * order + 2).alias("section"), rank.alias("n"), line.alias("value"))
    top = classified.sparkSession.createDataFrame([(0, "", f"# {title}\n")], "section int, n string, value string")
    return top.unionByName(head).unionByName(rows)


def write_report(pieces: DataFrame, path: str) -> None:
    """Writes the pieces of `markdown` as text files that, one behind the other, are the report."""
    pieces.orderBy("section", "n", "value").select("value").write.mode("overwrite").text(path)


# Shapes of a frame, the first that fits counts: (pattern, group of function, file, line).
FRAMES = (
    (r"^\s*at\s+(\S+)\s+\(([^:()]+):(\d+)(?::\d+)?\)\s*$", 1, 2, 3),
    (r"^\s*at\s+([\w$<>]+(?:\.[\w$<>]+)*)\(([^:()]+):(\d+)\)\s*$", 1, 2, 3),
    (r"^\s*#\d+\s+.*?\bin\s+([\w:]+)\s+\(.*?\)\s+at\s+([^:() ]+):(\d+)\s*$", 1, 2, 3),
    (r'File "([^"]+)", line (\d+)(?:, in ([^ ]+))?', 3, 1, 2),
    (r"^\s*([A-Za-z_][A-Za-z0-9_:]*[+\-]?)\s+\(([^:()]+):(\d+)(?::\d+)?\)\s*$", 1, 2, 3),
    (r"^\s*at\s+([^:() ]+):(\d+)(?::\d+)?\s*$", 0, 1, 2),
    (r"^\s*([A-Za-z0-9_:]+)\s+at\s+([^:() ]+):(\d+)(?::\d+)?\s*$", 1, 2, 3),
    (r"^\s*([^:() ]+):(\d+)(?::\d+)?\s*$", 0, 1, 2),
)


def frames(lines: DataFrame) -> DataFrame:
    """(trace, seq, function, file_hint, line) of traces lines(trace, seq, text).

    A line that is a symbol alone names the next frame that has no name.
    """
    text = F.trim("text")
    numbered = F.trim(F.regexp_extract(text, r"^\d+:(.+)$", 1))
    symbol = F.when((numbered != "") & (numbered.contains("::") | numbered.contains(".")), numbered).when(text.contains("::") & ~text.contains("(") & ~text.contains(" at "), text)
    found = F.lit(None).cast("struct<function:string,file_hint:string,line:int>")
    for pattern, fn, file, number in reversed(FRAMES):
        hint = F.regexp_extract(text, pattern, file)
        fits = text.rlike(pattern) & hint.rlike(r"[./\\]")
        named = F.regexp_extract(text, pattern, fn) if fn else F.lit("")
        found = F.when(fits, F.struct(named.alias("function"), hint.alias("file_hint"), F.regexp_extract(text, pattern, number).cast("int").alias("line"))).otherwise(found)
    marked = lines.where(text != "").withColumn("_symbol", symbol).withColumn("_frame", F.when(F.col("_symbol").isNull(), found))
    kept = marked.where("_symbol is not null or _frame is not null")
    w = Window.partitionBy("trace").orderBy("seq")
    before = F.lag("_symbol").over(w)
    name = F.col("_frame.function")
    short = F.when(name.rlike(r"^[^(]*\.[^.]*$") | name.rlike(r"\..*\."), F.regexp_extract(name, r"\.([^.]*)$", 1)).otherwise(name)
    out = kept.withColumn("_before", before).where("_frame is not null")
    return out.select("trace", "seq", F.when(name != "", short).otherwise(F.coalesce("_before", F.lit(""))).alias("function"), F.col("_frame.file_hint").alias("file_hint"), F.col("_frame.line").alias("line"))


def locate_frames(found: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """found with `path`: the hint if it is a file, else root/hint, else root/name; null if none is."""
    have = files.select(F.col("path").alias("_p")).distinct()
    tries = found.withColumn("_id", F.monotonically_increasing_id()).withColumn("_try", F.array("file_hint", F.concat(F.lit(root.rstrip("/") + "/"), "file_hint"), F.concat(F.lit(root.rstrip("/") + "/"), F.substring_index("file_hint", "/", -1))))
    each = tries.select("_id", F.posexplode("_try").alias("n", "_p")).join(have, "_p").groupBy("_id").agg(F.min(F.struct("n", "_p"))["_p"].alias("path"))
    return tries.join(each, "_id", "left").drop("_id", "_try")
