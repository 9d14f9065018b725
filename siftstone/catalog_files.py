"""Registered queries over source files made of table rows, with DuckDB SQL over the columns they are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone import standins
from siftstone.functions import scalars as S
from siftstone.operators import bayes, diff, findings, graphs, lexing, packages, reviews, rules, tables, taint
from siftstone.plans import reports, scan
from siftstone.plans.loops import cut
from siftstone.sources import files as sources
from siftstone.sources import forges, stores
from siftstone.streaming import monitor

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _add(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


# --- dependency files ---------------------------------------------------------


def _dependencies(kind: str):
    def query(spark, d):
        return packages.dependencies(standins.manifests(spark, d, kind))

    query.__name__, query.__doc__ = f"dependencies_{kind}", f"The dependencies in files of the kind {kind}."
    return query


for _kind in standins.MANIFESTS:
    _add(f"dependencies_{_kind}", _dependencies(_kind), standins.manifest_sql(_kind))


_LANGUAGES = ("npm_lock", "package_json", "requirements", "pyproject", "cargo", "pom", "go_mod", "gemfile")


def dependency_scan(spark, d):
    """Discovery over several languages: the manifests of those that have a lock file go, and so do skipped folders."""
    files = cut(reduce(DataFrame.unionByName, [standins.manifests(spark, d, k) for k in _LANGUAGES]), "manifests")
    hidden = files.withColumn("path", F.concat(F.lit("node_modules/x/"), "path"))
    return packages.dependencies(files.unionByName(hidden))


_add("dependency_scan", dependency_scan, " UNION ALL ".join(f"(SELECT * FROM ({standins.manifest_sql(k)}))" for k in _LANGUAGES if k not in ("package_json", "pyproject")))


def package_rows(spark, d):
    """The dependency list of a report: the first thousand by ecosystem, name and version (a limit of the report)."""
    return packages.by_name(packages.dependencies(standins.manifests(spark, d, "poetry"))).limit(1000)


_add("package_rows", package_rows, f"SELECT * FROM ({standins.manifest_sql('poetry')}) ORDER BY ecosystem, lower(name), name, version, path, line LIMIT 1000")


# --- code -----------------------------------------------------------------------

_CODE = standins.CODE
_TAINTED = "CASE l WHEN 3 THEN 'Code Injection' ELSE 'Command Injection' END AS category, CAST(CASE WHEN l >= 4 THEN 2 ELSE 3 END AS INTEGER) AS severity, 'a > t' AS flow"
_SINK_LINE = "CAST(above + CASE l WHEN 2 THEN 7 ELSE 6 END AS INTEGER) AS line"


def function_complexity(spark, d):
    return lexing.extract_functions(standins.code(spark, d)).select("path", "fn", "line", F.array_join("params", ",").alias("params"), "complexity")


_add("function_complexity", function_complexity, f"{_CODE} SELECT path, fn, CAST(above + 1 AS INTEGER) AS line, 'a,b' AS params, CAST(1 + 2 * b AS INTEGER) AS complexity FROM x")


def complexity_summary(spark, d):
    return lexing.complexity_summary(lexing.extract_functions(standins.code(spark, d)))


_add("complexity_summary", complexity_summary, f"{_CODE} SELECT count(*) AS functions, CAST(sum(1 + 2 * b) // count(*) AS BIGINT) AS mean, CAST(max(1 + 2 * b) AS INTEGER) AS highest, count(DISTINCT path) AS files FROM x")


def code_tokens(spark, d):
    """Tokens of the parameter, string literals and keywords `if` in each file."""
    t = lexing.lex(standins.code(spark, d))
    return t.groupBy("path").agg(F.count_if((F.col("kind") == "identifier") & (F.col("text") == "a")).alias("a"), F.count_if(F.col("kind") == "string").alias("strings"), F.count_if((F.col("kind") == "keyword") & (F.col("text") == "if")).alias("branches"))


_add("code_tokens", code_tokens, f"{_CODE} SELECT path, CAST(sum(1 + CASE s WHEN 2 THEN 0 ELSE 1 END) AS BIGINT) AS a, CAST(sum(CASE s WHEN 2 THEN 1 ELSE 0 END) AS BIGINT) AS strings, CAST(sum(b) AS BIGINT) AS branches FROM x GROUP BY path")


def code_call_edges(spark, d):
    code = cut(standins.code(spark, d), "code")
    return graphs.prefer_same_file(graphs.call_edges(lexing.lex(code), lexing.extract_functions(code))).select("path", "caller", "callee")


_add("code_call_edges", code_call_edges, f"{_CODE} SELECT path, fn AS caller, 'f' || (j + 1) || '_' || k AS callee FROM x WHERE j + 1 < n")


def taint_scan(spark, d):
    """The walk of each file by itself: every parameter begins tainted."""
    return taint.scan(standins.code(spark, d), standins.SOURCES, standins.SINKS).select("path", "function", "line", "category", "severity", F.array_join("taint_path", " > ").alias("flow"))


_add("taint_scan", taint_scan, f"{_CODE} SELECT path, fn AS function, {_SINK_LINE}, {_TAINTED} FROM x WHERE s = 0")


def _project(spark, d):
    return taint.project(standins.code(spark, d), standins.SOURCES, standins.SINKS)


def project_scan(spark, d):
    """The whole scan: facts of all files, the fixpoint, and walks that begin with what call sites taint."""
    return _project(spark, d).select("path", "function", "line", "category", "severity", F.array_join("taint_path", " > ").alias("flow"))


_PROJECT = "s = 0 AND (j = 0 OR s_before <> 2)"
_add("project_scan", project_scan, f"{_CODE} SELECT path, fn AS function, {_SINK_LINE}, {_TAINTED} FROM x WHERE {_PROJECT}")


def project_facts(spark, d):
    """Facts by kind: definitions, calls, seeds of parameters, static functions."""
    return taint.all_facts(standins.code(spark, d), standins.SOURCES).where(F.col("kind").isin("defined", "param_seed", "static")).select("path", "kind", "fn", "name")


_add("project_facts", project_facts, f"""{_CODE} SELECT path, 'defined' AS kind, fn, fn AS name FROM x UNION ALL SELECT path, 'static', fn, fn FROM x WHERE hidden
UNION ALL SELECT DISTINCT path, 'param_seed', 'f' || (j + 1) || '_' || k, '0' FROM x WHERE j + 1 < n AND s <> 2 UNION ALL SELECT DISTINCT path, 'param_seed',
CASE l WHEN 0 THEN 'system' WHEN 1 THEN 'exec' WHEN 2 THEN 'system' WHEN 3 THEN 'eval' ELSE 'run' END, '0' FROM x WHERE s IN (0, 1)""")


def dead_functions(spark, d):
    """Findings of the walk, without those in static functions that nothing calls."""
    code = cut(standins.code(spark, d), "code")
    found = taint.scan(code, standins.SOURCES, standins.SINKS)
    return graphs.without_dead(found, lexing.extract_functions(code), graphs.occurrences(lexing.lex(code))).select("path", "function", "line")


_add("dead_functions", dead_functions, f"{_CODE} SELECT path, fn AS function, {_SINK_LINE} FROM x WHERE s = 0 AND NOT (hidden AND j = 0)")


def sarif_log(spark, d):
    """The rules, artifacts and results of the project's SARIF log, a JSON record each."""
    found = _project(spark, d).select("*", F.col("category").alias("message"), F.concat_ws("#", "path", F.lpad(F.col("line").cast("string"), 9, "0")).alias("seq"))
    log = reports.sarif(found).where(F.col("section").isin(1, 3, 5))
    value = F.from_json("value", "id string, location struct<uri: string>, ruleId string, ruleIndex int, level string, locations array<struct<physicalLocation: struct<artifactLocation: struct<index: int, uri: string>, region: struct<startLine: int>>>>")
    place = F.col("v.locations")[0]["physicalLocation"]
    return log.withColumn("v", value).select(
        "section", F.coalesce("v.id", "v.ruleId", "v.location.uri").alias("name"), F.col("v.ruleIndex").alias("rule"), F.col("v.level").alias("level"),
        place["artifactLocation"]["uri"].alias("uri"), place["artifactLocation"]["index"].alias("artifact"), place["region"]["startLine"].alias("line"),
    )


_add("sarif_log", sarif_log, f"""{_CODE}, q AS (SELECT *, path || '#' || lpad(CAST(line AS VARCHAR), 9, '0') AS seq FROM (SELECT path, {_SINK_LINE}, {_TAINTED} FROM x WHERE {_PROJECT})),
r AS (SELECT category, row_number() OVER (ORDER BY min(seq)) - 1 AS rule, replace(lower(category), ' ', '-') AS id FROM q GROUP BY category),
a AS (SELECT path, row_number() OVER (ORDER BY min(seq)) - 1 AS artifact FROM q GROUP BY path)
SELECT 1 AS section, id AS name, NULL AS rule, NULL AS level, NULL AS uri, NULL AS artifact, NULL AS line FROM r UNION ALL SELECT 3, path, NULL, NULL, NULL, NULL, NULL FROM a
UNION ALL SELECT 5, id, CAST(rule AS INTEGER), 'error', path, CAST(artifact AS INTEGER), line FROM q JOIN r USING (category) JOIN a USING (path)""")


# --- changes -----------------------------------------------------------------------


def hunk_ranges(spark, d):
    return diff.hunks(standins.diffs(spark, d))


_add("hunk_ranges", hunk_ranges, f"{standins.HUNKS} SELECT CAST(d AS VARCHAR) AS diff, 'src/o' || o || '.c' AS path, i * 100 + 7 AS head_start, i * 100 + 7 + plus + 1 AS head_end, i * 100 AS base_start, i * 100 + minus + 1 AS base_end FROM h")


def patch_split(spark, d):
    return diff.split_by_path(standins.diffs(spark, d)).select("diff", "path", F.size(F.split("patch", "\n")).alias("lines"))


_add("patch_split", patch_split, f"{standins.HUNKS} SELECT CAST(d AS VARCHAR) AS diff, 'src/o' || o || '.c' AS path, CAST(3 + sum(1 + minus + plus) AS INTEGER) AS lines FROM h GROUP BY d, o")


def training_lines(spark, d):
    """Removed lines of diffs are bad, added ones good."""
    lines = bayes.patch_lines(standins.diffs(spark, d).select(F.col("diff").alias("patch"), "content"), ["c"])
    return lines.groupBy("patch", "bad", "text").agg(F.count("*").alias("n"))


_add("training_lines", training_lines, f"""{standins.HUNKS} SELECT CAST(d AS VARCHAR) AS patch, true AS bad, 'old' AS text, CAST(sum(minus) AS BIGINT) AS n FROM h GROUP BY d HAVING sum(minus) > 0
UNION ALL SELECT CAST(d AS VARCHAR), false, 'new', CAST(sum(plus) AS BIGINT) FROM h GROUP BY d HAVING sum(plus) > 0""")


# --- statements that write, weak primitives ---------------------------------------------


def output_scan(spark, d):
    """Markup, database commands and PHP output that carry tainted values."""
    return taint.scan(standins.written(spark, d), ["$_GET"], []).select("path", "function", "line", "category", "severity")


_add("output_scan", output_scan, f"{standins.OUTPUT} SELECT path, 'f' AS function, 3 AS line, CASE t WHEN 2 THEN 'SQL Injection' ELSE 'XSS (HTML Injection)' END AS category, 2 AS severity FROM x WHERE t IN (0, 2, 3)")


def body_scan(spark, d):
    """Weak cryptography and open XML parsers; comments and hardened parsers do not count."""
    return rules.body_findings(standins.written(spark, d))


_add("body_scan", body_scan, f"""{standins.OUTPUT} SELECT path, 'f' AS function, 3 AS line, 'Weak Cryptography (MD5 / SHA-1 / DES / RC4)' AS category, 2 AS severity FROM x WHERE t = 6
UNION ALL SELECT path, 'f', 3, 'Weak Cryptography (insecure algorithm/block mode)', 2 FROM x WHERE t = 7 UNION ALL SELECT path, 'f', 4, 'XXE (XML External Entity)', 2 FROM x WHERE t = 7""")


# --- trees, names, calls ------------------------------------------------------------------


def _part(spark, d, sql: str) -> DataFrame:
    return standins.sql(spark, sql, d, "part")


_PATHS = """SELECT p_partkey AS k, CASE p_partkey % 10 WHEN 0 THEN 'src/a' || p_partkey || '.RB' WHEN 1 THEN 'build/b' || p_partkey || '.c' WHEN 2 THEN 'x/.git/c' || p_partkey || '.c' WHEN 3 THEN '.hidden/d' || p_partkey || '.py'
 WHEN 4 THEN 'vendor/e' || p_partkey || '.go' WHEN 5 THEN 'lib/f' || p_partkey || '.inc' WHEN 6 THEN 'lib/g' || p_partkey || '.rake' WHEN 7 THEN 'lib/h' || p_partkey || '.swift' WHEN 8 THEN 'docs/i' || p_partkey || '.txt' ELSE 'rebuild/j' || p_partkey || '.cpp' END AS path FROM part"""


def tree_scanned(spark, d):
    """Files that the scanner reads: by extension, without hidden and excluded folders."""
    return sources.enumerate_files(_part(spark, d, _PATHS).select("path", F.lit("x").alias("content"))).select("path", "ext", "lang")


_add("tree_scanned", tree_scanned, f"SELECT path, CASE k % 10 WHEN 0 THEN 'rb' WHEN 5 THEN 'inc' WHEN 7 THEN 'swift' ELSE 'cpp' END AS ext, CASE k % 10 WHEN 0 THEN 'Ruby' WHEN 5 THEN 'PHP' WHEN 7 THEN 'Swift' ELSE 'C++' END AS lang FROM ({_PATHS}) WHERE k % 10 IN (0, 5, 7, 9)")


def tree_viewed(spark, d):
    """Files that a viewer shows, and those of every extension (null: not in its list)."""
    files = _part(spark, d, _PATHS).select("path", F.lit("x").alias("content"))
    viewed = sources.enumerate_files(files, sources.VIEWED).select("path", F.lit("viewed").alias("list"))
    return viewed.unionByName(sources.enumerate_files(files, None).select("path", F.lit("all").alias("list")))


_add("tree_viewed", tree_viewed, f"SELECT path, 'viewed' AS list FROM ({_PATHS}) WHERE k % 10 IN (0, 6, 7, 9) UNION ALL SELECT path, 'all' FROM ({_PATHS}) WHERE k % 10 NOT IN (1, 2, 3, 4)")


def file_listing(spark, d):
    """Entries of each folder; `vendor`, `build` and `.git` are not listed."""
    return sources.listing(_part(spark, d, _PATHS).select("path")).select("folder", "name", "is_dir")


_add("file_listing", file_listing, f"""WITH p AS ({_PATHS}), s AS (SELECT k, string_split(path, '/') AS x FROM p)
SELECT DISTINCT '' AS folder, x[1] AS name, true AS is_dir FROM s WHERE x[1] NOT IN ('build', 'vendor') UNION ALL SELECT DISTINCT x[1], x[2], len(x) > 2 FROM s WHERE x[2] <> '.git' UNION ALL SELECT 'x/.git', x[3], false FROM s WHERE len(x) = 3""")

_MACROS = """SELECT p_partkey AS k, 'inc/m' || (p_partkey % 30) || '.h' AS path, CAST(p_partkey AS INT) AS line, CASE p_partkey % 5 WHEN 0 THEN '#define NAME' || p_partkey || ' "v' || p_partkey || '"' WHEN 1 THEN '  # define call' || p_partkey || ' target' || (p_partkey % 9)
 WHEN 2 THEN 'static const char *PATH' || p_partkey || ' = "/etc/' || p_partkey || '";' WHEN 3 THEN 'int plain' || p_partkey || ' = 3;' ELSE '#define SUM' || p_partkey || '(a) ((a) + 1)' END AS text FROM part"""


def macro_table(spark, d):
    return rules.macros(_part(spark, d, _MACROS))


_add("macro_table", macro_table, f"SELECT path, line, CASE k % 5 WHEN 0 THEN 'string' WHEN 1 THEN 'alias' ELSE 'constant' END AS kind, CASE k % 5 WHEN 0 THEN 'NAME' || k WHEN 1 THEN 'call' || k ELSE 'PATH' || k END AS name, CASE k % 5 WHEN 0 THEN 'v' || k WHEN 1 THEN 'target' || (k % 9) ELSE '/etc/' || k END AS value FROM ({_MACROS}) WHERE k % 5 < 3")

_CLASSES = """SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 3 THEN 'test/' ELSE 'src/' END || 'K' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.java' WHEN 1 THEN '.cs' ELSE '.py' END AS path,
 'class K' || p_partkey || ' { void f() { Foo x = new Foo(1); y = new Foo<String>(2); z = new Food(3); ' || CASE p_partkey % 2 WHEN 0 THEN 'w = new Foo(); ' ELSE '' END || '} }' || chr(10) || 'interface I' || p_partkey || ' { }' AS content FROM part"""


def instantiations(spark, d):
    """`new Foo(...)` in Java and C# files outside tests."""
    files = _part(spark, d, _CLASSES).select(F.concat(F.lit("p/"), "path").alias("path"), "content")
    return rules.instantiations(files, "Foo")


_add("instantiations", instantiations, f"SELECT 'p/' || path AS path, CAST(CASE k % 2 WHEN 0 THEN 3 ELSE 2 END AS INTEGER) AS n FROM ({_CLASSES}) WHERE k % 3 < 2 AND k % 4 <> 3")


def class_names(spark, d):
    return rules.class_names(_part(spark, d, _CLASSES).select("path", "content"))


_add("class_names", class_names, f"SELECT path, 'K' || k AS name FROM ({_CLASSES}) UNION ALL SELECT path, 'I' || k FROM ({_CLASSES})")

_CALLS = "SELECT l_orderkey * 10 + l_linenumber AS line, CASE l_linenumber % 2 WHEN 0 THEN 'py' ELSE 'java' END AS lang, CASE l_partkey % 5 WHEN 0 THEN 'a.os.system' WHEN 1 THEN 'system' WHEN 2 THEN 'x.y.exec' WHEN 3 THEN 'mac' ELSE 'none' END AS chain, 'f' || l_suppkey || '.x' AS path FROM lineitem"
_SINKS = [("os.system", "Command (dotted)", 3, ["py"]), ("system", "Command (bare)", 2, None), ("exec", "Exec (java)", 3, ["java"]), ("exec", "Exec (any)", 1, None)]


def sink_rules(spark, d):
    """Calls against a rule table: dotted names first, then bare ones; rules for a language beat the others; macros are followed."""
    calls = standins.sql(spark, _CALLS, d, "lineitem")
    table = spark.createDataFrame(_SINKS, "key string, category string, severity int, langs array<string>")
    # A name that is defined twice, and a chain of macros.
    aliases = spark.createDataFrame([("mac", "mid"), ("mac", "mid"), ("mid", "system"), ("loop", "loop")], "name string, target string")
    return rules.match_sinks(calls, table, aliases).select("path", "line", "lang", "category", "severity")


_add("sink_rules", sink_rules, f"""SELECT path, line, lang, CASE WHEN chain = 'a.os.system' AND lang = 'py' THEN 'Command (dotted)' WHEN chain = 'x.y.exec' THEN CASE lang WHEN 'java' THEN 'Exec (java)' ELSE 'Exec (any)' END ELSE 'Command (bare)' END AS category,
CASE WHEN chain = 'a.os.system' AND lang = 'py' THEN 3 WHEN chain = 'x.y.exec' THEN CASE lang WHEN 'java' THEN 3 ELSE 1 END ELSE 2 END AS severity FROM ({_CALLS}) WHERE chain <> 'none'""")


def entry_sites(spark, d):
    """The first 500 sites of entry APIs by place (the report's limit), in code of six languages."""
    t = lexing.lex(standins.code(spark, d)).withColumnRenamed("ext", "lang")
    catalog = [("system", "os", "Process", "local", "primary", ["py"]), ("exec", "rt", "Process", "local", "indirect", ["java"]), ("sanitize", None, "Filter", "remote", "indirect", None)]
    return rules.entry_sites(t, spark.createDataFrame(catalog, "leaf string, prefix string, category string, origin string, confidence string, langs array<string>")).groupBy("path", "category").agg(F.count("*").alias("n"))


_add("entry_sites", entry_sites, f"""{standins.CODE}, s AS (SELECT path, j, 0 AS o, 'Filter' AS category FROM x WHERE s = 1 UNION ALL SELECT path, j, 1, 'Process' FROM x WHERE l IN (1, 2) AND s <> 3),
r AS (SELECT *, row_number() OVER (ORDER BY path, j, o) AS r FROM s) SELECT path, category, count(*) AS n FROM r WHERE r <= 500 GROUP BY path, category""")

_DEFS = "SELECT 'd' || (l_partkey % 7) AS path, 'c' || l_suppkey AS caller, 'd' || (l_orderkey % 5) AS callee_path, 'g' || (l_linenumber) AS callee FROM lineitem"


def same_file_first(spark, d):
    return graphs.prefer_same_file(standins.sql(spark, _DEFS, d, "lineitem").distinct())


_add("same_file_first", same_file_first, f"SELECT path, caller, coalesce(max(callee_path) FILTER (WHERE callee_path = path), min(callee_path)) AS callee_path, callee FROM ({_DEFS}) GROUP BY path, caller, callee")

_FLOW = "SELECT DISTINCT 'p' || (l_orderkey % 500) AS path, 'f' || l_linenumber AS caller, 'f' || (l_linenumber + 1) AS callee FROM lineitem WHERE l_partkey % 3 > 0"


def file_reachability(spark, d):
    """Functions that `main` of their file reaches; files without one are reachable throughout."""
    li = standins.table(spark, d, "lineitem")
    name = F.when((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 2 == 0), "main").otherwise(F.concat(F.lit("f"), F.col("l_linenumber")))
    fns = li.select(F.concat(F.lit("p"), F.col("l_orderkey") % 500).alias("path"), name.alias("fn")).distinct()
    steps = standins.sql(spark, _FLOW, d, "lineitem")
    first = steps.where("caller = 'f1'").withColumn("caller", F.lit("main"))
    return graphs.reachable(fns, steps.unionByName(first)).select("path", "fn", "reachable")


_add("file_reachability", file_reachability, f"""WITH RECURSIVE n AS (SELECT DISTINCT 'p' || (l_orderkey % 500) AS path, CASE WHEN l_linenumber = 1 AND l_orderkey % 2 = 0 THEN 'main' ELSE 'f' || l_linenumber END AS fn FROM lineitem),
e AS (SELECT * FROM ({_FLOW}) UNION ALL SELECT path, 'main', callee FROM ({_FLOW}) WHERE caller = 'f1'),
r(path, fn) AS (SELECT path, fn FROM n WHERE fn = 'main' UNION SELECT e.path, e.callee FROM r JOIN e ON e.path = r.path AND e.caller = r.fn JOIN n ON n.path = e.path AND n.fn = e.callee)
SELECT path, fn, path NOT IN (SELECT path FROM n WHERE fn = 'main') OR (path, fn) IN (SELECT (path, fn) FROM r) AS reachable FROM n""")


# --- reviews ----------------------------------------------------------------------------------


def answer_records(spark, d):
    """Records in loose answers: fenced, wrapped, with trailing commas, and in prose."""
    return reviews.parse_answers(_part(spark, d, _ANSWERS), "k").select("k", "line", "category", "severity")


_ANSWERS = """SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN '```json' || chr(10) || '[{"line": ' || p_partkey || ', "category": "XSS", "severity": "high"},]' || chr(10) || '```'
 WHEN 1 THEN 'Here: {"findings": [{"Line": "' || p_partkey || '", "type": "SQL"}, {"line": 2, "category": "Race"}]} done.' WHEN 2 THEN 'no finding [1] at all' WHEN 3 THEN '{"line_number": ' || p_partkey || ', "category": "Path", "severity": "LOW", "x": [1, 2,],}' ELSE '{"line": "many", "category": "Odd"}' END AS answer FROM part"""
_add("answer_records", answer_records, f"""WITH a AS ({_ANSWERS}) SELECT k, CAST(k AS INTEGER) AS line, 'XSS' AS category, 'high' AS severity FROM a WHERE k % 5 = 0 UNION ALL SELECT k, CAST(k AS INTEGER), 'SQL', '' FROM a WHERE k % 5 = 1
UNION ALL SELECT k, 2, 'Race', '' FROM a WHERE k % 5 = 1 UNION ALL SELECT k, CAST(k AS INTEGER), 'Path', 'LOW' FROM a WHERE k % 5 = 3 UNION ALL SELECT k, 0, 'Odd', '' FROM a WHERE k % 5 = 4""")


def review_batches(spark, d):
    """Cards of each source in batches of at most four and 48,000 characters."""
    cards = standins.table(spark, d, "documents").select(F.col("source").alias("path"), F.col("doc_id").cast("int").alias("card"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    return reviews.batches(cards).select("path", "card", "batch")


_add("review_batches", review_batches, """WITH RECURSIVE d AS (SELECT source AS path, CAST(doc_id AS INTEGER) AS card, length(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
b(path, card, i, batch, n, held) AS (SELECT path, card, i, 0, 1, size FROM d WHERE i = 1 UNION ALL
 SELECT d.path, d.card, d.i, CASE WHEN n >= 4 OR held + size > 48000 THEN batch + 1 ELSE batch END, CASE WHEN n >= 4 OR held + size > 48000 THEN 1 ELSE n + 1 END, CASE WHEN n >= 4 OR held + size > 48000 THEN size ELSE held + size END FROM b JOIN d ON d.path = b.path AND d.i = b.i + 1)
SELECT path, card, CAST(batch AS INTEGER) AS batch FROM b""")


def review_categories(spark, d):
    """Free categories under known names: equal ignoring case, else one inside the other, else as they are."""
    known = spark.createDataFrame([(0, "Economy"), (1, "Standard"), (2, "Small"), (3, "Promo")], "ord int, name string")
    found = standins.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat(F.col("p_type"), F.when(F.col("p_partkey") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit(" of "), F.col("p_size").cast("string")))).alias("category"), F.lit("High").alias("severity"))
    return reviews.normalised_categories(found, known)


_add("review_categories", review_categories, """WITH f AS (SELECT p_partkey AS k, p_type || CASE p_partkey % 2 WHEN 0 THEN '' ELSE ' of ' || p_size END AS category FROM part)
SELECT k, CASE WHEN lower(category) LIKE '%economy%' THEN 'Economy' WHEN lower(category) LIKE '%standard%' THEN 'Standard' WHEN lower(category) LIKE '%small%' THEN 'Small' WHEN lower(category) LIKE '%promo%' THEN 'Promo' ELSE substr(category, 1, 60) END AS category, 2 AS severity FROM f""")


# --- advisories, forges, stores ------------------------------------------------------------------


def advisory_batches(spark, d):
    """Distinct keys in order, a thousand to a request."""
    li = standins.table(spark, d, "lineitem").select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), F.col("l_partkey")).alias("name"), F.concat(F.lit("1."), F.col("l_linenumber")).alias("version"))
    return forges.query_batches(li)


_add("advisory_batches", advisory_batches, """WITH k AS (SELECT DISTINCT 'npm' AS ecosystem, 'p' || l_partkey AS name, '1.' || l_linenumber AS version FROM lineitem)
SELECT *, (row_number() OVER (ORDER BY ecosystem, name, version) - 1) // 1000 AS batch FROM k""")

_URLS = """SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'https://github.com/own' || p_partkey || '/r.git' WHEN 1 THEN 'git@gitlab.com:g/s/r' || p_partkey || '.git' WHEN 2 THEN 'ssh://git@bitbucket.org/o/r' || p_partkey || '/' WHEN 3 THEN 'https://codeberg.org/o/r' || p_partkey ELSE 'https://code.example.com/o/r' || p_partkey END AS url FROM part"""


def forge_urls(spark, d):
    return _part(spark, d, _URLS).select("k", S.forge_slug(F.col("url")).alias("slug"), S.forge_of(F.when(F.col("k") % 5 == 1, "gitlab.com").when(F.col("k") % 5 == 2, "bitbucket.org").otherwise(F.col("url"))).alias("forge"))


_add("forge_urls", forge_urls, f"""SELECT k, CASE k % 5 WHEN 0 THEN 'own' || k || '/r' WHEN 1 THEN 'g/s/r' || k ELSE 'o/r' || k END AS slug, CASE k % 5 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' WHEN 2 THEN 'bitbucket' WHEN 3 THEN 'gitea' END AS forge FROM ({_URLS})""")


def pull_requests(spark, d):
    """Answers of two forges as rows, from JSON that a collector has landed."""
    o = standins.table(spark, d, "orders").select((F.col("o_orderkey") % 3).alias("f"), F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))
    github = F.format_string('[{"id": %d, "number": 7, "title": "t", "user": {"login": "u"}, "head": {"ref": "h", "sha": "s%d"}, "base": {"ref": "main"}, "updated_at": "%s"}]', "id", "id", "at")
    gitlab = F.format_string('[{"id": %d, "iid": 7, "title": "t", "author": {"username": "u"}, "source_branch": "h", "target_branch": "main", "sha": "s%d", "updated_at": "%s"}]', "id", "id", "at")
    one = forges.pull_requests(o.where("f = 0").select(F.lit("a/b").alias("repo"), github.alias("value")), "github")
    two = forges.pull_requests(o.where("f = 1").select(F.lit("a/b").alias("repo"), gitlab.alias("value")), "gitlab")
    broken = forges.pull_requests(o.where("f = 2").select(F.lit("a/b").alias("repo"), F.lit('{"message": "rate limit"}').alias("value")), "github")
    return one.unionByName(two).unionByName(broken).withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


_add("pull_requests", pull_requests, "SELECT 'a/b' AS repo, o_orderkey AS id, CAST(7 AS BIGINT) AS number, 't' AS title, 'u' AS author, 'h' AS head, 'main' AS base, 's' || o_orderkey AS head_sha, strftime(date_trunc('second', o_orderdate), '%Y-%m-%d %H:%M:%S') AS updated_at FROM orders WHERE o_orderkey % 3 < 2")


def bug_search(spark, d):
    """Bugs that hold a text in any searched field."""
    bugs = standins.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("package"), F.col("o_orderstatus").alias("detail"), F.lit("High").alias("severity"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("createdAt"))
    return stores.search_bugs(bugs, "urgent").select("id", "title")


_add("bug_search", bug_search, "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS title FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%' OR lower(o_orderstatus) LIKE '%urgent%'")


def watched_polls(spark, d):
    """Polls of watched branches without ignored fingerprints."""
    e = standins.table(spark, d, "events")
    polls = e.select((F.col("user_id") % 50).cast("string").alias("repo"), F.when(F.col("event_id") % 2 == 0, "Main").otherwise("dev").alias("base"), F.concat(F.lit("e"), F.col("event_id")).alias("fingerprint"))
    branches = spark.range(0, 25).select(F.col("id").cast("string").alias("repo"), F.lit("main").alias("branch"))
    return monitor.allowed(polls, branches, e.where("event_id % 7 = 0").select(F.concat(F.lit("e"), F.col("event_id")).alias("fingerprint")))


_add("watched_polls", watched_polls, "SELECT CAST(user_id % 50 AS VARCHAR) AS repo, CASE event_id % 2 WHEN 0 THEN 'Main' ELSE 'dev' END AS base, 'e' || event_id AS fingerprint FROM events WHERE event_id % 7 <> 0 AND (user_id % 50 >= 25 OR event_id % 2 = 0)")


# --- findings of files ------------------------------------------------------------------------------

def cross_file(spark, d):
    """Findings whose flow begins at a source that only the project's index knows."""
    li = standins.table(spark, d, "lineitem")
    found = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_partkey") % 4 > 0, F.array(F.concat(F.lit("s"), F.col("l_suppkey")), F.lit("x"))).alias("taint_path"))
    known = standins.table(spark, d, "supplier").where("s_nationkey < 10").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("name"))
    return findings.cross_file(found, known).groupBy("cross_file").agg(F.count("*").alias("n"))


_add("cross_file", cross_file, "SELECT l_partkey % 4 > 0 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10) AS cross_file, count(*) AS n FROM lineitem GROUP BY 1")


def paths_normalised(spark, d):
    """Paths below a root, without case and outer slashes."""
    p = F.concat(F.lit("/Repo/"), F.col("p_brand"), F.lit("\\Src/"), F.col("p_partkey"), F.lit("/"))
    return standins.table(spark, d, "part").select("p_partkey", S.normalized_path(p).alias("path"), S.relative_path(p, F.lit("/Repo/")).alias("relative"))


_add("paths_normalised", paths_normalised, "SELECT p_partkey, 'repo/' || lower(p_brand) || '/src/' || p_partkey AS path, lower(p_brand) || '/src/' || p_partkey AS relative FROM part")


def frame_files(spark, d):
    """The file of each frame: as named, below the root, or by its bare name."""
    p = standins.table(spark, d, "part").withColumn("k", F.col("p_partkey"))
    hint = F.when(F.col("k") % 4 == 0, F.concat(F.lit("/r/a"), "k", F.lit(".c"))).when(F.col("k") % 4 == 1, F.concat(F.lit("b"), "k", F.lit(".c"))).when(F.col("k") % 4 == 2, F.concat(F.lit("/other/c"), "k", F.lit(".c"))).otherwise(F.lit("gone.c"))
    files = p.select(F.concat(F.lit("/r/"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")), (F.col("k") % 4 + 1).cast("int")), F.col("k"), F.lit(".c")).alias("path"))
    return reports.locate_frames(p.select("k", hint.alias("file_hint")), files, "/r").select("k", "path")


_add("frame_files", frame_files, "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN '/r/a' || p_partkey || '.c' WHEN 1 THEN '/r/b' || p_partkey || '.c' WHEN 2 THEN '/r/c' || p_partkey || '.c' END AS path FROM part")


# --- the whole scan -----------------------------------------------------------------------------------


def whole_scan(spark, d):
    """Files of all kinds to findings: walks, outputs, secrets, weak primitives, one for a place or a file."""
    secret = _part(spark, d, _SECRET_FILES).select("path", F.lit("py").alias("ext"), "content")
    files = standins.code(spark, d).unionByName(standins.written(spark, d)).unionByName(secret)
    return scan.scan(files, [*standins.SOURCES, "$_GET"], standins.SINKS).select("path", "line", "category", "severity")


_SECRET_FILES = """SELECT p_partkey AS k, 'keys/p' || p_partkey || '.py' AS path, CASE p_partkey % 3 WHEN 0 THEN 'x = "sk_live_' || lpad(CAST(p_partkey AS VARCHAR(20)), 10, '7') || '"' || chr(10) || 'y = "sk_live_' || lpad(CAST(p_partkey AS VARCHAR(20)), 11, '8') || '"'
 WHEN 1 THEN 'password =' || chr(10) || '  "Zk' || p_partkey || '!pw9"' ELSE 'n = 1' END AS content FROM part"""
_add("whole_scan", whole_scan, f"""SELECT path, line, category, severity FROM ({_CODE} SELECT path, {_SINK_LINE}, {_TAINTED} FROM x WHERE {_PROJECT})
UNION ALL SELECT path, line, category, severity FROM ({ORACLE_SQL['output_scan']}) UNION ALL SELECT path, line, category, severity FROM ({ORACLE_SQL['body_scan']})
UNION ALL SELECT path, 1, CASE k % 3 WHEN 0 THEN 'Hardcoded Secret Key' ELSE 'Hardcoded Credential' END, CASE k % 3 WHEN 0 THEN 3 ELSE 2 END FROM ({_SECRET_FILES}) WHERE k % 3 < 2""")


def declared_types(spark, d):
    """Declarations of the variable t in C and Java code."""
    found = lexing.declarations(standins.code(spark, d))
    return found.where("name = 't'").select("path", "type").groupBy("path", "type").agg(F.count("*").alias("n"))


_add("declared_types", declared_types, f"{_CODE} SELECT path, CASE l WHEN 0 THEN 'char' ELSE 'String' END AS type, count(*) AS n FROM x WHERE l < 2 GROUP BY path, l")


def plain_tokens(spark, d):
    """Tokens of four kinds in each file: keywords are identifiers."""
    return lexing.lex(standins.code(spark, d), keywords=False).groupBy("path").agg(F.count_if(F.col("kind") == "keyword").alias("keywords"), F.count_if((F.col("kind") == "identifier") & (F.col("text") == "if")).alias("branches"))


_add("plain_tokens", plain_tokens, f"{_CODE} SELECT path, CAST(0 AS BIGINT) AS keywords, CAST(sum(b) AS BIGINT) AS branches FROM x GROUP BY path")


# --- buffers, guards, reports, graphs ----------------------------------------------------------------

_BUFFERS = """SELECT p_partkey AS k, 'c/p' || p_partkey || '.c' AS path, '#define EXTRA 2' || chr(10) || 'void f(char *s) {' || chr(10) || '  char b[' || p_size || ' + EXTRA];' || chr(10) || '  memcpy(b, s, ' || (p_partkey % 60) || ');' || chr(10)
 || '  int n[' || (p_size % 4 + 1) || '];' || chr(10) || '  memset(n, 0, ' || (p_partkey % 20) || ');' || chr(10) || '}' || chr(10) AS content FROM part"""


def buffer_writes(spark, d):
    """Constant writes over the end of a buffer, with sizes that have to be worked out."""
    files = _part(spark, d, _BUFFERS).select("path", F.lit("c").alias("ext"), "content")
    return taint.scan(files, [], []).select("path", "function", "line", "category", "severity")


_add("buffer_writes", buffer_writes, """SELECT 'c/p' || p_partkey || '.c' AS path, 'f' AS function, 4 AS line, 'Buffer Overflow' AS category, 2 AS severity FROM part WHERE p_partkey % 60 > p_size + 2
UNION ALL SELECT 'c/p' || p_partkey || '.c', 'f', 6, 'Buffer Overflow', 2 FROM part WHERE p_partkey % 20 > 4 * (p_size % 4 + 1)""")

_GUARDED = """SELECT p_partkey AS k, 'g/p' || p_partkey || '.py' AS path, 'def f(a):' || chr(10) || CASE p_partkey % 4 WHEN 0 THEN '    if a not in ALLOWED:' || chr(10) || '        raise ValueError' WHEN 1 THEN '    if a in ALLOWED:' || chr(10) || '        raise ValueError'
 WHEN 2 THEN '    if a not in ALLOWED:' || chr(10) || '        log(1)' ELSE '    b = 1' || chr(10) || '    b = 2' END || chr(10) || CASE p_partkey % 3 WHEN 0 THEN '    subprocess.run([a])' WHEN 1 THEN '    subprocess.run([a], shell=True)' ELSE '    os.system(a)' END || chr(10) AS content FROM part"""


def guarded_scan(spark, d):
    """Walks past guards: a checked value is clean, and a list of arguments meets no shell."""
    files = _part(spark, d, _GUARDED).select("path", F.lit("py").alias("ext"), "content")
    return taint.scan(files, [], tables.sinks()).select("path", "line", "category", "severity")


_add("guarded_scan", guarded_scan, "SELECT 'g/p' || p_partkey || '.py' AS path, 4 AS line, 'Command Injection' AS category, 2 AS severity FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 3 <> 0")


def markdown_report(spark, d):
    """Lines of the markdown report of classified findings."""
    found = standins.table(spark, d, "part").select(
        F.concat(F.lit("f"), "p_partkey").alias("path"), F.col("p_size").alias("line"), F.col("p_type").alias("category"), (F.col("p_partkey") % 4).cast("int").alias("severity"),
        F.element_at(F.array(F.lit("introduced"), F.lit("contextual"), F.lit("fixed")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("awareness"),
    )
    return reports.markdown(found, "Report").select("section", "value")


_add("markdown_report", markdown_report, """WITH f AS (SELECT *, p_partkey % 3 AS o, CASE p_partkey % 3 WHEN 0 THEN 'Introduced' WHEN 1 THEN 'Contextual' ELSE 'Fixed' END AS name, CASE p_partkey % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Critical' END AS label FROM part)
SELECT 0 AS section, '# Report' || chr(10) AS value UNION ALL SELECT CAST(2 * o + 1 AS INTEGER), CASE o WHEN 0 THEN '' ELSE chr(10) END || '## ' || name || ' (' || count(*) || ')' || chr(10) FROM f GROUP BY o, name
UNION ALL SELECT CAST(2 * o + 2 AS INTEGER), '- **' || label || '** ' || p_type || ' — `f' || p_partkey || ':' || p_size || '`' FROM f""")

_TREE = "SELECT DISTINCT 'p' || l_orderkey AS caller, 'p' || (l_orderkey // 3) AS callee FROM lineitem WHERE l_orderkey > 0"


def _tree(spark, d) -> DataFrame:
    o = F.col("l_orderkey")
    return standins.table(spark, d, "lineitem").where(o > 0).select(F.concat(F.lit("p"), o).alias("caller"), F.concat(F.lit("p"), F.floor(o / 3)).alias("callee")).distinct()


def call_layers(spark, d):
    """The layer of each function: the longest way from one that nothing calls."""
    return graphs.layers(_tree(spark, d)).select("node", "rank", "settled")


_add("call_layers", call_layers, f"""WITH RECURSIVE e AS ({_TREE}), n AS (SELECT caller AS node FROM e UNION SELECT callee FROM e),
r(node, rank) AS (SELECT node, 0 FROM n WHERE node NOT IN (SELECT callee FROM e) UNION SELECT e.callee, r.rank + 1 FROM r JOIN e ON e.caller = r.node)
SELECT node, CAST(max(rank) AS INTEGER) AS rank, true AS settled FROM r GROUP BY node""")


def reach_verdicts(spark, d):
    """Whether what reaches each root holds a remote or a local entry (twelve calls and 80 nodes at most, the feature's limits)."""
    start = standins.table(spark, d, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey")).alias("root"))
    origin = F.when(F.startswith("o_orderpriority", F.lit("1")), "remote").when(F.startswith("o_orderpriority", F.lit("2")), "local").otherwise("none")
    entries = standins.table(spark, d, "orders").select(F.concat(F.lit("p"), "o_orderkey").alias("node"), origin.alias("origin"))
    return graphs.verdict(graphs.closure(_tree(spark, d), start), entries)


_add("reach_verdicts", reach_verdicts, f"""WITH RECURSIVE e AS ({_TREE}), c(root, node, depth) AS (SELECT 'p' || n_nationkey, 'p' || n_nationkey, 0 FROM nation UNION SELECT c.root, e.caller, c.depth + 1 FROM c JOIN e ON e.callee = c.node WHERE c.depth < 12),
n AS (SELECT root, node, min(depth) AS depth FROM c GROUP BY root, node), r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, node) AS r FROM n),
m AS (SELECT root, max(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS remote, max(CASE WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 0 END) AS local FROM r LEFT JOIN orders ON node = 'p' || o_orderkey WHERE r <= 80 GROUP BY root)
SELECT root, CASE WHEN remote = 1 THEN 'remote' WHEN local = 1 THEN 'local' ELSE 'unverified' END AS verdict FROM m""")


def value_flows(spark, d):
    """Ways of a value over steps, no node twice on a way, four steps at most."""
    k = F.col("n_nationkey")
    n = standins.table(spark, d, "nation")
    name = lambda x: F.concat(F.lit("v"), x.cast("string"))
    steps = n.select(name(k).alias("src"), name((2 * k + 1) % 25).alias("dst")).union(n.select(name(k).alias("src"), name((k + 3) % 25).alias("dst"))).distinct()
    return graphs.flow_paths(spark, steps, n.select(name(k).alias("root")), depth=4).select("root", F.array_join("path", ">").alias("way"), "depth")


_add("value_flows", value_flows, """WITH RECURSIVE s AS (SELECT 'v' || n_nationkey AS src, 'v' || ((2 * n_nationkey + 1) % 25) AS dst FROM nation UNION SELECT 'v' || n_nationkey, 'v' || ((n_nationkey + 3) % 25) FROM nation),
p(root, way, here, depth) AS (SELECT 'v' || n_nationkey, ['v' || n_nationkey], 'v' || n_nationkey, 0 FROM nation UNION ALL SELECT root, list_append(way, dst), dst, depth + 1 FROM p JOIN s ON src = here WHERE depth < 4 AND NOT list_contains(way, dst))
SELECT root, array_to_string(way, '>') AS way, CAST(depth AS INTEGER) AS depth FROM p""")


# --- reviews against findings -----------------------------------------------------------------------

_BUILT = "SELECT 'f' || (p_partkey % 50) AS path, CAST(p_size % 10 AS INTEGER) AS line, p_type AS category, 'g' || (p_partkey % 3) AS function, 'AST' AS engine, p_partkey AS seq FROM part"
_REVIEWED = "SELECT 'f' || (p_partkey * 7 % 50) AS path, CAST(p_partkey % 10 AS INTEGER) AS line, lower(substr(p_type, 1, 5)) AS category, 'g' || (p_partkey % 2) AS function, 'AI' AS engine, p_partkey AS seq FROM part"


def review_merge(spark, d):
    """Built-in findings credited to reviewed ones at their place, and the reviewed ones without a partner."""
    merged, rest = findings.merge_reviews(_part(spark, d, _BUILT), _part(spark, d, _REVIEWED))
    return merged.select("seq", "engine", F.lit("built").alias("list")).unionByName(rest.select("seq", "engine", F.lit("reviewed").alias("list")))


_add("review_merge", review_merge, f"""WITH b AS ({_BUILT}), r AS ({_REVIEWED}), p AS (SELECT b.seq AS bs, r.seq AS rs FROM b JOIN r ON b.path = r.path AND b.line = r.line AND (contains(lower(b.category), lower(r.category)) OR contains(lower(r.category), lower(b.category)))),
x AS (SELECT rs, min(bs) AS bs FROM p GROUP BY rs), y AS (SELECT bs, min(rs) AS rs FROM x GROUP BY bs)
SELECT seq, CASE WHEN seq IN (SELECT bs FROM y) THEN 'AST, AI' ELSE 'AST' END AS engine, 'built' AS list FROM b
UNION ALL SELECT min(seq), 'AI', 'reviewed' FROM r WHERE seq NOT IN (SELECT rs FROM y) GROUP BY path, line, lower(category), function""")


def review_places(spark, d):
    """Lines of reviewed findings moved into the range of their card."""
    k = F.col("p_partkey")
    p = standins.table(spark, d, "part")
    found = p.select(k.alias("seq"), (k % 20).cast("string").alias("path"), (k % 3).cast("int").alias("card"), F.col("p_size").alias("line"))
    cards = p.select((k % 20).cast("string").alias("path"), (k % 3).cast("int").alias("card"), ((k % 3) * 10 + 1).cast("int").alias("first_line"), ((k % 3) * 10 + 10).cast("int").alias("last_line")).distinct()
    return reviews.attributed(found, cards).select("seq", "line")


_add("review_places", review_places, "SELECT p_partkey AS seq, CAST(greatest(p_partkey % 3 * 10 + 1, least(p_partkey % 3 * 10 + 10, p_size)) AS INTEGER) AS line FROM part")


def finding_snippets(spark, d):
    """The lines around a place in each document."""
    docs = standins.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    found = docs.select("path", (F.col("path").cast("long") % 5 + 1).cast("int").alias("line"))
    return reviews.snippets(found, bayes.lines_of(docs, "text", "path"), before=1, after=2).select("path", F.md5("snippet").alias("digest"))


_add("finding_snippets", finding_snippets, """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS line FROM documents)
SELECT CAST(d.doc_id AS VARCHAR) AS path, md5(coalesce(string_agg(l.text, chr(10) ORDER BY l.line), '')) AS digest FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id AND l.line BETWEEN d.doc_id % 5 AND d.doc_id % 5 + 3 GROUP BY d.doc_id""")
