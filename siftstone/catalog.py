"""The engine's own registered queries over the supplied tables, with DuckDB SQL that gives the same rows.

The tables hold no source code, so rows stand in for it: lines of documents are
lines of files, lineitem rows are findings and call edges, orders and customers
are dependencies, events are polls of pull requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone import catalog_files, standins
from siftstone.functions import scalars as S
from siftstone.operators import bayes, diff, findings, graphs, packages, reviews, rules
from siftstone.plans import reports
from siftstone.plans.loops import cut
from siftstone.streaming import monitor

FLAGSHIP = "nb_heatmap_topk"
THRESHOLD = 0.8
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _sql_values(rows: list[tuple], columns: str) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS v({columns})"


# --- the line classifier ---------------------------------------------------


def _labelled(spark, d):
    docs = bayes.lines_of(_t(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").where(F.trim("text") != "")
    return docs.join(_t(spark, d, "labels").where("quality is not null").select("doc_id", (F.col("quality") == 0).alias("bad")), "doc_id")


_TOKENS = r"regexp_extract_all(regexp_replace(lower({x}), '([\p{L}\p{N}_])[^\p{L}\p{N}_\s]', '\1 ', 'g'), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"
_SIGNAL = f"list_distinct(list_filter({_TOKENS}, lambda t: length(t) >= 3 OR t IN ('*','%','=','<','>','!','&','|','+','-')))"
_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents"
_NB = f"""
WITH l AS ({_LINES}),
lab AS (SELECT l.doc_id, l.line, l.text, q.quality = 0 AS bad, {_SIGNAL.replace('{x}', 'l.text')} AS toks
        FROM l JOIN labels q USING (doc_id) WHERE quality IS NOT NULL AND trim(l.text) <> ''),
tok AS (SELECT bad, unnest(toks) AS token FROM lab),
model AS (SELECT token, count(*) FILTER (WHERE bad) AS bad, count(*) FILTER (WHERE NOT bad) AS good FROM tok GROUP BY token),
meta AS (SELECT (SELECT count(*) FROM lab WHERE bad) AS be, (SELECT count(*) FROM lab WHERE NOT bad) AS ge, (SELECT count(*) FROM model) AS v)"""


@_query(_NB + " SELECT token, bad, good FROM model")
def nb_token_counts(spark, d):
    return bayes.train(_labelled(spark, d))


def _scores(spark, d):
    labelled = _labelled(spark, d)
    model = cut(bayes.train(labelled), "model")  # used twice: to score, and to count its words
    lines = bayes.lines_of(_t(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")
    return bayes.score(lines, model, bayes.totals(labelled, model), "doc_id", "line")


_SCORED = (
    _NB
    + f""", x AS (SELECT doc_id, line, unnest({_SIGNAL.replace('{x}', 'text')}) AS token FROM ({_LINES})),
o AS (SELECT doc_id, line, sum(ln((coalesce(m.bad, 0) + 1.0) / (be + v)) - ln((coalesce(m.good, 0) + 1.0) / (ge + v))) AS odds
      FROM x LEFT JOIN model m USING (token) CROSS JOIN meta GROUP BY doc_id, line),
s AS (SELECT l.doc_id, l.line, coalesce(1 / (1 + exp(-(odds + CASE WHEN be > 0 AND ge > 0 THEN ln(CAST(be AS DOUBLE) / ge) END))), 0.5) AS prob
      FROM l LEFT JOIN o USING (doc_id, line) CROSS JOIN meta)"""
)


@_query(_SCORED + " SELECT doc_id, CAST(line AS INTEGER) AS line, round(prob, 4) AS prob FROM s")
def nb_line_scores(spark, d):
    return _scores(spark, d).select("doc_id", "line", F.round("prob", 4).alias("prob"))


@_query(_SCORED + f""", f AS (SELECT doc_id, count(*) AS flagged FROM s WHERE prob >= {THRESHOLD} GROUP BY doc_id)
SELECT doc_id, flagged, round(flagged / (SELECT max(flagged) FROM f), 6) AS intensity FROM f ORDER BY flagged DESC, doc_id LIMIT 20""")
def nb_heatmap_topk(spark, d):
    """The flagship: train, score every line, rank the hottest documents (a top-k report)."""
    heat = bayes.heatmap(_scores(spark, d), THRESHOLD, "doc_id")
    return heat.orderBy(F.desc("flagged"), "doc_id").limit(20).select("doc_id", "flagged", F.round("intensity", 6).alias("intensity"))


@_query(f"SELECT 'doc/' || doc_id || '.txt' AS path, CAST(line AS INTEGER) AS line, CAST(strpos(lower(text), 'license') - 1 AS INTEGER) AS \"column\" FROM ({_LINES}) WHERE strpos(lower(text), 'license') > 0")
def line_search(spark, d):
    files = _t(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id"), F.lit(".txt")).alias("path"), "text")
    return rules.search(bayes.lines_of(files, "text", "path"), "license")


@_query("""SELECT doc_id, CASE
 WHEN contains(lower(text), 'mit license') OR contains(lower(text), 'permission is hereby granted, free of charge') THEN 'MIT License'
 WHEN contains(lower(text), 'apache license') AND contains(lower(text), 'version 2.0') THEN 'Apache License 2.0'
 WHEN contains(lower(text), 'bsd 3-clause') OR (contains(lower(text), 'bsd license') AND contains(lower(text), 'redistribution and use in source and binary forms')) THEN 'BSD 3-Clause License'
 WHEN contains(lower(text), 'bsd 2-clause') THEN 'BSD 2-Clause License'
 WHEN contains(lower(text), 'gnu general public license') OR contains(lower(text), 'gpl v3') OR contains(lower(text), 'gpl-3.0') THEN 'GNU General Public License v3.0 (GPLv3)'
 WHEN contains(lower(text), 'gnu lesser general public license') OR contains(lower(text), 'lgpl') THEN 'GNU Lesser General Public License (LGPL)'
 WHEN contains(lower(text), 'mozilla public license') OR contains(lower(text), 'mpl') THEN 'Mozilla Public License (MPL 2.0)'
 WHEN contains(lower(text), 'isc license') THEN 'ISC License'
 WHEN contains(lower(text), 'unlicense') OR contains(lower(text), 'disclaims all copyright') THEN 'The Unlicense (Public Domain)'
 ELSE 'Custom / Unrecognized Open Source / Proprietary' END AS licence FROM documents""")
def license_classify(spark, d):
    return _t(spark, d, "documents").select("doc_id", S.license_of(F.col("text")).alias("licence"))


@_query(f"""WITH l AS ({_LINES}), s AS (SELECT doc_id, regexp_extract(text, '(?i)\\b(?:token|key|secret)\\w*\\s*[:=]\\s*["'']([0-9a-f]{{40}})["'']', 1) AS token FROM l)
SELECT doc_id, count(*) AS n FROM s WHERE token <> '' GROUP BY doc_id""")
def long_token_counts(spark, d):
    """An extension: long hexadecimal tokens, one for each line that has any."""
    lines = bayes.lines_of(_t(spark, d, "documents").select(F.col("doc_id").alias("path"), "text"), "text", "path")
    return rules.long_tokens(lines).groupBy(F.col("path").alias("doc_id")).agg(F.count_distinct("line").alias("n"))


# --- findings ---------------------------------------------------------------

_FIND = """SELECT 'src/f' || l_suppkey || '.m' AS path, CAST(l_partkey % 40 AS INTEGER) AS line, 'fn' || (l_partkey % 7) AS function,
 CASE l_returnflag WHEN 'A' THEN 'Hardcoded Credential' WHEN 'N' THEN 'Command Injection' ELSE 'Weak Randomness' END AS category,
 CAST(l_quantity AS INTEGER) % 4 AS severity, CASE l_linestatus WHEN 'O' THEN 'AST' ELSE 'Heuristic' END AS engine, l_orderkey * 10 + l_linenumber AS seq FROM lineitem"""


def _findings(spark, d):
    li = _t(spark, d, "lineitem")
    return li.select(
        F.concat(F.lit("src/f"), F.col("l_suppkey"), F.lit(".m")).alias("path"), (F.col("l_partkey") % 40).cast("int").alias("line"), F.concat(F.lit("fn"), F.col("l_partkey") % 7).alias("function"),
        F.when(F.col("l_returnflag") == "A", "Hardcoded Credential").when(F.col("l_returnflag") == "N", "Command Injection").otherwise("Weak Randomness").alias("category"),
        (F.round("l_quantity").cast("int") % 4).alias("severity"), F.when(F.col("l_linestatus") == "O", "AST").otherwise("Heuristic").alias("engine"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.lit(None).cast("array<string>").alias("taint_path"), F.lit(None).cast("string").alias("package"),
    )


_DEDUPED = f"WITH f AS ({_FIND}), d AS (SELECT *, row_number() OVER (PARTITION BY path, line, category ORDER BY CASE engine WHEN 'AST' THEN 0 ELSE 1 END, seq) AS r FROM f) "


@_query(_DEDUPED + "SELECT path, line, category, engine, seq FROM d WHERE r = 1")
def findings_dedupe(spark, d):
    return findings.dedupe(_findings(spark, d)).select("path", "line", "category", "engine", "seq")


@_query(f"""WITH f AS ({_FIND}), s AS (SELECT *, row_number() OVER (PARTITION BY path, category ORDER BY seq) AS r FROM f)
SELECT path, category, seq FROM s WHERE category = 'Command Injection' OR r = 1""")
def file_scope_dedupe(spark, d):
    return findings.dedupe_file_scope(_findings(spark, d)).select("path", "category", "seq")


@_query(f"WITH f AS ({_FIND}) SELECT CAST(severity AS INTEGER) AS severity, engine, count(*) AS n FROM f GROUP BY ROLLUP (severity, engine)")
def severity_summary(spark, d):
    return findings.summary(_findings(spark, d))


@_query(f"WITH f AS ({_FIND}) SELECT path, line, seq FROM f WHERE path || '#' || line NOT IN (SELECT 'src/f' || s_suppkey || '.m#' || (s_suppkey % 40) FROM supplier)")
def ignore_antijoin(spark, d):
    s = F.col("s_suppkey")
    ignored = _t(spark, d, "supplier").select(F.concat(F.lit("src/f"), s, F.lit(".m#"), s % 40).alias("key"))
    return findings.without_ignored(_findings(spark, d), ignored).select("path", "line", "seq")


@_query("SELECT doc_id AS id, 'old' AS origin FROM labels UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def append_missing(spark, d):
    old = _t(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit("old").alias("origin"))
    return findings.append_missing(old, _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("new").alias("origin")))


@_query(f"""WITH f AS ({_FIND}), p AS (SELECT DISTINCT path FROM f WHERE category <> 'Weak Randomness')
SELECT path, seq FROM f WHERE category <> 'Weak Randomness' OR path NOT IN (SELECT path FROM p)""")
def hygiene_filter(spark, d):
    return findings.drop_hygiene(_findings(spark, d), ["Weak Randomness"]).select("path", "seq")


@_query(f"""WITH f AS ({_FIND}) SELECT path, line, seq FROM f h WHERE engine = 'AST' OR EXISTS
(SELECT 1 FROM f p WHERE p.engine = 'AST' AND p.path = h.path AND p.function = h.function AND p.category = h.category AND abs(p.line - h.line) <= 2)""")
def precise_veto(spark, d):
    return findings.veto(_findings(spark, d)).select("path", "line", "seq")


@_query(f"WITH f AS ({_FIND}) SELECT seq, CAST(greatest(0, least(3, severity + CASE WHEN line % 2 = 0 AND line % 3 = 0 THEN 1 WHEN line % 2 = 0 OR line % 3 = 0 THEN 0 ELSE -1 END)) AS INTEGER) AS exploitability FROM f")
def exploitability(spark, d):
    f = _findings(spark, d)
    return f.select("seq", S.exploitability(F.col("severity"), F.col("line") % 2 == 0, F.col("line") % 3 == 0).cast("int").alias("exploitability"))


@_query(f"WITH f AS ({_FIND}) SELECT path, line, category, severity, seq FROM f ORDER BY severity DESC, path, line, category, seq LIMIT 100")
def findings_ranked(spark, d):
    """A top-k report."""
    return findings.ordered(_findings(spark, d), [("severity", True), ("path", False), ("line", False), ("category", False), ("seq", False)]).limit(100).select("path", "line", "category", "severity", "seq")


@_query(f"WITH f AS ({_FIND}) SELECT path, count(*) AS findings, max(severity) AS worst, count(DISTINCT category) AS categories FROM f GROUP BY path")
def findings_by_file(spark, d):
    return _findings(spark, d).groupBy("path").agg(F.count("*").alias("findings"), F.max("severity").alias("worst"), F.count_distinct("category").alias("categories"))


@_query("""WITH f AS (SELECT conv_id, 2 * (turn // 2) AS lo, 2 * (turn // 2) + 2 AS hi, turn // 2 AS fn FROM conversations GROUP BY ALL
  UNION ALL SELECT conv_id, 0, max(turn) + 1, -1 FROM conversations GROUP BY conv_id),
j AS (SELECT c.conv_id, c.turn, f.fn, row_number() OVER (PARTITION BY c.conv_id, c.turn ORDER BY f.hi - f.lo, f.lo, CAST(f.fn AS VARCHAR)) AS r
  FROM conversations c JOIN f ON c.conv_id = f.conv_id AND c.turn >= f.lo AND c.turn < f.hi)
SELECT conv_id AS path, turn AS off, CAST(fn AS VARCHAR) AS fn FROM j WHERE r = 1""")
def range_enclosing(spark, d):
    c = _t(spark, d, "conversations")
    sites = c.select(F.col("conv_id").alias("path"), F.col("turn").alias("off"))
    half = F.floor(F.col("turn") / 2)
    inner = c.select(F.col("conv_id").alias("path"), (2 * half).alias("lo"), (2 * half + 2).alias("hi"), half.cast("string").alias("fn")).distinct()
    outer = c.groupBy(F.col("conv_id").alias("path")).agg(F.lit(0).cast("long").alias("lo"), (F.max("turn") + 1).alias("hi"), F.lit("-1").alias("fn"))
    return findings.enclosing(sites, inner.union(outer)).select("path", "off", "fn")


# --- changes ----------------------------------------------------------------

_SCOPE = "'f' || l_suppkey || '.c' AS path, CAST(l_partkey % 150 AS INTEGER) AS line, 'fn' || (l_partkey % 11) AS function, l_returnflag AS category FROM lineitem"
_CHANGES = f"""WITH files AS (SELECT 'f' || s_suppkey || '.c' AS path, CASE s_suppkey % 4 WHEN 3 THEN 'f' || (s_suppkey + 1) || '.c' END AS old_path, CASE s_suppkey % 4 WHEN 1 THEN 'A' WHEN 2 THEN 'M' ELSE 'R' END AS kind FROM supplier WHERE s_suppkey % 4 <> 0),
hunks AS (SELECT 'f' || s_suppkey || '.c' AS path, CAST(s_suppkey * 7 % 100 AS INTEGER) AS s, CAST(s_suppkey * 7 % 100 + 20 AS INTEGER) AS e FROM supplier),
head AS (SELECT {_SCOPE} WHERE l_linestatus = 'O' OR l_returnflag = 'R'), base AS (SELECT {_SCOPE} WHERE l_linestatus = 'F' OR l_returnflag = 'N')"""


@_query(f"""{_CHANGES}, same AS (SELECT DISTINCT path, line FROM base), old AS (SELECT DISTINCT path AS old_path, line FROM base), fns AS (SELECT DISTINCT path, function FROM base),
c AS (SELECT h.*, CASE WHEN f.kind IS NULL THEN 'preExisting' WHEN f.kind = 'A' THEN 'introduced' WHEN a.line IS NOT NULL THEN 'preExisting'
  WHEN h.line >= r.s AND h.line < r.e THEN 'introduced' WHEN f.kind = 'R' AND o.line IS NOT NULL THEN 'preExisting' ELSE 'contextual' END AS awareness
  FROM head h LEFT JOIN files f USING (path) LEFT JOIN hunks r USING (path) LEFT JOIN same a ON a.path = h.path AND a.line = h.line LEFT JOIN old o ON o.old_path = f.old_path AND o.line = h.line)
SELECT c.path, c.line, c.function, category, CASE WHEN awareness = 'introduced' AND k.path IS NOT NULL THEN 'contextual' ELSE awareness END AS awareness FROM c LEFT JOIN fns k ON k.path = c.path AND k.function = c.function
UNION ALL SELECT DISTINCT b.*, 'fixed' FROM base b WHERE b.path IN (SELECT path FROM files UNION ALL SELECT old_path FROM files WHERE old_path IS NOT NULL)
  AND (b.path, b.line) NOT IN (SELECT (path, line) FROM head) AND (b.path, b.function, b.category) NOT IN (SELECT (path, function, category) FROM head)""")
def pr_classify(spark, d):
    li, s, k = _t(spark, d, "lineitem"), _t(spark, d, "supplier"), F.col("s_suppkey")
    name = lambda x: F.concat(F.lit("f"), x, F.lit(".c"))
    scope = (name(F.col("l_suppkey")).alias("path"), (F.col("l_partkey") % 150).cast("int").alias("line"), F.concat(F.lit("fn"), F.col("l_partkey") % 11).alias("function"), F.col("l_returnflag").alias("category"))
    files = s.where(k % 4 != 0).select(name(k).alias("path"), F.when(k % 4 == 3, name(k + 1)).alias("old_path"), F.when(k % 4 == 1, "A").when(k % 4 == 2, "M").otherwise("R").alias("kind"))
    ranges = s.select(name(k).alias("path"), (k * 7 % 100).cast("int").alias("head_start"), (k * 7 % 100 + 20).cast("int").alias("head_end"))
    # Two scans of one project, before and after; every row is reported by one of them at least.
    return diff.classify(li.where("l_linestatus = 'O' OR l_returnflag = 'R'").select(*scope), li.where("l_linestatus = 'F' OR l_returnflag = 'N'").select(*scope), files, ranges)


_VERSIONS = """SELECT p_partkey AS k, p_size AS x1, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey % 10 END AS x2, p_size + p_partkey % 3 - 1 AS y1, p_partkey % 7 AS y2,
 CASE p_partkey % 4 WHEN 0 THEN 'v' ELSE '' END || p_size || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '.' || (p_partkey % 10) END || CASE WHEN p_partkey % 11 = 0 THEN '-beta' ELSE '' END AS a,
 (p_size + p_partkey % 3 - 1) || '.' || (p_partkey % 7) || '.0' AS b FROM part"""


@_query(f"SELECT k, a, b, CASE WHEN k % 11 = 0 OR x1 < y1 OR (x1 = y1 AND x2 < y2) THEN -1 WHEN x1 = y1 AND x2 = y2 THEN 0 ELSE 1 END AS ord FROM ({_VERSIONS})")
def version_order(spark, d):
    return standins.sql(spark, _VERSIONS, d, "part").select("k", "a", "b", S.version_order(F.col("a"), F.col("b")).alias("ord"))


_VECTORS = """SELECT p_partkey AS k, 'AV:' || substr('NALP', CAST(p_partkey % 4 + 1 AS INT), 1) || '/AC:' || substr('LH', CAST(p_size % 2 + 1 AS INT), 1) || '/PR:' || substr('NLH', CAST(p_partkey % 3 + 1 AS INT), 1)
 || '/UI:' || substr('NR', CAST(p_size % 3 % 2 + 1 AS INT), 1) || '/S:' || CASE WHEN p_partkey % 5 < 2 THEN 'C' ELSE 'U' END || '/C:' || substr('HLN', CAST(p_size % 5 % 3 + 1 AS INT), 1) || '/I:' || substr('NLH', CAST(p_partkey % 7 % 3 + 1 AS INT), 1)
 || CASE WHEN p_partkey % 13 = 0 THEN '' ELSE '/A:' || substr('NLH', CAST(p_size % 7 % 3 + 1 AS INT), 1) END AS vector FROM part"""
_METRIC = lambda name, table: f"CASE regexp_extract(vector, '{name}:([A-Z])', 1) {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN CAST({w} AS DOUBLE)' for k, w in table.items())} END"
_IMPACT = {"N": 0.0, "L": 0.22, "H": 0.56}
_CVSS = f"""WITH v AS ({_VECTORS}), m AS (SELECT *, vector LIKE '%S:C%' AS changed, {_METRIC('AV', {'N': 0.85, 'A': 0.62, 'L': 0.55, 'P': 0.2})} AS av, {_METRIC('/UI', {'N': 0.85, 'R': 0.62})} AS ui,
 {_METRIC('AC', {'L': 0.77, 'H': 0.44})} AS ac, CASE WHEN vector LIKE '%S:C%' THEN {_METRIC('PR', {'N': 0.85, 'L': 0.68, 'H': 0.5})} ELSE {_METRIC('PR', {'N': 0.85, 'L': 0.62, 'H': 0.27})} END AS pr,
 {_METRIC('AC', {'L': 0.77, 'H': 0.2})} AS ac2, {_METRIC('PR', {'N': 0.85})} AS pr2,
 1 - (1 - {_METRIC('/C', _IMPACT)}) * (1 - {_METRIC('/I', _IMPACT)}) * (1 - {_METRIC('/A', _IMPACT)}) AS iss FROM v),
i AS (SELECT *, CASE WHEN changed THEN 7.52 * (iss - 0.029) - 3.25 * pow(iss - 0.02, 15) ELSE 6.42 * iss END AS impact, 8.22 * av * ac * pr * ui AS reach,
 CASE WHEN changed THEN 7.52 * (iss - 0.029) - 3.25 * pow(iss * 0.9731 - 0.02, 13) ELSE 7.52 * (iss - 0.029) - 3.25 * pow(iss - 0.02, 13) END AS impact2, 8.22 * av * ac2 * pr2 * ui AS reach2 FROM m),
t AS (SELECT *, CASE WHEN changed THEN least(1.08 * (reach + impact), 10) ELSE least(reach + impact, 10) END AS total, CASE WHEN changed THEN least(1.08 * (reach2 + impact2), 10) ELSE least(reach2 + impact2, 10) END AS total2 FROM i)
SELECT k, vector, CAST(CASE WHEN iss IS NULL THEN NULL WHEN iss <= 0 OR impact <= 0 THEN 0 ELSE least(10.0, ceil(round(total * 10, 8)) / 10) END AS DOUBLE) AS score,
 CAST(CASE WHEN iss IS NULL OR reach2 IS NULL THEN NULL WHEN iss <= 0 OR impact2 <= 0 THEN least(10.0, ceil(round(reach2 * 10, 8)) / 10) ELSE least(10.0, ceil(round(total2 * 10, 8)) / 10) END AS DOUBLE) AS compat FROM t"""


@_query(_CVSS)
def cvss_score(spark, d):
    v = F.col("vector")
    return standins.sql(spark, _VECTORS, d, "part").select("k", "vector", S.cvss3_base(v).alias("score"), S.cvss3_base(v, compat=True).alias("compat"))


# --- graphs -----------------------------------------------------------------

_EDGES = "SELECT DISTINCT 'p' || l_orderkey AS caller, 'p' || (l_orderkey // 3 + l_linenumber % 2) AS callee FROM lineitem"


def _edges(spark, d):
    """Call edges of all rows: an order calls one with a third of its key, or the next."""
    o = F.col("l_orderkey")
    callee = F.floor(o / 3) + F.col("l_linenumber") % 2
    return _t(spark, d, "lineitem").select(F.concat(F.lit("p"), o).alias("caller"), F.concat(F.lit("p"), callee).alias("callee")).distinct()


@_query(f"""WITH RECURSIVE e AS ({_EDGES}), c(root, node, depth) AS (SELECT 'p' || n_nationkey, 'p' || n_nationkey, 0 FROM nation
  UNION SELECT c.root, e.caller, c.depth + 1 FROM c JOIN e ON e.callee = c.node WHERE c.depth < 12),
n AS (SELECT root, node, min(depth) AS depth FROM c GROUP BY root, node), r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, node) AS r FROM n)
SELECT root, node, CAST(depth AS INTEGER) AS depth FROM r WHERE r <= 80""")
def reverse_closure(spark, d):
    """The first 80 callers of each root, twelve calls away at most (both are limits of the feature)."""
    start = _t(spark, d, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey")).alias("root"))
    return graphs.closure(_edges(spark, d), start)


@_query(f"""WITH RECURSIVE e AS ({_EDGES}), t(name, round) AS (SELECT 'p' || n_nationkey, 0 FROM nation WHERE n_nationkey < 3
  UNION SELECT e.caller, t.round + 1 FROM t JOIN e ON e.callee = t.name WHERE t.round < 10)
SELECT name, CAST(min(round) AS INTEGER) AS round FROM t GROUP BY name""")
def taint_fixpoint(spark, d):
    seeds = _t(spark, d, "nation").where("n_nationkey < 3").select(F.concat(F.lit("p"), F.col("n_nationkey")).alias("name"))
    return graphs.fixpoint(_edges(spark, d), seeds)


@_query(f"""WITH e AS ({_EDGES}), n AS (SELECT caller AS node FROM e UNION SELECT callee FROM e)
SELECT node, (SELECT count(*) FROM e WHERE e.caller = n.node) AS callees, node NOT IN (SELECT callee FROM e) AS topmost FROM n""")
def callee_overlay(spark, d):
    return graphs.overlay(_edges(spark, d))


# --- polls ------------------------------------------------------------------

_POLLS = "SELECT time_bucket(INTERVAL '15 minutes', ts) AS poll_ts, CAST(user_id AS VARCHAR) AS repo, CAST(event_type AS VARCHAR) AS id, '' AS sha, date_trunc('hour', ts) AS updated_at FROM events"
_FRESH = f"WITH p AS ({_POLLS}), k AS (SELECT *, repo || '#' || id || '@' || strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS fingerprint FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY poll_ts) AS r FROM k)"


def _polls(spark, d):
    ts = F.col("ts")
    return _t(spark, d, "events").select(F.window(ts, "15 minutes")["start"].alias("poll_ts"), F.col("user_id").cast("string").alias("repo"), F.col("event_type").alias("id"), F.lit("").alias("sha"), F.date_trunc("hour", ts).alias("updated_at"))


@_query(_FRESH + " SELECT CAST(poll_ts AS VARCHAR) AS poll_ts, fingerprint FROM n WHERE r = 1")
def pr_poll_new(spark, d):
    return monitor.new_in_batch(_polls(spark, d)).select(F.date_format("poll_ts", "yyyy-MM-dd HH:mm:ss").alias("poll_ts"), "fingerprint")


@_query(_FRESH + ", t AS (SELECT *, row_number() OVER (PARTITION BY poll_ts ORDER BY updated_at DESC NULLS LAST, fingerprint) AS k FROM n WHERE r = 1) SELECT CAST(poll_ts AS VARCHAR) AS poll_ts, fingerprint FROM t WHERE k <= 5")
def pr_top5(spark, d):
    return monitor.announced(monitor.new_in_batch(_polls(spark, d))).select(F.date_format("poll_ts", "yyyy-MM-dd HH:mm:ss").alias("poll_ts"), "fingerprint")


# --- dependencies -----------------------------------------------------------

_DEPS = "SELECT CASE c_nationkey % 2 WHEN 0 THEN 'npm' ELSE 'PyPI' END AS ecosystem, 'pkg' || (c_custkey % 50) AS name, '1.' || (c_custkey % 4) AS version, c_mktsegment AS path, c_custkey AS line FROM customer"
_ADVISORIES = [("npm", "pkg1", "1.1", "A-1", "CRITICAL"), ("npm", "pkg2", "1.2", "A-2", None), ("PyPI", "pkg7", "1.3", "A-3", "LOW"), ("PyPI", "pkg7", "1.3", "A-4", "MODERATE"), ("npm", "pkg1", "1.1", "A-1", "CRITICAL")]


@_query(f"""WITH d AS ({_DEPS}), a AS (SELECT DISTINCT * FROM {_sql_values(_ADVISORIES, 'ecosystem, name, version, id, db')})
SELECT d.ecosystem, d.name, d.version, d.path, d.line, a.id, CASE a.db WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'LOW' THEN 0 ELSE 1 END AS severity FROM d JOIN a USING (ecosystem, name, version)""")
def dep_advisory_join(spark, d):
    k = F.col("c_custkey")
    deps = _t(spark, d, "customer").select(F.when(F.col("c_nationkey") % 2 == 0, "npm").otherwise("PyPI").alias("ecosystem"), F.concat(F.lit("pkg"), k % 50).alias("name"), F.concat(F.lit("1."), k % 4).alias("version"), F.col("c_mktsegment").alias("path"), k.alias("line"))
    a = _values(spark, _ADVISORIES, "ecosystem string, name string, version string, id string, db_severity string").withColumn("severity", F.lit(None).cast("array<struct<type:string,score:string>>"))
    return packages.package_findings(deps, a).select("ecosystem", "name", "version", "path", "line", "id", "severity")


# --- text rules, hosts, reviews ----------------------------------------------

_SECRET_LINES = """SELECT p_partkey AS k, 'src/p' || p_partkey || '.py' AS path, CASE p_partkey % 11 WHEN 0 THEN 'key = ''AKIA' || lpad(CAST(p_partkey AS VARCHAR(20)), 16, 'Q') || chr(39)
 WHEN 1 THEN 'url = postgres://u' || p_partkey || ':p@h' WHEN 2 THEN 'x = sk_live_' || lpad(CAST(p_partkey AS VARCHAR(20)), 10, '7') WHEN 3 THEN 'hook whsec_' || lpad(CAST(p_partkey AS VARCHAR(20)), 20, '7')
 WHEN 4 THEN 'g = ghp_' || lpad(CAST(p_partkey AS VARCHAR(20)), 24, '7') WHEN 5 THEN 's = xoxb-' || lpad(CAST(p_partkey AS VARCHAR(20)), 12, '7') WHEN 6 THEN 'm = AIza' || lpad(CAST(p_partkey AS VARCHAR(20)), 24, '7')
 WHEN 7 THEN 'api_key = "changeme' || p_partkey || '"' WHEN 8 THEN '-----BEGIN RSA PRIVATE KEY-----' WHEN 9 THEN 'total = ' || p_partkey ELSE 'password =\n  "Zk' || p_partkey || '!pw9"' END AS text FROM part"""


@_query(f"""WITH s AS ({_SECRET_LINES}) SELECT path, CAST(2 AS INTEGER) AS line, CASE k % 11 WHEN 0 THEN 'Hardcoded AWS Access Key' WHEN 1 THEN 'Hardcoded Connection String (with password)' WHEN 2 THEN 'Hardcoded Secret Key'
 WHEN 3 THEN 'Hardcoded Webhook Secret' WHEN 4 THEN 'Hardcoded GitHub Token' WHEN 5 THEN 'Hardcoded Slack Token' WHEN 6 THEN 'Hardcoded Google API Key' WHEN 8 THEN 'Hardcoded Private Key' ELSE 'Hardcoded Credential' END AS category,
 CAST(CASE WHEN k % 11 IN (1, 5, 6, 10) THEN 2 ELSE 3 END AS INTEGER) AS severity FROM s WHERE k % 11 NOT IN (7, 9) UNION ALL SELECT path, 2, 'Hardcoded Credential', 2 FROM s WHERE k % 11 = 10""")
def secret_findings(spark, d):
    """Secrets of whole files; an assignment may end on the line after its name."""
    files = standins.sql(spark, _SECRET_LINES, d, "part").select("path", F.concat(F.lit("# made\n"), "text", F.lit("\n")).alias("content"))
    return rules.file_secrets(files)


@_query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^.*://', ''), '[/?#].*$', ''), ':+$', '') AS host FROM pages")
def page_hosts(spark, d):
    return _t(spark, d, "pages").select("page_id", S.bare_host(F.col("url")).alias("host"))


@_query("SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^\\p{L}\\p{N}]+', '-', 'g'), '-') AS slug FROM part")
def category_slugs(spark, d):
    return _t(spark, d, "part").select("p_partkey", S.slug(F.col("p_type")).alias("slug"))


@_query("SELECT conv_id, turn, CASE WHEN contains(upper(text), 'INVALID') THEN 'invalid' WHEN contains(upper(text), 'VALID') THEN 'valid' ELSE 'unknown' END AS verdict FROM conversations")
def triage_verdicts(spark, d):
    return reviews.triage(_t(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("answer"))).select("conv_id", "turn", "verdict")


@_query("""WITH RECURSIVE l AS (SELECT doc_id, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS line, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: length(x) + 1)) AS size FROM documents),
c(doc_id, line, chunk, held) AS (SELECT doc_id, line, 0, size FROM l WHERE line = 1
  UNION ALL SELECT l.doc_id, l.line, CASE WHEN held + size > 2000 THEN chunk + 1 ELSE chunk END, CASE WHEN held + size > 2000 THEN size ELSE held + size END FROM c JOIN l ON l.doc_id = c.doc_id AND l.line = c.line + 1)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(min(line) AS INTEGER) AS first_line, CAST(max(line) AS INTEGER) AS last_line, CAST(max(held) - 1 AS INTEGER) AS n_chars FROM c GROUP BY doc_id, chunk""")
def chunk_pack(spark, d):
    return reviews.chunks(_t(spark, d, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("content")), 2_000).select(F.col("path").alias("doc_id"), "chunk", "first_line", "last_line", F.length("text").alias("n_chars"))


@_query("SELECT doc_id, sha256(concat(length(source), ':', source, length(text), ':', text)) AS key FROM documents")
def review_cache_keys(spark, d):
    return _t(spark, d, "documents").select("doc_id", S.cache_key(F.col("source"), F.col("text")).alias("key"))


_TRACE = """SELECT p_partkey AS k, CAST(p_partkey % 50 AS VARCHAR(9)) AS trace, CAST(p_partkey AS INT) AS seq, CASE p_partkey % 8 WHEN 0 THEN 'at fn' || p_partkey || ' (lib/app.js:' || p_partkey || ':5)'
 WHEN 1 THEN 'at org.Made.m' || p_partkey || '(Made.java:' || p_partkey || ')' WHEN 2 THEN '#3  0x9 in g' || p_partkey || ' (n=2) at lib/a.c:' || p_partkey WHEN 3 THEN 'File "mod.py", line ' || p_partkey || ', in h' || p_partkey
 WHEN 4 THEN 'run' || p_partkey || ' (lib/m.c:' || p_partkey || ')' WHEN 5 THEN p_partkey || ': std::f' || p_partkey WHEN 6 THEN 'foo' || p_partkey || ' at lib/n.c:' || p_partkey ELSE 'lib/o.c:' || p_partkey END AS text FROM part"""


@_query(f"""WITH t AS ({_TRACE}) SELECT trace, seq, CASE k % 8 WHEN 0 THEN 'fn' || k WHEN 1 THEN 'm' || k WHEN 2 THEN 'g' || k WHEN 3 THEN 'h' || k WHEN 4 THEN 'run' || k WHEN 6 THEN 'foo' || k ELSE CASE WHEN k >= 50 THEN 'std::f' || (k - 50) ELSE '' END END AS function,
CASE k % 8 WHEN 0 THEN 'lib/app.js' WHEN 1 THEN 'Made.java' WHEN 2 THEN 'lib/a.c' WHEN 3 THEN 'mod.py' WHEN 4 THEN 'lib/m.c' WHEN 6 THEN 'lib/n.c' ELSE 'lib/o.c' END AS file_hint, seq AS line FROM t WHERE k % 8 <> 5""")
def stack_frames(spark, d):
    """Frames of 50 traces; a line that is a symbol alone names the next frame without a name."""
    return reports.frames(standins.sql(spark, _TRACE, d, "part").select("trace", "seq", "text"))


_COMMENTS = """SELECT p_partkey AS k, p_partkey % 40 AS path, p_partkey % 7 AS t, CASE p_partkey % 7 WHEN 0 THEN '/* open' WHEN 1 THEN 'middle' WHEN 2 THEN 'end */ x()' WHEN 3 THEN '' WHEN 4 THEN 'foo(); /* late' WHEN 5 THEN '// c' ELSE '/* a */ b' END AS text FROM part"""


@_query(f"""WITH l AS (SELECT *, CASE t WHEN 0 THEN 1 WHEN 2 THEN 0 WHEN 6 THEN 0 END AS mark FROM ({_COMMENTS})),
s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS inside FROM l)
SELECT path, CAST(k AS INTEGER) AS line, t IN (0, 3, 5) OR (t IN (1, 4) AND inside) AS is_comment FROM s""")
def comment_state(spark, d):
    rows = standins.sql(spark, _COMMENTS, d, "part").select("path", F.col("k").cast("int").alias("line"), "text")
    return bayes.comment_lines(rows, "path").select("path", "line", "is_comment")

QUERIES.update(catalog_files.QUERIES)
ORACLE_SQL.update(catalog_files.ORACLE_SQL)
