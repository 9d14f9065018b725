"""Source files made of table rows.

The supplied tables hold no source code.  Each maker writes text files whose
contents follow from columns, so that SQL over the same columns can say what an
operator must find in them, line by line.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, text: str, sf_dir: str, name: str) -> DataFrame:
    """SQL that reads one of the tables; braces in it are plain text."""
    view = f"standin_{uuid.uuid4().hex}"
    table(spark, sf_dir, name).createOrReplaceTempView(view)
    try:
        return spark.sql(text.replace(f"FROM {name}", f"FROM {view}"))
    finally:
        spark.catalog.dropTempView(view)


def joined(rows: DataFrame, keys: list[str], order: list[str], text: str, separator: str = "\n") -> DataFrame:
    """(keys, body): the texts of each group's rows, in order."""
    each = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(each, lambda x: x["_t"]), separator).alias("body"))


@dataclass(frozen=True)
class Manifest:
    """How rows of `part` become one dependency file for each of 20 groups.

    A row has its number i in the file; its text takes `lines` lines, of which
    that numbered `at` is where the dependency is reported.  `name` is SQL over
    k (the part's key); `only` drops rows that the format must not report.
    """

    file: str
    ecosystem: str
    text: str  # SQL over k, g, v (the version as written) and ver (an exact one)
    head: str = ""
    tail: str = ""
    between: str = "\n"
    lines: int = 1
    at: int = 1
    name: str = "'pkg' || k"
    only: str = "true"
    repeats: bool = True  # some rows stand twice
    kept_twice: bool = False  # and are reported twice

    @property
    def first(self) -> int:
        return self.head.count("\n")


_MAVEN = "'org.g' || (k % 7) || ':lib' || k"
MANIFESTS = {
    "npm_lock": Manifest("package-lock.json", "npm", """'"node_modules/m' || k || '": {"name": "pkg' || k || '", "version": "' || v || '"}'""", '{"packages": {"": {"version": "1.0.0"},\n', "\n}}", ",\n", repeats=False),
    "npm_shrinkwrap": Manifest("npm-shrinkwrap.json", "npm", """'"pkg' || k || '": {"version": "' || v || '"}'""", '{"dependencies": {\n', "\n}}", ",\n", repeats=False),
    "yarn": Manifest("yarn.lock", "npm", "'pkg' || k || '@^1.0:\n  version \"' || v || '\"\n'", "# yarn lockfile v1\n\n", lines=3),
    "pnpm": Manifest("pnpm-lock.yaml", "npm", "CASE WHEN k % 2 = 0 THEN '  /pkg' || k || '/' || v || '_peer:' ELSE '  pkg' || k || '@' || v || '(peer@1.0):' END || '\n    dev: true\n'", "lockfileVersion: 5.4\n\npackages:\n\n", lines=3),
    "poetry": Manifest("poetry.lock", "PyPI", "'[[package]]\nname = \"pkg' || k || '\"\nversion = \"' || v || '\"\n'", lines=4, kept_twice=True),
    "uv": Manifest("uv.lock", "PyPI", "'[[package]]\nname = \"pkg' || k || '\"\nversion = \"' || v || '\"\n'", "version = 1\n\n", lines=4, kept_twice=True),
    "pipfile": Manifest("Pipfile.lock", "PyPI", """'"pkg' || k || '": {"version": "==' || v || '"}'""", '{"default": {\n', "\n}}", ",\n", repeats=False),
    "requirements": Manifest("requirements.txt", "PyPI", "'pkg' || k || CASE k % 3 WHEN 0 THEN '' ELSE '[extra]' END || '==' || v || CASE k % 3 WHEN 1 THEN ' # note' WHEN 2 THEN '; python_version > \"3\"' ELSE '' END", "# made\n-r other.txt\nfree>=1.0\n"),
    "cargo_lock": Manifest("Cargo.lock", "crates.io", "'[[package]]\nname = \"pkg' || k || '\"\nversion = \"' || v || '\"\nsource = \"' || CASE k % 4 WHEN 0 THEN 'git' ELSE 'registry' END || '+https://r\"\n'", lines=5, only="k % 4 <> 0", kept_twice=True),
    "composer_lock": Manifest("composer.lock", "Packagist", """'{"name": "pkg' || k || '", "version": "v' || v || '"}'""", '{"packages": [\n', "\n]}", ",\n"),
    "go_mod": Manifest("go.mod", "Go", "CHR(9) || 'example.com/m' || k || ' v' || v || ' // indirect'", "module x\n\nrequire (\n", "\n)\n", name="'example.com/m' || k"),
    "gem_lock": Manifest("Gemfile.lock", "RubyGems", "'    pkg' || k || ' (' || v || ')\n      other (1.0)'", "GEM\n  remote: https://r\n  specs:\n", "\n\nPLATFORMS\n    ruby (2.0)\n", lines=2),
    "nuget_lock": Manifest("packages.lock.json", "NuGet", """'"pkg' || k || '": {"type": "Direct", "resolved": "' || v || '"}'""", '{"version": 1, "dependencies": {"net6.0": {\n', "\n}}}", ",\n", repeats=False),
    "swift_resolved": Manifest("Package.resolved", "SwiftURL", """'{"location": "https://example.com/r' || k || '-x.git", "state": {"version": "' || v || '"}}'""", '{"pins": [\n', "\n]}", ",\n", name="'https://example.com/r' || k || '-x'"),
    "gradle_lock": Manifest("gradle.lockfile", "Maven", "'org.g' || (k % 7) || ':lib' || k || ':' || v || '=compileClasspath'", "# made\n", "\nempty=\n", name=_MAVEN),
    "package_json": Manifest("package.json", "npm", """'"pkg' || k || '": "' || v || '"'""", '{"dependencies": {\n', "\n}}", ",\n", repeats=False),
    "pyproject": Manifest("pyproject.toml", "PyPI", "'  \"pkg' || k || '==' || v || '\",'", "[project]\ndependencies = [\n", '\n]\n[tool.other]\nurl = "decoy==9.9"\n'),
    "poetry_section": Manifest("pyproject.toml", "PyPI", "'pkg' || k || CASE k % 2 WHEN 0 THEN ' = \"' || v || '\"' ELSE ' = { version = \"' || v || '\", optional = true }' END", "[tool.poetry.dependencies]\n", repeats=False),
    "cargo": Manifest("Cargo.toml", "crates.io", "'pkg' || k || CASE k % 2 WHEN 0 THEN ' = \"' || v || '\"' ELSE ' = { version = \"' || v || '\", features = [] }' END", '[package]\nversion = "9.9"\n[workspace.dependencies]\n', repeats=False),
    "composer": Manifest("composer.json", "Packagist", """'"pkg' || k || '": "v' || v || '"'""", '{"require": {\n', "\n}}", ",\n", repeats=False),
    "gemfile": Manifest("Gemfile", "RubyGems", "'gem ''pkg' || k || ''', ''' || v || ''''", "source 'https://r'\n"),
    "pom": Manifest("pom.xml", "Maven", "'<dependency>\n<groupId>org.g' || (k % 7) || '</groupId>\n<artifactId>lib' || k || '</artifactId>\n<version>' || v || '</version>\n</dependency>'", "<project>\n", "\n</project>", lines=5, name=_MAVEN),
    "gradle": Manifest("build.gradle", "Maven", "CASE k % 4 WHEN 0 THEN '  classpath ' ELSE '  implementation ' END || '\"org.g' || (k % 7) || ':lib' || k || ':' || v || '\"'", "dependencies {\n", "\n}\n", name=_MAVEN, only="k % 4 <> 0"),
    "gradle_kts": Manifest("build.gradle.kts", "Maven", "'  api(\"org.g' || (k % 7) || ':lib' || k || ':' || v || '\")'", "dependencies {\n", "\n}\n", name=_MAVEN),
    "csproj": Manifest("app.csproj", "NuGet", "'<PackageReference Include=\"pkg' || k || '\" Version=\"' || v || '\" />'", "<Project>\n", "\n</Project>"),
}


def _rows(kind: Manifest) -> str:
    """SQL, for both engines: the rows of a manifest with their place."""
    twice = f"SELECT *, 1 AS c FROM p WHERE {'p_size % 7 = 0' if kind.repeats else 'false'}"
    return f"""WITH p AS (SELECT p_partkey AS k, p_partkey % 20 AS g, p_size, p_size % 5 <> 0 AS exact, p_size || '.' || (p_partkey % 10) || '.' || (p_partkey % 7) AS ver FROM part),
e AS (SELECT *, 0 AS c FROM p UNION ALL {twice}),
i AS (SELECT *, CASE WHEN exact THEN ver ELSE '^' || ver END AS v, row_number() OVER (PARTITION BY g ORDER BY c, k) - 1 AS i FROM e)"""


def manifests(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(path, content) of the files of one kind."""
    m = MANIFESTS[kind]
    rows = sql(spark, f"{_rows(m)} SELECT g, i, {m.text} AS t FROM i", sf_dir, "part")
    files = joined(rows, ["g"], ["i"], "t", m.between)
    return files.select(F.concat(F.lit("g"), F.col("g").cast("string"), F.lit(f"/{m.file}")).alias("path"), F.concat(F.lit(m.head), "body", F.lit(m.tail)).alias("content"))


def manifest_sql(kind: str) -> str:
    """DuckDB SQL for the dependencies that the files of one kind hold."""
    m = MANIFESTS[kind]
    once = "" if m.kept_twice else " AND c = 0"
    return f"""{_rows(m)} SELECT '{m.ecosystem}' AS ecosystem, {m.name} AS name, ver AS version, 'g' || g || '/{m.file}' AS path,
CAST({m.first} + {m.lines} * i + {m.at} AS INTEGER) AS line FROM i WHERE exact AND {m.only}{once}"""


# --- code -----------------------------------------------------------------------

EXTENSIONS = ("c", "java", "py", "js", "go", "kt")
_EXT = "CASE l WHEN 0 THEN 'c' WHEN 1 THEN 'java' WHEN 2 THEN 'py' WHEN 3 THEN 'js' WHEN 4 THEN 'go' ELSE 'kt' END"
#: SQL, for both engines: one row for each function j of the file that a part stands for.  b is its branches; s
#: says what it does with its parameter a: 0 sends it to a sink, 1 cleans it first, 2 sends a constant, 3 sends nothing.
CODE = f"""WITH p AS (SELECT p_partkey AS k, p_partkey % 6 AS l, p_size % 3 + 1 AS n FROM part),
j AS (SELECT *, 0 AS j FROM p UNION ALL SELECT *, 1 AS j FROM p WHERE n > 1 UNION ALL SELECT *, 2 AS j FROM p WHERE n > 2),
f AS (SELECT *, {_EXT} AS ext, 'f' || j || '_' || k AS fn, CASE l WHEN 1 THEN 1 ELSE 0 END + 9 * j AS above, (k + j) % 3 AS b,
  (k % 7 + j * (k % 5)) % 4 AS s, (k % 7 + (j - 1) * (k % 5)) % 4 AS s_before FROM j),
x AS (SELECT *, 'src/' || ext || '/p' || k || '.' || ext AS path, l = 0 AND (k + j) % 5 = 0 AS hidden FROM f)"""
SOURCES = ["getenv", "input"]
SINKS = [("system", "Command Injection", 3), ("rt.exec", "Command Injection", 3), ("os.system", "Command Injection", 3), ("eval", "Code Injection", 3), ("run", "Command Injection", 2)]

_SIGNATURE = """CASE l WHEN 0 THEN CASE WHEN hidden THEN 'static ' ELSE '' END || 'int ' || fn || '(char *a, int b) {'
 WHEN 1 THEN '  public int ' || fn || '(String a, int b) throws IOException, SQLException {'
 WHEN 2 THEN 'def ' || fn || '(a,\n        b):'
 WHEN 3 THEN CASE j WHEN 1 THEN 'function ' || fn || '(a, b) {' ELSE 'const ' || fn || ' = (a, b) => {' END
 WHEN 4 THEN 'func ' || fn || '(a string, b int) (int, error) {'
 ELSE 'fun ' || fn || '(a: String, b: Int): Map<String, Int> {' END"""
_BRANCH = "CASE l WHEN 2 THEN '    if b > 1 and b < 9: b = b + 1' WHEN 4 THEN '  if b > 1 && b < 9 { b = b + 1 }' ELSE '  if (b > 1 && b < 9) { b = b + 1; }' END"
_VALUE = "CASE s WHEN 1 THEN 'sanitize(a)' WHEN 2 THEN '\"x\"' ELSE 'a' END"
_END = "CASE WHEN l IN (0, 1, 3) THEN ';' ELSE '' END"
_ASSIGN = f"CASE l WHEN 0 THEN '  char *t = ' WHEN 1 THEN '  String t = ' WHEN 2 THEN '    t = ' WHEN 3 THEN '  let t = ' WHEN 4 THEN '  t := ' ELSE '  val t = ' END || {_VALUE} || {_END}"
_STEP = "CASE l WHEN 2 THEN '    b = ' ELSE '  b = ' END"
_SINK = f"CASE WHEN s = 3 THEN {_STEP} || '2' ELSE CASE l WHEN 0 THEN '  system(t)' WHEN 1 THEN '  rt.exec(t)' WHEN 2 THEN '    os.system(t)' WHEN 3 THEN '  eval(t)' ELSE '  run(t)' END END || {_END}"
_CALL = f"CASE WHEN j + 1 < n THEN CASE l WHEN 2 THEN '    ' ELSE '  ' END || 'f' || (j + 1) || '_' || k || '(t, b)' ELSE {_STEP} || '3' END || {_END}"


def _slot(i: int) -> str:
    return f"CASE WHEN b >= {i} THEN {_BRANCH} ELSE {_STEP} || '1' || {_END} END"


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, ext, content): a file of one to three functions for each part, in six languages."""
    lines = [_SIGNATURE, _slot(1), _slot(2), _slot(3), _ASSIGN, _SINK, _CALL]
    text = " || '\n' || ".join(f"({x})" for x in lines) + " || CASE l WHEN 2 THEN '\n' ELSE '\n}\n' END"
    rows = sql(spark, f"{CODE} SELECT path, ext, k, l, j, {text} AS t FROM x", sf_dir, "part")
    files = joined(rows, ["path", "ext", "k", "l"], ["j"], "t")
    java = F.col("l") == 1
    return files.select("path", "ext", F.when(java, F.concat(F.lit("class A"), F.col("k").cast("string"), F.lit(" {\n"), "body", F.lit("\n}\n"))).otherwise(F.col("body")).alias("content"))


# --- diffs -----------------------------------------------------------------------

#: SQL, for both engines: hunk i of file o in the diff d; minus and plus count its lines.
HUNKS = """WITH h AS (SELECT l_suppkey AS d, l_orderkey AS o, l_partkey % 3 AS minus, (l_partkey + l_linenumber) % 4 AS plus,
 row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS i FROM lineitem)"""


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(diff, content): a unified diff for each supplier, with a file for each order and a hunk for each row."""
    text = "'@@ -' || (i * 100) || ',' || minus || ' +' || (i * 100 + 7) || ',' || plus || ' @@ f()' || repeat('\n-old', CAST(minus AS INT)) || repeat('\n+new', CAST(plus AS INT))"
    rows = sql(spark, f"{HUNKS} SELECT d, o, i, {text} AS t FROM h", sf_dir, "lineitem")
    files = joined(rows, ["d", "o"], ["i"], "t")
    name = F.concat(F.lit("src/o"), F.col("o").cast("string"), F.lit(".c"))
    head = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n"))
    return joined(files.withColumn("t", F.concat(head, "body")), ["d"], ["o"], "t").select(F.col("d").cast("string").alias("diff"), F.col("body").alias("content"))


# --- statements that write ----------------------------------------------------------

#: SQL, for both engines: a file of one function for each part, whose statement writes its parameter (or a request's).
OUTPUT = """WITH o AS (SELECT p_partkey AS k, p_partkey % 9 AS t, CASE WHEN p_partkey % 9 IN (2, 8) THEN 'cs' WHEN p_partkey % 9 IN (3, 4, 5) THEN 'php' WHEN p_partkey % 9 = 6 THEN 'c' ELSE 'java' END AS ext FROM part),
x AS (SELECT *, 'web/p' || k || '.' || ext AS path FROM o)"""
_OUTPUT_TEXT = """CASE t WHEN 0 THEN 'class A {\n  String f(String a) {\n    String b = "<b>" + a + "</b>";\n  }\n}\n' WHEN 1 THEN 'class A {\n  String f(String a) {\n    String b = "<b>" + escapeHtml(a) + "</b>";\n  }\n}\n'
 WHEN 2 THEN 'class A {\n  void f(string a) {\n    cmd.CommandText = "SELECT " + a;\n  }\n}\n' WHEN 3 THEN '<?php\nfunction f($a) {\n  echo $_GET["q"];\n}\n' WHEN 4 THEN '<?php\nfunction f($a) {\n  echo htmlspecialchars($_GET["q"]);\n}\n'
 WHEN 5 THEN '<?php\nfunction f($a) {\n  echo $a;\n}\n' WHEN 6 THEN '/* MD5( */\nvoid f(char *a) {\n  unsigned char *d = MD5(a, 3, 0); /* MD5( */\n}\n' WHEN 7 THEN 'class A {\n  void f(String a) {\n    c = Cipher.getInstance("DES/CBC");\n    x = SAXParserFactory.newInstance();\n  }\n}\n'
 ELSE 'class A {\n  void f(string a) {\n    x = new Unmarshaller(); s.DtdProcessing = DtdProcessing.Prohibit;\n  }\n}\n' END"""


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, ext, content) of those files."""
    return sql(spark, f"{OUTPUT} SELECT path, ext, {_OUTPUT_TEXT} AS content FROM x", sf_dir, "part")
