"""Function shapes of eleven languages, walks through them, and what files hold."""

import pytest
from pyspark.sql import functions as F

from siftstone.operators import bayes, graphs, lexing, packages, reviews, rules, taint
from siftstone.plans import loops, reports

SINKS = {k: ("X", 3) for k in ("exec", "Exec", "system", "os.system", "eval", "run")}
SHAPES = [
    ("java", "class A { void go(String s) throws IOException, SQLException { exec(s); }\n <T> List<T> many(Map<String, T> m) { return null; } A(int x) { this.x = x; } }", [("go", ["s"]), ("many", ["m"]), ("A", ["x"])], ["go"]),
    ("go", "func Load(p string) (int, error) { exec(p) }\nfunc (s *Srv) Do(a, b string, n int) error { return nil }", [("Load", ["p"]), ("Do", ["s", "a", "b", "n"])], ["Load"]),
    ("cpp", "Foo::Foo(int a) : x_(a), y_{b} { exec(a); }\nint Foo::get() const noexcept { return x_; }", [("Foo", ["a"]), ("get", [])], ["Foo"]),
    ("kt", "fun f(a: String): Map<String, Int> { exec(a) }", [("f", ["a"])], ["f"]),
    ("js", "const f = (a, b) => { exec(a); };\nlet g = async x => { eval(x) };\nconst o = { h: function (q) { run(q) }, k(z) { return z } };\nfoo((x) => { bar(x) });\nif (foo(x)) { y() }", [("f", ["a", "b"]), ("g", ["x"]), ("h", ["q"]), ("k", ["z"])], ["f", "g", "h"]),
    ("py", "def run(\n    cmd: Dict[str, int],\n    *args,\n    other=(1, 2),\n) -> None:\n    os.system(cmd)\n\ndef one(x): return x\n", [("run", ["cmd", "args", "other"]), ("one", ["x"])], ["run"]),
    ("rb", "def go(a, b = 1)\n  system(a)\nend\n", [("go", ["a", "b"])], ["go"]),
    ("swift", "func f(a b: String) async throws -> [String: Int] { exec(b) }", [("f", ["b"])], ["f"]),
    ("rs", "fn f<T: Clone>(a: &str, b: T) -> Result<i32, E> where T: X { exec(a) }", [("f", ["a", "b"])], ["f"]),
    ("php", "<?php function f($a) { exec($a); }", [("f", ["$a"])], ["f"]),
    ("cs", "public async Task<int> F(string a) where T : class { Exec(a); }", [("F", ["a"])], ["F"]),
    ("c", "static int helper(char *p) {\n  if (p && *p) { return 1; }\n  return 0;\n}\nint decl(int a);\nint x = f(a) ? g(b) : h(c);", [("helper", ["p"])], []),
]


@pytest.mark.parametrize("ext,text,names,sunk", SHAPES, ids=[s[0] for s in SHAPES])
def test_shapes(ext, text, names, sunk):
    assert [(r[0], r[6]) for r in lexing.functions(text, ext)] == names
    assert [w[0] for w in taint.walk(text, ext, set(), SINKS, set())] == sunk


def test_long_signature():
    text = "void f(char *a) " + "__attribute__((x)) " * 40 + "{ system(a); }"
    assert [r[0] for r in lexing.functions(text, "c")] == ["f"] and len(list(taint.walk(text, "c", set(), SINKS, set()))) == 1


def test_php_echo():
    assert lexing.php_code("<b><?= $x ?></b>\n<?php y(); ?>z").split() == ["echo", "$x", ";", "y();"]
    found = list(taint.walk('<?php function f($a) { ?><p><?= $_GET["q"] ?></p><?php }', "php", {"$_GET"}, {}, set()))
    assert [f[2] for f in found] == ["XSS (HTML Injection)"]


def test_outputs():
    walk = lambda text, ext, sources=(): [(f[1], f[2]) for f in taint.walk(text, ext, set(sources), {}, set())]
    assert walk('String f(String a) {\n return "<b>" + a;\n}', "java") == [(2, "XSS (HTML Injection)")]
    assert walk('String f(String a) {\n return "<b>" + escapeHtml(a);\n}', "java") == []
    assert walk('function f(a) { return "<b>" + a; }', "js") == [] and len(walk('function f(a) { document.body = "<b>" + a; }', "js")) == 1
    assert walk("def f(a):\n    return f'<b>{a}</b>'\n", "py") == [(2, "XSS (HTML Injection)")]
    assert walk("def f(a):\n    return render_template_string(f'<b>{a}</b>')\n", "py") == []
    assert walk('void f(string a) { c.CommandText = "SELECT " + a; }', "cs") == [(1, "SQL Injection")]


def test_project_across_files(spark):
    """A source in one file taints a call in another; a function that is only called with constants is clean."""
    files = [
        ("a.py", "py", "def load():\n    return getenv('X')\n"),
        ("b.py", "py", "def main():\n    c = load()\n    os.system(c)\n    helper('fixed')\n"),
        ("c.py", "py", "def helper(x):\n    os.system(x)\n"),
        ("d.py", "py", "def alone(x):\n    os.system(x)\n"),
    ]
    df = spark.createDataFrame(files, "path string, ext string, content string")
    got = taint.project(df, ["getenv"], [("os.system", "Command Injection", 3)]).collect()
    assert sorted((r["path"], r["line"], tuple(r["taint_path"])) for r in got) == [("b.py", 3, ("load()", "c")), ("d.py", 2, ("x",))]
    assert taint.project(df.limit(0), ["getenv"], [("os.system", "Command Injection", 3)]).collect() == []


def test_formats_that_repeat():
    lock = '[[package]]\nname = "a"\nversion = "1.0"\n\n[[package]]\nname = "a"\nversion = "1.0"\n'
    assert [x[2] for x in packages.parse("toml_lock", lock)] == [1, 5]
    assert list(packages.parse("requirements", "A==1.0\na==1.0\n-e x==2.0\nb c==1.0")) == [("A", "1.0", 1)]
    assert list(packages.parse("pyproject", '[project]\ndependencies = ["a==1.0; python_version > \'3\'"]\n[tool.x]\nz = "b==2.0"\n')) == [("a", "1.0", 2)]
    assert list(packages.parse("npm", "[1]")) == list(packages.parse("npm_lock", '{"packages": 3}')) == list(packages.parse("pom", "")) == []


def test_secrets_over_lines(spark):
    files = spark.createDataFrame([("a.py", 'x = 1\npassword =\n  "hunter2!x"\n'), ("b.java", "password = decrypted;\n"), ("c.php", "$password = \"$secret99\";\n'k' => 'abc123!x'\n"), ("d.py", None)], "path string, content string")
    assert sorted(tuple(r) for r in rules.file_secrets(files).select("path", "line").distinct().collect()) == [("a.py", 2), ("c.php", 1), ("c.php", 2)]


def test_aliases(spark):
    a = spark.createDataFrame([("a", "b"), ("a", "z"), ("b", "c"), ("c", "d"), ("d", "e"), ("loop", "loop")], "name string, target string")
    assert {r["name"]: r["target"] for r in rules.resolved_aliases(a).collect()} == {"a": "e", "b": "e", "c": "e", "d": "e", "loop": "loop"}


def test_closure_limit(spark):
    edges = spark.createDataFrame([(f"n{i}", "root") for i in range(5)] + [(f"m{i}", f"n{i}") for i in range(5)], "caller string, callee string")
    start = spark.createDataFrame([("root",)], "root string")
    got = sorted((r["depth"], r["node"]) for r in graphs.closure(edges, start, most=8).collect())
    assert got == [(0, "root"), *((1, f"n{i}") for i in range(5)), (2, "m0"), (2, "m1")]


def test_layers_of_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("a", "d")], "caller string, callee string")
    got = {r["node"]: (r["rank"], r["settled"]) for r in graphs.layers(edges, rounds=6).collect()}
    assert got["a"] == (0, True) and got["d"] == (1, True)


def test_sarif_file(spark, tmp_path):
    import json

    rows = [("b.c", 3, "SQL Injection", "m", 2, 2), ("a.c", 0, "SQL injection", "m", 1, 1), ("a.c", 9, "Race", "m", 0, 3)]
    log = reports.sarif(spark.createDataFrame(rows, "path string, line int, category string, message string, severity int, seq int"))
    reports.write_log(log, str(tmp_path / "log"))
    doc = json.loads("".join(p.read_text() for p in sorted((tmp_path / "log").glob("part-*"))))
    run = doc["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["sql-injection", "sql-injection-2", "race"]
    assert [a["location"]["uri"] for a in run["artifacts"]] == ["a.c", "b.c"]
    assert [(r["ruleIndex"], r["level"], r["locations"][0]["physicalLocation"]["region"]["startLine"]) for r in run["results"]] == [(0, "warning", 1), (1, "error", 3), (2, "note", 9)]


def test_numbered(spark):
    df = spark.range(0, 5000).withColumn("k", F.expr("(id * 7919) % 5000"))
    assert loops.numbered(df, "k", "n").where("n <> k").count() == 0 and loops.numbered(df.limit(0), "k", "n").count() == 0


def test_slices(spark):
    files = spark.createDataFrame([("a", "x" * 30 + "\nab\ncd\n"), ("b", ""), ("c", None)], "path string, content string")
    assert sorted(tuple(r) for r in reviews.chunks(files, 8).collect()) == [("a", 0, 1, 1, "x" * 30), ("a", 1, 2, 4, "ab\ncd\n"), ("b", 0, 1, 1, ""), ("c", 0, 1, 1, "")]


def test_comments(spark):
    lines = ["/* start", "middle", "end */ x()", "", "foo(); /* late", "bar", "// c", "/* a */ // b", "/* a */ b"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines, 1)], "path string, line int, text string")
    assert [r["is_comment"] for r in sorted(bayes.comment_lines(df, "path").collect(), key=lambda r: r["line"])] == [True, True, False, True, False, False, True, True, False]


def test_write_through(spark):
    text = "void f(int s) {\n char buf[9]; char *c = 0;\n recv(s, buf, 9);\n system(buf);\n fill(c);\n system(c);\n}\n"
    walk = lambda **k: [w[1] for w in taint.walk(text, "c", set(), {"system": ("X", 3, 0)}, set(), **k)]
    assert walk() == [4] and walk(writes={"fill": [0]}) == [4, 6]
    files = [("a.c", "c", "void fill(char *p) {\n char *v = getenv(\"X\");\n *p = v;\n}\n"), ("b.c", "c", "void g() {\n char *c = 0;\n fill(c);\n system(c);\n}\n")]
    got = taint.project(spark.createDataFrame(files, "path string, ext string, content string"), ["getenv"], [("system", "X", 3, 0)]).collect()
    assert [(r["path"], r["line"]) for r in got] == [("b.c", 4)]


def test_tables():
    from siftstone.operators import tables

    assert len(tables.sinks()) == 176 and len(tables.sources()) < 160
    rules_ = taint.sinks_of(tables.sinks(), "py")
    assert rules_["os.system"] == ("Command Injection", 2, 0) and "IO.popen" not in rules_ and rules_["strcpy"][0] == "Buffer Overflow"
    walk = lambda text: [w[1:4] for w in taint.walk(text, "py", set(tables.sources()), rules_, set())]
    assert walk("def f():\n    x = input()\n    os.system(x)\n    os.execl('a', x)\n    os.execl(x, 'b')\n") == [(3, "Command Injection", 2), (4, "Command Injection", 2)]
    always = taint.sinks_of(tables.sinks(), "java")["ObjectInputStream"]
    assert always[2] == taint.ALWAYS and len(list(taint.walk("class A { void f() { x = new ObjectInputStream(1); } }", "java", set(), {"ObjectInputStream": always}, set()))) == 1


def test_scan_directory(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "build").mkdir()
    (tmp_path / "src" / "a.py").write_text("def f(c):\n    os.system(c)\n    key = 'sk_live_123456789'\n")
    (tmp_path / "build" / "b.py").write_text("def f(c):\n    os.system(c)\n")
    from siftstone.plans import jobs, scan

    got = scan.scan_directory(spark, str(tmp_path)).collect()
    assert sorted((r["path"], r["line"], r["category"]) for r in got) == [("src/a.py", 2, "Command Injection"), ("src/a.py", 3, "Hardcoded Secret Key")]
    job = jobs.Jobs(spark).scan_directory(str(tmp_path), wait_seconds=100)
    assert job.status == "done" and job.summary["findings"] == 2


def test_declarations():
    names = lambda text, ext: [(x[0], x[1]) for x in lexing.declared(text, ext)]
    assert names("void f(char *a, int n) { List<Map<String, X>> m = g(); unsigned b[4]; }", "java") == [("a", "char"), ("n", "int"), ("m", "List"), ("b", "unsigned")]
    assert names("fun f(a: String) { val b: Int = 1 }", "kt") == [("a", "String"), ("b", "Int")]


GUARDS = [
    ("py", "def f(a):\n    if a not in ALLOWED:\n        raise ValueError\n    os.system(a)\n", 0),
    ("py", "def f(a):\n    if a in BLOCKED:\n        raise ValueError\n    os.system(a)\n", 1),
    ("py", "def f(a):\n    if a not in ALLOWED:\n        log(a)\n    os.system(a)\n", 1),
    ("py", "def f(a):\n    subprocess.run([a], shell=False)\n", 0),
    ("py", "def f(a):\n    subprocess.run([a], shell=True)\n", 1),
    ("py", "def f(a):\n    subprocess.run(a)\n", 1),
    ("java", "class A { void f(String a) { if (!ALLOWED.contains(a)) { return; } exec(a); } }", 0),
    ("java", "class A { void f(String a) { if (!ALLOWED.contains(a)) { return; } a = other(b); exec(a); } }", 0),
    ("java", "class A { void f(String a, String b) { if (!ALLOWED.contains(b)) return; exec(a); } }", 1),
    ("java", "class A { void f(String a) { if (!X.contains(a) || y) { return; } exec(a); } }", 1),
    ("php", '<?php function f($a) { if (!in_array($a, $list)) { exit(1); } system($a); }', 0),
    ("c", "void f(int n) { if (n > MAX) n = MAX; system(n); }", 0),
    ("c", "void f(int n, int m) { if (n > m) n = m; system(n); }", 1),
    ("go", "func f(a string) { if !allowed.has(a) { return }\n exec(a) }", 0),
]


@pytest.mark.parametrize("ext,text,n", GUARDS)
def test_guards(ext, text, n):
    sinks = SINKS | {"subprocess.run": ("X", 3)}
    assert len(list(taint.walk(text, ext, set(), sinks, set()))) == n


def test_sizes():
    from siftstone.operators import buffers

    names = buffers.constants("#define A 8\n#define B (A * 2 + 1)\n#define C(x) x\n#define D 0x10u\n#define E 1 << 3\n")
    assert names == {"A": 8, "B": 17, "D": 16, "E": 8}
    of = lambda t: buffers.Sizes(names, {"buf": 9}).of(list(lexing.tokenize(t, "c")))
    assert [of(x) for x in ("sizeof(int) * 4", "sizeof buf", "sizeof(char *)", "B - A", "n + 1", "1 / 0", "017", "")] == [16, 9, 8, 9, None, None, 15, None]


BUFFERS = [
    ("char b[8]; strcpy(b, \"12345678\");", 1), ("char b[9]; strcpy(b, \"12345678\");", 0), ("char b[N]; memcpy(b, s, N + 1);", 1), ("char b[N]; memcpy(b, s, sizeof(b));", 0),
    ("int b[2]; memset(b, 0, 9);", 1), ("char *p = malloc(4 * 2); fgets(p, 9, f);", 1), ("char *p = malloc(n); fgets(p, 9, f);", 0), ("char b[4]; char *s = \"12345\"; strcpy(b, s);", 1),
    ("char b[4]; char *s = \"12345\"; s = other(); strcpy(b, s);", 0), ("char b[4]; read(0, b, 5);", 1), ("char b[4]; snprintf(b, 4, \"%s\", x);", 0), ("char b[2]; sprintf(b, \"%s\", x);", 0),
]


@pytest.mark.parametrize("body,n", BUFFERS)
def test_buffers(body, n):
    assert [w[2] for w in taint.walk("#define N 16\nvoid f(int x) { " + body + " }", "c", set(), {}, set())] == ["Buffer Overflow"] * n


def test_fields_and_cleaners(spark):
    text = "class A { String p; A(String s) { this.p = s; } void go() { exec(p); } void no() { exec(q); } }"
    assert [(w[0], w[4]) for w in taint.walk(text, "java", set(), SINKS, set())] == [("go", ["this", "p"])]
    cap = "int cap(int n) { if (n > MAX) { n = MAX; } return n; }"
    ok = "class V { String check(String s) { if (!ALLOWED.contains(s)) { return null; } return s; } String not(String s) { if (!ALLOWED.contains(s)) { return null; } return other(s); } }"
    kinds = lambda t, e: sorted(f[1] for f in taint.facts(t, e, set()) if f[0] == "cleaner")
    assert kinds(cap, "c") == ["cap"] and kinds(ok, "java") == ["check"]
    files = [("v.java", "java", ok), ("a.java", "java", "class A { void go(String s) { String a = check(s); exec(a); String b = other(s); exec(b); } }")]
    got = taint.project(spark.createDataFrame(files, "path string, ext string, content string"), [], [("exec", "X", 3)]).collect()
    assert [(r["path"], r["taint_path"]) for r in got] == [("a.java", ["s", "b"])]


def test_report_sections(spark):
    rows = [("a", 1, "X", 3, "introduced"), ("b", 2, "Y", 0, "introduced"), ("c", 3, "Z", 1, "fixed")]
    text = reports.assembled(reports.markdown(spark.createDataFrame(rows, "path string, line int, category string, severity int, awareness string"), "T"))
    assert text == "# T\n\n## Introduced (2)\n\n- **Critical** X — `a:1`\n- **Low** Y — `b:2`\n\n## Fixed (1)\n\n- **Medium** Z — `c:3`\n"
