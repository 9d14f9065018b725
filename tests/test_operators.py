"""Operators on small literal tables."""

import json
import time

import pytest
from pyspark.sql import functions as F

from siftstone.functions import scalars as S
from siftstone.operators import bayes, diff, findings, graphs, lexing, packages, reviews, rules, taint
from siftstone.plans import jobs, reports
from siftstone.sources import files, forges, stores
from siftstone.streaming import monitor


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(("text", "want"), [("a+b", ["a", "b"]), ("a ++b", ["a", "+", "+", "b"]), ("if (a+b == C++ && x)", ["if", "(", "a", "b", "=", "=", "c", "+", "&", "&", "x"])])
def test_tokens(spark, text, want):
    assert one(spark, S.tokens, text) == want


def test_posterior(spark):
    t = spark.createDataFrame([(True, "strcpy(buf, src)"), (True, "gets(line)"), (False, "strncpy(buf, src, len)")], "bad boolean, text string")
    model = bayes.train(t)
    lines = spark.createDataFrame([(1, "strcpy(dst, src)"), (2, "()"), (3, None)], "line int, text string")
    got = {r["line"]: r["prob"] for r in bayes.score(lines, model, bayes.totals(t, model), "line").collect()}
    assert got[1] == pytest.approx(2048 / 2777) and got[2] == 0.5 and got[3] == 0.5


def test_patches_and_model(spark, tmp_path):
    p = "--- a/x.java\n+++ b/x.java\n@@ -1 +1 @@\n-bad\n+good\n--- a/y.md\n+++ b/y.md\n-no\n+yes\n"
    got = bayes.patch_lines(spark.createDataFrame([("p", p)], "patch string, content string"), ["java"])
    assert sorted((r["bad"], r["text"]) for r in got.collect()) == [(False, "good"), (True, "bad")]
    model = bayes.train(got)
    bayes.model_json("m", model, bayes.totals(got, model)).write.text(str(tmp_path / "m"))
    again, meta = bayes.read_model(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, model.collect())) and meta.first()["bad_examples"] == 1


def test_scalars(spark):
    assert one(spark, S.fnv1a, "a") == "af63dc4c8601ec8c" and one(spark, S.fnv1a, "") == "cbf29ce484222325" and one(spark, S.fnv1a, "foobar") == "85944171f73967e8"
    assert one(spark, S.pascal_case, "sql injection (raw)") == "SqlInjectionRaw" and one(spark, S.pascal_case, "--") == "Rule"
    assert one(spark, S.normalized_path, "\\A\\b.C/") == "a/b.c"
    assert one(spark, S.forge_slug, "git@github.com:o/r.git") == "o/r" and one(spark, S.forge_of, "https://GitLab.com/x") == "gitlab"
    assert one(spark, S.looks_like_secret, "iG0@t_L0cK") and not one(spark, S.looks_like_secret, "version_2")
    assert one(spark, S.natural_key, "f10") > one(spark, S.natural_key, "f9")


def test_advisory_severity(spark):
    kind = "array<struct<type:string,score:string>>"
    rows = [("HIGH", [("CVSS_V3", "1.0")]), (None, [("X", "9.1")]), (None, [("CVSS_V3", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:L/I:N/A:N")]), (None, None)]
    got = spark.createDataFrame(rows, f"d string, s {kind}").select(S.advisory_severity(F.col("d"), F.col("s"))).collect()
    assert [r[0] for r in got] == [2, 3, 1, 1]


def test_merge_reviews(spark):
    schema = "seq int, path string, line int, function string, category string, engine string"
    built = spark.createDataFrame([(1, "a", 1, "f", "SQL Injection", "Heuristic"), (2, "a", 2, "f", "XSS", "AST")], schema)
    seen = spark.createDataFrame([(9, "a", 1, "f", "injection", "AI"), (10, "a", 1, "f", "sql injection", "AI"), (11, "a", 5, "f", "Race", "AI"), (12, "a", 5, "f", "race", "AI")], schema)
    merged, rest = findings.merge_reviews(built, seen)
    assert {r["seq"]: r["engine"] for r in merged.collect()} == {1: "Heuristic, AI", 2: "AST"}
    assert sorted(r["seq"] for r in rest.collect()) == [10, 11]


def test_diff_parts(spark):
    d = spark.createDataFrame([("d", "diff --git a/x b/x\n+1\ndiff --git a/y b/z\n-2")], "diff string, content string")
    assert sorted((r["path"], r["patch"].count("\n")) for r in diff.split_by_path(d).collect()) == [("x", 1), ("z", 1)]
    s = spark.createDataFrame([("M\ta",), ("R090\told\tnew",), ("junk",)], "raw string")
    assert sorted(map(tuple, diff.changed_files(s).collect()), key=str) == sorted([("a", None, "M"), ("new", "old", "R")], key=str)


def test_graphs(spark):
    chain = spark.createDataFrame([(f"f{i}", f"f{i + 1}") for i in range(14)] + [("a", "b"), ("b", "a")], "caller string, callee string")
    reached = graphs.closure(chain, spark.createDataFrame([("f14",), ("a",), ("x",)], "root string"))
    depth = {(r["root"], r["node"]): r["depth"] for r in reached.collect()}
    assert depth["f14", "f2"] == 12 and ("f14", "f1") not in depth and depth["a", "b"] == 1 and depth["x", "x"] == 0
    star = spark.createDataFrame([(f"c{i:03}", "hub") for i in range(100)], "caller string, callee string")
    assert graphs.closure(star, spark.createDataFrame([("hub",)], "root string")).count() == 80
    entries = spark.createDataFrame([("f3", "remote"), ("b", "local")], "node string, origin string")
    assert {r["root"]: r["verdict"] for r in graphs.verdict(reached, entries).collect()} == {"f14": "remote", "a": "local", "x": "unverified"}
    rounds = graphs.fixpoint(chain, spark.createDataFrame([("f14",)], "name string"))
    assert rounds.count() == 11 and rounds.where("name = 'f4'").first()["round"] == 10
    fns = spark.createDataFrame([("p", "main"), ("p", "g"), ("p", "dead"), ("q", "h")], "path string, fn string")
    calls = spark.createDataFrame([("p", "main", "g")], "path string, caller string, callee string")
    assert {(r["path"], r["fn"]): r["reachable"] for r in graphs.reachable(fns, calls).collect()} == {("p", "main"): True, ("p", "g"): True, ("p", "dead"): False, ("q", "h"): True}
    steps = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    flows = graphs.flow_paths(spark, steps, spark.createDataFrame([("a",)], "root string"))
    assert sorted(r["path"] for r in flows.collect()) == [["a"], ["a", "b"], ["a", "b", "c"]]
    assert {r["node"]: r["rank"] for r in graphs.layers(steps.where("dst <> 'a'").toDF("caller", "callee")).collect()} == {"a": 0, "b": 1, "c": 2}


FORMATS = [
    ("yarn", 'lodash@^4.0.0:\n  version "4.17.21"\n\nmine@workspace:.:\n  version "1.0.0"\n', [("lodash", "4.17.21", 1)]),
    ("pnpm", "packages:\n  /left-pad/1.3.0:\n    x: 1\n  '@a/b@2.0.0(c@1.0.0)':\n", [("left-pad", "1.3.0", 2), ("@a/b", "2.0.0", 4)]),
    ("toml_lock", '[[package]]\nname = "x"\nversion = "1.2.3"\n', [("x", "1.2.3", 1)]),
    ("cargo_lock", '[[package]]\nname = "x"\nversion = "1.2.3"\nsource = "registry+https://r"\n\n[[package]]\nname = "own"\nversion = "0.1.0"\n', [("x", "1.2.3", 1)]),
    ("pipfile", '{"default": {"x": {"version": "==1.2"}}}', [("x", "1.2", 1)]),
    ("composer_lock", '{"packages": [{"name": "a/b", "version": "v1.2"}]}', [("a/b", "1.2", 1)]),
    ("go_mod", "module m\nrequire (\n  a.b/c v1.2.3 // indirect\n)\nrequire d v0.1.0\n", [("a.b/c", "1.2.3", 3), ("d", "0.1.0", 5)]),
    ("gem_lock", "GEM\n  specs:\n    rack (2.2.3)\n      dep (>= 1)\nPLATFORMS\n", [("rack", "2.2.3", 3)]),
    ("nuget_lock", '{"dependencies": {"net6": {"N": {"resolved": "1.0.0"}}}}', [("N", "1.0.0", 1)]),
    ("swift_resolved", '{"pins": [{"location": "git@h.org:o/r.git", "state": {"version": "1.0.0"}}]}', [("https://h.org/o/r", "1.0.0", 1)]),
    ("gradle_lock", "a:b:1.0=compile\nempty=\n", [("a:b", "1.0", 1)]),
    ("gradle_catalog", '[versions]\nk = "1.9.0"\n[libraries]\nx = { module = "a:b", version.ref = "k" }\n', [("a:b", "1.9.0", 4)]),
    ("npm", '{"dependencies": {"a": "1.0.0", "b": "^2.0.0"}}', [("a", "1.0.0", 1)]),
    ("pyproject", 'dependencies = [ "x==1.2" ]\n[tool.poetry.dependencies]\ny = "2.0"\n', [("y", "2.0", 3), ("x", "1.2", 1)]),
    ("cargo", '[dependencies]\na = "1.0"\nb = { version = "2.1", features = ["z"] }\n', [("a", "1.0", 2), ("b", "2.1", 3)]),
    ("composer", '{"require": {"a/b": "v1.0"}}', [("a/b", "1.0", 1)]),
    ("gemfile", 'gem "x", "1.2"\n', [("x", "1.2", 1)]),
    ("pom", "<p>\n<dependency><groupId>g</groupId><artifactId>a</artifactId><version>1.0</version></dependency>\n<dependency><groupId>g</groupId><artifactId>b</artifactId><version>${v}</version></dependency></p>", [("g:a", "1.0", 2)]),
    ("gradle", "implementation 'g:a:1.0'\nclasspath 'x:y:2.0'\n", [("g:a", "1.0", 1)]),
    ("csproj", '<PackageReference Include="N" Version="1.0" />\n', [("N", "1.0", 1)]),
    ("npm_lock", '{"dependencies": {"a": {"version": "1.0.0", "dependencies": {"b": {"version": "2.0.0"}}}}}', [("a", "1.0.0", 1), ("b", "2.0.0", 1)]),
    ("npm_lock", "not json", []),
]


@pytest.mark.parametrize(("kind", "text", "want"), FORMATS)
def test_formats(kind, text, want):
    assert list(packages.parse(kind, text)) == want


def test_rules(spark):
    rows = [("p", 1, "py", "a.os.system"), ("p", 2, "go", "system"), ("p", 3, "c", "RUN")]
    calls = spark.createDataFrame(rows, "path string, line int, lang string, chain string")
    table = spark.createDataFrame([("os.system", "A", 3, ["py"]), ("system", "B", 2, None)], "key string, category string, severity int, langs array<string>")
    alias = spark.createDataFrame([("RUN", "system")], "name string, target string")
    assert {r["line"]: r["category"] for r in rules.match_sinks(calls, table, alias).collect()} == {1: "A", 2: "B", 3: "B"}
    code = spark.createDataFrame([("x.py", "py", "def f():\n    return request.args.get('x')\ndef get(x):\n    pass\n")], "path string, ext string, content string")
    tokens = lexing.lex(code).withColumn("lang", F.col("ext"))
    catalog = spark.createDataFrame([("get", "args", "HTTP", "remote", "primary", None)], "leaf string, prefix string, category string, origin string, confidence string, langs array<string>")
    sites = rules.entry_sites(tokens, catalog)
    assert [r["category"] for r in sites.collect()] == ["HTTP"] and rules.sites_by_category(sites).first()["n"] == 1
    made = spark.createDataFrame([("a/B.java", "new Foo<X>(1); new\nFoo();"), ("a/test/C.java", "new Foo()")], "path string, content string")
    assert [(r["path"], r["n"]) for r in rules.instantiations(made, "Foo").collect()] == [("a/B.java", 2)]
    lines = spark.createDataFrame([("m.h", 1, '#define NAME "v"'), ("m.h", 2, "#define A b")], "path string, line int, text string")
    assert [(r["kind"], r["name"], r["value"]) for r in rules.macros(lines).orderBy("line").collect()] == [("string", "NAME", "v"), ("alias", "A", "b")]


def test_reviews(spark):
    text = "\n".join(["x" * 9] * 5)
    got = reviews.chunks(spark.createDataFrame([("p", text), ("e", "")], "path string, content string"), 20).collect()
    assert [(r["first_line"], r["last_line"]) for r in got if r["path"] == "p"] == [(1, 2), (3, 4), (5, 5)] and len(got) == 4
    cards = spark.createDataFrame([("p", i, s) for i, s in enumerate([10, 10, 90, 10, 10, 10, 10])], "path string, card int, size int")
    assert [r["batch"] for r in reviews.batches(cards, 4, 100).orderBy("card").collect()] == [0, 0, 1, 1, 2, 2, 2]
    answer = 'text ```json\n[{"line": 3, "category": "xss", "severity": "High",}]\n``` {"category": "Odd", "line": "x"}'
    assert list(reviews.records(answer))[0][:3] == (3, "xss", "High")
    known = spark.createDataFrame([(0, "Cross-Site Scripting (XSS)"), (1, "XSS")], "ord int, name string")
    found = spark.createDataFrame([("xss", "h"), ("", None), ("new kind", "low")], "category string, severity string")
    assert sorted(map(tuple, reviews.normalised_categories(found, known).collect())) == [("Other", 1), ("XSS", 2), ("new kind", 0)]


def test_lexing():
    got = list(lexing.functions("int f(int a, char *b) { return g(a); }\nvoid g();\n", "c"))
    assert [(x[0], x[6]) for x in got] == [("f", ["a", "b"])]
    assert [x[0] for x in lexing.functions("class A {\n  public int go(String s) throws E { if (s == null) { return 1; } return 0; }\n}", "java")] == ["go"]
    assert lexing.php_code("a<?php b ?>c\n").split() == ["b"]
    assert [t[2] for t in lexing.tokenize('a("x;//y") // z\n', "c")] == ["a", "(", '"x;//y"', ")"]
    assert lexing.complexity("{ switch (x) { case 1: case 2: break; } while (a && b) {} }", "c") == 5


def test_taint(spark):
    code = [("a.c", "c", "char *src() { char *v = getenv(\"X\"); return v; }\nchar *mid() { return src(); }\nvoid go() { char *t = mid(); system(t); t = \"ok\"; system(t); }")]
    files_ = spark.createDataFrame(code, "path string, ext string, content string")
    facts = taint.all_facts(files_, ["getenv"])
    names = {r["name"]: r["round"] for r in taint.tainting_functions(facts).collect()}
    assert names == {"src": 0, "mid": 1}
    hits = taint.scan(files_, ["getenv"], [("system", "Command Injection", 3)], list(names)).collect()
    assert [(r["function"], r["taint_path"]) for r in hits] == [("go", ["mid()", "t"])]


def test_facts_of_long_lines():
    far = " + ".join(str(i) for i in range(300))
    code = f"int own(void) {{ return {far} + getenv(); }}\nint call(void) {{ return {far} + own(); }}\nint same(int p) {{ return {far} + p; }}\nint held(void) {{ int x = {far} + getenv(); return x; }}\nvoid put(char *q) {{ *q = {far} + getenv(); }}\n"
    found = set(taint.facts(code, "c", {"getenv"}))
    assert {("source", "own", "own"), ("returns_call", "call", "own"), ("pass_through", "same", "same"), ("source", "held", "held"), ("write_through", "put", "0")} <= found


def test_parameter_facts(spark):
    code = [("a.c", "c", 'static void put(char *d, int n) { d[0] = getenv("X"); }\nvoid go() { char *t = getenv("Y"); put(t, 3); run(1, t); }')]
    found = taint.all_facts(spark.createDataFrame(code, "path string, ext string, content string"), ["getenv"])
    assert sorted(map(tuple, taint.parameter_facts(found).collect()), key=str) == [("a.c", "put", [0]), (None, "run", [1])]
    assert [tuple(r) for r in taint.parameter_facts(found, "write_through").collect()] == [("a.c", "put", [0])]


def test_types(spark):
    d = spark.createDataFrame([("p", "x", "int", 0, 0, 100), ("p", "x", "char", 20, 10, 50)], "path string, name string, type string, at int, lo int, hi int")
    sites = spark.createDataFrame([("p", 5, "x"), ("p", 15, "x"), ("p", 30, "x"), ("p", 60, "x"), ("p", 60, "y")], "path string, off int, name string")
    assert [r["type"] for r in findings.types_at(sites, d).orderBy("off", "name").collect()] == ["int", "int", "char", "int", None]


def test_sources(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "node_modules" / "b.py").write_text("y")
    (tmp_path / "LICENSE").write_text("Apache License\nVersion 2.0\n")
    tree = files.read_tree(spark, str(tmp_path), None)
    assert sorted(r["path"] for r in tree.collect()) == ["LICENSE", "src/a.py"]
    assert files.licences(tree).first()["licence"] == "Apache License 2.0"
    names = [r["name"] for r in files.listing(spark.createDataFrame([("f10.c",), ("f9.c",), ("d/x.c",)], "path string")).where("folder = ''").collect()]
    assert names == ["d", "f9.c", "f10.c"]


def test_forges_and_stores(spark):
    raw = json.dumps([{"id": 7, "number": 3, "title": "t", "user": {"login": "u"}, "head": {"ref": "h", "sha": "s"}, "base": {"ref": "main"}, "updated_at": "2024-01-02T03:04:05Z"}])
    row = forges.pull_requests(spark.createDataFrame([("o/r", raw), ("o/x", "nonsense")], "repo string, value string"), "github").collect()
    assert len(row) == 1 and (row[0]["number"], row[0]["head_sha"], str(row[0]["updated_at"])) == (3, "s", "2024-01-02 03:04:05")
    notes = spark.createDataFrame([("a", 1, "n")], stores.SCHEMAS["notes"])
    sealed = stores.seal(notes, "pw", b"salt")
    assert stores.unseal(sealed, "pw", b"salt", stores.SCHEMAS["notes"]).collect() == notes.collect()
    wiki = spark.createDataFrame([("cafe", "Café", "b")], "slug string, title string, body string")
    assert stores.search_wiki(wiki, "CAFE").count() == 1
    assert stores.resolve(wiki, spark.createDataFrame([("Café",), ("none",)], "name string")).orderBy("name").collect()[0]["slug"] == "cafe"


def test_reports(spark):
    f = spark.createDataFrame([("b.c", 2, "X Y", "m", 3, 1), ("a.c", 1, "x-y", "n", 0, 2)], "path string, line int, category string, message string, severity int, seq int")
    log = json.loads(reports.assembled(reports.sarif(f)))["runs"][0]
    assert [r["id"] for r in log["tool"]["driver"]["rules"]] == ["x-y", "x-y-2"] and [r["level"] for r in log["results"]] == ["error", "note"]
    text = reports.assembled(reports.markdown(f.withColumn("awareness", F.lit("introduced")), "T"))
    assert text.startswith("# T\n\n## Introduced (2)\n\n- **Critical** X Y")
    found = spark.createDataFrame([(0, "x.c"), (1, "nope")], "seq int, file_hint string")
    assert [r["path"] for r in reports.locate_frames(found, spark.createDataFrame([("/r/x.c",)], "path string"), "/r").orderBy("seq").collect()] == ["/r/x.c", None]


def test_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "r", str(i), f"s{i}", f"2024-01-01 00:0{i}:00") for i in range(7)] + [("2024-01-01 00:15:00", "r", "1", "s1", "2024-01-01 00:09:00"), ("2024-01-01 00:15:00", "r", "2", "new", "2024-01-01 00:10:00")]
    schema = "poll_ts string, repo string, id string, sha string, updated_at string"
    df = spark.createDataFrame(rows, schema).withColumn("poll_ts", F.to_timestamp("poll_ts")).withColumn("updated_at", F.to_timestamp("updated_at"))
    df.write.parquet(str(tmp_path / "polls"))
    out = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "polls"))
    q = monitor.monitor(stream, lambda b, n: out.extend(r["fingerprint"] for r in b.collect()), str(tmp_path / "cp"), every=None)
    assert q.awaitTermination(120)
    batch = [r["fingerprint"] for r in monitor.announced(monitor.new_in_batch(df)).collect()]
    assert sorted(out) == sorted(batch) and len(out) == 6 and "r#2@new" in out
    assert monitor.new_in_batch(df, spark.createDataFrame([("r",)], "repo string")).count() == 1


def test_jobs(spark):
    server = jobs.Jobs(spark, lambda job, report: (report("scan", 0.5), ({"n": spark.range(3).count()}, "{}"))[1])
    job = server.scan_directory("/x", wait_seconds=60)
    assert server.get_scan(job.id, True) | {"id": 0} == {"id": 0, "path": "/x", "engine": "static", "status": "done", "stage": "scan", "progress": 1.0, "summary": {"n": 3}, "error": None, "sarif": "{}"}
    assert server.scan_directory("/x").id == job.id and not server.cancel_scan(job.id)
    slow = jobs.Jobs(spark, lambda job, report: (time.sleep(0.5), ({}, ""))[1])
    first, second = slow.scan_directory("/a"), slow.scan_directory("/b")
    assert slow.cancel_scan(second.id) and second.status == "cancelled" and first.status in ("queued", "running")


def test_merge_reviews_of_a_crowded_place(spark):
    n = 20_000  # 400 million pairs of findings, 400 of categories
    k = F.col("id")
    rows = spark.range(n).select(F.lit("a.c").alias("path"), F.lit(1).alias("line"), F.concat(F.lit("Kind"), k % 20, F.lit("!")).alias("category"), F.lit("f").alias("function"), F.lit("AST").alias("engine"), k.alias("seq"))
    began = time.time()
    merged, rest = findings.merge_reviews(rows, rows.withColumn("category", F.lower("category")))
    assert {r["seq"] for r in merged.where("engine = 'AST, AI'").collect()} == set(range(20))
    assert sorted(r["seq"] for r in rest.collect()) == list(range(20, 40))
    assert time.time() - began < 60


def test_large_manifests_in_linear_time():
    n = 20_000
    pom = "".join(f"<dependency>\n<groupId>g</groupId>\n<artifactId>a{i}</artifactId>\n<version>1.{i}</version>\n</dependency>\n" for i in range(n))
    lock = '{"packages": {' + ",\n".join(f'"node_modules/m{i}": {{"name": "p{i}", "version": "1.{i}"}}' for i in reversed(range(n))) + "}}"
    began = time.process_time()
    assert [x[2] for x in packages.parse("pom", pom)] == [5 * i + 1 for i in range(n)]
    assert {x[0]: x[2] for x in packages.parse("npm_lock", lock)} == {f"p{i}": n - i for i in range(n)}
    assert time.process_time() - began < 5


def test_places_of_names():
    text = '{"a": 1,\n"b": "a",\n"c\\"d": "a",\n"e": bare xyz\n"b": "" "a"}'
    names = ["a", "a", "b", "a", "xyz", 'c"d', "none", "b", "a", 'd": "a', "a"]
    at, want = 0, []
    for name in names:
        spot, size = next(((s, len(x)) for x in (f'"{name}"', name) for s in (text.find(x, at), text.find(x)) if s >= 0), (-1, 0))
        want.append(text.count("\n", 0, max(spot, 0)) + 1)
        at = spot + size if spot >= 0 else at
    line = packages._places(text, set(names))
    assert [line(name) for name in names] == want
