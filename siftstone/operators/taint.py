"""Taint: facts of each function, and the ordered walk that follows values to sinks."""

from __future__ import annotations

import bisect
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.operators import buffers
from siftstone.operators.graphs import fixpoint
from siftstone.operators.lexing import _closing, functions, tokenize
from siftstone.operators.perfile import per_file
from siftstone.plans.loops import cut

MOST = 1_000_000  #: characters of the longest file that is scanned
ANY, ALWAYS = -1, -2
# Calls that fill what they are given, with the arguments they fill (the last one of a scanf: all from it on).
WRITES = {"fgets": [0], "gets": [0], "fread": [0], "read": [1], "recv": [1], "recvfrom": [1], "scanf": [1], "fscanf": [2], "sscanf": [2]}
_ASSIGN = ("=", "+=", "-=", "*=", ":=")


def _chain(tokens: list, at: int) -> tuple[str, int]:
    """The dotted name that ends at a token, and where it begins."""
    parts, i = [tokens[at][2]], at
    while i >= 2 and tokens[i - 1][2] in (".", "->", "::") and tokens[i - 2][1] == "identifier":
        i -= 2
        parts.append(tokens[i][2])
    return ".".join(reversed(parts)), i


def _is_clean(name: str) -> bool:
    from siftstone.functions.scalars import SANITIZER_MARKERS

    return any(m in name.lower() for m in SANITIZER_MARKERS)


def _bodies(text: str, ext: str):
    """(fn, parameters, qualifiers, tokens of the body) of each function; the text is lexed once."""
    tokens = list(tokenize(text, ext))
    places = [t[5] for t in tokens]
    for fn, _, _, _, lo, hi, params, quals in functions(text, ext, tokens):
        yield fn, params, quals, tokens[bisect.bisect_left(places, lo) : bisect.bisect_left(places, hi)]


# What asks whether a value is in a list, and what leaves a function or a round.
_MEMBERS = frozenset("contains containsKey has includes in_array include? matches isMember".split())
_EXITS = frozenset("return throw raise exit die abort continue break panic".split())


def _guard(tokens: list, at: int, ext: str) -> tuple[int, list[str]]:
    """(index, names): from there on, the names that the `if` at `at` has checked are clean.

    Two shapes count: a value that is not in a list of allowed ones leaves, and
    a value over a constant becomes that constant.
    """
    n = len(tokens)
    if ext in ("py", "rb"):
        line = tokens[at][3]
        colon = next((k for k in range(at + 1, n) if tokens[k][2] in (":", "then") or tokens[k][3] != line), n)
        cond = tokens[at + 1 : colon]
        begin = colon + 1 if colon < n and tokens[colon][2] in (":", "then") else colon
        end = next((k for k in range(begin, n) if tokens[k][3] != tokens[begin][3]), n) if begin < n else n
    else:
        if at + 1 >= n:
            return n, []
        if tokens[at + 1][2] == "(":
            close = _closing(tokens, at + 1, "(", ")")
            cond, begin = tokens[at + 2 : close], close + 1
        else:
            begin = next((k for k in range(at + 1, n) if tokens[k][2] == "{"), n)
            cond = tokens[at + 1 : begin]
        if begin < n and tokens[begin][2] == "{":
            end, begin = _closing(tokens, begin, "{", "}"), begin + 1
        else:
            end = next((k for k in range(begin, n) if tokens[k][2] == ";"), n)
    body = tokens[begin:end]
    words = [t[2] for t in cond]
    names = [t[2] for t in cond if t[1] == "identifier"]
    negated = words[:1] in (["!"], ["not"]) or any(a == "not" and b == "in" for a, b in zip(words, words[1:], strict=False))
    if negated and (_MEMBERS.intersection(words) or "in" in words) and body and body[0][2] in _EXITS and "||" not in words and "or" not in words:
        return end, names
    if len(cond) == 3 and words[1] in (">", ">=") and len(body) >= 3 and body[0][2] == words[0] and body[1][2] == "=" and body[2][2] == words[2] and (cond[2][1] == "number" or words[2].isupper()):
        return end, names[:1]
    return end, []


def walk(text: str, ext: str, sources: set[str], sinks: dict[str, tuple[str, int]], tainting: set[str], seeds: dict[str, list[int]] | None = None, writes: dict[str, list[int]] | None = None, cleaners: frozenset = frozenset()):
    """(fn, line, category, severity, path) of values that reach a sink, in one pass over each body.

    Parameters begin tainted (only the given indices where call sites are
    known).  An assignment from a tainted value extends its path; a clean plain
    one ends it; calls of sanitizers are clean.  What stands inside a sink's
    arguments is not visited again.  A sink is (category, severity[, argument]):
    only a tainted value in that argument counts (ANY: in one of them; ALWAYS:
    the call itself).  writes tells which parameters a function writes tainted
    data into: variables that are given there are tainted from then on.  What a
    guard has checked (`_guard`) is clean behind it; so is the result of a
    function in `cleaners`.  In Java, Kotlin and C# a field that one method
    taints is tainted in all.  In C and its kin, constant writes over a buffer's
    end are reported too.
    """
    writes = WRITES | (writes or {})
    bodies = list(_bodies(text, ext))
    fields: set[str] = set()
    given = (ext, sources, sinks, tainting, seeds, writes, cleaners)
    if ext in _FIELDS:  # what one method stores in a field, another one finds there
        for _ in bodies:
            found: set[str] = set()
            for body in bodies:
                list(_follow(body, *given, fields, found))
            if found <= fields:
                break
            fields |= found
    names = buffers.constants(text) if ext in buffers.FAMILY else {}
    for body in bodies:
        for row in _follow(body, *given, fields, set()):
            yield body[0], *row
        if ext in buffers.FAMILY:
            for line, _, _ in buffers.overflows(body[3], names):
                yield body[0], line, "Buffer Overflow", 2, []


def _follow(body: tuple, ext: str, sources: set[str], sinks: dict, tainting: set[str], seeds: dict | None, writes: dict, cleaners: frozenset, fields: set[str], stored: set[str]):
    """(line, category, severity, path) of one body; `stored` gains the fields that it taints."""
    fn, params, _, tokens = body
    live = {p for i, p in enumerate(params) if p not in ("self", "cls") and (seeds is None or fn not in seeds or i in seeds[fn])}
    tainted = {f: ["this", f] for f in fields} | {p: [p] for p in live}
    ever = dict(tainted)

    def of(part: list, tainted=tainted) -> list[str] | None:
        i = 0
        while i < len(part):
            if part[i][1] == "identifier":
                name, _ = _chain(part, i)
                called = i + 1 < len(part) and part[i + 1][2] == "("
                if called and (_is_clean(part[i][2]) or part[i][2] in cleaners):
                    i = _closing(part, i + 1, "(", ")")
                elif name in sources or part[i][2] in sources:
                    return [name]
                elif called and part[i][2] in tainting:
                    return [f"{part[i][2]}()"]
                elif not called and part[i][2] in tainted:
                    return tainted[part[i][2]]
            i += 1
        return None

    i, clean = 0, {}
    while i < len(tokens):
        t = tokens[i]
        for at in [k for k in clean if k <= i]:
            for checked in clean.pop(at):
                tainted.pop(checked, None)
        if t[2] in ("if", "unless"):
            at, checked = _guard(tokens, i, ext)
            if checked:
                clean.setdefault(at, []).extend(checked)
        if t[1] == "identifier" and i + 1 < len(tokens) and tokens[i + 1][2] == "(":
            name, _ = _chain(tokens, i)
            if t[2] in writes:
                parts = _arguments(tokens[i + 2 : _closing(tokens, i + 1, "(", ")")])
                for k in writes[t[2]]:
                    for x in parts[k:] if k == writes[t[2]][-1] and t[2].endswith("scanf") else parts[k : k + 1]:
                        given = next((y[2] for y in x if y[1] == "identifier"), None)
                        if given:
                            tainted[given] = [f"{t[2]}()", given]
                            ever.setdefault(given, tainted[given])
            rule = next((sinks[k] for k in (name, ".".join(name.split(".")[-2:]), t[2]) if k in sinks), None)
            if rule and t[2] not in params:
                close = _closing(tokens, i + 1, "(", ")")
                argument = rule[2] if len(rule) > 2 else ANY
                given = tokens[i + 2 : close]
                if argument >= 0:
                    parts = _arguments(given)
                    given = parts[argument] if argument < len(parts) else []
                # A list of arguments never meets a shell, unless it is asked for.
                listed = ext == "py" and name.startswith("subprocess.") and given[:1] and given[0][2] == "[" and "shell=True" not in "".join(x[2] for x in tokens[i + 2 : close])
                path = None if listed else of(given)
                if path or argument == ALWAYS:
                    yield t[3], rule[0], rule[1], path or []
                i = close + 1
                continue
        elif t[1] == "identifier" and i + 1 < len(tokens) and tokens[i + 1][2] in _ASSIGN:
            end = i + 2
            while end < len(tokens) and tokens[end][2] != ";" and (tokens[end][3] == t[3] or ext not in ("py", "rb", "go", "kt", "swift")):
                end += 1
            path = of(tokens[i + 2 : end])
            if path:
                tainted[t[2]] = [*path, t[2]]
                if i >= 2 and tokens[i - 2][2] == "this" and tokens[i - 1][2] == ".":
                    stored.add(t[2])
                ever.setdefault(t[2], tainted[t[2]])
            elif tokens[i + 1][2] in ("=", ":="):
                tainted.pop(t[2], None)
        i += 1
    for line, category, severity, path in outputs(tokens, ext, ever, sources):
        yield line, category, severity, path


# Calls whose result is safe in HTML, receivers that are outputs, constructs of PHP that write or include,
# calls that end a flow there, and marks of a function that includes from a list.
_ESCAPES = frozenset("esc escape escapeHtml escapeHtml3 escapeHtml4 escapeEcmaScript escapeEcmaScript4 EscapeUtils StringEscapeUtils encodeURI encodeURIComponent HtmlUtils html_escape html_escape_once strip_tags sanitize h HtmlEncode HtmlAttributeEncode UrlEncode UrlPathEncode JavaScriptStringEncode HtmlString WriteLiteral".split())
_OUTPUTS = frozenset("res response resp reply ctx out stdout document console writer".split())
_PHP_OUTPUT = {
    "echo": "XSS (HTML Injection)", "print": "XSS (HTML Injection)", "include": "Path Traversal (File Inclusion)", "include_once": "Path Traversal (File Inclusion)",
    "require": "Path Traversal (File Inclusion)", "require_once": "Path Traversal (File Inclusion)",
}
_PHP_BARRIERS = frozenset("htmlspecialchars htmlentities urlencode rawurlencode escapeshellarg intval system shell_exec exec passthru proc_open".split())
_PHP_LISTS = ("VIEW_DIR", "VIEWS", "in_array")
_TEMPLATES = frozenset("render_template_string from_string render_template get_template Template".split())
_FIELDS = ("java", "kt", "cs")
_BY_LINE = ("py", "rb", "go", "kt", "swift")


def _statements(tokens: list, ext: str):
    """The statements of a body: up to `;`, or to the end of a line where the language ends them so."""
    part: list = []
    for t in tokens:
        if part and (ext in _BY_LINE and t[3] != part[-1][3] and part[-1][2] not in ("+", ",", "(")):
            yield part
            part = []
        if t[2] in (";", "{", "}"):
            if part:
                yield part
            part = []
        else:
            part.append(t)
    if part:
        yield part


def _value(part: list) -> list:
    """What a statement assigns, or all of it."""
    depth = start = 0
    for i, t in enumerate(part):
        depth += (t[2] in ("(", "[")) - (t[2] in (")", "]"))
        if depth == 0 and t[2] in ("=", "+=", "-=", ":=", "??="):
            start = i + 1
    return part[start:]


def _outside(part: list, calls: frozenset):
    """(index, token) of what does not stand in the arguments of `calls`."""
    i = 0
    while i < len(part):
        if part[i][1] == "identifier" and part[i][2] in calls and i + 1 < len(part) and part[i + 1][2] == "(":
            i = _closing(part, i + 1, "(", ")")
        else:
            yield i, part[i]
        i += 1


def outputs(tokens: list, ext: str, tainted: dict[str, list[str]], known: set[str]):
    """(line, category, severity, path) of tainted values that become markup, commands of a database, or output of PHP.

    known holds the sources: in PHP and Swift a bare parameter may be a
    constant of every caller, so only flows that begin at a source count.
    """
    php, script = ext in ("php", "phtml", "inc"), ext in ("js", "jsx", "ts", "tsx")
    rooted = lambda path: path if not (php or ext == "swift") or path[0].split(".")[0] in known or path[0] in known or path[0].endswith("()") else None
    templates = ext == "py" and any(t[2] in _TEMPLATES for t in tokens)
    listed = php and any(t[2] in _PHP_LISTS or t[2].lstrip("$") in _PHP_LISTS for t in tokens)
    told = set()

    def first(part: list, calls: frozenset, plain: bool = True):
        for i, t in _outside(part, calls):
            path = [t[2]] if php and t[2] in known else tainted.get(t[2]) if t[1] == "identifier" else None
            if not path or not rooted(path):
                continue
            if i + 1 < len(part) and part[i + 1][2] in (".", "->") and not php and not (script and t[2].lower() not in _OUTPUTS):
                continue
            if script and len(path) == 1 and not plain:
                continue
            return path
        return None

    for part in _statements(tokens, ext):
        for i, t in enumerate(part[:-1]):
            if t[2] == "CommandText" and i and part[i - 1][2] == "." and part[i + 1][2] == "=" and ("sql", t[3]) not in told:
                path = first(part[i + 2 :], frozenset())
                if path:
                    told.add(("sql", t[3]))
                    yield t[3], "SQL Injection", 2, path
        if php and part[0][2] in _PHP_OUTPUT and (len(part) < 2 or part[1][2] != "("):
            category = _PHP_OUTPUT[part[0][2]]
            path = None if listed and category.startswith("Path") else first(part[1:], _PHP_BARRIERS)
            if path and ("out", part[0][3]) not in told:
                told |= {("out", part[0][3]), ("html", part[0][3])}
                yield part[0][3], category, 2, path
            continue
        markup = [t for t in part if t[1] == "string" and "<" in t[2] and ">" in t[2]]
        if not markup or templates:
            continue
        value = _value(part)
        if ext == "py":
            inside = [m for t in markup for m in re.findall(r"\{\s*([A-Za-z_]\w*)", t[2])]
            path = next((tainted[m] for m in inside if m in tainted), None)
        else:
            signs = {t[2] for t in value}
            joined = "+" in signs or php and "." in signs or ext == "swift" and any("\\(" in t[2] for t in markup) or ext == "rb" and "<<" in signs
            path = first(value, _ESCAPES, plain=part[0][2] != "return") if joined else None
        line = markup[0][3]
        if path and ("html", line) not in told:
            told.add(("html", line))
            yield line, "XSS (HTML Injection)", 2, path


def _arguments(tokens: list) -> list[list]:
    """The parts of an argument list between its own commas."""
    out, depth = [[]], 0
    for t in tokens:
        if t[2] == "," and depth == 0:
            out.append([])
        else:
            depth += (t[2] in "([{") - (t[2] in ")]}")
            out[-1].append(t)
    return out if out != [[]] else []


def _rest(tokens: list, at: int, line: int) -> list:
    """The tokens of a line from `at` on."""
    end = at
    while end < len(tokens) and tokens[end][3] == line:
        end += 1
    return tokens[at:end]


def _cleans(tokens: list, params: list[str], ext: str) -> bool:
    """Whether a body's shape is that of a check: what it returns is capped by a constant, or it returns null for what is not allowed."""
    capped, rejects, returned = set(), False, []
    for i, t in enumerate(tokens):
        if t[2] == "if":
            end, names = _guard(tokens, i, ext)
            if names:
                inside = [x[2] for x in tokens[i:end]]
                if any(a == "return" and b in ("null", "nil", "None", "NULL") for a, b in zip(inside, inside[1:], strict=False)):
                    rejects |= any(x in params for x in names)
                elif "return" not in inside:
                    capped.add(names[0])
        elif t[2] == "return" and i + 1 < len(tokens):
            returned.append(tokens[i + 1][2])
    last = returned[-1] if returned else ""
    return last in capped or rejects and last in params


def facts(text: str, ext: str, sources: set[str]):
    """(kind, fn, name) facts of each function.

    defined: it is defined here; call: it calls name; source: its result can come from a source;
    pass_through: from a parameter; returns_call: from a call of name;
    param_seed: somebody passes a tainted value as parameter number `name`;
    write_through: it writes one into parameter number `name`; static;
    sanitizer.
    """
    for fn, params, quals, tokens in _bodies(text, ext):
        yield "defined", fn, fn
        if _is_clean(fn):
            yield "sanitizer", fn, fn
        if "static" in quals:
            yield "static", fn, fn
        if _cleans(tokens, params, ext):
            yield "cleaner", fn, fn
        tainted = set(params)
        # Of each line, the last token that ends a source, that has a name, and that has a tainted name.
        source = {t[3]: i for i, t in enumerate(tokens) if _chain(tokens, i)[0] in sources}
        last: dict[str, dict[int, int]] = {}
        for i, t in enumerate(tokens):
            last.setdefault(t[2], {})[t[3]] = i
        far: dict[int, int] = {}
        for p in tainted:
            for n, k in last.get(p, {}).items():
                far[n] = max(far.get(n, -1), k)
        for i, t in enumerate(tokens):
            if t[1] == "identifier" and i + 1 < len(tokens) and tokens[i + 1][2] == "(":
                yield "call", fn, t[2]
                for n, part in enumerate(_arguments(tokens[i + 2 : _closing(tokens, i + 1, "(", ")")])):
                    if any(x[1] == "identifier" and (_chain(part, k)[0] in sources or x[2] in tainted and x[2] not in params) for k, x in enumerate(part)):
                        yield "param_seed", t[2], str(n)
            if t[2] in params and i + 1 < len(tokens) and (tokens[i + 1][2] in ("[", "->") or i and tokens[i - 1][2] == "*"):
                k = _closing(tokens, i + 1, "[", "]") + 1 if tokens[i + 1][2] == "[" else i + 3 if tokens[i + 1][2] == "->" else i + 1
                right = _rest(tokens, k + 1, t[3]) if k < len(tokens) and tokens[k][2] == "=" else []
                if any(_chain(right, n)[0] in sources or x[2] in tainted and x[2] not in params for n, x in enumerate(right) if x[1] == "identifier"):
                    yield "write_through", fn, str(params.index(t[2]))
            assigned = t[1] == "identifier" and i + 1 < len(tokens) and tokens[i + 1][2] in _ASSIGN
            line = _rest(tokens, i + 1, t[3]) if t[2] == "return" else []
            if assigned and max(source.get(t[3], -1), far.get(t[3], -1)) > i and t[2] not in tainted:
                tainted.add(t[2])
                for n, k in last[t[2]].items():
                    far[n] = max(far.get(n, -1), k)
            if t[2] == "return":
                names = {x[2] for x in line if x[1] == "identifier"}
                chains = {_chain(tokens, i + 1 + k)[0] for k, x in enumerate(line) if x[1] == "identifier"}
                if (chains | names) & sources or (names & tainted) - set(params):
                    yield "source", fn, fn
                elif names & tainted:
                    yield "pass_through", fn, fn
                for k, x in enumerate(line):
                    if x[1] == "identifier" and k + 1 < len(line) and line[k + 1][2] == "(":
                        yield "returns_call", fn, x[2]


def all_facts(files: DataFrame, sources: list[str]) -> DataFrame:
    """(path, kind, fn, name) of files(path, ext, content)."""
    names = frozenset(sources)
    return per_file(files, ["path"], ["content", "ext"], lambda content, ext: dict.fromkeys(facts(content or "", ext or "", names)), "kind string, fn string, name string")


def parameter_facts(found: DataFrame, kind: str = "param_seed") -> DataFrame:
    """(path, fn, indices): parameters that a project's facts name; path is null where they hold everywhere.

    Facts about a static function stay in its file; the others are united over
    all files.
    """
    static = found.where("kind = 'static'").select("path", "fn").distinct().withColumn("_static", F.lit(True))
    joined = found.where(F.col("kind") == kind).join(static, ["path", "fn"], "left")
    place = F.when(F.col("_static"), F.col("path")).alias("path")
    return joined.groupBy(place, "fn").agg(F.sort_array(F.collect_set(F.col("name").cast("int"))).alias("indices"))


def tainting_functions(found: DataFrame, rounds: int = 10) -> DataFrame:
    """(name, round): functions of the project whose result is tainted; sanitizers never are."""
    calls = found.where("kind = 'returns_call'").select(F.col("fn").alias("caller"), F.col("name").alias("callee"))
    return fixpoint(calls, found.where("kind = 'source'").select(F.col("fn").alias("name")), rounds, found.where("kind = 'sanitizer'").select(F.col("fn").alias("name")))


def sinks_of(table: list[tuple], ext: str) -> dict:
    """{key: (category, severity, argument)} of a table (key, category, severity, argument, extensions) for one language.

    A rule for the language beats one for all; of equals the first counts.
    """
    out: dict = {}
    for own in (True, False):
        for key, category, severity, argument, exts in table:
            if key not in out and (exts is not None and ext in exts if own else exts is None):
                out[key] = (category, severity, argument)
    return out


def scan(files: DataFrame, sources: list[str], sinks: list[tuple[str, str, int]], tainting: DataFrame | list[str] | None = None, seeds: DataFrame | None = None, most: int = MOST, writes: DataFrame | None = None, cleaners: DataFrame | None = None) -> DataFrame:
    """(path, function, line, category, severity, taint_path) of files(path, ext, content) of at most `most` characters.

    sinks are (key, category, severity[, argument, extensions]); see `tables`.
    tainting has (path, name): the project's functions whose result is tainted
    and that the file calls; seeds has (path, fn, indices): parameters that the
    call sites of a function taint; writes has (path, fn, indices): parameters
    that functions which the file calls write into; cleaners (path, name):
    functions it calls whose result is checked.  All reach a file by a join on its path, so
    nothing of the project is repeated in every row or held by the driver.
    """
    table = [(*r, *(ANY, None)[len(r) - 3 :]) for r in sinks]
    names = frozenset(sources)
    read = files.where(F.length("content") <= most).select("path", "ext", "content")
    if tainting is None or isinstance(tainting, (list, tuple)):  # a few names that the caller gives
        read = read.withColumn("_t", F.array(*map(F.lit, tainting or ())).cast("array<string>"))
    else:
        read = read.join(tainting.groupBy("path").agg(F.collect_set("name").alias("_t")), "path", "left")
    if seeds is None:
        read = read.withColumn("_s", F.lit(None).cast("array<struct<fn:string,indices:array<int>>>"))
    else:
        read = read.join(seeds.groupBy("path").agg(F.collect_list(F.struct("fn", "indices")).alias("_s")), "path", "left")

    if writes is None:
        read = read.withColumn("_w", F.lit(None).cast("array<struct<fn:string,indices:array<int>>>"))
    else:
        read = read.join(writes.groupBy("path").agg(F.collect_list(F.struct("fn", "indices")).alias("_w")), "path", "left")

    if cleaners is None:
        read = read.withColumn("_k", F.array().cast("array<string>"))
    else:
        read = read.join(cleaners.groupBy("path").agg(F.collect_set("name").alias("_k")), "path", "left")

    def make(content, ext, tainted, seeded, written, checked):
        known = None if seeded is None else {x["fn"]: x["indices"] for x in seeded}
        return walk(content or "", ext or "", names, sinks_of(table, ext or ""), set(tainted or ()), known, {x["fn"]: x["indices"] for x in written or ()}, frozenset(checked or ()))

    return per_file(read, ["path"], ["content", "ext", "_t", "_s", "_w", "_k"], make, "function string, line int, category string, severity int, taint_path array<string>")


def project(files: DataFrame, sources: list[str], sinks: list[tuple[str, str, int]], most: int = MOST) -> DataFrame:
    """The findings of `scan`, with what the project's facts say.

    Facts are staged once.  A function whose result is tainted somewhere (the
    fixpoint over calls) taints where it is called; a function with known call
    sites begins with the parameters that these taint, others with all.
    """
    found = cut(all_facts(files.where(F.length("content") <= most), sources), "facts")
    tainted = tainting_functions(found)
    called = found.where("kind = 'call'").select("path", "name").distinct()
    into = parameter_facts(found, "write_through").where("path is null").select(F.col("fn").alias("name"), "indices")
    clean = called.join(found.where("kind = 'cleaner'").select("name").distinct(), "name").select("path", "name")
    written = called.join(into, "name").select("path", F.col("name").alias("fn"), "indices")
    return scan(files, sources, sinks, called.join(tainted.select("name"), "name").select("path", "name"), parameter_seeds(found), most, written, clean)


def parameter_seeds(found: DataFrame) -> DataFrame:
    """(path, fn, indices): of each function that a file of the project calls, the parameters that some call taints.

    The rows are those of the files that define the function: `defined` facts
    tell where.  Functions that nothing calls are not in the result.
    """
    called = found.where("kind = 'call'").select(F.col("name").alias("fn")).distinct()
    everywhere = parameter_facts(found).where("path is null").select("fn", "indices")
    here = parameter_facts(found).where("path is not null").select("path", "fn", F.col("indices").alias("_own"))
    defined = found.where("kind = 'defined'").select("path", "fn").distinct().join(called, "fn")
    joined = defined.join(everywhere, "fn", "left").join(here, ["path", "fn"], "left")
    none = F.array().cast("array<int>")
    return joined.select("path", "fn", F.array_union(F.coalesce("indices", none), F.coalesce("_own", none)).alias("indices"))
