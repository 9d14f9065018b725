"""Lexing and function extraction, one file at a time."""

from __future__ import annotations

import bisect
import re

from pyspark.sql import DataFrame

from siftstone.operators.perfile import per_file

# Words that are no call or function name.
KEYWORDS = frozenset(
    "if else for while do switch case default break continue return goto try catch finally throw throws new delete sizeof typeof instanceof in is as "
    "func function def fn fun class struct enum union interface trait impl namespace package import include using public private protected static final "
    "const let var val void int long short char float double bool boolean unsigned signed string self this super nil null true false and or not elif except raise with yield await async guard when match unless until end begin".split()
)

_HASH_COMMENTS = ("py", "rb", "sh", "pl", "php")
_COMMON = r"""
  (?P<space>[ \t\r\f\v]+)|(?P<newline>\n)
 |(?P<comment>/\*(?:[^*]|\*(?!/))*(?:\*/)?|//[^\n]*{hash})
 |(?P<string>{triple}"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)
 |(?P<number>0[xX][0-9a-fA-F_]+[uUlL]*|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?\w*)
 |(?P<identifier>[^\W\d]\w*|[$@]\w+)
 |(?P<symbol>>>>=|<<=|>>=|===|!==|\.\.\.|->|=>|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|:=|\?\?|.)
"""


def _lexer(hashes: bool, triples: bool) -> re.Pattern:
    return re.compile(_COMMON.format(hash=r"|\#[^\n]*" if hashes else "", triple=r"\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|" if triples else ""), re.X | re.S)


_LEXERS = {(h, t): _lexer(h, t) for h in (False, True) for t in (False, True)}


def php_code(text: str) -> str:
    """The text with all outside `<?php ... ?>` blanked and `<?=` as `echo`; lines stay where they are.

    `echo` takes the place of the mark and of blanks before it, if there are
    any on its line; else what follows on the line moves by two characters.
    """
    out: list[str] = []
    at = 0
    for m in re.finditer(r"(?is)<\?(?:php\b|=)(.*?)(?:\?>|\Z)", text):
        blank = re.sub(r"[^\n]", " ", text[at : m.start(1)])
        if text.startswith("<?=", m.start()):
            blank = (blank[:-5] if len(blank) > 4 and "\n" not in blank[-5:] else blank[:-3]) + "echo "
            out += [blank, m[1], ";"]
            at = min(m.end(1) + 1, len(text))
        else:
            out += [blank, m[1]]
            at = m.end(1)
    return "".join(out) + re.sub(r"[^\n]", " ", text[at:])


def tokenize(text: str, ext: str = "c"):
    """(idx, kind, text, line, col, off): identifiers, keywords, numbers, strings and symbols; comments are left out."""
    if ext == "php":
        text = php_code(text)
    line, begin, idx = 1, 0, 0
    for m in _LEXERS[ext in _HASH_COMMENTS, ext == "py"].finditer(text):
        kind, value = m.lastgroup, m[0]
        if kind not in ("space", "newline", "comment"):
            if kind == "identifier" and value in KEYWORDS:
                kind = "keyword"
            yield idx, kind, value, line, m.start() - begin + 1, m.start()
            idx += 1
        if lines := value.count("\n"):
            line += lines
            begin = m.start() + value.rindex("\n") + 1


def comment_spans(text: str, ext: str = "c") -> list[tuple[int, int]]:
    """(first character, end) of each comment."""
    found = _LEXERS[ext in _HASH_COMMENTS, ext == "py"].finditer(php_code(text) if ext == "php" else text)
    return [m.span() for m in found if m.lastgroup == "comment"]


def _closing(tokens: list, at: int, open_: str, close: str) -> int:
    depth = 0
    for i in range(at, len(tokens)):
        t = tokens[i][2]
        depth += (t == open_) - (t == close)
        if depth == 0:
            return i
    return len(tokens) - 1


def _parameters(tokens: list) -> list[str]:
    """Names of a parameter list: the last identifier of each part before a colon, or its first if a colon follows."""
    out, part, depth = [], [], 0
    for t in [*tokens, (0, "symbol", ",", 0, 0, 0)]:
        if t[2] == "," and depth == 0:
            head = [x for x in part if x[1] == "identifier"]
            cut = next((i for i, x in enumerate(part) if x[2] in (":", "=")), None)
            if cut is not None and part[cut][2] == ":":
                head = [x for x in part[:cut] if x[1] == "identifier"]
            elif cut is not None:
                head = [x for x in part[:cut] if x[1] == "identifier"]
            if head:
                out.append(head[-1][2])
            part = []
        else:
            depth += (t[2] in "([{<") - (t[2] in ")]}>")
            part.append(t)
    return out


def _bracket(text: str, at: int) -> int:
    """Where the bracket at `at` closes; strings and comments of Python and Ruby are passed over."""
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c in "\"'":
            mark = text[i : i + 3] if text[i : i + 3] in ('"""', "'''") else c
            i += len(mark)
            while i < len(text) and not text.startswith(mark, i):
                i += 2 if text[i] == "\\" else 1
            i += len(mark) - 1
        elif c == "#":
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
            continue
        else:
            depth += (c in "([{") - (c in ")]}")
            if depth == 0:
                return i
        i += 1
    return len(text) - 1


_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?def[ \t]+(?:self\.)?(\w+[?!]?)[ \t]*(\(?)([^\n]*)", re.M)


def _blocks(text: str, ext: str):
    """Functions whose body is an indented or `end`-closed block; parameters may stand on several lines."""
    lines = text.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    for m in _DEF.finditer(text):
        if m[3]:
            close = _bracket(text, m.start(3))
            names = _parameters(list(tokenize(text[m.end(3) : close], ext)))
        else:
            close = m.start(4)
            names = _parameters(list(tokenize(m[4], ext))) if ext == "rb" else []
        first = text.count("\n", 0, m.start())
        j = head = text.count("\n", 0, close)
        indent = len(m[1].expandtabs())
        j += 1
        while j < len(lines) and (not lines[j].strip() or len(lines[j].expandtabs()) - len(lines[j].expandtabs().lstrip()) > indent):
            j += 1
        if ext == "rb" and j < len(lines) and lines[j].strip() == "end":
            j += 1
        # A body on the line of its header begins after the colon.
        colon = re.compile(r"[^\n:]*:[ \t]*(?=[^\s#])").match(text, close + 1) if ext == "py" else None
        lo = colon.end() if colon else starts[head] + len(lines[head])
        yield m[2], first + 1, starts[first], lo, lo, min(starts[min(j, len(lines))], len(text)), names, []


# Names before a parenthesis and a brace that define nothing.
_NO_FUNCTION = frozenset("foreach synchronized lock fixed elseif using with unsafe autoreleasepool".split())
_SCRIPTS = ("js", "jsx", "ts", "tsx", "mjs", "vue")
_STOPS = frozenset([";", "=", ")", "]", "}", "=>", ".", "+", "-", "/", "%", "&&", "||", "==", "!=", "<=", ">=", "|", "^", "??", "<<", ">>", "+=", "-="])


def _angle(tokens: list, at: int) -> int:
    """The token that closes the generic arguments opened at `at`, or -1 if it opens none."""
    depth = 0
    for i in range(at, len(tokens)):
        t = tokens[i][2]
        if t in (";", "{", "}", "&&", "||"):
            return -1
        depth += (t == "<") - (t == ">") - 2 * (t == ">>") - 3 * (t == ">>>")
        if depth <= 0:
            return i
    return -1


def _body(tokens: list, at: int) -> int:
    """The brace that opens the body of the function whose parameter list ends before `at`; -1: no definition.

    Between them may stand: throws and where clauses, results (bracketed,
    generic, after a colon or an arrow), qualifiers, and the initialisers of a
    constructor.
    """
    i, listed, colon = at, False, False
    while i < len(tokens):
        t, kind = tokens[i][2], tokens[i][1]
        if t == "{":
            # `name{...}` after a colon initialises a member, unless it is the body.
            if colon and tokens[i - 1][1] == "identifier":
                end = _closing(tokens, i, "{", "}")
                if end + 1 < len(tokens) and tokens[end + 1][2] in (",", "{"):
                    i = end + 1
                    continue
            return i
        if t in _STOPS or kind in ("string", "number"):
            return -1
        if t == "," and not listed:
            return -1
        if t == "(":
            i = _closing(tokens, i, "(", ")")
        elif t == "[":
            i = _closing(tokens, i, "[", "]")
        elif t == "<":
            i = _angle(tokens, i)
            if i < 0:
                return -1
        elif t in ("throws", "throw", "where", "noexcept"):
            listed = True
        elif t == ":":
            listed = colon = True
        elif kind == "keyword" and t in ("if", "for", "while", "switch", "return", "case", "else", "do", "new", "function"):
            return -1
        i += 1
    return -1


def _arrow(tokens: list, i: int):
    """(parameters, brace) of `name = function (...) {`, `name = (...) => {` and `name = x => {` at the token after `name`."""
    k = i + 1
    if k < len(tokens) and tokens[k][2] == "async":
        k += 1
    if k < len(tokens) and tokens[k][2] == "function":
        k += 2 if k + 1 < len(tokens) and tokens[k + 1][1] == "identifier" else 1
        if k < len(tokens) and tokens[k][2] == "(":
            close = _closing(tokens, k, "(", ")")
            return (tokens[k + 1 : close], close + 1) if close + 1 < len(tokens) and tokens[close + 1][2] == "{" else None
        return None
    if k < len(tokens) and tokens[k][2] == "(":
        close = _closing(tokens, k, "(", ")")
        j = close + 1
        while j < len(tokens) and tokens[j][2] not in ("=>", ";", "{", ")", ",", "="):
            j += 1
        part = tokens[k + 1 : close]
    else:
        j, part = k + 1, tokens[k : k + 1]
    return (part, j + 1) if j + 1 < len(tokens) and tokens[j][2] == "=>" and tokens[j + 1][2] == "{" else None


def _braced(tokens: list, ext: str):
    """(name token, first token of the signature, parameters, opening brace, closing brace) of each definition."""
    i = 0
    while i < len(tokens) - 1:
        t, after = tokens[i], tokens[i + 1][2]
        if t[1] == "identifier" and t[2] not in _NO_FUNCTION:
            opened, part = -1, []
            start = i + 1
            if after == "<" and ext not in ("c", "m"):
                end = _angle(tokens, i + 1)
                start = end + 1 if end > 0 else start
            before = tokens[i - 1][2] if i else ""
            if start < len(tokens) and tokens[start][2] == "(":
                # A method may stand after a comma in an object of JavaScript.
                if before not in (".", "->", "=", "(", "return", "new", "!", "&&", "||", "throw", "await", ":") and (before != "," or ext in _SCRIPTS):
                    close = _closing(tokens, start, "(", ")")
                    opened, part = _body(tokens, close + 1), tokens[start + 1 : close]
                    if ext == "go" and before == ")":  # a method: its receiver is its first parameter
                        part = _receiver(tokens, i - 1) + part
            elif after in ("=", ":") and ext in _SCRIPTS:
                found = _arrow(tokens, i + 1)
                if found:
                    part, opened = found
            if opened >= 0:
                k = i
                while k and tokens[k - 1][2] not in (";", "}", "{"):
                    k -= 1
                yield i, k, part, opened, _closing(tokens, opened, "{", "}")
                i = opened
        i += 1


def _receiver(tokens: list, close: int) -> list:
    i = close
    while i and tokens[i][2] != "(":
        i -= 1
    return [*tokens[i + 1 : close], (0, "symbol", ",", 0, 0, 0)] if i and tokens[i - 1][2] == "func" else []


def functions(text: str, ext: str = "c", tokens: list | None = None):
    """(fn, line, sig_lo, sig_hi, lo, hi, params, quals) of each definition, by braces or by indentation."""
    if ext in ("py", "rb"):
        yield from _blocks(text, ext)
        return
    tokens = list(tokenize(text, ext)) if tokens is None else tokens
    for i, k, part, opened, closed in _braced(tokens, ext):
        quals = [t[2] for t in tokens[k:i] if t[1] == "keyword"]
        names = _go_parameters(part) if ext == "go" else _parameters(part)
        yield tokens[i][2], tokens[i][3], tokens[k][5], tokens[opened][5], tokens[opened][5], tokens[closed][5] + 1, names, quals


def _go_parameters(tokens: list) -> list[str]:
    """Names of a Go parameter list: the first word of each part."""
    out, first, depth = [], True, 0
    for t in tokens:
        if t[2] == "," and depth == 0:
            first = True
        elif first and t[1] == "identifier":
            out.append(t[2])
            first = False
        depth += (t[2] in "([{") - (t[2] in ")]}")
    return out


def measure(tokens: list, ext: str) -> int:
    """Cyclomatic complexity of a body: one, and for each branch or loop one plus its `&&` and `||`; a switch counts its cases."""
    n = 1
    for i, t in enumerate(tokens):
        if t[2] in ("if", "elif", "while", "for", "foreach", "guard", "unless", "until"):
            stop = {"{", ":", ";", "then"} if ext in ("py", "rb", "swift", "go", "rs") else None
            if stop is None and i + 1 < len(tokens) and tokens[i + 1][2] == "(":
                part = tokens[i + 1 : _closing(tokens, i + 1, "(", ")")]
            else:
                part = []
                for x in tokens[i + 1 :]:
                    if x[2] in (stop or {"{", ";"}) or x[3] > t[3]:
                        break
                    part.append(x)
            n += 1 + sum(x[2] in ("&&", "||", "and", "or") for x in part)
        elif t[2] in ("switch", "when", "match") and ext not in ("py", "rb"):
            opened = next((k for k in range(i, len(tokens)) if tokens[k][2] == "{"), None)
            if opened is not None:
                body = tokens[opened : _closing(tokens, opened, "{", "}")]
                n += max(sum(x[2] == "case" for x in body), 1)
    return n


def complexity(text: str, ext: str = "c") -> int:
    """`measure` of a body's text."""
    return measure(list(tokenize(text, ext)), ext)


def measured(text: str | None, ext: str | None):
    """The rows of `functions`, each with its complexity; the text is lexed once."""
    text, ext = text or "", ext or ""
    tokens = list(tokenize(text, ext))
    places = [t[5] for t in tokens]
    for row in functions(text, ext, tokens):
        yield *row, measure(tokens[bisect.bisect_left(places, row[4]) : bisect.bisect_left(places, row[5])], ext)


def lex(files: DataFrame, keywords: bool = True) -> DataFrame:
    """(path, ext, idx, kind, text, line, col, off) of files(path, ext, content).

    Without `keywords` there are four kinds: identifier, number, string and symbol.
    """

    def make(content, ext):
        for idx, kind, *rest in tokenize(content or "", ext or ""):
            yield idx, kind if keywords or kind != "keyword" else "identifier", *rest

    return per_file(files, ["path", "ext"], ["content", "ext"], make, "idx int, kind string, text string, line int, col int, off int")


# Keywords that name a type.
_TYPES = frozenset("int long short char float double bool boolean unsigned signed string var val let auto".split())


_TYPED = ("c", "h", "cpp", "cc", "cxx", "hpp", "hxx", "hh", "m", "mm", "java", "cs", "csx", "sol")


def declared(text: str | None, ext: str | None):
    """(name, type, at, lo, hi) of declarations: where the name stands, and the range of the braces around it.

    `Type name`, `Type *name` and `Type<...> name` before `=`, `;`, `,`, `)` or
    `[`, and `name: Type` where the language writes types behind names.
    """
    text, ext = text or "", ext or ""
    tokens = list(tokenize(text, ext))
    scopes, stack = {}, []
    for t in tokens:
        if t[2] == "{":
            stack.append(t[5])
        elif t[2] == "}" and stack:
            scopes[stack.pop()] = t[5]
    open_: list[int] = []
    behind = ext in ("kt", "swift", "rs", "ts", "tsx")
    for i, t in enumerate(tokens):
        if t[2] == "{":
            open_.append(t[5])
        elif t[2] == "}" and open_:
            open_.pop()
        if t[1] != "identifier" or i + 1 >= len(tokens):
            continue
        after, of = tokens[i + 1][2], None
        if behind and after == ":" and i + 2 < len(tokens):
            of = tokens[i + 2][2]
        elif ext in _TYPED and i and after in ("=", ";", ",", ")", "["):
            k = i - 1
            while k and tokens[k][2] in ("*", "&", "]", "["):
                k -= 1
            if tokens[k][2] in (">", ">>", ">>>"):
                depth = 0
                while k:
                    depth += len(tokens[k][2]) if tokens[k][2] in (">", ">>", ">>>") else -(tokens[k][2] == "<")
                    k -= 1
                    if depth <= 0:
                        break
            if tokens[k][1] == "identifier" or tokens[k][2] in _TYPES:
                of = tokens[k][2]
        if of:
            lo = open_[-1] if open_ else 0
            yield t[2], of, t[5], lo, scopes.get(lo, len(text)) if open_ else len(text)


def declarations(files: DataFrame) -> DataFrame:
    """(path, name, type, at, lo, hi) of files(path, ext, content); `findings.types_at` joins sites with them."""
    return per_file(files, ["path"], ["content", "ext"], declared, "name string, type string, at int, lo int, hi int")


def extract_functions(files: DataFrame) -> DataFrame:
    """(path, ext, fn, line, sig_lo, sig_hi, lo, hi, params, quals, complexity) of files(path, ext, content)."""
    return per_file(files, ["path", "ext"], ["content", "ext"], measured, "fn string, line int, sig_lo int, sig_hi int, lo int, hi int, params array<string>, quals array<string>, complexity int")


def complexity_summary(functions_: DataFrame) -> DataFrame:
    """One row: functions, integer mean, maximum, and files."""
    from pyspark.sql import functions as F

    return functions_.agg(F.count("*").alias("functions"), F.expr("sum(complexity) div count(*)").alias("mean"), F.max("complexity").alias("highest"), F.countDistinct("path").alias("files"))
