"""Rule tables applied to text: secrets, weak cryptography, sinks and entry APIs."""

from __future__ import annotations

import bisect
import re
import unicodedata
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions.scalars import PLACEHOLDERS, is_placeholder, looks_like_secret
from siftstone.operators.lexing import comment_spans, functions
from siftstone.operators.perfile import per_file
from siftstone.plans.loops import cut

# Fixed values: (pattern, category, severity rank) of secrets whose shape is known.
SECRETS = (
    (r"\bAKIA[0-9A-Z]{16}\b", "Hardcoded AWS Access Key", 3),
    (r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----|\bBEGIN RSA PRIVATE KEY\b", "Hardcoded Private Key", 3),
    (r"""(?i)(api[_-]?key|apikey|secret|password|passwd|pwd|access[_-]?key|client[_-]?secret|auth[_-]?token|bearer[_-]?token|private[_-]?key)[ \t]*[:=][ \t]*["'][^"'\n]{6,}["']""", "Hardcoded Credential", 2),
    (r"(?i)(mysql|postgres|mongodb|redis|amqp|jdbc|smtp)://[^/\s:@]+:[^@\s]+@", "Hardcoded Connection String (with password)", 2),
    (r"\b(?:sk|pk|rk)_live_[0-9A-Za-z]{8,}\b", "Hardcoded Secret Key", 3),
    (r"\bwhsec_[0-9A-Za-z]{16,}\b", "Hardcoded Webhook Secret", 3),
    (r"\bghp_[0-9A-Za-z]{20,}\b", "Hardcoded GitHub Token", 3),
    (r"\bxoxb-[0-9-]{10,}\b", "Hardcoded Slack Token", 2),
    (r"\bAIza[0-9A-Za-z\-_]{20,}\b", "Hardcoded Google API Key", 2),
    (r"""(?i)#\s*define\s+\w*(?:token|secret|password|passwd|pwd|credential|apikey)\w*\s+["'][^"']{8,}["']""", "Hardcoded Credential", 2),
)
# Assignments of passwords, values whose shape is that of a secret, and entries of maps.
PASSWORD = r"""(?i)\b(?:password|pwd|passwd)\s*=\s*(?:"([^"]{4,})"|'([^']{4,})'|([^;"'\s.()\[\]{}<>/\\]{4,}))(?![A-Za-z0-9_])(?!\s*[.:(\[])"""
SHAPED = r"""(?i)\b(?:pass|password|passwd|pwd|secret|token|credential)\w*\s*[,=:]\s*["']([^"'\n]{6,})["']"""
MAPPED = r"""=>\s*["']([^"']{7,})["']"""
# Fixed values: (pattern, category, severity rank, whether case counts) of weak primitives.
WEAK_CRYPTO = (
    (r"""(?<!["'])\b(MD5(?=\s*[.(])|MD5_Init|MD5_Update|MD5_Final|EVP_md5|SHA1(?=\s*[.(])|SHA1_Init|EVP_sha1|EVP_des_ecb|DES_ecb_encrypt|EVP_rc4|DES_cblock)\b""", "Weak Cryptography (MD5 / SHA-1 / DES / RC4)", 2, True),
    (r"""getInstance\s*\(\s*["'](?:(?:MD2|MD4|MD5|MD5-SHA1|SHA-?1|SHA1|DES|DESede|RC2|RC4)(?:/[A-Za-z0-9]+)*|AES/ECB[a-zA-Z/]*|.*/ECB/)[/"']""", "Weak Cryptography (insecure algorithm/block mode)", 2, False),
    (r"""new\s+SecureRandom\s*\(\s*["'][^"']{1,64}["']""", "Weak Cryptography (predictable SecureRandom seed)", 2, True),
)
# Names of XML parsers, and what makes them safe.
XML_PARSERS = ("DocumentBuilderFactory", "SAXParserFactory", "TransformerFactory", "XMLInputFactory", "SchemaFactory", "Unmarshaller", "xmlReadFile", "xmlReadMemory", "xmlParseFile", "xmlParseMemory", "xmlParseDoc")
XML_SAFE = ("FEATURE_SECURE_PROCESSING", "disallow-doctype-decl", "external-general-entities=false", "without-entities", "DtdProcessing.Prohibit", "DtdProcessing.Ignore")
_SECRETS = tuple((re.compile(p), c, s) for p, c, s in SECRETS)
_PASSWORD, _SHAPED, _MAPPED = map(re.compile, (PASSWORD, SHAPED, MAPPED))


def _each(found, category: str, severity: int):
    """A finding for each element of an array."""
    return F.array_repeat(F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity")), F.size(found))


def secret_findings(lines: DataFrame) -> DataFrame:
    """(path, line, category, severity) of secrets in lines(path, line, text).

    The table of patterns has a fixed size and is unrolled into one projection
    over the lines, so no line is shuffled; only hits are exploded.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    php, java = ext == "php", ext == "java"
    text = F.col("text")
    hits = []
    for pattern, category, severity in SECRETS:
        good = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: ~is_placeholder(m) & ~(php & m.contains("$")))
        hits.append(_each(good, category, severity))
    groups = [F.regexp_extract_all(text, F.lit(PASSWORD), F.lit(g)) for g in (1, 2, 3)]
    plain = F.filter(F.arrays_zip(groups[0].alias("a"), groups[1].alias("b"), groups[2].alias("c")), lambda g: ~(java & (g["c"] != "")) & ~is_placeholder(F.concat(g["a"], g["b"], g["c"])) & ~(php & F.concat(g["a"], g["b"], g["c"]).contains("$")))
    hits.append(_each(plain, "Hardcoded Credential", 2))
    hits.append(_each(F.filter(F.regexp_extract_all(text, F.lit(SHAPED), F.lit(1)), looks_like_secret), "Hardcoded Credential", 2))
    mapped = F.filter(F.regexp_extract_all(text, F.lit(MAPPED), F.lit(1)), looks_like_secret)
    hits.append(F.when(php, _each(mapped, "Hardcoded Credential", 2)).otherwise(F.array().cast("array<struct<category:string,severity:int>>")))
    return lines.select("path", "line", F.inline(F.concat(*hits)))


def _found(path: str, text: str):
    """(line, category, severity) of the secrets of one file, in the order of the rules."""
    ext = (re.search(r"\.([^./]+)$", path or "") or [None, ""])[1].lower()
    php, java = ext == "php", ext == "java"
    ends = [m.start() for m in re.finditer("\n", text)]
    held = lambda v: not any(p in v.lower() for p in PLACEHOLDERS) and not (php and "$" in v)
    shaped = lambda v: len(v) >= 7 and any(c.isalpha() for c in v) and any(c.isdecimal() for c in v) and any(not (c.isalnum() or c in "_-. " or unicodedata.category(c)[0] == "M") for c in v)
    at = lambda m: bisect.bisect_left(ends, m.start()) + 1
    for pattern, category, severity in _SECRETS:
        for m in pattern.finditer(text):
            if held(m[0]):
                yield at(m), category, severity
    for m in _PASSWORD.finditer(text):
        if not (java and m[3]) and held(m[1] or m[2] or m[3]):
            yield at(m), "Hardcoded Credential", 2
    for pattern in (_SHAPED, _MAPPED) if php else (_SHAPED,):
        for m in pattern.finditer(text):
            if shaped(m[1]):
                yield at(m), "Hardcoded Credential", 2


def file_secrets(files: DataFrame) -> DataFrame:
    """(path, line, category, severity) of secrets in whole files(path, content): a match may cross a line end."""
    return per_file(files, ["path"], ["path", "content"], lambda path, content: _found(path, content or ""), "line int, category string, severity int")


def long_tokens(lines: DataFrame, length: int = 40) -> DataFrame:
    """Extension: hexadecimal tokens of `length` digits assigned to a name that says token, key or secret."""
    pattern = rf"""(?i)\b(?:token|key|secret)\w*\s*[:=]\s*["']([0-9a-f]{{{length}}})["']"""
    return lines.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("token"))


_WEAK = tuple((re.compile(p, 0 if exact else re.I), c, s) for p, c, s, exact in WEAK_CRYPTO)


def _body_findings(text: str, ext: str):
    """(function, line, category, severity) of weak primitives and open XML parsers in each function of a file."""
    ends = [m.start() for m in re.finditer("\n", text)]
    comments = comment_spans(text, ext)
    line = lambda at: bisect.bisect_left(ends, at) + 1
    for fn, _, _, _, lo, hi, _, _ in functions(text, ext):
        body = text[lo:hi]
        for pattern, category, severity in _WEAK:
            for m in pattern.finditer(body):
                a, b = lo + m.start(), lo + m.end()
                if not any(x <= a and b <= y for x, y in comments):
                    yield fn, line(a), category, severity
        at = [p for p in (body.find(x) for x in XML_PARSERS) if p >= 0]
        if at and not any(x in body for x in XML_SAFE) and "XmlResolver=null" not in body.replace(" ", ""):
            yield fn, line(lo + min(at)), "XXE (XML External Entity)", 2


def body_findings(files: DataFrame) -> DataFrame:
    """(path, function, line, category, severity) of weak cryptography and XML external entities in files(path, ext, content).

    Matches inside comments do not count; an XML parser is reported once a
    function, where its first name stands, unless the body hardens it.
    """
    return per_file(files, ["path"], ["content", "ext"], lambda content, ext: _body_findings(content or "", ext or ""), "function string, line int, category string, severity int")


def shared_state(files: DataFrame) -> DataFrame:
    """(path, name, category): static variables that a file without a lock writes to."""
    names = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\bstatic\s+(?!final\b|const\b)(?:\w+[\s*]+)+(\w+)\s*(?:=[^=]|;)"), F.lit(1))))
    locked = F.col("content").rlike(r"(?i)\b(?:mutex|synchronized|lock_guard|pthread_mutex_lock|dispatch_sync|atomic|Lock)\b")
    found = files.where(~locked).select("path", "content", names.alias("name"))
    writes = F.size(F.regexp_extract_all("content", F.concat(F.lit(r"\b"), F.col("name"), F.lit(r"\s*(?:\+\+|--|[-+*/|&^]?=[^=])")), F.lit(0)))
    return found.where(writes > 1).select("path", "name", F.lit("Race Condition").alias("category"))


def resolved_aliases(aliases: DataFrame, hops: int = 8) -> DataFrame:
    """(name, target): where the chain of each name of aliases(name, target) ends after `hops` steps at most.

    Of a name that several files define, the first target by name counts, so no
    row is ever multiplied; the chain is followed on the alias table alone.
    """
    one = aliases.groupBy("name").agg(F.min("target").alias("target"))
    now, step = cut(one, "aliases"), 1
    while step < hops:  # each round joins the table with itself and doubles the steps
        nxt = now.select(F.col("name").alias("target"), F.col("target").alias("_to"))
        now, step = cut(now.join(nxt, "target", "left").select("name", F.coalesce("_to", "target").alias("target")), "aliases"), 2 * step
    return now


def match_sinks(calls: DataFrame, rules: DataFrame, aliases: DataFrame | None = None, hops: int = 8) -> DataFrame:
    """calls(path, line, lang, chain) with the best of rules(key, category, severity, langs).

    The full dotted chain is tried first, then its last two parts, then the
    bare name; a rule for the language beats one for all.  With aliases(name,
    target), macro names are replaced by what they stand for (a join whose side
    grows with the code and is not broadcast by hand).  The best rule of each
    chain and language is found once, before the calls are read.
    """
    c = calls
    if aliases is not None:
        to = resolved_aliases(aliases, hops).select(F.col("name").alias("chain"), "target")
        c = c.join(to, "chain", "left").withColumn("chain", F.coalesce("target", "chain")).drop("target")
    distinct = c.select("chain", "lang").distinct()
    parts = F.split("chain", r"\.")
    keys = F.array(F.col("chain"), F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "."), F.element_at(parts, -1))
    met = distinct.select("*", F.posexplode(keys).alias("_try", "key")).join(rules, "key").where(F.col("langs").isNull() | F.array_contains("langs", F.col("lang")))
    value = [x for x in rules.columns if x not in ("key", "langs")]
    best = met.groupBy("chain", "lang").agg(F.min(F.struct("_try", F.col("langs").isNull().alias("_any"), *value, "key")).alias("_best"))
    return c.join(best, ["chain", "lang"]).select(*c.columns, *[F.col(f"_best.{x}").alias(x) for x in ("key", *value)])


_PARTS = 6


def entry_sites(tokens: DataFrame, catalog: DataFrame, most: int = 500) -> DataFrame:
    """(path, off, category, origin, confidence) of entry APIs in tokens(path, idx, off, kind, text, lang).

    An identifier that equals the leaf of catalog(leaf, prefix, category,
    origin, confidence, langs) is a site if its receiver is the prefix or ends
    in `.prefix`, and none of the three tokens before declares it.  A receiver
    has up to `_PARTS` names.  The first `most` sites by place are kept (the
    limit is the feature).
    """
    w = Window.partitionBy("path").orderBy("idx")
    near = tokens.withColumns({f"_{k}": F.lag("text", k).over(w) for k in range(1, 2 * _PARTS + 1)} | {"_next": F.lead("text").over(w)})
    declares = F.array("_1", "_2", "_3")
    keyword = F.exists(declares, lambda t: F.coalesce(t.isin("def", "func", "function", "fn", "fun", "class", "struct", "interface", "import"), F.lit(False)))
    receiver, linked = F.lit(""), [F.col(f"_{k}") == "." for k in range(1, 2 * _PARTS, 2)]
    for n in range(_PARTS):  # names behind n + 1 dots in a row
        receiver = F.when(reduce(lambda a, b: a & b, linked[: n + 1]), F.concat_ws(".", *[f"_{k}" for k in range(2 * n + 2, 0, -2)])).otherwise(receiver)
    sites = near.where((F.col("kind") == "identifier") & (F.col("_next") == "(") & ~keyword).withColumn("receiver", receiver)
    met = sites.join(F.broadcast(catalog.withColumnRenamed("leaf", "text")), "text").where(F.col("langs").isNull() | F.array_contains("langs", F.col("lang")))
    prefix = F.coalesce("prefix", F.lit(""))
    good = met.where((F.col("receiver") == prefix) | F.endswith(F.col("receiver"), F.concat(F.lit("."), prefix)))
    return good.orderBy("path", "off").limit(most).select("path", "off", "category", "origin", "confidence")


def sites_by_category(sites: DataFrame) -> DataFrame:
    """(category, group, n) in report order: primary remote, primary local, indirect; then name."""
    group = F.when((F.col("confidence") == "primary") & (F.col("origin") == "remote"), 0).when(F.col("confidence") == "primary", 1).otherwise(2)
    return sites.groupBy("category", group.alias("group")).agg(F.count("*").alias("n")).orderBy("group", "category")


def structural_entries(functions: DataFrame, sites: DataFrame) -> DataFrame:
    """(path, fn, check) of functions(path, fn, signature, body) that look like entries but hold no catalog site.

    sites has (path, fn).  Checks: the signature takes a request, or an event
    and context; a route decorator; a delegate method; a mark of trust.
    """
    s = F.lower("signature")
    check = (
        F.when(s.rlike(r"\b(?:request|req|httprequest|httpservletrequest)\b"), "handler")
        .when(s.rlike(r"\bevent\b.*\bcontext\b"), "handler")
        .when(s.rlike(r"@(?:\w+\.)?(?:route|get|post|put|delete|requestmapping|getmapping|postmapping)\b"), "route")
        .when(s.rlike(r"\bapplication\b.*\b(?:open|continue)\b|\bdelegate\b"), "delegate")
        .when(F.lower("body").rlike(r"\b(?:untrusted|user[_-]?supplied|attacker)\b"), "trust_marker")
    )
    return functions.join(sites.select("path", "fn").distinct(), ["path", "fn"], "left_anti").select("path", "fn", check.alias("check")).where("check is not null")


def macros(lines: DataFrame) -> DataFrame:
    """(path, line, kind, name, value): string macros, identifier aliases and global string constants."""
    t = F.col("text")
    string = r'^\s*#\s*define\s+(\w+)\s+"([^"]*)"'
    alias = r"^\s*#\s*define\s+(\w+)\s+([A-Za-z_]\w*)\s*$"
    constant = r'^(?:static\s+|public\s+|final\s+|const\s+|let\s+|val\s+)*(?:char\s*\*?\s*|String\s+|string\s+)?(?:const\s+)?([A-Z_][A-Z0-9_]*)(?:\[\])?\s*(?::\s*\w+\s*)?=\s*"([^"]*)"'
    pick = lambda p, k: F.when(t.rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract(t, p, 1).alias("name"), F.regexp_extract(t, p, 2).alias("value")))
    return lines.select("path", "line", F.coalesce(pick(string, "string"), pick(alias, "alias"), pick(constant, "constant")).alias("m")).where("m is not null").select("path", "line", "m.*")


def search(lines: DataFrame, query: str) -> DataFrame:
    """(path, line, column): the first hit of a text in each line, from 0, ignoring case; binary files are skipped."""
    # Extensions that are never searched.
    binary = ("png", "jpg", "jpeg", "gif", "pdf", "zip", "app", "framework")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    at = F.locate(query.lower(), F.lower("text"))
    return lines.where(~ext.isin(*binary) & (at > 0)).select("path", "line", (at - 1).alias("column"))


def instantiations(files: DataFrame, name: str) -> DataFrame:
    """(path, n): `new Name(` or `new Name<...>(` in Java and C# files outside tests."""
    found = F.regexp_extract_all("content", F.lit(rf"(?s)\bnew\s+{re.escape(name)}\s*(?:<[^;(]*>)?\s*\("), F.lit(0))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where(ext.isin("java", "cs") & ~F.col("path").contains("/test/")).select("path", F.size(found).alias("n")).where("n > 0")


def class_names(files: DataFrame) -> DataFrame:
    """(path, name): classes, structs, interfaces, protocols and traits."""
    return files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b(?:class|struct|interface|protocol|trait|enum)\s+([A-Za-z_]\w*)"), F.lit(1)))).alias("name"))
