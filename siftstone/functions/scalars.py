"""Scalar functions as column expressions: everything here stays in generated JVM code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severity labels by rank; comparisons are made on the rank.
SEVERITIES = ("low", "medium", "high", "critical")

# Fixed values that results depend on.
PLACEHOLDERS = ("redacted", "changeme", "change-me", "placeholder", "dummy", "example-only", "not-a-real", "your-key", "your_key", "xxxxx", "****")
SANITIZER_MARKERS = ("sanitize", "validate", "normalize", "escape", "redact", "scrub", "allowlist", "whitelist", "isvalid", "isallowed", "ispermitted", "clean", "safe")
SIGNAL_SYMBOLS = ("*", "%", "=", "<", ">", "!", "&", "|", "+", "-")
PUBLIC_FORGES = {"github.com": "github", "gitlab.com": "gitlab", "bitbucket.org": "bitbucket", "codeberg.org": "gitea"}
SEVERITY_ALIASES = {"critical": 3, "3": 3, "c": 3, "high": 2, "2": 2, "h": 2, "medium": 1, "1": 1, "m": 1, "low": 0, "0": 0, "l": 0}

_WORD = r"[\p{L}\p{N}_]+"


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def tokens(line: Column) -> Column:
    """Lower-case words, and symbols that do not follow a word directly."""
    return F.regexp_extract_all(F.lower(line), F.lit(rf"{_WORD}|(?<![\p{{L}}\p{{N}}_])[^\p{{L}}\p{{N}}_\s]"), F.lit(0))


def signal_tokens(line: Column) -> Column:
    """The distinct tokens of three characters or more, and the telling symbols."""
    return F.array_distinct(F.filter(tokens(line), lambda t: (F.length(t) >= 3) | t.isin(*SIGNAL_SYMBOLS)))


def is_placeholder(value: Column) -> Column:
    return _any(F.lower(value).contains(p) for p in PLACEHOLDERS)


def looks_like_secret(value: Column) -> Column:
    """Seven characters or more, with a letter, a digit and a symbol that is not `_ - . space`."""
    return (F.length(value) >= 7) & value.rlike(r"\p{L}") & value.rlike(r"\p{Nd}") & value.rlike(r"[^\p{L}\p{M}\p{N}_\-. ]")


def is_sanitizer_name(name: Column) -> Column:
    return _any(F.lower(name).contains(m) for m in SANITIZER_MARKERS)


def normalized_path(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", ""))


def relative_path(path: Column, root: Column) -> Column:
    """The normalised path below root; a path outside root keeps its own form."""
    base = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(path == F.regexp_replace(root, "/+$", ""), F.lit("")).when(F.startswith(path, base), normalized_path(F.substr(path, F.length(base) + 1))).otherwise(normalized_path(path))


def slug(text: Column) -> Column:
    """Lower-case letters and digits with single hyphens between."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def pascal_case(text: Column) -> Column:
    parts = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda p: p != "")
    joined = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")
    return F.when(joined == "", F.lit("Rule")).otherwise(joined)


def bare_host(url: Column) -> Column:
    """The host of a URL or host name, lower-case, without scheme, path, query or trailing colons."""
    host = F.regexp_replace(F.lower(F.trim(url)), "^.*://", "")
    return F.regexp_replace(F.regexp_replace(host, "(?s)[/?#].*$", ""), ":+$", "")


def api_host(url: Column) -> Column:
    host = bare_host(url)
    return F.when(host == "", F.lit(None)).when(F.startswith(host, F.lit("api.github.com")), F.lit("github.com")).otherwise(host)


def forge_of(url: Column) -> Column:
    """The forge that owns a public host; null for others."""
    host, out = bare_host(url), F.lit(None).cast("string")
    for name, forge in PUBLIC_FORGES.items():
        out = F.when(host == name, F.lit(forge)).otherwise(out)
    return out


def forge_slug(url: Column) -> Column:
    """owner/name of a repository URL in its https, ssh or scp form."""
    path = F.regexp_extract(F.trim(url), r"^(?:[a-z+]+://(?:[^@/]+@)?[^/]+/|[^@/\s]+@[^:]+:)(.+?)(?:\.git)?/*$", 1)
    return F.when(path != "", path)


def version_key(version: Column) -> Column:
    """Components of a version of digits and dots; null if it cannot be read."""
    text = F.regexp_replace(F.trim(version), "^[vV]", "")
    return F.when(text.rlike(r"^[0-9]+(\.[0-9]+)*$"), F.transform(F.split(text, r"\."), lambda x: x.cast("long")))


def version_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1; missing components are zero; an unreadable side makes it -1 (older)."""
    x, y = version_key(a), version_key(b)
    n = F.greatest(F.size(x), F.size(y))
    pad = lambda v: F.concat(v, F.array_repeat(F.lit(0).cast("long"), n - F.size(v)))
    return F.when(x.isNull() | y.isNull(), -1).when(pad(x) < pad(y), -1).when(pad(x) > pad(y), 1).otherwise(0)


def exploitability(severity: Column, reachable: Column, tainted: Column) -> Column:
    """Rank moved up if reached and tainted, down if neither, within low to critical."""
    step = F.when(reachable & tainted, 1).when(reachable | tainted, 0).otherwise(-1)
    return F.greatest(F.lit(0), F.least(F.lit(3), severity + step))


def cvss3_base(vector: Column, compat: bool = False) -> Column:
    """CVSS 3.1 base score of a vector string; null if a metric is missing or unknown.

    compat gives the scores of the engine that this one replaces: other weights
    for AC and PR, the changed-scope polynomial for both scopes, and the
    exploitability alone where there is no impact.
    """
    m = F.str_to_map(vector, F.lit("/"), F.lit(":"))

    def weight(name: str, table: dict[str, float]) -> Column:
        out, v = F.lit(None).cast("double"), m[name]
        for k, w in table.items():
            out = F.when(v == k, F.lit(w)).otherwise(out)
        return out

    changed = m["S"] == "C"
    # Published metric weights, and those of the compatible form.
    av = weight("AV", {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2})
    ui = weight("UI", {"N": 0.85, "R": 0.62})
    ac = weight("AC", {"L": 0.77, "M": 0.44, "H": 0.2} if compat else {"L": 0.77, "H": 0.44})
    inner, outer = ({"N": 0.85, "U": 0.62, "C": 0.68}, {"N": 0.85, "U": 0.27, "C": 0.5}) if compat else ({"N": 0.85, "L": 0.62, "H": 0.27}, {"N": 0.85, "L": 0.68, "H": 0.5})
    pr = F.when(changed, weight("PR", outer)).otherwise(weight("PR", inner))
    c, i, a = (weight(k, {"N": 0.0, "L": 0.22, "H": 0.56}) for k in ("C", "I", "A"))
    iss = 1 - (1 - c) * (1 - i) * (1 - a)
    reach = 8.22 * av * ac * pr * ui
    up = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.ceil(F.round(x * 10, 8)) / 10))
    if compat:
        wide = 7.52 * (iss - 0.029) - 3.25 * F.pow(iss * 0.9731 - 0.02, F.lit(13))
        narrow = 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(13))
    else:
        wide = 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15))
        narrow = 6.42 * iss
    impact = F.when(changed, wide).otherwise(narrow)
    total = F.when(changed, F.least(1.08 * (reach + impact), F.lit(10.0))).otherwise(F.least(reach + impact, F.lit(10.0)))
    nothing = up(reach) if compat else F.lit(0.0)
    known = m["S"].isNotNull() & iss.isNotNull() & reach.isNotNull()
    return F.when(known, F.when((iss <= 0) | (impact <= 0), nothing).otherwise(up(total)))


def severity_bucket(score: Column) -> Column:
    return F.when(score >= 9, 3).when(score >= 7, 2).when(score >= 4, 1).when(score.isNotNull(), 0)


def severity_rank(label: Column) -> Column:
    """Rank of a severity's name, number or initial; null if unknown."""
    low, out = F.lower(F.trim(label)), F.lit(None).cast("int")
    for k, v in SEVERITY_ALIASES.items():
        out = F.when(low == k, v).otherwise(out)
    return out


def advisory_severity(db_label: Column, entries: Column, compat: bool = False) -> Column:
    """The database's label, else the first usable numeric score or v3 vector, else medium."""
    label = F.upper(db_label)
    named = F.when(label == "CRITICAL", 3).when(label == "HIGH", 2).when(label.isin("MODERATE", "MEDIUM"), 1).when(label == "LOW", 0)

    def of(e: Column) -> Column:
        number = F.when(e["score"].rlike(r"^\s*[0-9]+(\.[0-9]+)?\s*$"), e["score"].cast("double"))
        v3 = F.coalesce(F.upper(e["type"]).contains("V3"), F.lit(False)) | F.startswith(e["score"], F.lit("CVSS:3"))
        return severity_bucket(F.coalesce(number, F.when(v3, cvss3_base(F.regexp_replace(e["score"], "^CVSS:3[^/]*/", ""), compat))))

    scored = F.filter(F.transform(F.coalesce(entries, F.array().cast("array<struct<type:string,score:string>>")), of), lambda x: x.isNotNull())
    return F.coalesce(named, F.try_element_at(scored, F.lit(1)), F.lit(1))


def license_of(text: Column) -> Column:
    """The licence that a text names; the first that applies, in this order."""
    low = F.lower(text)
    has = low.contains
    return (
        F.when(has("mit license") | has("permission is hereby granted, free of charge"), "MIT License")
        .when(has("apache license") & has("version 2.0"), "Apache License 2.0")
        .when(has("bsd 3-clause") | (has("bsd license") & has("redistribution and use in source and binary forms")), "BSD 3-Clause License")
        .when(has("bsd 2-clause"), "BSD 2-Clause License")
        .when(has("gnu general public license") | has("gpl v3") | has("gpl-3.0"), "GNU General Public License v3.0 (GPLv3)")
        .when(has("gnu lesser general public license") | has("lgpl"), "GNU Lesser General Public License (LGPL)")
        .when(has("mozilla public license") | has("mpl"), "Mozilla Public License (MPL 2.0)")
        .when(has("isc license"), "ISC License")
        .when(has("unlicense") | has("disclaims all copyright"), "The Unlicense (Public Domain)")
        .otherwise("Custom / Unrecognized Open Source / Proprietary")
    )


def fingerprint(repo: Column, number: Column, sha: Column, updated: Column) -> Column:
    """repo#id@sha12; the time of the update where there is no sha."""
    mark = F.when(F.coalesce(sha, F.lit("")) != "", F.substring(sha, 1, 12)).otherwise(updated.cast("string"))
    return F.concat(repo.cast("string"), F.lit("#"), number.cast("string"), F.lit("@"), mark)


def cache_key(*parts: Column) -> Column:
    """SHA-256 over parts that are told apart by their lengths."""
    return F.sha2(F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of a text's bytes, in hexadecimal."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substr(F.hex(text), 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    h = F.aggregate(F.when(F.octet_length(text) > 0, codes).otherwise(F.array().cast("array<bigint>")), F.lit(-3750763034362895579).cast("long"), lambda a, b: _wrapped(a.bitwiseXOR(b)))
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def _wrapped(a: Column) -> Column:
    """a times the FNV prime modulo 2**64, by shifts that cannot overflow: 2**40 + 2**8 + 0xb3."""
    low = a.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(a, 32)
    first = low * 0x1B3
    upper = (high * 0x1B3 + F.shiftrightunsigned(first, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    base = F.shiftleft(upper, 32).bitwiseOR(first.bitwiseAND(F.lit(0xFFFFFFFF)))
    more = F.shiftleft(low, 40)
    return F.shiftleft((F.shiftrightunsigned(base, 32) + F.shiftrightunsigned(more, 32)).bitwiseAND(F.lit(0xFFFFFFFF)), 32).bitwiseOR(base.bitwiseAND(F.lit(0xFFFFFFFF)))


def forge_time(text: Column) -> Column:
    return F.try_to_timestamp(text)


def natural_key(name: Column) -> Column:
    """Orders digits by value: every number is padded to 20 digits."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 20, "0")).otherwise(p)), "")
