"""Dependency files: discovery, 22 formats, and the join with advisories."""

from __future__ import annotations

import bisect
import itertools
import json
import re
import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.scalars import advisory_severity
from siftstone.operators.perfile import per_file

# File name -> (format, ecosystem, language, is a lock file).
FILES = {
    "package-lock.json": ("npm_lock", "npm", "JavaScript", True),
    "npm-shrinkwrap.json": ("npm_lock", "npm", "JavaScript", True),
    "yarn.lock": ("yarn", "npm", "JavaScript", True),
    "pnpm-lock.yaml": ("pnpm", "npm", "JavaScript", True),
    "poetry.lock": ("toml_lock", "PyPI", "Python", True),
    "uv.lock": ("toml_lock", "PyPI", "Python", True),
    "Pipfile.lock": ("pipfile", "PyPI", "Python", True),
    "requirements.txt": ("requirements", "PyPI", "Python", True),
    "Cargo.lock": ("cargo_lock", "crates.io", "Rust", True),
    "composer.lock": ("composer_lock", "Packagist", "PHP", True),
    "go.mod": ("go_mod", "Go", "Go", True),
    "Gemfile.lock": ("gem_lock", "RubyGems", "Ruby", True),
    "packages.lock.json": ("nuget_lock", "NuGet", ".NET", True),
    "Package.resolved": ("swift_resolved", "SwiftURL", "Swift", True),
    "gradle.lockfile": ("gradle_lock", "Maven", "Java", True),
    "libs.versions.toml": ("gradle_catalog", "Maven", "Java", True),
    "package.json": ("npm", "npm", "JavaScript", False),
    "pyproject.toml": ("pyproject", "PyPI", "Python", False),
    "Cargo.toml": ("cargo", "crates.io", "Rust", False),
    "composer.json": ("composer", "Packagist", "PHP", False),
    "Gemfile": ("gemfile", "RubyGems", "Ruby", False),
    "pom.xml": ("pom", "Maven", "Java", False),
    "build.gradle": ("gradle", "Maven", "Java", False),
    "build.gradle.kts": ("gradle", "Maven", "Java", False),
}
# Folders that are not searched (hidden ones never are), and the deepest level.
SKIPPED = (
    "node_modules", "vendor", "Pods", "Carthage", "build", "Build", "BUILD", "dist", "Dist", "out", "target", "bin", "obj", "packages", "DerivedData",
    "__pycache__", "bower_components", "coverage", "tmp", "venv", "Godeps",
)
DEPTH = 10
# Formats that keep a name and version each time they stand in a file.
REPEATING = ("toml_lock", "pipfile", "cargo_lock", "npm")
EXACT = r"^[0-9]+(\.[0-9]+)+([-+][0-9A-Za-z.\-+]+)?$"
_EXACT = re.compile(EXACT)
_PLAIN = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*$")


def is_exact(version: Column) -> Column:
    """A version of two or more numbers, and no range, URL or link."""
    return version.rlike(EXACT)


def discover(files: DataFrame) -> DataFrame:
    """files(path, content) that are dependency files, with format, ecosystem, language.

    Manifests of a language that has a lock file anywhere go.
    """
    name = F.substring_index("path", "/", -1)
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    specs = files.sparkSession.createDataFrame([(k, *v) for k, v in FILES.items()], "name string, format string, ecosystem string, language string, lock boolean")
    named = files.where(~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED))) & ~F.exists(folders, lambda x: F.startswith(x, F.lit("."))) & (F.size(folders) <= DEPTH)).withColumn("name", F.when(F.endswith(name, F.lit(".csproj")), "*.csproj").otherwise(name))
    specs = specs.union(files.sparkSession.createDataFrame([("*.csproj", "csproj", "NuGet", ".NET", False)], specs.schema))
    found = named.join(F.broadcast(specs), "name")
    locked = found.where("lock").select("language").distinct().withColumn("locked", F.lit(True))  # reads paths alone
    return found.join(F.broadcast(locked), "language", "left").where(F.col("lock") | F.col("locked").isNull()).drop("locked")


def _exact(v) -> bool:
    return isinstance(v, str) and bool(_EXACT.match(v))


def _sorted(o) -> list:
    """The items of a JSON object in the order of their keys; nothing for what is no object."""
    return sorted(o.items()) if isinstance(o, dict) else []


def _npm_tree(deps: dict):
    for name, d in _sorted(deps):
        if isinstance(d, dict):
            yield name, d.get("version")
            yield from _npm_tree(d.get("dependencies"))


def _repository(url: str) -> str:
    url = re.sub(r"^git@([^:]+):", r"https://\1/", url.strip())
    return re.sub(r"(?:\.git)?/*$", "", url)


def _toml_blocks(text: str):
    """(first line, header, {key: raw value}) of each table."""
    at, header, values = 1, "", {}
    for n, raw in enumerate(text.split("\n"), 1):
        line = raw.strip()
        if line.startswith("["):
            yield at, header, values
            at, header, values = n, line, {}
        elif (m := re.match(r"""["']?([\w.\-]+)["']?\s*=\s*(.+)$""", line)) and not line.startswith("#"):
            values[m[1]] = (m[2].strip(), n)
    yield at, header, values


def _quoted(raw: str) -> str | None:
    m = re.match(r"""^["']([^"']*)["']""", raw)
    return m[1] if m else None


def _inline_version(raw: str) -> str | None:
    """The version of `"1.2"` or of an inline table's own `version` key."""
    m = re.search(r"""\bversion\s*=\s*["']([^"']*)["']""", raw) if raw.startswith("{") else None
    return m[1] if m else _quoted(raw)


def _json_formats(kind: str, o: dict):
    if kind == "npm_lock":
        if isinstance(o.get("packages"), dict):
            for key, p in _sorted(o["packages"]):
                if key and isinstance(p, dict) and p.get("link") is not True:
                    yield p.get("name") or (key.rpartition("node_modules/")[2] if "node_modules/" in key else None), p.get("version")
        else:
            yield from _npm_tree(o.get("dependencies"))
    elif kind == "pipfile":
        for section in ("default", "develop"):
            for name, p in _sorted(o.get(section)):
                yield name, str(p.get("version", "")).lstrip("=") if isinstance(p, dict) else None
    elif kind == "composer_lock":
        for section in ("packages", "packages-dev"):
            for p in o.get(section) or []:
                yield p.get("name"), str(p.get("version", "")).removeprefix("v")
    elif kind == "nuget_lock":
        for _, deps in _sorted(o.get("dependencies")):
            for name, p in _sorted(deps):
                yield name, p.get("resolved")
    elif kind == "swift_resolved":
        for p in o.get("pins") or (o.get("object") or {}).get("pins") or []:
            url = p.get("location") or p.get("repositoryURL")
            yield _repository(url) if url else None, (p.get("state") or {}).get("version")
    elif kind == "npm":
        for section in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
            yield from _sorted(o.get(section))
    elif kind == "composer":
        for section in ("require", "require-dev"):
            for name, v in _sorted(o.get(section)):
                yield name, str(v).removeprefix("v")


def _places(text: str, names: set[str]):
    """line(name): where a name stands next, in quotes if it can; the search goes on behind the last find, then from the top.

    Names in quotes are indexed in one pass: between two neighbouring quotes stands a whole one or none.
    """
    ends = [m.start() for m in re.finditer("\n", text)]
    quoted: dict[str, list[int]] = {}
    quotes = [m.start() for m in re.finditer('"', text)]
    for a, b in itertools.pairwise(quotes):
        if (name := text[a + 1 : b]) in names:
            quoted.setdefault(name, []).append(a)
    at = 0

    def find(name: str) -> tuple[int, int]:
        if '"' not in name:
            if spots := quoted.get(name):
                i = bisect.bisect_left(spots, at)
                return spots[i if i < len(spots) else 0], len(name) + 2
        elif (spot := text.find(f'"{name}"', at)) >= 0 or (spot := text.find(f'"{name}"')) >= 0:
            return spot, len(name) + 2
        spot = text.find(name, at)
        return (spot if spot >= 0 else text.find(name)), len(name)

    def line(name: str) -> int:
        nonlocal at
        spot, size = find(name)
        if spot < 0:
            return 1
        at = spot + size
        return bisect.bisect_left(ends, spot) + 1

    return line


def _yarn(lines):
    names, at = None, 0
    for n, raw in enumerate(lines, 1):
        if not raw.strip():
            names = None
        elif not raw[0].isspace() and raw.rstrip().endswith(":") and not raw.startswith("#"):
            selector = raw.rstrip()[:-1].split(",")[0].strip().strip('"')
            name, _, want = selector[1:].partition("@") if selector.startswith("@") else selector.partition("@")
            name = "@" + name if selector.startswith("@") else name
            names, at = (None if re.match(r"(?:workspace|file|link|portal|patch|exec):", want) else name), n
        elif names and (m := re.match(r"""^\s+version:?\s+"?([^"\s]+)"?""", raw)):
            yield names, m[1], at
            names = None


def _pnpm(lines):
    inside = False
    for n, raw in enumerate(lines, 1):
        if raw and not raw[0].isspace():
            inside = raw.startswith("packages:")
        elif inside and (m := re.match(r"^  (\S.*):\s*$", raw)):
            key = re.sub(r"\(.*$", "", m[1].strip("'\""))
            if key.startswith("/"):
                key = key[1:]
                name, _, version = key.rpartition("@") if "@" in key[1:] else key.rpartition("/")
            else:
                name, _, version = key.rpartition("@")
            yield name, version.split("_")[0], n


def _line_formats(kind: str, text: str):
    lines = text.split("\n")
    if kind == "yarn":
        yield from _yarn(lines)
    elif kind == "pnpm":
        yield from _pnpm(lines)
    elif kind == "requirements":
        for n, raw in enumerate(lines, 1):
            line = re.split(r"\s#|;", raw.strip())[0].strip()
            if line and not line.startswith(("#", "-", "//")) and "==" in line:
                name, _, version = line.partition("==")
                name = name.partition("[")[0]
                if _PLAIN.match(name):
                    yield name, version.strip(), n
    elif kind == "go_mod":
        block = False
        for n, raw in enumerate(lines, 1):
            line = raw.split("//")[0].strip()
            if line.startswith("require ("):
                block = True
            elif block and line == ")":
                block = False
            elif (block or line.startswith("require ")) and (m := re.match(r"^(?:require\s+)?(\S+)\s+v(\d+(?:\.\d+)+\S*)", line)):
                yield m[1], m[2], n
    elif kind == "gem_lock":
        section, specs = "", False
        for n, raw in enumerate(lines, 1):
            if raw and not raw[0].isspace():
                section, specs = raw.strip(), False
            elif section == "GEM" and raw.strip() == "specs:":
                specs = True
            elif specs and (m := re.match(r"^ {4}(\S+) \(([^)]+)\)", raw)):
                yield m[1], m[2], n
    elif kind == "gradle_lock":
        for n, raw in enumerate(lines, 1):
            parts = raw.split("=")[0].strip().split(":")
            if len(parts) == 3 and not raw.startswith("#"):
                yield ":".join(parts[:2]), parts[2], n
    elif kind == "gemfile":
        for n, raw in enumerate(lines, 1):
            if m := re.match(r"""^\s*gem\s+["']([^"']+)["']\s*,\s*["']([^"']+)["']""", raw):
                yield m[1], m[2].lstrip("= "), n
    elif kind == "gradle":
        for n, raw in enumerate(lines, 1):
            line = raw.strip()
            if "classpath" in line or "platform(" in line:
                continue
            if re.match(r"(?:api|implementation|compile|compileOnly|runtimeOnly|runtime|testImplementation|testCompile|annotationProcessor|kapt)\b", line) and (m := re.search(r"""["']([^"':]+):([^"':]+):([^"':@]+)["'@:]""", line)):
                yield f"{m[1]}:{m[2]}", m[3], n
    elif kind == "csproj":
        for n, raw in enumerate(lines, 1):
            if m := re.search(r'<PackageReference\s+[^>]*Include="([^"]+)"', raw):
                v = re.search(r'Version="([^"]+)"', raw) or re.search(r"<Version>([^<]+)</Version>", " ".join(lines[n - 1 : n + 2]))
                if v:
                    yield m[1], v[1].strip("[]"), n


def _toml_formats(kind: str, text: str):
    blocks = list(_toml_blocks(text))
    if kind in ("toml_lock", "cargo_lock"):
        for at, header, v in blocks:
            if header == "[[package]]" and "name" in v and "version" in v and (kind == "toml_lock" or (_quoted(v.get("source", ("", 0))[0]) or "").startswith("registry+")):
                yield _quoted(v["name"][0]), _quoted(v["version"][0]), at
    elif kind == "gradle_catalog":
        versions = {k: _quoted(raw) for _, h, v in blocks if h == "[versions]" for k, (raw, _) in v.items()}
        for _, h, v in blocks:
            for raw, n in v.values() if h == "[libraries]" else ():
                module = re.search(r"""\bmodule\s*=\s*["']([^"']+)["']""", raw)
                ref = re.search(r"""\bversion\.ref\s*=\s*["']([^"']+)["']""", raw)
                if module:
                    yield module[1], versions.get(ref[1]) if ref else _inline_version(raw), n
    elif kind == "cargo":
        for _, h, v in blocks:
            if re.match(r"^\[(?:.*\.)?(?:dev-|build-)?dependencies\]$", h):
                for name, (raw, n) in v.items():
                    yield name, (_inline_version(raw) or "").lstrip("="), n
    elif kind == "pyproject":
        for _, h, v in blocks:
            if "poetry" in h and "dependencies" in h:
                for name, (raw, n) in v.items():
                    yield name, (_inline_version(raw) or "").lstrip("="), n
        inside = False
        for n, raw in enumerate(text.split("\n"), 1):
            line = raw.strip()
            if line.startswith("[") and line.endswith("]"):
                inside = False
            elif inside or re.match(r"dependencies\s*=\s*\[", line):
                inside = "]" not in line
                for quoted in re.findall(r'"([^"]+)"', line):
                    name, _, version = (x.strip() for x in quoted.partition("=="))
                    if _PLAIN.match(name):
                        yield name, version.partition(";")[0].strip(), n


def _pom(text: str):
    line, at = 1, 0
    for m in re.finditer(r"(?s)<dependency>(.*?)</dependency>", text):
        line, at = line + text.count("\n", at, m.start()), m.start()
        tag = {k: (re.search(rf"<{k}>\s*([^<]+?)\s*</{k}>", m[1]) or [None, None])[1] for k in ("groupId", "artifactId", "version")}
        if all(tag.values()) and "${" not in tag["version"]:
            yield f"{tag['groupId']}:{tag['artifactId']}", tag["version"], line


def parse(kind: str, text: str):
    """(name, version, line) of the exact versions in a file of any format; a broken file gives nothing.

    The first of each name and version counts, but for the REPEATING formats;
    names of requirements differ by more than case.
    """
    seen = set()

    def fresh(name, version) -> bool:
        key = name.lower() if kind == "requirements" else name, version
        if kind not in REPEATING and key in seen:
            return False
        seen.add(key)
        return True

    try:
        if kind in ("npm_lock", "pipfile", "composer_lock", "nuget_lock", "swift_resolved", "npm", "composer"):
            found = []
            try:
                for name, version in _json_formats(kind, json.loads(text)):
                    version = version.strip() if isinstance(version, str) else version
                    if name and _exact(version) and fresh(name, version):
                        found.append((name, version))
            finally:  # what stands before a broken part counts
                line = _places(text, {name for name, _ in found if isinstance(name, str)})
                for name, version in found:
                    yield name, version, line(name)
            return
        rows = _pom(text) if kind == "pom" else _toml_formats(kind, text) if kind in ("toml_lock", "cargo_lock", "gradle_catalog", "cargo", "pyproject") else _line_formats(kind, text)
        for name, version, n in rows:
            if name and _exact(version) and fresh(name, version):
                yield name, version, n
    except (ValueError, AttributeError, TypeError, ET.ParseError):
        return


def dependencies(files: DataFrame) -> DataFrame:
    """(ecosystem, path, name, version, line) of files(path, content): what `parse` finds in each dependency file."""
    return per_file(discover(files), ["ecosystem", "path"], ["format", "content"], lambda kind, content: parse(kind, content or ""), "name string, version string, line int")


def requirements(lines: DataFrame) -> DataFrame:
    """(path, line, name, version) of requirement lines: the relational form of that parser."""
    clean = F.trim(F.regexp_replace("text", r"(?:\s#|;).*$", ""))
    name, version = F.lower(F.trim(F.regexp_replace(F.substring_index(clean, "==", 1), r"\[.*\]", ""))), F.trim(F.regexp_extract(clean, r"==(.*)$", 1))
    return lines.where(~clean.rlike(r"^(#|-|//)") & clean.contains("==")).select("path", "line", name.alias("name"), version.alias("version")).where(is_exact(F.col("version")))


def package_findings(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """deps joined to advisories(ecosystem, name, version, id, summary, severity entries, db_severity).

    Each advisory is rated once, before the join; of copies of one advisory the
    worst rating counts, and its first summary.  The rows come in no order: see
    `worst_first`.
    """
    keys = ["ecosystem", "name", "version", "id"]
    rest = [F.min(c).alias(c) for c in advisories.columns if c not in (*keys, "severity", "db_severity")]
    rated = advisories.withColumn("severity", advisory_severity(F.col("db_severity"), F.col("severity"))).groupBy(*keys).agg(F.max("severity").alias("severity"), *rest)
    return deps.join(rated, ["ecosystem", "name", "version"])


def worst_first(found: DataFrame) -> DataFrame:
    """Findings in report order: severity, then name and advisory."""
    return found.orderBy(F.desc("severity"), "name", "id")


def by_name(deps: DataFrame) -> DataFrame:
    """Dependencies in list order: ecosystem, name ignoring case, version, place."""
    return deps.orderBy("ecosystem", F.lower("name"), "name", "version", "path", "line")
