"""Source trees as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions.scalars import license_of, natural_key

LIMIT = 1_000_000  #: characters of a file at most
# Path parts that are never entered, and languages by extension.
EXCLUDED = ("build", "vendor", "node_modules", ".git")
LANGUAGES = {
    "c": "C", "h": "C", "cpp": "C++", "cc": "C++", "cxx": "C++", "hpp": "C++", "hxx": "C++", "hh": "C++", "java": "Java", "cs": "C#", "csx": "C#", "go": "Go",
    "kt": "Kotlin", "kts": "Kotlin", "rb": "Ruby", "rake": "Ruby", "gemspec": "Ruby", "php": "PHP", "phtml": "PHP", "inc": "PHP", "py": "Python",
    "m": "Cocoa", "mm": "Cocoa", "objc": "Cocoa", "rs": "Rust", "sol": "Solidity", "js": "JavaScript", "jsx": "JavaScript", "ts": "JavaScript", "tsx": "JavaScript",
    "swift": "Swift",
}
#: What the scanner reads, and what a viewer shows: they differ on purpose.
SCANNED = (*(x for x in LANGUAGES if x not in ("rake", "gemspec")), "c++", "h++")
VIEWED = (*(x for x in LANGUAGES if x != "inc"), "c++", "h++")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def visible(path: Column) -> Column:
    """No hidden part and no excluded folder on the path."""
    parts = "|".join(x.replace(".", r"\.") for x in EXCLUDED)
    return ~path.rlike(rf"(^|/)({parts})/") & ~path.rlike(r"(^|/)\.[^/]")


def enumerate_files(listing: DataFrame, extensions: tuple[str, ...] | None = SCANNED) -> DataFrame:
    """listing(path, content) of visible files, with ext and lang; None takes every extension.

    The extension table is small and fixed, and is broadcast.
    """
    ext = listing.where(visible(F.col("path"))).withColumn("ext", extension(F.col("path")))
    table = listing.sparkSession.createDataFrame(list(LANGUAGES.items()), "ext string, lang string")
    kept = ext if extensions is None else ext.where(F.col("ext").isin(*extensions))
    return kept.join(F.broadcast(table), "ext", "left")


def read_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] | None = SCANNED, limit: int = LIMIT) -> DataFrame:
    """(path, ext, lang, content) of a tree: paths below root; larger files are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/")
    path = F.regexp_replace(F.element_at(F.split("path", base.replace("\\", r"\\"), 2), -1), "^/+", "")
    files = raw.where(F.col("length") <= 4 * limit).select(path.alias("path"), F.decode("content", "utf-8").alias("content"))
    return enumerate_files(files, extensions).where(F.length("content") <= limit)


def listing(files: DataFrame, ignored: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Children of every folder: folders first, then names with numbers by value."""
    parts = F.split("path", "/")
    steps = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i - 1), "/").alias("folder"), F.element_at(parts, i).alias("name"), (i < F.size(parts)).alias("is_dir")))).alias("x")).select("x.*").distinct()
    return steps.where(~F.col("name").isin(*ignored)).orderBy("folder", F.desc("is_dir"), natural_key(F.col("name")), "name")


def licences(files: DataFrame, preview: int = 25) -> DataFrame:
    """(path, licence, preview) of LICENSE* and COPYING files; the preview is a feature."""
    name = F.upper(F.substring_index("path", "/", -1))
    found = files.where(F.startswith(name, F.lit("LICENSE")) | F.startswith(name, F.lit("LICENCE")) | (name == "COPYING"))
    return found.select("path", license_of(F.col("content")).alias("licence"), F.array_join(F.slice(F.split("content", "\n"), 1, preview), "\n").alias("preview"))


def patches(spark: SparkSession, root: str) -> DataFrame:
    """(patch, content) of .patch and .diff files of a tree."""
    files = spark.read.option("recursiveFileLookup", True).option("wholetext", True).option("pathGlobFilter", "*.{patch,diff}").text(root)
    return files.select(F.col("_metadata.file_path").alias("patch"), F.col("value").alias("content")).where(visible(F.regexp_replace("patch", "^[a-z]+:/*", "")))
