"""Notes, bugs and wiki pages: JSON tables, search, and sealed archives."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions.scalars import slug

SCHEMAS = {
    "notes": "path string, line int, text string",
    "bugs": "id string, title string, package string, detail string, severity string, status string, createdAt timestamp",
    "wiki": "slug string, title string, body string, created double, updated double",
}
ROUNDS = 10_000  #: rounds of the key derivation


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[kind]).json(path)


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def key(password: str, salt: bytes) -> bytes:
    """32 bytes: SHA-256 of salt and password, hashed again ROUNDS times; made once, on the driver."""
    out = salt + password.encode()
    for _ in range(ROUNDS):
        out = hashlib.sha256(out).digest()
    return out


def seal(df: DataFrame, password: str, salt: bytes) -> DataFrame:
    """(sealed binary): each row as JSON, encrypted with AES-GCM under a random nonce."""
    k = F.lit(bytearray(key(password, salt)))
    return df.select(F.aes_encrypt(F.to_json(F.struct(*df.columns)), k, F.lit("GCM")).alias("sealed"))


def unseal(df: DataFrame, password: str, salt: bytes, schema: str) -> DataFrame:
    """The rows that `seal` has sealed; a wrong password is an error."""
    k = F.lit(bytearray(key(password, salt)))
    text = F.aes_decrypt("sealed", k, F.lit("GCM")).cast("string")
    return df.select(F.from_json(text, schema).alias("r")).select("r.*")


def search_bugs(bugs: DataFrame, query: str) -> DataFrame:
    """Bugs that hold the text in any searched field, ignoring case, newest first."""
    fields = ("title", "package", "detail", "id", "severity", "status")
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.lower(f).contains(query.lower()), F.lit(False))
    return bugs.where(hit).orderBy(F.desc("createdAt"), "id")


def folded(text: Column) -> Column:
    """Lower case without accents, for the letters of Latin scripts."""
    plain = str.maketrans("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿšž", "aaaaaaceeeeiiiinoooooouuuuyysz")
    source, target = "".join(map(chr, plain)), "".join(chr(v) for v in plain.values())
    return F.translate(F.lower(text), source, target)


def search_wiki(pages: DataFrame, query: str) -> DataFrame:
    q = folded(F.lit(query))
    return pages.where(folded(F.col("title")).contains(q) | folded(F.col("body")).contains(q)).orderBy("slug")


def resolve(pages: DataFrame, names: DataFrame) -> DataFrame:
    """(name, slug): the page of each name, by slug or else by title; null if there is none."""
    by_title = pages.select(folded(F.col("title")).alias("_t"), F.col("slug").alias("_by_title")).dropDuplicates(["_t"])
    by_slug = pages.select(F.col("slug").alias("_s")).distinct()
    asked = names.withColumn("_slug", slug(F.col("name"))).withColumn("_t", folded(F.col("name")))
    return asked.join(by_slug, asked["_slug"] == by_slug["_s"], "left").join(by_title, "_t", "left").select("name", F.coalesce("_s", "_by_title").alias("slug"))
