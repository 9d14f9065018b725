"""The corpus pipeline: language ID, line dedup, near-dedup, passage dedup, packing.

Each stage takes all that its predecessor kept and returns it with its own
decisions in effect; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm import language_id, line_dedup, packing, simhash, suffix_dedup
from siftstone.llm.common import stage
from siftstone.llm.queries import TOKENIZERS
from siftstone.session import ship, shipped_stage

#: SQL cannot express the stages; tests/llm holds each one's kept rows and texts against brute force.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0))) if "n_chars" in docs.columns else docs


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language for half of their letters, go.

    Null and empty texts have no letter and go.  Ids play no part but to choose
    the fold that the model does not see: rows with a null id and repeated rows
    stay or go by their text alone.  A tie of languages goes to the one that
    sorts first.  An empty table stays empty; documents of which none has a
    language to learn from are an error.  Other columns stay, whatever their names.
    """
    return language_id.keep_known(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches are cut out; documents stay, if empty.

    Earlier means a smaller id, then line number.  Null texts stay null, empty
    ones empty; rows with a null id neither lose nor remove lines; rows that
    share an id lose the same line numbers, and a repeated row's line is no
    later line.  An empty table stays empty; other columns stay, whatever their
    names; n_chars follows the text.
    """
    return _counted(line_dedup.remove(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents linked by a similarity of their 5-word shingles of 0.8 or more, one row stays.

    It is that with the smallest id, the first of its rows; one with a null id
    stays only if no linked document has an id.  Null texts, empty ones and
    texts without words are alike, and one row of them stays; so does one of
    repeated rows.  An empty table stays empty; other columns stay, whatever
    their names.
    """
    rows = stage(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*docs.columns).alias("row")), "rows")
    found = simhash.near_classes(rows.select("_row", "row.text"), id_col="_row")
    ids = rows.select("_row", "row.doc_id").join(found.select(F.col("doc_id").alias("_row"), "component_id").hint("shuffle_hash"), "_row")
    stay = ids.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id").alias("unknown"), "doc_id", "_row")).alias("least")).select("least._row")
    return rows.join(stay.hint("shuffle_hash"), "_row", "left_semi").select("row.*")


def fresh_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document holds are cut out.

    Earlier means a smaller id.  A character that loses a byte goes whole.  Null
    texts stay null; rows with a null id neither lose nor remove passages, and
    rows that share an id do not remove from each other.  An empty table stays
    empty; other columns stay, whatever their names; n_chars follows the text.
    """
    return _counted(suffix_dedup.remove(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their place in sequences of 2048.

    A null or empty text is the end mark alone.  Rows with a null id or a
    repeated one are packed as rows of their own.  An empty table gives no
    piece; other columns are ignored.
    """
    return packing.pack(docs, TOKENIZERS["words"])


STAGES = [
    ("language_id", shipped_stage(known_language)),
    ("line_dedup", shipped_stage(fresh_lines)),
    ("simhash_near_dedup", shipped_stage(one_of_each)),
    ("suffix_array_dedup", shipped_stage(fresh_passages)),
    ("packing", shipped_stage(packed)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written and read again."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
