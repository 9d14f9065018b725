"""The registered queries of this subpackage, and DuckDB SQL for those it can express.

Each query applies its operator, with production parameters, to its whole
table.  Tokenizer files are named by `TOKENIZERS`; they are read where they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm import bit_sliced, byte_bpe, language_id, line_dedup, packing, simhash, substring_dedup, suffix_dedup, transport_stream, warc

TOKENIZERS = {"bytes": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "words": public_tokenizers.path("word_bpe_49k.json")}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.read(transport_stream.store(_table(spark, sf_dir, "documents")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(_table(spark, sf_dir, "documents"), TOKENIZERS["bytes"], public_tokenizers.PATTERN)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), TOKENIZERS["words"])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup(_table(spark, sf_dir, "documents")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(_table(spark, sf_dir, "documents"))


def op9_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.dedup(_table(spark, sf_dir, "documents")))


_ALL = (op1_transport_stream, op2_warc, op3_byte_bpe, op4_language_id, op5_packing, op6_line_dedup, op7_suffix_dedup, op8_simhash, op9_bit_sliced, op10_substring_dedup)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL = {
    "op2_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
        SELECT page_id, n AS payload_bytes, h AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
    "op7_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        w AS (SELECT doc_id, unnest(range(0, length(x) // 2 - 49)) AS p, x FROM d),
        k AS (SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS s FROM w),
        m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS least FROM k),
        hit AS (SELECT doc_id, p FROM m WHERE least < doc_id),
        gap AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM hit),
        run AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM gap),
        span AS (SELECT doc_id, r, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY ALL),
        cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM span),
        part AS (SELECT c.doc_id, c.a, substr(d.x, 2 * since + 1, 2 * (a - since)) AS x, b, a FROM cut c JOIN d USING (doc_id)),
        left_ AS (SELECT doc_id, string_agg(x, '' ORDER BY a) AS x, max(b) AS b, sum(b - a) AS n, count(*) AS spans FROM part GROUP BY doc_id)
        SELECT d.doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
               CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(l.x, '') || substr(d.x, 2 * coalesce(b, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN left_ l USING (doc_id)""",
    "op9_bit_sliced": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 10""",
    "op10_substring_dedup": """
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
        w AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS p, ws FROM d),
        k AS (SELECT doc_id, p, list_aggregate(ws[p:p + 12], 'string_agg', ' ') AS s FROM w),
        m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS least FROM k),
        hit AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM m WHERE least < doc_id),
        word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM d),
        kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS x, count(*) AS n FROM word ANTI JOIN hit USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(encode(coalesce(x, ''))) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
}
