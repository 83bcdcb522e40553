"""The queries op1 to op10 and their SQL where SQL can express them. Each gets its rows from its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.sharding import assign_shards

    placed = assign_shards(table(spark, sf_dir, "documents"), n_shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.common import scratch
    from logloom.llm.warc import page_of, read_warc, write_warc

    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    found = read_warc(spark, path).where("gap_reason is null")
    return found.select(page_of(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.exact_dedup import exact_dedup

    found = exact_dedup(table(spark, sf_dir, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from logloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from logloom.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.quality import classify_quality

    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op8_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.langid import classify_language

    return classify_language(table(spark, sf_dir, "documents"))


def op9_neighbour_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.toxicity import classify_toxicity

    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op10_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.media import media_features

    return media_features(table(spark, sf_dir, "documents")).drop("clips")


QUERIES = {f.__name__: f for f in (op1_feistel_sharding, op2_warc_salvage, op3_exact_dedup, op4_minmax_near_dedup, op5_histogram_packing, op6_neighbour_quality, op7_byte_bpe, op8_kneser_ney_langid, op9_neighbour_toxicity, op10_avi_media)}

ORACLE = {
    "op4_minmax_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(x) >= 5 THEN list_distinct(list_transform(range(1, len(x) - 3), lambda i: array_to_string(x[i:i + 4], ' '))) WHEN len(x) > 0 THEN [array_to_string(x, ' ')] ELSE [] END AS g FROM w),
        u AS (SELECT doc_id, len(g) AS n, unnest(g) AS shingle FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.doc_id),
        m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)""",
    "op2_warc_salvage": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((((('0x' || substr(d, (5 * (i // 4) + 1)::INT, 5))::BIGINT) >> (5 * (3 - i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM f""",
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
}
