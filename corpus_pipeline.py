"""The corpus pipeline: language ID, quality, exact dedup, near dedup, packing; each stage written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import scratch, small_batches, text_or_empty


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects: without letters (null and empty ones too), or unlike every learned language.

    The models learn from the documents given; without any that has a language, all go. Documents with equal texts are decided
    alike, whatever their ids; very long ones are judged whole; an empty table stays empty; columns keep their names.
    """
    from logloom.llm.langid import identify, train

    small_batches(spark)
    return identify(docs, train(docs), carry=tuple(docs.columns)).where(~F.col("rejected")).select("row.*")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier predicts to be of low quality, null and empty ones too. It learns from the labels of the documents given; without any, all stay.

    Documents with equal texts are decided alike, whatever their ids; very long ones are judged whole; an empty table stays
    empty; columns keep their names.
    """
    from logloom.llm.quality import score_quality, train

    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, train(docs, labels), carry=tuple(docs.columns)).where("predicted = 1").select("row.*")


def _key(digest: Column) -> Column:
    """A row's identity: its id, null or not, and its text's digest."""
    return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.lit(b":"), digest)


def _staying(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Of the rows of docs that kept (doc_id, digest) names, one for each id and text. Repeated rows are reduced in their tasks before the shuffle, so a hot one moves a row a task."""
    from logloom.llm.exact_dedup import SHA256

    rows = docs.select(_key(SHA256(text_or_empty())).alias("_key"), F.struct("*").alias("row")).dropDuplicates(["_key"])
    return rows.join(kept.select(_key(F.col("digest")).alias("_key")).distinct(), "_key", "left_semi").select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (null counts as empty) one stays: that with the largest doc_id, or one without an id if none has any.

    Where the id that stays is on several such rows, one of them does. Rows with one id and other texts are decided each by
    itself. Very long texts are compared whole; an empty table stays empty; columns keep their names, clashing ones too.
    """
    from logloom.llm.exact_dedup import exact_dedup

    return _staying(docs, exact_dedup(docs, keep="largest").where("kept").select("doc_id", "digest"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one document stays: that with the smallest doc_id, or, if none has an id, one for each text without one.

    Texts without words (null, empty) are near nothing: each id of them stays once. Rows repeated with id and text are reduced to
    one. Rows with one id and other texts are decided each by itself, all of a component with its smallest id staying. Very long
    texts are compared whole; an empty table stays empty; columns keep their names, clashing ones too.
    """
    from logloom.llm.exact_dedup import SHA256
    from logloom.llm.minhash import near_duplicates

    small_batches(spark)
    keyed = docs.select("doc_id", "text", SHA256(text_or_empty()).alias("digest"))
    return _staying(docs, near_duplicates(keyed, carry=("digest",)).where("kept").select("doc_id", "digest"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document's pieces in sequences of at most 2048 tokens: null texts as empty ones, repeated rows and null ids like others; an empty table gives none."""
    import public_tokenizers

    from logloom.llm.packing import pack

    small_batches(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality", classify_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack_sequences),
]

#: The models of the first stages and the tokenizer can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
