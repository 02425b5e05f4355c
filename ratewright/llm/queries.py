"""The numbered operators as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.llm import (
    alignment,
    decontamination,
    embedding_dedup,
    language_id,
    line_dedup,
    ngram_join,
    packing,
    quality,
    spelling,
    token_counts,
    token_files,
    url_filters,
    warc,
)
from ratewright.llm.common import table
from ratewright.session import new_shared_path

#: The rules every page is judged by: host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.judge(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_key")


def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    urls = table(spark, folder, "pages").select(F.col("page_id").alias("key"), "url")
    return url_filters.judge(urls, rules).select(F.col("key").alias("page_id"), "host", "path", "rule", "verdict")


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    lines = line_dedup.removed_lines(table(spark, folder, "documents"))
    numbers = F.concat_ws(",", F.col("removed").cast("array<string>"))
    return lines.select(
        "doc_id",
        "n_lines",
        F.size("removed").cast("long").alias("n_removed"),
        F.sha2(numbers.cast("binary"), 256).alias("removed_sha256"),
    )


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    vectors = quality.word_vectors(docs)
    return quality.score(docs, quality.fit(docs, labels, vectors), vectors)


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = warc.round_trip(table(spark, folder, "pages"))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete")


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language_id.identify(docs, language_id.learn(docs.where(~language_id.held_out(F.col("doc_id")))))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


def op9_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op10_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.group(table(spark, folder, "documents"))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    files = public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.path(PIECE_MODEL)
    found = alignment.align_with_counts(table(spark, folder, "documents"), *files, digest=True)
    counts = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return found.select("doc_id", *counts, F.col("groups").alias("groups_sha256"))


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, folder, "documents")))


def op13_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = new_shared_path(spark, "token-files")
    token_files.write(table(spark, folder, "documents"), public_tokenizers.path(BYTE_VOCABULARY), path)
    return token_files.digests(spark, path)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_decontamination,
        op3_url_filters,
        op4_line_dedup,
        op5_quality,
        op6_warc,
        op7_language_id,
        op8_token_counts,
        op9_embedding_dedup,
        op10_ngram_join,
        op11_alignment,
        op12_spelling,
        op13_token_files,
        pipeline,
    )
}
