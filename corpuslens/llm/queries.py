"""The corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslens.llm import bpe, exact_dedup, line_dedup, main_text, mixing, near_dup, pii, quality, sharding, token_files
from corpuslens.llm.common import new_path, table

#: The tokenizer file is a parameter of the operators; it is never copied here.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, from the shard files as read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = sharding.shard_records(docs, new_path(spark, "shards"))
    return back.select(
        "doc_id",
        F.col("size").cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as read back from the Arrow files."""
    return token_files.token_file_round_trip(table(spark, sf_dir, "documents"), TOKENIZER).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_spans")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), TOKENIZER).select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1, mode="all")
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mix of all sources."""
    rows = mixing.positions(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return rows.select(F.col("id").alias("doc_id"), "source", "weight", "block", "slot", "phase", "position")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    verdict = [F.col(f"quality.{c}") for c in ("base_failed", "kept", "posterior")]
    return rows.select("doc_id", *[F.col(f"quality.f.{c}") for c in counts], *verdict)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class and number of links; a class's representative is its least doc_id of that shingle set."""
    rows = near_dup.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "class_id", "rep_id", "n_links")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = main_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_mixing, op3_quality, op4_sharding, op5_token_files, op6_ngram_jaccard, op7_pii, op8_main_text, op9_bpe, op10_exact_dedup, pipeline)}

ORACLE_SQL = {
    "op1_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
        ), keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
        ), common AS (
            SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
        ), marked AS (
            SELECT doc_id, line, pos, key IN (SELECT key FROM common) AS lost FROM keyed
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op10_exact_dedup": """
        WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)
    """,
}
