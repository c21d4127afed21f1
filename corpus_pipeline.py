"""A training corpus from the documents table: STAGES in their order, run() for all of them.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. What a stage returns
is written as Parquet and read back for the next.

Defined results: documents with a null or empty text, or fewer than ten words, go with the quality rules, so later
stages see none when run() starts; a null source is a source of its own. Of rows with equal texts, lower case alike,
one stays: that of the largest id (a null id is smallest), of fully repeated rows any one. Of a group of near copies
the row of the least id stays. Ties in the mix go by id, then by scan order. Very long texts are taken whole by
every stage. An empty table gives an empty result. All stages but the last keep extra columns, whatever their names;
the last gives doc_id, n_tokens, ids_sha256, decoded_sha256 and position (0, 1, ... in the mix).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import bpe, exact_dedup, mixing, near_dup, quality
from corpuslens.llm.common import file_places, staged, table

#: SQL cannot express the fitted quality model, near duplicates and BPE; tests hold run() against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' model finds good."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_exact_copies(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dup.keep_representatives(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that mixes the sources by their target weights."""
    return mixing.mixed(docs)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, decoded again, and its position in the mix: its place in the files of ``docs``."""
    import public_tokenizers

    place, files = file_places(docs)
    rows = docs.select(F.struct(F.col("doc_id"), place.alias("at")).alias("row"), "text")
    coded = bpe.encode_decode(rows, public_tokenizers.path("byte_bpe_50k.json"), id_col="row")
    placed = coded.join(F.broadcast(files), F.col("id.at.file") == F.col("file"))  # one row for each file
    return placed.select(F.col("id.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256", (F.col("before") + F.col("id.at.idx")).alias("position"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", bpe_round_trip),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"stage-{k}")
    return docs
