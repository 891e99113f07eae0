"""A corpus pipeline: quality, exact dedup, near dedup, decontamination, tokens.

Each stage takes all documents that its predecessor kept, as Parquet. All but
the last return the columns of documents; the last returns tokens.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom import ship
from graphloom.llm._spark import checkpoint_dir, drop_folder, drop_rows, keep_rows
from graphloom.llm.decontaminate import find_contamination
from graphloom.llm.exact_dedup import exact_duplicates
from graphloom.llm.minhash_dedup import near_duplicates
from graphloom.llm.quality import train_quality, with_quality
from graphloom.llm.sentencepiece_wfst import load_model, round_trip

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; it learns from the labels outside its fold.

    Null and empty texts are scored like any other, as are very long ones, and
    a tie at 0.5 is kept. Repeated rows get one score and stay together. A null
    id is never learned from. An empty table stays empty; columns beyond those
    of documents are left out.
    """
    ship(spark)
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_quality(docs.select(*COLUMNS), model, score_col="_quality").filter("_quality >= 0.5").drop("_quality")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id.

    Null and empty texts are one group; a null id is below all others. Of rows
    that repeat, id and text alike, one stays, as of any equal texts. Texts of
    any length are told apart whole. An empty table stays empty.
    """
    ship(spark)
    return keep_rows(docs.select(*COLUMNS), exact_duplicates(docs).filter("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the row with the smallest doc_id.

    Texts without words, and nulls, are linked with nothing and all stay,
    though rows repeating both id and text are one. A null id is below all
    others. Very long texts count whole. An empty table stays empty.
    """
    ship(spark)
    return keep_rows(docs.select(*COLUMNS), near_duplicates(docs).filter("kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark windows.

    A share of just a twentieth goes. Null and empty texts have no words and
    stay, as do all repeats of a clean row. Ids may be null or repeat: a row is
    judged by its own text. Very long texts are read whole. An empty table or
    benchmark removes nothing.
    """
    ship(spark)
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drop_rows(docs.select(*COLUMNS), found.filter("n_hit > 0 and 20 * n_hit >= n_words"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding gives its text back.

    A row per row. Null text has null ids and round_trip and 0 tokens; empty
    text has no ids; texts of any length are encoded whole. Null and repeated
    ids come back as they are. An empty table gives an empty result.
    """
    ship(spark)
    return round_trip(docs, load_model(), ("doc_id", "lang", "source")).drop("decoded").withColumnRenamed("exact", "round_trip")


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: SQL cannot express the classifier; the pipeline is tested against its stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written to the shared folder and read again.

    A stage's table goes once its successor's is written; the last one stays
    for the returned DataFrame to read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                drop_folder(spark, f"{folder}/{k - 1}")
    return docs
