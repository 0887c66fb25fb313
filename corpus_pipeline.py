"""A corpus pipeline of five operators, each stage on all that the one before it kept.

Quality and toxicity classifiers take rejected documents out, of each group of near
duplicates one document stays, personal data is blanked, and what is left is packed.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.functions.index import checkpointed, shared_folder
from quadrel.llm.common import read_table, where_scored
from quadrel.llm.jaccard import join_similar
from quadrel.llm.packing import pack_documents
from quadrel.llm.pii import find_personal_data, train_field
from quadrel.llm.quality import train_quality
from quadrel.llm.toxicity import train_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more; others go. Rows that share
    an id are kept or go by their own texts."""
    model = train_quality(docs, read_table(spark, sf_dir, "labels"))
    return where_scored(_rows(docs), model.score, lambda score: score >= 0.7)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores under 0.3; others go."""
    model = train_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return where_scored(_rows(docs), model.score, lambda score: score < 0.3)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of the least id. Of several
    rows of that id the one of the least text stays, then of the least other columns (null
    first). Documents with a null id are in no group and stay."""
    rows = _rows(docs)
    kept = checkpointed(join_similar(rows).where("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("n")))
    single = rows.join(kept.where("n = 1").select("doc_id"), "doc_id", "left_semi")
    several = rows.join(kept.where("n > 1").select("doc_id"), "doc_id", "left_semi")
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    least = several.groupBy("doc_id").agg(F.min(F.struct("text", *others)).alias("row")).select("doc_id", "row.*")
    return single.select(*COLUMNS).union(least.select(*COLUMNS)).union(rows.where("doc_id IS NULL"))


def blank_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind in brackets; n_chars follows."""
    rows = _rows(docs).select(F.struct("doc_id", "lang", "source").alias("row"), "text")
    found = find_personal_data(rows, train_field(rows), key="row", redact=True)
    return found.select("doc_id.doc_id", F.col("redacted").alias("text"), "doc_id.lang", "doc_id.source", F.length("redacted").cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4,096 tokens and their places in packed sequences."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_each_group),
    ("pii", blank_personal_data),
    ("best_fit_packing", pack_sequences),
]

# Trained classifiers and a tokenizer's file decide these rows, so SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents. Each stage's result is written as Parquet under the
    checkpoint folder, which all executors share, and read again as the next one's input; the
    folders stay, as the checkpoints do."""
    base = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        path = f"{base}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
