"""From raw documents to packed training sequences, stage by stage.

Each stage takes the table that the one before it wrote. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscore.llm import common, language, line_dedup, near_join, packing, winnowing
from panelscore.session import checkpoint_folder, remove, scratch


#: Fewer tokens than packing alone remembers: workers that have run the stages before hold more already.
REMEMBERED = 300_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learned from the labelled ones outside the held-out fold."""
    common.small_batches(spark)
    return language.keep_identified(docs, language.train(docs, common.crc_fold() != 1))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines that an earlier document has; emptied documents go."""
    common.small_batches(spark)
    return line_dedup.drop_repeated_lines(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and similar documents."""
    common.small_batches(spark)
    return near_join.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    common.small_batches(spark)
    return winnowing.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, laid out in sequences."""
    common.small_batches(spark)
    return packing.pack_documents(docs, packing.tokenizer_path(), remembered=REMEMBERED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", ngram_jaccard),
    ("benchmark_decontamination", decontamination),
    ("packing", pack),
]

#: No SQL for the trained model and the linear program; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the shared folder, read again by the next stage.

    A stage's own tables go when it has written its result, and that goes when the next stage has written its own. The last
    result stays where ``session.release`` finds it.
    """
    folder = f"{checkpoint_folder(spark)}/panelscore/{spark.sparkContext.applicationId}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(F.col(x) for x in ("doc_id", "text", "lang", "source", "n_chars")))
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if k:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
