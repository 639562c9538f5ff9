"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``, whatever
their names beyond doc_id, text, lang, source and n_chars; every stage gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stocktake.llm import divergence, jaccard_join, mixing, packing, secrets
from stocktake.llm.shared import table, written
from stocktake.llm.tokens import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged; null and empty texts go, equal rows go or stay together."""
    return divergence.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each near-duplicate group, by row: rows without a doc_id come last, and of repeated rows one stays; texts without words all stay."""
    return jaccard_join.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every reported secret replaced by a mark; null and empty texts as they are, equal rows alike."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out as the mix of sources takes them; null sources are a source, repeated rows are drawn one by one."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 4096 tokens; a null or empty text is its end id, repeated rows are packed as often as they occur."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), cache=60_000)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("secret scan", secret_scan), ("mixing", mix_sources), ("packing", pack_sequences)]

#: SQL has no tokenizer, sketch or Pareto sample; tests/llm/test_pipeline.py compares each stage with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
