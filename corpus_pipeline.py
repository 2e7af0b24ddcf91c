"""Corpus pipeline: from raw documents to packed training sequences.

Every stage takes the documents that the one before kept, with all their columns,
and its decisions take effect in what it returns.  ``run`` writes each stage's rows
to the folder that the executors share and reads them again, so a lost executor
costs part of one stage; tables of finished stages are deleted.  SQL cannot express the stages (a fitted classifier,
fingerprint components, tokenisation), so ``ORACLE_SQL`` is None; the tests hold
each stage against a brute-force version.

Defined results: a null text is rejected by the first stage (it has no words);
rows that repeat both doc_id and text come out once; an empty table gives an
empty result; extra columns pass through to the last stage, which returns pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultline.llm.common import made, materialize, release, table, tokenizer_path
from faultline.llm.exact_dedup import drop_exact_duplicates
from faultline.llm.packing import pack_documents
from faultline.llm.quality_classifier import drop_low_quality
from faultline.llm.simhash import drop_near_duplicates
from faultline.llm.suffix_dedup import remove_repeats


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer rejects go."""
    return drop_low_quality(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the largest doc_id stays."""
    return drop_exact_duplicates(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the smallest doc_id stays."""
    return drop_near_duplicates(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that a smaller doc_id has go from the text."""
    return remove_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), made(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark, mark, but_last=1)  # what the stage worked with, and the rows of the one before
    return STAGES[-1][1](spark, docs, sf_dir)
