"""The corpus pipeline: language ID, exact dedup, MinHash near-dedup, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``docs``.  Stages are cut by a written table in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxquarry.llm.decontaminate import remove_contamination
from boxquarry.llm.exact_dedup import drop_exact_copies
from boxquarry.llm.language_id import UNKNOWN, identify_languages
from boxquarry.llm.minhash_dedup import drop_near_copies
from boxquarry.llm.packing import pack
from boxquarry.llm.storage import cut


#: No language claims a document below this: it is about what a mixture of all languages gets.  Of 10,000 documents at scale 0.1 none is below.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in no language go: null, empty or without a letter, or with a best language's score under LEAST_SCORE.

    A table without labels, from which nothing can be learned, keeps all texts that have letters.
    """
    found = identify_languages(docs, with_rows=True, least_score=LEAST_SCORE)
    return found.where((F.col("lang_pred") != UNKNOWN) | (~F.col("learned") & F.col("row.text").rlike("\\p{L}"))).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the most characters stays, then the smallest id."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts linked at Jaccard 0.8 the smallest id stays; a pair at the limit is overlooked with a chance of 3e-6."""
    return drop_near_copies(docs, share=80, bands=32)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go from the texts; a document that is mostly such passages goes as a whole."""
    return remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the language model, the tokenizer or the plan of packing; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
