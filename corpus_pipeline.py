"""The corpus pipeline: five stages, each of which reads what the one before kept.

Quality rules, line dedup, near-dedup and mixing return documents; the last
stage returns their tokens.  SQL cannot express the robust estimates, the
fingerprints or the encoding, so ``ORACLE_SQL`` is None and the tests hold
``run`` against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.bpe import round_trip
from barloom.llm.common import apart, materialise, read_documents
from barloom.llm.linededup import without_common_lines
from barloom.llm.mixing import mixed_documents
from barloom.llm.quality import good_documents
from barloom.llm.simhash import one_of_each


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that lost lines get a new n_chars."""
    changed = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return apart(docs, ("doc_id", "text", "n_chars"), lambda own: without_common_lines(own).withColumn("n_chars", changed))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of the ids and of the decoded bytes, and the ids."""
    return round_trip(docs, keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing", mixing),
    ("byte-level bpe", byte_bpe),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, "stage")
    return docs
