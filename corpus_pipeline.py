"""Training sequences from raw documents, in five stages.

Documents in no language go, then exact copies, then all but one of each group of near copies, then
documents with a benchmark passage; what is left is packed into token sequences. Every stage works
on all rows its predecessor kept, which are written to the shared folder in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quayside.llm.common import stored, table
from quayside.llm.decontamination import decontaminated
from quayside.llm.exact_dedup import without_copies
from quayside.llm.jaccard_join import without_near_copies
from quayside.llm.language_id import in_some_language
from quayside.llm.packing import TOKENIZER, pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_some_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # A small cache of words: the executors still hold what the stages before needed.
    return pack(docs, public_tokenizers.path(TOKENIZER), cached_words=250_000)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot express the recurrent network, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents that every stage keeps."""
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = stored(stage(spark, rows, sf_dir), name)
    return rows
