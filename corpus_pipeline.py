"""A corpus in five stages: quality rules, near-duplicates, benchmark decontamination, personal data, token ids.

Each stage takes what its predecessor kept, as Parquet in the shared folder, so a lost executor costs the tasks of one stage at most.

In every stage: rows with null ids count as rows; a null text has no words (quality rules reject it), as an empty one; texts of any length are read whole; repeated
rows are rows of their own until near-dedup leaves one of them; an empty table gives an empty result with the same columns; columns besides doc_id and text
are carried along, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspace.llm.bpe import bpe_encode
from loomspace.llm.common import fresh_path, read_table, remove, scratch
from loomspace.llm.decontamination import decontaminated
from loomspace.llm.pii import redacted
from loomspace.llm.quality_rules import quality_filter
from loomspace.llm.queries import tokenizer_path
from loomspace.llm.simhash_dedup import simhash_filter


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules keep. The rules are fitted on these very documents; without documents nothing is kept."""
    return quality_filter(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id, null last; texts without words are one group."""
    return simhash_filter(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; all of them if the benchmark is empty. Equal ids with different texts are decided apart."""
    return decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; n_chars, if there is such a column, follows the text (null for a null text)."""
    made = redacted(docs)
    return made.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else made


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token ids of each document; a null text encodes as the empty one."""
    return bpe_encode(docs, tokenizer_path())


STAGES = [
    ("quality rules", keep_good),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("pii", redact),
    ("bpe", encode),
]

#: No SQL: SimHash votes over XXH64, the fitted rule weights and BPE merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table of documents. What a stage wrote for itself is deleted when it ends, and its result when the next one has ended."""
    docs, last = read_table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"corpus-{k}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
