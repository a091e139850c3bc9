"""From raw documents to a training mix, in five stages of the operators in lakesieve.llm.

Each stage gets (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of `documents`; the last
one returns a row for each copy that the mix takes, with the number of the copy. run() writes what each stage returns as
Parquet into the shared folder and reads it again, so that a lost executor repeats one stage at most.

Null and empty texts have no words and go in the first stage, as does junk; a very long text is handled whole by every
stage. A null id is a document of its own: it is nobody's copy, comes last where passages repeat, and draws like any
other. Rows of equal id share a component, so that all or none of them stay if another document has the least id; equal rows
have copies of their own in the mix. Ties (equal sizes, equal ranks) go by id, then by the row's hash. An empty table
passes through every stage as an empty table with the same columns. Extra columns go along, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakesieve.llm import decontamination, jaccard_join, mixing, quality_rules, suffix_dedup
from lakesieve.llm._spark import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy web-1 rejects go."""
    return quality_rules.filter_documents(docs, "web-1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that of least doc_id stays."""
    return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes that occur earlier go; n_chars follows the text."""
    return suffix_dedup.dedup_documents(docs, n_chars="n_chars" if "n_chars" in docs.columns else None)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    return decontamination.filter_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes."""
    return mixing.mix_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("mixing sources", mixed),
]
#: SQL can't express the stages on pairs and passages over whole tables; tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
