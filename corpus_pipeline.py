"""From documents to token files, in five stages. Each is one operator of ``evidencelake.llm`` with its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidencelake.llm import decontaminate, mixing, ngram_join, repetition
from evidencelake.llm.queries import file_order, token_file_digests
from evidencelake.session import configure, materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words do not mostly repeat one another; null, empty and short texts go. Repeated rows are judged alike; an empty table stays empty, here and in all stages."""
    return repetition.drop_repetitive(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each class that three quarters of common 5-word shingles link; of repeated rows one. Null and empty texts are like no other and stay; rows of null or equal id are documents of their own."""
    return ngram_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than half of every benchmark item; null and empty texts hold nothing, and an empty benchmark drops nothing."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to weights 3, 1, 2 takes them, in the order of their shards and shuffled within each; a null source is a source, null texts have no words."""
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bit-packed token files of all that is left, in the order of the files that the mix was written to, digested per document from the token files; null texts are empty documents."""
    return token_file_digests(spark, docs, file_order(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_files),
]
#: SQL expresses neither the suffix arrays nor the tiling nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written to the shared folder and read again as the next one's input."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
