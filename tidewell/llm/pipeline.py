"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

SQL can express neither the classifier nor the tokenizer, so ORACLE_SQL is None; the
tests hold the pipeline against the operators' brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import cotraining, decontamination, mixing, near_dedup, shared, token_store


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    return cotraining.filter_documents(docs, shared.table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group stays, the one with the smallest id."""
    return near_dedup.deduplicate(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated documents go."""
    return decontamination.decontaminate(docs, shared.table(spark, sf_dir, "benchmark"))


def in_target_shares(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: every document stays; the files, read in order, are the mix."""
    return mixing.mixed(docs)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID output in the order of the mix, which is that of the files read; the store is written and read back, one row for each document."""
    path = shared.place(spark, "corpus")
    token_store.write_store(docs, path, order=("_metadata.file_name", "_metadata.row_index"))
    return token_store.read_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "sound")


STAGES = [
    ("quality_classifier", keep_good),
    ("near_dedup", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("source_mix", in_target_shares),
    ("token_output", as_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What the stages hand on is removed when the token store stands; the store stays.

    Null or repeated ids, null, empty and very long texts, null sources and languages, equal texts and columns of any name do as in
    the operators (see there): the classifier keeps rows without an id, near_dedup keeps one row of a class and all rows without an id,
    the mix orders ties by place. An empty documents table gives no rows; empty labels or an empty benchmark reject nothing.
    """
    docs = shared.table(spark, sf_dir, "documents")
    with shared.Scope(spark, "pipeline") as scope:
        for name, stage in STAGES[:-1]:
            path = scope.place(name)
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
        with scope.outside():
            return STAGES[-1][1](spark, docs, sf_dir)
