"""A training-data pipeline: each stage works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapweave.llm import decontamination, mixing, ngram_join, token_store, toxicity
from snapweave.llm._tables import checkpoint, drop_ids, shared_folder, small_batches, table
from snapweave.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; rows with a null doc_id stay."""
    with small_batches(spark):
        scores = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"))
        return drop_ids(docs, scores.filter("predicted = 1"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at similarity 0.8 the least doc_id stays.

    Documents without words stay, each its own group; rows with a null doc_id stay. Of rows that
    repeat a doc_id, the one with the least text stays.
    """
    with small_batches(spark):
        groups = checkpoint(ngram_join.jaccard_components(docs, words=5, p=8, q=10))
    kept = drop_ids(docs, groups.filter("doc_id <> component_id"))
    twice = checkpoint(groups.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"))
    if twice.isEmpty():
        return kept
    again = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])).alias("row"))
    return drop_ids(kept, twice).unionByName(again.select("doc_id", "row.*").select(*docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows with a null doc_id stay."""
    with small_batches(spark):
        return drop_ids(docs, decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of each source as often as its target takes them, whole documents only."""
    return mixing.mixed_documents(docs)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids in the binary format, read back: one row per row of docs."""
    folder = shared_folder(spark, "corpus")
    token_store.write(docs, folder, tokenizer_path())
    return token_store.read(spark, folder)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_copies),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix_sources),
    ("token_store", store_tokens),
]

#: SQL can't express the trained classifier of the first stage; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir.

    Each stage's result is written as Parquet in the shared folder and read as the next one's docs.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
