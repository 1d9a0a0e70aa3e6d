"""The queries opN_<name> that apply the operators to whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapweave.llm import additive, decontamination, line_dedup, mixing, ngram_join, outliers, span_dedup, sql, token_store, toxicity, url_filter
from snapweave.llm._tables import shared_folder, table

URL_RULES = [
    ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"),
]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), URL_RULES)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    token_store.write(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return token_store.read(spark, folder)


def op5_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judged(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), words=3, p=9, q=10)


def _digest(spans: DataFrame, items: str) -> DataFrame:
    """(doc_id, number of items, number deleted, spans as text)."""
    return spans.select(
        "doc_id",
        F.col("n").alias(f"n_{items}"),
        F.expr("aggregate(spans, 0L, (a, s) -> a + s.last - s.first + 1)").alias("n_deleted"),
        F.array_join(F.transform("spans", lambda s: F.concat(s["first"].cast("string"), F.lit("-"), s["last"].cast("string"))), ";").alias("deleted"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document that loses lines."""
    return _digest(line_dedup.repeated_lines(table(spark, sf_dir, "documents")), "lines")


def op9_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document that loses sentences."""
    return _digest(span_dedup.repeated_spans(table(spark, sf_dir, "documents")), "sentences")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and benchmark item that it holds."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_source_mixing, op3_toxicity, op4_token_store, op5_quality_outliers, op6_quality_classifier,
        op7_ngram_jaccard_join, op8_line_dedup, op9_span_dedup, op10_decontamination,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_source_mixing": sql.SOURCE_MIXING,
    "op7_ngram_jaccard_join": sql.NGRAM_JACCARD_JOIN,
    "op8_line_dedup": sql.LINE_DEDUP,
    "op9_span_dedup": sql.SPAN_DEDUP,
}
