"""Queries over the operators of this folder and, where SQL can say it, their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import (
    bpe, content_sort, language, lines, mixing, ngram_join, posting_lists, prefix_trie,
    quality, suffix, token_counts, toxicity, value_codes,
)
from codeloom.plans.corpora import table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_documents(spark, sf_dir))


def op2_bpe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_documents(spark, sf_dir))


def op8_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.content_groups(_documents(spark, sf_dir))


def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op3_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return language.identify(docs, language.fit(docs))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), table(spark, sf_dir, "labels")
    return toxicity.score_documents(docs, toxicity.fit(docs, labels))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_documents(spark, sf_dir))


def op7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.recounted(_documents(spark, sf_dir), token_counts.cleaning_edits)


def op5_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_decisions(_documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_value_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_codes.compressed(table(spark, sf_dir, "embeddings"))


def op13_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op5_line_join": op5_line_join,
    "op7_edit_counts": op7_edit_counts,
    "op6_repeated_passages": op6_repeated_passages,
    "op10_toxicity": op10_toxicity,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op3_cross_parsing": op3_cross_parsing,
    "op1_quality_rules": op1_quality_rules,
    "op2_bpe_documents": op2_bpe_documents,
    "op8_content_sort": op8_content_sort,
    "op9_pareto_mix": op9_pareto_mix,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_value_codes": op12_value_codes,
    "op13_posting_lists": op13_posting_lists,
}
ORACLES = {
    "op8_content_sort": content_sort.SQL, "op9_pareto_mix": mixing.SQL,
    "op11_prefix_trie": prefix_trie.SQL, "op12_value_codes": value_codes.SQL,
}
