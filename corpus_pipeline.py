"""A training corpus from ``documents``: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet and
read again as the next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import codeloom
from codeloom.llm import bpe, content_sort, language, mixing, ngram_join
from codeloom.llm.tables import stored
from codeloom.plans.corpora import table

# Python functions travel with the tasks, so executors need no installed package
cloudpickle.register_pickle_by_value(codeloom)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null texts, texts without a letter) go. Without any
    labelled document there is no language to tell; then only these go as well."""
    model = language.fit(docs)
    found = language.with_language(docs, model)
    lettered = F.col("row.text").rlike(r"\p{L}")
    known = found.lang_pred != language.UNKNOWN if model.langs else lettered
    return found.where(known).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    return content_sort.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest id stays."""
    return ngram_join.keep_first(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document of the mix."""
    return bpe.encode_documents(docs)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources", mix_stage),
    ("BPE encoding", encode_stage),
]

#: The stages of the language model and of the tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
