"""The corpus pipeline: each stage is one operator of ``airlake.llm`` on all that the stage before it kept.

Documents (doc_id, text, lang, source, n_chars) come in; toxic ones go, one of each group of near-duplicates stays,
documents with benchmark windows go, personal data are replaced by pseudonyms, and what is left gets rates that bring the
languages to their wanted shares of tokens. The last stage keeps all rows and adds their rates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlake import session
from airlake.llm import decontaminate, minhash_tensor, pii_feistel, soft_mix, toxicity
from airlake.llm.common import table
from airlake.llm.queries import KEY, TARGETS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the model is learned from all labelled documents."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), held_out=None)
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id."""
    return minhash_tensor.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in their texts; ``n_chars`` follows the new text."""
    return pii_feistel.pseudonymise(docs, KEY).withColumn("n_chars", F.char_length("text").cast("long"))


def weigh_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their likeliest language, rate and number of copies.

    Membership and rate depend on the row alone once the model and the rates are fitted, so nothing is joined back.
    """
    domains = soft_mix.Domains(soft_mix.labelled_sample(docs, table(spark, sf_dir, "labels"), "lang"))
    return soft_mix.weigh(docs, domains, TARGETS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal-data", replace_personal_data),
    ("mixing", weigh_sources),
]
#: SQL has no Levenshtein automata learned from labels, Feistel networks or gradient steps; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = session.materialize(stage(spark, docs, sf_dir), name)
    return docs
