"""From raw documents to packed sequences: language, toxicity, near copies, packing.

Each stage takes the documents its predecessor kept. Between stages the documents are written as
Parquet, so a lost executor costs a reread.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborfolio.llm import language, packing, simhash, toxicity
from arborfolio.llm.shared import Workspace, table

#: A document stays if its language is told with at least this much of the score.
LEAST_LANGUAGE_SCORE = 0.5


def _apart(docs: DataFrame) -> tuple[DataFrame, list]:
    """The documents with all columns but text renamed, so none clashes with an operator's, and the way back."""
    names = {c: "text" if c == "text" else f"doc_{k}" for k, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(names), [F.col(n).alias(c) for c, n in names.items()]


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters and undecided ones go."""
    apart, back = _apart(docs)
    told = language.identify(apart, language.fit_language(docs), apart.columns)
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(back)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't mark as toxic."""
    apart, back = _apart(docs)
    scored = toxicity.score(apart, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep=apart.columns)
    return scored.where("predicted = 0").select(back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies; rows that share an id but not a text are different documents."""
    return simhash.one_of_each(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in windows."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", keep_known_language),
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("packing", pack_windows),
]

#: Learned models, SimHash and tokenizer ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    space, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = space.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
