"""A corpus pipeline: each stage is one operator over all that its predecessor kept.

In every stage a null or empty text has no words, extra columns pass through unchanged, an
extra column whose name an operator uses inside keeps its name and values, and an empty
table gives an empty table. Stages tell what else is defined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evenkeel.llm import decontamination, minhash_dedup, mixing, quality_rules, sharding
from evenkeel.sources.tables import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the decision list learned from labels.

    A text of fewer than 50 words, null and empty ones too, goes. Repeated rows are judged alike.
    Labels that are null or of unknown documents are ignored; of several for one document the
    lowest holds; without usable labels the base rules alone decide.
    """
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least doc_id.

    Of different texts under that id the one of the least hash stays. Documents without a word are no copies of
    each other, and all stay. Exact repeats of the row that stays, doc_id and text alike, stay too.
    """
    return minhash_dedup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts hold none. Repeated rows are judged alike. Items without a word match nothing;
    repeated items count once.
    """
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the source, language and topic targets.

    A null source or language is a name of its own. A row is kept or not by a hash of its doc_id, so
    that rows with one id share their fate. Names without a target weigh by their own tokens; goals
    that no sample meets are named in a warning.
    """
    return mixing.sample(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard, and the shard's bytes and rows.

    A null text has no bytes. A row larger than the limit has a shard for itself; repeated rows are told apart
    by their place. A column named like one of those added is renamed with own_ before it.
    """
    return sharding.shard_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
    ("sharding", shard),
]

#: The learned list and the similarity classes have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = materialize(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
