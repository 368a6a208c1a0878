"""From raw documents to a training mix: quality, near-duplicates, repeated passages, benchmark leaks, weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.

Defined results of every stage: null and empty texts go through (the classifier scores them, blank texts are one group of
near-duplicates, nothing is cut from them, they hold no benchmark item, and the mix never takes a document without words);
null ids come last in both dedup stages, null languages and sources are nodes of their own in the mix; very long texts are read whole; of a group of
near-duplicates the smallest id stays, any one of rows that tie; repeated rows stay but in the near-dedup stage; extra columns
are kept whatever their names, but ones named like a column that a stage adds for its work (``simhash_*``, ``repeat_spans``,
``quality_score_of_stage``, in the mix ``mix_*``, ``n_tokens``, ``n_copies``) go; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import decontamination, mixing, quality_ranker, queries, simhash, suffix_repeats
from weftwork.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality_ranker.accepted(docs, queries.quality_of(spark, docs, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles with a Jaccard similarity of 0.8 or more."""
    return simhash.keep_one_of_similar(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the bytes that repeat an earlier passage; characters stay whole and n_chars follows."""
    out = suffix_repeats.remove_repeats(docs).drop("repeat_spans")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents taken for the mix, with their domain, tokens and number of copies."""
    return mixing.mix(docs, queries.MIX_WEIGHTS, 80, queries.MIX_EPOCHS, queries.MIX_SEED)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
]

#: Fingerprints and learned scores are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
