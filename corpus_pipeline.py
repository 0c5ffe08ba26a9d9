"""The corpus pipeline: toxic documents, near copies, repeated passages and benchmark text go; the rest is encoded.

STAGES are applied to ``documents`` in turn. Each is a function of (spark, docs, sf_dir); all but the last
return the columns of ``documents``. No SQL can express the first stage, so ORACLE_SQL is None; the stages of
near copies, repeated passages and benchmark text are tested against plain versions (tests/llm).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinsieve.llm import bpe, decontaminate, simhash, suffix_dedup, toxicity
from twinsieve.llm.common import table
from twinsieve.llm.queries import vocabulary_path
from twinsieve.session import written

ORACLE_SQL = None


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the classifier learns outside the held fold."""
    model = toxicity.fit_on_fold(docs, table(spark, sf_dir, "labels"))
    return docs.where(~toxicity.rejected(docs, model))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: four-word shingles, fingerprints within 4 bits, as operator 9."""
    return simhash.deduplicated(docs, distance=4, words=4)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings that start in earlier documents."""
    return suffix_dedup.deduplicated(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return docs.where(~decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them."""
    lexicon = bpe.build_lexicon(docs, vocabulary_path())
    return bpe.round_trip(docs, vocabulary_path(), lexicon, ids_too=True)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_copies", remove_near_copies),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", remove_contaminated),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
