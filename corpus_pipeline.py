"""A corpus pipeline of five operators: each stage reads what its predecessor wrote.

``STAGES`` are (name, function) pairs; a function takes the session, the
documents that are left and the folder of the tables.  ``run`` applies them to
the table of documents, writing each stage's result as Parquet in the shared
scratch folder and reading it again.

All stages but the last return the columns of the documents, whatever further
columns there are and whatever their names.  A null or empty text has no words:
it fails the quality rules.  A null lang or source says nothing of the language,
and a null source is a source of its own in the mix.  Rows without a doc_id, and
rows that share one, pass the first two stages each; the third keeps those without
an id and one of those that share one.  Ties go to the first language by name and to the smallest
doc_id.  Very long texts are read whole; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyfold.llm import language, mixing, ngram_join, packing, quality
from tallyfold.llm.shared import stash, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an accepted language go; lang becomes the one found."""
    return language.keep_identified(docs)


def rate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return quality.keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates: the smallest doc_id of each class stays. Five words to a shingle, as for near-duplicate stages."""
    return ngram_join.deduplicate(docs, size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights: a row for each time a document is taken."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences."""
    return packing.packed(docs)


STAGES = [("language ID", identify), ("quality rules", rate), ("n-gram Jaccard join", deduplicate), ("source mix", mix), ("best-fit packing", pack)]

#: Several stages (learned tables, similarity classes, tokens) are beyond SQL; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        # Every stage's texts lie in the folder until the end, so they are packed closer than what one operator writes for itself.
        docs = stash(stage(spark, docs, sf_dir), "stage", codec="zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
