"""The corpus pipeline: stages that each read what their predecessor kept, written as Parquet in between.

Every stage takes any table with doc_id and text, further columns stay as they are, and an empty table gives an empty one.
Null texts count as empty; rows given twice, or with a null id, are told apart by id and text together.
"""

from __future__ import annotations

from tidemark.llm.common import clean_up, materialize, table, tables_written
from tidemark.llm.decontamination import drop_leaks
from tidemark.llm.exact_dedup import keep_largest
from tidemark.llm.jaccard_join import keep_one
from tidemark.llm.pieces import encode
from tidemark.llm.quality import keep_good


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go; a score of the threshold itself stays, and without labels all stay."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark, docs, sf_dir):
    """Of equal texts the one with the largest id stays; one with a null id only where all ids are null, and of rows given twice all stay or go."""
    return keep_largest(docs)


def near_dedup_stage(spark, docs, sf_dir):
    """Of each class of similar texts the one with the smallest id stays; texts without words are classes of their own."""
    return keep_one(docs)


def decontamination_stage(spark, docs, sf_dir):
    """Documents that hold a benchmark item go; without a benchmark, or with items without words only, all stay."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pieces_stage(spark, docs, sf_dir):
    """What stays, as sampled pieces that decode to the whole text; an empty text has none."""
    return encode(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("sentencepiece", pieces_stage),
]
#: SQL cannot express the classifier, the sampled pieces or the latent search; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, first = table(spark, sf_dir, "documents"), tables_written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
        clean_up(first, keep=1)  # what the stage read and wrote on the way
    return STAGES[-1][1](spark, docs, sf_dir)
