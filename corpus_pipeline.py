"""Corpus pipeline: documents in, packed training sequences out.

``STAGES`` names the stages in order.  Each takes (spark, docs, sf_dir) and
returns a DataFrame; ``run`` writes every stage's result to the shared folder
and reads it back as the next one's documents.  All but the last return the
columns of ``documents``.

Defined results: a null text is empty, so it fails the rules; nulls in other
columns are kept as they are; texts are read whole; rows with null or repeated
doc_ids and repeated rows pass or fail by their own texts, and of linked ones
those with the smallest doc_id stay; extra columns stay, whatever their names;
an empty table passes every stage as an empty one.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession

from shopflow.llm import ngram_join, packing, perplexity, quality, secrets
from shopflow.llm.common import SMALL_BATCHES, begin_scope, materialize, read_table, settings


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that fail the rules or their language's band go."""
    return perplexity.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents taken for low quality or toxic go."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each group of linked ones stays (five-word
    shingles, similarity 0.8)."""
    return ngram_join.keep_first(docs, width=5, threshold=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: live-looking credentials are masked."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the packed sequences of all documents, with their ids."""
    return packing.packed_sequences(docs)


#: The stages, and whose working tables go when one begins: those that its
#: documents were made from further back, never those of a result that may
#: still be read.
_STAGES = [
    ("quality_rules", quality_rules, []),
    ("quality_classifier", quality_classifier, []),
    ("near_duplicates", near_duplicates, ["quality_rules"]),
    ("secret_scan", secret_scan, ["quality_rules"]),
    ("packing", pack, ["quality_rules", "quality_classifier", "near_duplicates"]),
]


def _own_tables(name: str, stage, ended: list[str]):
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        begin_scope(spark, f"work-{name}", [f"work-{n}" for n in ended])
        with settings(spark, SMALL_BATCHES):
            return stage(spark, docs, sf_dir)
    return run_stage


STAGES = [(name, _own_tables(name, stage, ended)) for name, stage, ended in _STAGES]

#: SQL expresses neither the models nor the tokenizer; the tests hold what the
#: first two stages keep against their operators' verdicts, near duplicates and
#: packed ids against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the whole ``documents`` table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = stage(spark, docs, sf_dir)
        begin_scope(spark, f"result-{uuid.uuid4().hex[:8]}")
        docs = materialize(rows, f"stage-{name}")
    begin_scope(spark, "tables")
    return docs
