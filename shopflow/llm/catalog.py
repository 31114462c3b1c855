"""Registered queries of this package and their DuckDB SQL.

SQL is given only where it can state a query's whole result; the tests hold
the others against brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shopflow.llm import chat, fptree, licenses, manifest, merkle, ngram_join, packing, perplexity, pieces, quality, secrets, sharding, warc
from shopflow.llm.sql import ORACLE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_index_merge": warc.query,
    "op2_license_diagonals": licenses.query,
    "op3_ngram_jaccard_join": ngram_join.query,
    "op4_merkle_fingerprints": merkle.query,
    "op5_hierarchical_quality": quality.query,
    "op6_secret_ownership": secrets.query,
    "op7_external_shuffle": sharding.query,
    "op8_group_packing": packing.query,
    "op9_piece_spans": pieces.query,
    "op10_ngram_perplexity": perplexity.query,
    "op11_fptree_search": fptree.query,
    "op12_manifest_descent": manifest.query,
    "op13_prefix_target_chat": chat.query,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
