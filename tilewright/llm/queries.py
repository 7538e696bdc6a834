"""Queries over whole tables, one for each operator, with production parameters; SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language, licenses, mixing, pii, quality, secrets, simhash, sstable, toxicity, trie, wordpiece

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secrets.query,
    "op2_sstable_shards": sstable.query,
    "op3_quality_cascade": quality.query,
    "op4_wordpiece_counts": wordpiece.query,
    "op5_mixing": mixing.query,
    "op6_license_scan": licenses.query,
    "op7_simhash_near_duplicates": simhash.query,
    "op8_toxicity": toxicity.query,
    "op9_decontaminate": decontaminate.query,
    "op10_pii": pii.query,
    "op11_prefix_trie": trie.query,
    "op12_language_id": language.query,
}

SQL: dict[str, str] = {
    "op3_quality_cascade": quality.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op11_prefix_trie": trie.SQL,
}
