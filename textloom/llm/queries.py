"""Queries opN_<name> of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.decontaminate import op6_benchmark_decontamination
from textloom.llm.html import op4_html_extraction
from textloom.llm.langid import op8_language_id
from textloom.llm.lm import op5_lm_scoring
from textloom.llm.media import op7_media_columns
from textloom.llm.merkle import ORACLE as MERKLE_SQL
from textloom.llm.merkle import op11_merkle_manifest
from textloom.llm.outliers import op12_quality_rules
from textloom.llm.packing import op1_best_fit_packing
from textloom.llm.pii import op3_pii
from textloom.llm.simhash import op9_simhash_near_dedup
from textloom.llm.suffixes import op2_suffix_array_dedup
from textloom.llm.toxicity import op10_toxicity
from textloom.llm.trie import ORACLE as TRIE_SQL
from textloom.llm.trie import op13_conversation_prefix_trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_pii": op3_pii,
    "op4_html_extraction": op4_html_extraction,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_media_columns": op7_media_columns,
    "op8_language_id": op8_language_id,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_quality_rules": op12_quality_rules,
    "op13_conversation_prefix_trie": op13_conversation_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op11_merkle_manifest": MERKLE_SQL,
    "op13_conversation_prefix_trie": TRIE_SQL,
}
