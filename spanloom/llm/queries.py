"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import decontam, langid, line_dedup, mixing, ngram_join, pivots, prefix_trie, quality, ranked_search, sstable, substring_dedup, token_counts, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_mixing": mixing.op2_mixing,
    "op3_token_ids": sstable.op3_token_ids,
    "op7_pivot_index": pivots.op7_pivot_index,
    "op8_warc": warc.op8_warc,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_decontamination": decontam.op10_decontamination,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_quality": quality.op5_quality,
    "op6_language_id": langid.op6_language_id,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_substring_dedup": substring_dedup.op12_substring_dedup,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.ORACLE,
    "op11_ranked_search": ranked_search.ORACLE,
    "op12_substring_dedup": substring_dedup.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
