"""The queries of this subpackage, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from quarrystone.llm import (
    best_fit_packing,
    collision_ann,
    collocations,
    histogram_shards,
    language_id,
    line_dedup,
    prefix_trie,
    quality_cnn,
    quality_rules,
    simhash_dedup,
    source_mixing,
    token_file,
    toxicity,
)

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_quality_rules": quality_rules.query,
    "op3_language_id": language_id.query,
    "op4_collision_ann": collision_ann.query,
    "op5_simhash_dedup": simhash_dedup.query,
    "op6_token_file": token_file.query,
    "op7_best_fit_packing": best_fit_packing.query,
    "op8_toxicity": toxicity.query,
    "op9_source_mixing": source_mixing.query,
    "op10_quality_cnn": quality_cnn.query,
    "op11_collocations": collocations.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_histogram_shards": histogram_shards.query,
}

ORACLE = {
    "op1_line_dedup": line_dedup.SQL,
    "op9_source_mixing": source_mixing.SQL,
    "op11_collocations": collocations.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
}
