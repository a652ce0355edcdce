"""Queries of the training-data operators: one ``opN_<name>`` each, and their SQL."""

from __future__ import annotations

from . import (conversation_repair, cross_polytope, dac, jaccard_join, katz, language_id, packing, positional_index,
               quality_rules, sentencepiece_lattice, spelling, substring_dedup, toxicity)

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_packing": packing.query,
    "op4_toxicity": toxicity.query,
    "op5_dac": dac.query,
    "op6_cross_polytope": cross_polytope.query,
    "op7_sentencepiece": sentencepiece_lattice.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_katz": katz.query,
    "op10_quality_rules": quality_rules.query,
    "op11_spelling": spelling.query,
    "op12_positional_index": positional_index.query,
    "op13_conversation_repair": conversation_repair.query,
}
ORACLE_SQL = {
    "op2_substring_dedup": substring_dedup.ORACLE_SQL,
    "op8_jaccard_join": jaccard_join.ORACLE_SQL,
    "op11_spelling": spelling.ORACLE_SQL,
    "op12_positional_index": positional_index.ORACLE_SQL,
    "op13_conversation_repair": conversation_repair.ORACLE_SQL,
}
