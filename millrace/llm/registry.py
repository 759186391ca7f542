"""Queries of this subpackage and their SQL, by the names that the entry module registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import chat, exact_dedup, html, inverted, licenses, minhash, mixing, packing, quality, sharding, spelling, substrings, trie


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_perspective_rotation": chat.op1,
        "op2_swap_packing": packing.op2,
        "op3_distribution_divergence": quality.op3,
        "op4_streaming_dedup": exact_dedup.op4,
        "op5_interleaved_shards": sharding.op5,
        "op6_hash_threshold_mix": mixing.op6,
        "op7_site_templates": html.op7,
        "op8_superminhash": minhash.op8,
        "op9_license_rules": licenses.op9,
        "op10_levelwise_doubling": substrings.op10,
        "op11_partial_tries": trie.op11,
        "op12_automaton_halves": spelling.op12,
        "op13_positional_index": inverted.op13,
    }


def oracles() -> dict[str, str]:
    return {
        "op1_perspective_rotation": chat.OP1_SQL,
        "op3_distribution_divergence": quality.OP3_SQL,
        "op4_streaming_dedup": exact_dedup.OP4_SQL,
        "op5_interleaved_shards": sharding.OP5_SQL,
        "op6_hash_threshold_mix": mixing.OP6_SQL,
        "op11_partial_tries": trie.OP11_SQL,
        "op12_automaton_halves": spelling.OP12_SQL,
        "op13_positional_index": inverted.OP13_SQL,
    }
