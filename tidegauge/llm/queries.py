"""The registered queries of this package and the pipeline, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tidegauge.llm import conversations, decontaminate, language, licenses, periods, pieces, quality, secrets, sharding, simhash, substrings, suffixes, tokens


def llm_queries() -> dict:
    return {
        "op1_rare_words": licenses.op1_rare_words,
        "op2_simple8b": tokens.op2_simple8b,
        "op3_forest": secrets.op3_forest,
        "op4_winnowing": decontaminate.op4_winnowing,
        "op5_isolation": quality.op5_isolation,
        "op6_two_pass": sharding.op6_two_pass,
        "op7_relative_lz": substrings.op7_relative_lz,
        "op8_simhash": simhash.op8_simhash,
        "op9_backoff": language.op9_backoff,
        "op10_offsets": pieces.op10_offsets,
        "op11_tree_contraction": conversations.op11_tree_contraction,
        "op12_suffix_array": suffixes.op12_suffix_array,
        "op13_block_convolution": periods.op13_block_convolution,
        "pipeline": corpus_pipeline.run,
    }


def llm_oracles() -> dict[str, str]:
    return {
        "op4_winnowing": decontaminate.OP4_SQL,
        "op7_relative_lz": substrings.OP7_SQL,
        "op11_tree_contraction": conversations.OP11_SQL,
        "op12_suffix_array": suffixes.OP12_SQL,
        "op13_block_convolution": periods.OP13_SQL,
    }
