"""The queries of this subpackage, by name."""

from __future__ import annotations

from . import licences, oracles
from .chat import chat_query
from .decontaminate import contamination_query
from .mixing import mixing_query
from .ngram_join import join_query
from .pii import pii_query
from .quality import quality_query
from .tokens import tokens_query
from .topk import topk_query
from .warc import warc_query


def queries() -> dict:
    return {
        "op1_quality_classifier": quality_query,
        "op2_ngram_jaccard_join": join_query,
        "op3_warc": warc_query,
        "op4_benchmark_decontamination": contamination_query,
        "op5_token_counts": tokens_query,
        "op6_chat_formatting": chat_query,
        "op7_licence_scan": licences.licence_query,
        "op8_temperature_mixing": mixing_query,
        "op9_pii_surrogates": pii_query,
        "op10_exact_top_k": topk_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard_join": oracles.NGRAM_JOIN,
        "op3_warc": oracles.WARC,
        "op4_benchmark_decontamination": oracles.DECONTAMINATION,
        "op7_licence_scan": licences.oracle(),
        "op6_chat_formatting": oracles.CHAT,
        "op8_temperature_mixing": oracles.MIXING,
        "op10_exact_top_k": oracles.TOP_K,
    }
