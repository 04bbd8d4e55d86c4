"""The operators' registered queries, and SQL where SQL can express them."""

from __future__ import annotations

from rillcep.llm import chat, decontaminate, katz, language, minhash, packing, suffix, toxicity, urlfilter, vectors

QUERIES = {
    "op1_nnpu_toxicity": toxicity.query,
    "op2_graph_embedding_dedup": vectors.query,
    "op3_katz_backoff": katz.query,
    "op4_url_filter": urlfilter.query,
    "op5_suffix_dedup": suffix.query,
    "op6_power_of_two_packing": packing.query,
    "op7_seed_align_decontamination": decontaminate.query,
    "op8_compression_language_id": language.query,
    "op9_minmax_near_dedup": minhash.query,
    "op10_reply_tree_chat": chat.query,
}

_SQL = {"op2_graph_embedding_dedup": vectors.oracle, "op4_url_filter": urlfilter.oracle, "op5_suffix_dedup": suffix.oracle, "op9_minmax_near_dedup": minhash.oracle, "op10_reply_tree_chat": chat.oracle}


def __getattr__(name: str):
    if name == "ORACLES":  # made when asked for, since one holds a fitted model
        return {k: make() for k, make in _SQL.items()}
    raise AttributeError(name)
