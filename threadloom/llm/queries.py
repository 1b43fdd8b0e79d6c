"""The queries of this subpackage for the driver's entry module, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, html_text, mixing, packing, pii, shingles, suffixes, toxicity, vectors


def queries() -> dict:
    return {
        "op1_topk": vectors.op1_topk,
        "op2_mix": mixing.op2_mix,
        "op3_neardup": vectors.op3_neardup,
        "op4_html": html_text.op4_html,
        "op5_pack": packing.op5_pack,
        "op6_jaccard": shingles.op6_jaccard,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_pii": pii.op8_pii,
        "op9_chat": chat.op9_chat,
        "op10_suffixes": suffixes.op10_suffixes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk": vectors.ORACLE_TOP_K,
        "op2_mix": mixing.ORACLE,
        "op3_neardup": vectors.ORACLE_NEAR,
        "op6_jaccard": shingles.ORACLE,
        "op9_chat": chat.ORACLE,
        "op10_suffixes": suffixes.ORACLE,
    }
