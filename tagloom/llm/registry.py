"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from . import chat, langid, lines, minhash, mixing, packing, paragraphs, pii, quality, spotsigs


def queries() -> dict:
    return {f.__name__: f for f in (
        lines.op1_line_dedup,
        langid.op2_language_id,
        quality.op3_quality_rules,
        chat.op4_chat_formatting,
        pii.op5_pii,
        spotsigs.op6_spotsigs,
        packing.op7_packing,
        paragraphs.op8_paragraph_dedup,
        minhash.op9_minhash,
        mixing.op10_mixing,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality.oracle(), "op4_chat_formatting": chat.oracle(), "op6_spotsigs": spotsigs.oracle(), "op10_mixing": mixing.oracle()}
