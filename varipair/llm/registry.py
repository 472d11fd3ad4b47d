"""The queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, divergence, edits, jaccard, katz, lines, negatives, pieces, quality, suffixes, tokenstore, warc


def queries() -> dict:
    return {
        "op1_token_counts": edits.op1,
        "op2_katz_scores": katz.op2,
        "op3_suffix_array_dedup": suffixes.op3,
        "op4_jaccard_join": jaccard.op4,
        "op5_warc": warc.op5,
        "op6_pieces": pieces.op6,
        "op7_quality_rules": quality.op7,
        "op8_chat_format": chat.op8,
        "op9_decontamination": decontaminate.op9,
        "op10_token_store": tokenstore.op10,
        "op11_line_runs": lines.op11,
        "op12_hard_negatives": negatives.op12,
        "op13_source_divergence": divergence.op13,
        "quality_policy_ablations": quality.policy_ablations,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op4_jaccard_join": jaccard.SQL4,
        "op5_warc": warc.SQL5,
        "op7_quality_rules": quality.SQL7,
        "quality_policy_ablations": quality.SQL_ABLATIONS,
        "op8_chat_format": chat.SQL8,
        "op9_decontamination": decontaminate.SQL9,
        "op11_line_runs": lines.SQL11,
        "op12_hard_negatives": negatives.SQL12,
        "op13_source_divergence": divergence.SQL13,
    }
