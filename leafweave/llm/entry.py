"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from leafweave.llm import chat_format, decontaminate, exact_dedup, html_extract, line_dedup, packing, quality, simhash, toxicity, warc


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_simhash": simhash.op2_simhash,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_chat_format": chat_format.op4_chat_format,
        "op5_packing": packing.op5_packing,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_warc": warc.op7_warc,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_html_extract": html_extract.op9_html_extract,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op4_chat_format": chat_format.OP4_SQL,
        "op6_exact_dedup": exact_dedup.OP6_SQL,
        "op7_warc": warc.OP7_SQL,
        "op10_line_dedup": line_dedup.OP10_SQL,
    }
