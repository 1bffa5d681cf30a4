"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from evq.llm import decontaminate, lines, packing, paragraphs, pii, quality, secrets, simhash, suffix, warc

QUERIES = {
    "op1_quality": quality.query,
    "op2_warc": warc.query,
    "op3_lines": lines.query,
    "op4_paragraphs": paragraphs.query,
    "op5_decontaminate": decontaminate.query,
    "op6_suffix": suffix.query,
    "op7_secrets": secrets.query,
    "op8_simhash": simhash.query,
    "op9_packing": packing.query,
    "op10_pii": pii.query,
}

ORACLES = {
    "op1_quality": quality.ORACLE,
    "op2_warc": warc.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
    "op7_secrets": secrets.ORACLE,
    "op10_pii": pii.ORACLE,
}
