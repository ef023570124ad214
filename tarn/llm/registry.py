"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from tarn.llm import matroska, mixing, near_dedup, packing, passages, quality_classifier, quality_rules, quotes, secret_scan, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_quality": quality_classifier.op3_quality,
    "op4_secrets": secret_scan.op4_secrets,
    "op5_passages": passages.op5_passages,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_warc": warc.op7_warc,
    "op8_quotes": quotes.op8_quotes,
    "op9_packing": packing.op9_packing,
    "quoted_replies": quotes.quoted_replies,
    "op10_matroska": matroska.op10_matroska,
}
#: Without one: training, byte-pair encoding and media muxing aren't for SQL; the tests hold those against plain versions.
ORACLES = {
    "op1_mixing": mixing.OP1_SQL,
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op4_secrets": secret_scan.OP4_SQL,
    "op5_passages": passages.OP5_SQL,
    "op6_near_dedup": near_dedup.OP6_SQL,
    "op7_warc": warc.OP7_SQL,
    "op8_quotes": quotes.OP8_SQL,
    "quoted_replies": quotes.QUOTED_SQL,
}
