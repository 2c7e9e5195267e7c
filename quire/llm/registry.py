"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import op1_sharding, op10_jaccard, op11_whitening, op12_toxicity, op13_audit, op2_bpe, op3_pii, op4_quality, op5_secrets, op6_decontam, op7_warc, op8_url_filters, op9_repeats


def queries() -> dict:
    return {
        "op1_sharding": op1_sharding.query,
        "op2_bpe": op2_bpe.query,
        "op3_pii": op3_pii.query,
        "op4_quality": op4_quality.query,
        "op5_secrets": op5_secrets.query,
        "op6_decontam": op6_decontam.query,
        "op7_warc": op7_warc.query,
        "op8_url_filters": op8_url_filters.query,
        "op9_repeats": op9_repeats.query,
        "op10_jaccard": op10_jaccard.query,
        "op11_whitening": op11_whitening.query,
        "op12_toxicity": op12_toxicity.query,
        "op13_audit": op13_audit.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filters": op8_url_filters.SQL, "op13_audit": op13_audit.SQL}
