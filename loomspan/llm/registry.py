"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from functools import wraps

from . import chat, decontaminate, fingerprint, htmltext, lm, near, packing, quality, shared, substring, warc


def _ready(f):
    @wraps(f)
    def run(spark, sf_dir):
        shared.importable(spark)
        return f(spark, sf_dir)

    return run


def queries():
    found = {
        "op1_lm_scoring": lm.op1,
        "op2_decontamination": decontaminate.op2,
        "op3_best_fit_packing": packing.op3,
        "op4_fingerprints": fingerprint.op4,
        "op5_html_text": htmltext.op5,
        "op6_quality_resampling": quality.op6,
        "op7_near_duplicates": near.op7,
        "op8_substring_dedup": substring.op8,
        "op9_warc": warc.op9,
        "op10_chat": chat.op10,
    }
    return {name: _ready(f) for name, f in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": decontaminate.OP2_SQL, "op9_warc": warc.OP9_SQL, "op10_chat": chat.OP10_SQL, "op7_near_duplicates": near.OP7_SQL, "op8_substring_dedup": substring.OP8_SQL}
