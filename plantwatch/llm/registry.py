"""The text operators' queries and their SQL, by name."""

from __future__ import annotations

from functools import wraps

from plantwatch.llm.decontaminate import op1_template_leaks
from plantwatch.llm.dedup_lines import op7_repeated_units
from plantwatch.llm.html_text import op3_main_text
from plantwatch.llm.packing import op5_best_fit
from plantwatch.llm.pii import op2_pii
from plantwatch.llm.quality import op8_compression_bands
from plantwatch.llm.secrets import op10_markov_secrets
from plantwatch.llm.simhash import op9_simhash
from plantwatch.llm.toxicity import op6_toxicity
from plantwatch.llm.warc import op4_warc_index
from plantwatch.session import ship


def _shipped(f):
    @wraps(f)
    def run(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict:
    return {f.__name__: _shipped(f) for f in (op1_template_leaks, op2_pii, op3_main_text, op4_warc_index, op5_best_fit, op6_toxicity, op7_repeated_units, op8_compression_bands, op9_simhash, op10_markov_secrets)}


def oracle_sql() -> dict:
    return {}
