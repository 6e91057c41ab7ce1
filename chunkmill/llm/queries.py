"""Registered queries of the training-data operators: name -> builder, and SQL where SQL can say it."""

from __future__ import annotations

from . import bpe_codec, html_extract, language, lexical_search, minhash_forest, mixing, packing, phrases, quality_ledger, suffix_dedup, url_filter, vector_dedup, warc
from .common import prepare

MODULES = {
    "op4_suffix_intervals": suffix_dedup,
    "op6_lsh_forest": minhash_forest,
    "op3_nearest_url_diff": html_extract,
    "op1_source_mix": mixing,
    "op5_subspace_pigeonhole": vector_dedup,
    "op2_rank_order_language": language,
    "op10_harmonic_packing": packing,
    "op7_url_vocabulary": url_filter,
    "op8_warc_segments": warc,
    "op9_quality_ledger": quality_ledger,
    "op11_toivonen_phrases": phrases,
    "op12_hybrid_ranking": lexical_search,
    "op13_bpe_backtracking": bpe_codec,
}


def _builder(module):
    def run(spark, sf_dir):
        prepare(spark)
        return module.query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _builder(m) for name, m in MODULES.items()}


def oracle_sql() -> dict:
    return {name: m.ORACLE for name, m in MODULES.items() if getattr(m, "ORACLE", None)}
