"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from . import ann, bpe, chat, fingerprint, html, neardup, packing, quality, toxicity
from .common import table


def _documents(f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_bpe_codec": _documents(bpe.op2_bpe_codec),
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_ann_search": ann.op5_ann_search,
    "op6_token_counts": _documents(bpe.op6_token_counts),
    "op7_best_fit_packing": _documents(packing.op7_best_fit_packing),
    "op8_minhash_near_dedup": _documents(neardup.op8_minhash_near_dedup),
    "op9_document_fingerprints": _documents(fingerprint.op9_document_fingerprints),
    "op10_html_extraction": lambda spark, sf_dir: html.op10_html_extraction(table(spark, sf_dir, "pages")),
}

#: DuckDB SQL for the operators that SQL can express.
ORACLE_SQL: dict[str, str] = {}
