"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import collocations, decontaminate, embedding_dedup, hard_negatives, html_text, license_scan, ngram_join, quality_rules, toxicity, url_filter
from .bpe_codec import op8_bpe_codec
from .token_counts import op2_token_counts
from .token_store import op7_token_store

QUERIES = {
    "op1_html_text": html_text.op1_html_text,
    "op2_token_counts": op2_token_counts,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_token_store": op7_token_store,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_quality_rules": quality_rules.op11_quality_rules,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_collocations": collocations.op13_collocations,
}

#: DuckDB SQL where SQL can express the query; the others have brute-force tests in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_join": ngram_join.sql(),
    "op4_url_filter": url_filter.SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op9_embedding_dedup": embedding_dedup.SQL,
    "op10_license_scan": license_scan.SQL,
    "op11_quality_rules": quality_rules.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_collocations": collocations.SQL,
}
