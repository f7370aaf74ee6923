"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from . import (
    op01_katz,
    op02_decontamination,
    op03_language,
    op04_compression,
    op05_secrets,
    op06_simhash,
    op07_urls,
    op08_licenses,
    op09_packing,
    op10_sharding,
    op11_merkle,
    op12_collocations,
    op13_parity,
)

QUERIES = {
    "op1_katz_backoff": op01_katz.op1_katz_backoff,
    "op2_template_decontamination": op02_decontamination.op2_template_decontamination,
    "op3_hierarchical_svm": op03_language.op3_hierarchical_svm,
    "op4_compression_bands": op04_compression.op4_compression_bands,
    "op5_blob_ledger": op05_secrets.op5_blob_ledger,
    "op6_simhash_vp_forest": op06_simhash.op6_simhash_vp_forest,
    "op7_redirect_equivalence": op07_urls.op7_redirect_equivalence,
    "op8_template_automata": op08_licenses.op8_template_automata,
    "op9_histogram_best_fit": op09_packing.op9_histogram_best_fit,
    "op10_rendezvous_sharding": op10_sharding.op10_rendezvous_sharding,
    "op11_merkle_exchange": op11_merkle.op11_merkle_exchange,
    "op12_dynamic_itemsets": op12_collocations.op12_dynamic_itemsets,
    "op13_parity_join": op13_parity.op13_parity_join,
}

ORACLE_SQL: dict[str, str] = {
    "op5_blob_ledger": op05_secrets.ORACLE_SQL,
    "op7_redirect_equivalence": op07_urls.ORACLE_SQL,
    "op8_template_automata": op08_licenses.ORACLE_SQL,
    "op10_rendezvous_sharding": op10_sharding.ORACLE_SQL,
    "op11_merkle_exchange": op11_merkle.ORACLE_SQL,
    "op12_dynamic_itemsets": op12_collocations.ORACLE_SQL,
}
