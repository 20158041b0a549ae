"""The opN_ queries, each over its whole table with production parameters, and their SQL where it can express them."""

from __future__ import annotations

import importlib

from .common import table

#: query name: module of this folder, function (spark, sf_dir) of it
WHERE = {
    "op1_html_extraction": ("html_extraction", "extracted", "pages"),
    "op2_minhash_dedup": ("minhash_dedup", "near_groups", "documents"),
    "op3_language_id": ("language_id", "language_of_documents", "documents"),
    "op4_best_fit_packing": ("packing", "packed_documents", "documents"),
    "op5_fingerprints": ("fingerprints", "fingerprints", "documents"),
    "op6_personal_data": ("pii", "personal_data", "documents"),
    "op7_source_mixing": ("mixing", "mixed_sizes", "documents"),
    "op8_lm_scoring": ("lm_scoring", "scored", "documents"),
    "op9_suffix_dedup": ("suffix_dedup", "repeats_removed", "documents"),
    "op10_embedding_dedup": ("embedding_dedup", "near_vectors", "embeddings"),
}
ORACLE_MODULES = {"op2_minhash_dedup": "minhash_dedup", "op7_source_mixing": "mixing", "op10_embedding_dedup": "embedding_dedup"}


def _query(name: str):
    module, function, source = WHERE[name]
    run = getattr(importlib.import_module(f".{module}", __package__), function)

    def query(spark, sf_dir):
        return run(spark.read.parquet(table(sf_dir, source)))

    return query


QUERIES = {name: _query(name) for name in WHERE}
ORACLE_SQL = {name: importlib.import_module(f".{module}", __package__).ORACLE for name, module in ORACLE_MODULES.items()}
