"""The queries of the operators, and SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: Query and module.
WHERE = {
    "op10_pii": "pii",
    "op11_fim": "fim",
    "op12_quality_model": "nbsvm",
    "op13_phrases": "phrases",
    "op1_token_files": "token_ids",
    "op2_licenses": "licenses",
    "op3_bpe": "bpe",
    "op4_quality": "quality",
    "op5_sharding": "sharding",
    "op6_packing": "packing",
    "op7_topk": "topk",
    "op8_language": "langid",
    "op9_simhash": "simhash",
    "base_licenses": "base_sql",
    "base_quality": "base_sql",
    "base_pii": "base_sql",
}


def queries() -> dict:
    return {name: getattr(import_module(f".{module}", __package__), name) for name, module in WHERE.items()}


def oracle_sql() -> dict[str, str]:
    from .base_sql import SQL
    from .fim import OP11_SQL
    from .phrases import OP13_SQL
    from .topk import OP7_SQL

    return {"op7_topk": OP7_SQL, "op11_fim": OP11_SQL, "op13_phrases": OP13_SQL} | SQL
