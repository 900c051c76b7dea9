"""The queries of this subpackage, and their DuckDB SQL where there is one."""

from __future__ import annotations

import importlib

#: query name -> module
MODULES = {
    "op1_lm_score": "scoring",
    "op2_chat": "chat",
    "op3_media": "media",
    "op4_substring_dedup": "passages",
    "op5_jaccard_join": "jaccard",
    "op6_token_ids": "tokens",
    "op7_language": "language",
    "op8_mixing": "mixing",
    "op9_toxicity": "toxicity",
    "op10_decontaminate": "decontaminate",
}


def _query(module: str):
    return lambda spark, sf_dir: importlib.import_module(f".{module}", __package__).query(spark, sf_dir)


def queries() -> dict:
    return {name: _query(module) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f".{module}", __package__), "SQL", None) for name, module in MODULES.items()}
    return {k: v for k, v in found.items() if v}
