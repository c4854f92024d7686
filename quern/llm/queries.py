"""The operators' queries over their whole tables, and their SQL where it can say them."""

from __future__ import annotations

import importlib

#: module, query
MODULES = {
    "op2_block_labeller": "html_extract",
    "op10_repeats": "suffix_dedup",
    "op5_simhash_dedup": "near_dedup",
    "op9_toxicity": "toxicity",
    "op8_bpe_codec": "bpe",
    "op1_quality_ledger": "quality",
    "op3_url_rules": "url_rules",
    "op4_exact_dedup": "exact_dedup",
    "op6_cube_mixing": "mixing",
    "op7_bin_packing": "sharding",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"quern.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in MODULES.items():
        sql = getattr(importlib.import_module(f"quern.llm.{module}"), "SQL", None)
        if sql:
            found[name] = sql
    return found
