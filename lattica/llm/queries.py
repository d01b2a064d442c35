"""The corpus operators' queries, as (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Query name -> module that holds it.
MODULES = {
    "op1_winnow": "op1_winnow",
    "op2_quality": "op2_quality",
    "op3_quality_rules": "op3_rules",
    "op6_toxicity": "op6_toxicity",
    "op4_packing": "op4_packing",
    "op5_suffix": "op5_suffix",
    "op7_neardup": "op7_neardup",
    "op8_langid": "op8_langid",
    "op9_ids": "op9_ids",
    "op10_mixing": "op10_mixing",
}


def queries() -> dict[str, Callable]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
