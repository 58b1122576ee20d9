"""Queries and oracle SQL of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

import importlib

#: Query name: module, and whether the module has ORACLE.
_MODULES = {
    "op1_license_scan": "license_scan",
    "op2_nearest": "nearest",
    "op3_secret_scan": "secret_scan",
    "op4_decontaminate": "decontaminate",
    "op5_packing": "packing",
    "op6_jaccard_join": "jaccard_join",
    "op7_warc_revisits": "warc_revisits",
    "op8_language_id": "language_id",
    "op9_line_dedup": "line_dedup",
    "op10_lm_score": "lm_score",
}


def _module(name: str):
    return importlib.import_module(f"lodetext.llm.{_MODULES[name]}")


def queries() -> dict:
    return {name: getattr(_module(name), name) for name in _MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in _MODULES if (sql := getattr(_module(name), "ORACLE", None))}
