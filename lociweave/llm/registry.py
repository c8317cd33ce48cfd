"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES and ORACLE_SQL.
MODULES = ("exact_dedup", "mixing", "simhash", "language", "tokens", "quality", "decontamination", "language_model", "substring_dedup", "line_dedup")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"lociweave.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"lociweave.llm.{m}").ORACLE_SQL.items()}
