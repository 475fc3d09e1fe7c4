"""All registered queries and their SQL twins."""

from __future__ import annotations

from tidemark.catalog import audits, evaluate, extras, feeds, models, quotes, streams, tables

MODULES = [quotes, tables, evaluate, feeds, audits, extras, streams, models]


def queries() -> dict:
    out: dict = {}
    for module in MODULES:
        clash = out.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(module.QUERIES)
    return out


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in MODULES:
        out.update(module.ORACLES)
    return out
