"""The registered queries of the operators and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ("queries_corpus", "queries_web", "queries_models")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(import_module(f"{__package__}.{name}"), attribute))
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict[str, str]:
    return _merged("ORACLES")
