"""Training-data operators and their queries; nothing else in the library imports this package."""

from __future__ import annotations


def load():
    """All queries of the package and the SQL of those that have one."""
    import importlib
    import pkgutil

    from tidemark.llm.common import ORACLES, QUERIES
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return QUERIES, ORACLES
