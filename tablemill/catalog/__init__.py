"""Every operator as a named query over the given tables, with its SQL where there is one."""

from importlib import import_module

MODULES = ("sources", "features", "prep", "selection", "tuning", "models", "metrics", "explain")


def load() -> tuple[dict, dict]:
    """(queries, SQL) by name."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    base = import_module(f"{__name__}.base")
    return base.QUERIES, base.ORACLES
