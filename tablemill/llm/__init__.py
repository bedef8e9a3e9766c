"""Operators of a large training-data pipeline and their queries.

Nothing else in the library imports this subpackage; it can be deleted whole.
"""

from importlib import import_module

MODULES = ("topk", "bpe", "hmm", "quality", "counts", "jaccard", "voting", "packing", "pii", "suffixes", "runs", "decontamination", "collocations")


def load() -> tuple[dict, dict]:
    """(queries, SQL) by name, of every operator module."""
    queries: dict = {}
    oracles: dict = {}
    for name in MODULES:
        module = import_module(f"{__name__}.{name}")
        queries.update(module.QUERIES)
        oracles.update(getattr(module, "ORACLES", {}))
    return queries, oracles
