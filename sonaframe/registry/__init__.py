"""Query registry used by ``__spark_entry__`` and ``bench.py``."""

from .base import REGISTRY, register, table  # noqa: F401


def load_all() -> dict:
    # importing the modules fills REGISTRY
    from . import aggs, arrays, filters, joins, lexicon, plans, scans, signal, streaming, text, windows  # noqa: F401

    return REGISTRY
