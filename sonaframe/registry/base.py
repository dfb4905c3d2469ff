"""Registered queries: each pairs a Spark callable with its DuckDB twin.

A query reads the driver tables under ``sf_dir`` (or data Spark derives from
them) and returns a DataFrame whose computed columns carry the same aliases as
the SQL twin.  Floats are rounded to 6 places on both sides; integers are
64-bit on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir)`` under ``name`` with its SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = (fn, sql)
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Round to 6 places as ``floor(x·1e6 + 0.5) / 1e6``, or to 7 significant digits
    from 1e6 up; the SQL twin does the same double arithmetic."""
    x = F.col(c) if isinstance(c, str) else c
    small = F.floor(x * F.lit(1000000.0) + F.lit(0.5)) / F.lit(1000000.0)
    # |x| >= 1e6: 7 significant digits (mantissa rounded, then scaled back)
    k = F.floor(F.log10(F.abs(x)))
    scale = F.pow(F.lit(10.0), k)
    big = F.floor(x / scale * F.lit(1000000.0) + F.lit(0.5)) / F.lit(1000000.0) * scale
    return F.when(F.abs(x) < F.lit(1e6), small).otherwise(big)
