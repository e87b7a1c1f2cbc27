"""Key register: query key → (Spark plan builder, DuckDB oracle SQL).

Modules add entries with :func:`register`; :func:`load_all` imports every
module that defines keys. ``__spark_entry__`` reads the two maps.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

AS_OF = _dt.date(2001, 12, 31)
LAST_YEAR = AS_OF.year - 1
TOP_K = 3
PRODUCT_NAME = "red widget"          # stand-in for the reference's named product
RANK_CATEGORY = "STANDARD"           # stand-in for the reference's ranked category


def register(key: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    # Importing the modules fills the maps.
    from quarry.plans import verified  # noqa: F401
    from quarry.operators import analytics, docs, feedback, outbox, policy, quality, search  # noqa: F401
    from quarry.plans import model_ops, qualified, values  # noqa: F401
    from quarry.streaming import refresh  # noqa: F401
    from quarry.sources import csv, files, load  # noqa: F401
    from quarry.functions import json  # noqa: F401
