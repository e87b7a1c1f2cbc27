"""Semi-structured values: parse a JSON string once, read paths from it.

``parse_json`` yields a VARIANT; ``variant_get`` reads a path with a target
type and returns NULL when the path is missing. Both are JVM expressions in
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.registry import register
from quarry.sources import tables as T


def json_get(col: str | Column, path: str, type_: str = "string") -> Column:
    """Value at ``path`` (e.g. ``$.labels[0]``) of a JSON string column, cast to ``type_``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_variant_get(F.try_parse_json(c), path, type_)


@register("json_path_extract",
          "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_path_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "events").select("event_id", json_get("props", "$.k", "int").alias("k"))
