"""JSON objects of unknown keys as rows of dotted paths."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.plans.store import write_table


def flatten_json(df: DataFrame, keys: Sequence[str], column: str, sep: str = ".") -> DataFrame:
    """(``keys``..., path, value): one row per value of the JSON objects in ``column``, with dotted keys.

    Objects are opened level by level (VARIANT columns), whatever keys they have; lists stay JSON text, strings are as they
    are, other values JSON text, and JSON null is a null value.  Empty objects have no values.  Text that is no JSON
    object gives one row with a null path and the text itself, so that no row is lost.  Each level is written once.
    """
    raw = df.select(*keys, F.col(column).alias("_text"), F.try_parse_json(F.col(column)).alias("v"))
    kind = F.schema_of_variant("v")
    is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    level = write_table(raw.where(is_object).select(*keys, F.lit("").alias("path"), "v"), "json-level")
    text = F.when(kind == "STRING", F.variant_get("v", "$", "string")).when(~F.is_variant_null("v"), F.to_json("v"))
    parts = [raw.where(~is_object).select(*keys, F.lit(None).cast("string").alias("path"), F.col("_text").alias("value"))]
    while not level.isEmpty():
        opened = level.alias("l").lateralJoin(df.sparkSession.tvf.variant_explode(F.col("l.v").outer()).alias("e"))
        path = F.when(F.col("l.path") == "", F.col("e.key")).otherwise(F.concat_ws(sep, "l.path", "e.key"))
        opened = write_table(opened.select(*[F.col(f"l.{k}") for k in keys], path.alias("path"), F.col("e.value").alias("v")),
                             "json-level")
        parts.append(opened.where(~is_object).select(*keys, "path", text.alias("value")))
        level = opened.where(is_object)
    return reduce(DataFrame.unionByName, parts)
