"""Typed reads from JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_json_fields(df: DataFrame, text: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Add one column for each field, given as (path, type), of the JSON text in a column.

    The text is parsed once, however many fields are read. Null, empty and malformed texts, texts with a repeated
    key, missing paths and values that the type cannot hold give null. Objects and arrays can be read as text of
    JSON or as `variant`. A column of a field's name is replaced, all others stay.
    """
    read = {name: F.try_variant_get("__document", path, kind) for name, (path, kind) in fields.items()}
    return df.withColumn("__document", F.try_parse_json(F.col(text).cast("string"))).withColumns(read).drop("__document")
