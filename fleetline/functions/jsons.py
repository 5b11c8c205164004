"""Strict parsing of JSON objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_object(text: Column, schema: T.StructType) -> Column:
    """The text as one object; null when it is anything else.

    Spark ignores what follows the first value, so the text is read as the only element of a list.
    """
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), T.ArrayType(schema))
    return F.when(F.size(listed) == 1, listed[0])
