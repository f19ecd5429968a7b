"""Data types from short texts, without a session, and vectorised functions made with them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAIN = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "float": T.FloatType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "timestamp": T.TimestampType()}


def _split(text: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for k, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(text[start:k])
            start = k + 1
    return [p.strip() for p in [*parts, text[start:]]]


def kind(text: str) -> T.DataType:
    """``long``, ``array<double>``, ``struct<a:long,b:array<int>>`` and so on."""
    text = text.strip()
    if text.startswith("array<"):
        return T.ArrayType(kind(text[6:-1]))
    if text.startswith("struct<"):
        return fields(text[7:-1])
    return _PLAIN[text]


def fields(text: str) -> T.StructType:
    """A row type from ``a:long,b:double``."""
    return T.StructType([T.StructField(name.strip(), kind(t)) for name, t in (f.split(":", 1) for f in _split(text))])


def vectorized(text: str):
    """A pandas UDF whose type needs no session to be read."""
    return F.pandas_udf(kind(text))
