"""What the operators share: reading, spilling to the shared folder, byte arrays."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of every contract: space and the controls 9 to 13.
WHITESPACE = " \t\n\x0b\x0c\r"
WHITESPACE_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    """The text as a string that is never null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in one process (a local master, as in tests) may it be unset: a folder of our own is then made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or None
    if named is None:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="shared-")
        context.setCheckpointDir(named)
    return named


def spill(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without computing
    ``df`` again, and values such as partition numbers are fixed from here on.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc32_of_id(column: str = "doc_id"):
    """crc32 of the identifier written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def about(df: DataFrame, key: str, rows: int, seed: str = "") -> DataFrame:
    """A reproducible sample of about ``rows`` rows, chosen by a hash of ``key``.

    The expected size is bounded by ``rows`` whatever the size of ``df``; a table
    of fewer rows is taken whole.
    """
    every = max(1, -(-df.count() // rows))
    if every == 1:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(every)) == 0)


def utf8_column(array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if not pa.types.is_binary(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def in_slices(batches, most_bytes: int = 4 << 20, column: str = "text"):
    """Cut Arrow record batches so that a slice holds about ``most_bytes`` of text.

    A text is never cut: one longer than the limit is a slice of its own.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = utf8_column(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "float": T.FloatType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}


def schema(*fields: tuple[str, str]) -> T.StructType:
    """A schema from (name, type) pairs; ``array<...>`` of the plain types too.  Needs no session."""

    def kind(t: str):
        return T.ArrayType(kind(t[6:-1])) if t.startswith("array<") else _TYPES[t]

    return T.StructType([T.StructField(n, kind(t), True) for n, t in fields])
