"""Small helpers shared by the operators."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.session import checkpoint_dir

#: What separates words where a contract says so, as bytes and as a Java character class.
SPACES = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` already has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(text: Column) -> Column:
    """The text as UTF-8 bytes for a Python worker; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hex_long(digits: Column) -> Column:
    """Up to 15 hexadecimal digits as a bigint."""
    return F.conv(digits, 16, 10).cast("bigint")


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def cut_packed(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the checkpoint folder with a given compression and go on from what was written."""
    path = f"{checkpoint_dir(df.sparkSession)}/weftline/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(make: Callable[[Any], Any], given: Any) -> Any:
    """``make(given)``, once for all tasks of a Python worker; a later call with something else takes its place."""
    # functions come by value, so only a module of the process outlives a task
    store = sys.modules.setdefault("_weftline_kept", types.ModuleType("_weftline_kept"))
    held = store.__dict__.setdefault(make.__qualname__, [None, None])
    if held[1] is None or held[0] != given:
        held[:] = [given, make(given)]
    return held[1]
