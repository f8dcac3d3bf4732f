"""Small helpers the training-data operators share."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..scratch import drop_folder, dropping, materialize, new_folder, shared_dir

__all__ = ["WORD", "drop_folder", "dropping", "materialize", "new_folder", "parts", "pick", "remembered", "shared_dir", "table", "text_bytes", "word_count"]

WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any file system Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Exactly these columns, whatever else df holds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: Bytes of text that a range of rows holds, about.
RANGE_BYTES = 64 << 20


def parts(spark: SparkSession, size: int = 0) -> int:
    """Number of ranges for so many bytes: that of the session's shuffles, or more if ranges would exceed RANGE_BYTES."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / RANGE_BYTES))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


# --- what a Python worker remembers from one task to the next

_remembered: dict[str, dict] = {}


def remembered(owner: str) -> dict:
    """What this operator has kept in this worker. Workers outlive stages, so what other operators have kept is let go first."""
    for other in [o for o in _remembered if o != owner]:
        del _remembered[other]
    return _remembered.setdefault(owner, {})


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
