"""Tables written once to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest table, in bytes, that is sent to all tasks.
BROADCAST_BYTES = 32 << 20


def staged(df: DataFrame) -> DataFrame:
    """`df` written as Parquet below `spark.checkpoint.dir` (where that is unset, on one machine alone, a temporary folder) and read back: what follows more than once isn't worked out more than once."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="framelake-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, row_bytes: int = 128) -> DataFrame:
    """`df` written once, and broadcast if its rows, counted, are proven small; else it is joined by its keys."""
    df = staged(df)
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df.hint("merge")
