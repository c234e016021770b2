"""What the training-data jobs share: written intermediate tables and byte bounds for broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes, that a job here sends to every executor.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` where set, else, on one machine alone, a new temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="framelake-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def settle(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes `df` once as a Parquet table in the shared folder and reads it back.

    This cuts the lineage: what follows sees the same rows in every job and
    after the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that `settle` wrote and nothing reads any more."""
    top = shared_dir(spark).removeprefix("file://")
    for df in tables:
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if top in f:
                path = spark._jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(c: Column) -> Column:
    """UTF-8 bytes of a text; null gives 0."""
    return F.coalesce(F.octet_length(c).cast("long"), F.lit(0).cast("long"))


def no_spaces(c: Column) -> Column:
    """The text without the six characters of `[\\x20\\x09-\\x0D]`; null gives the empty text."""
    out = F.coalesce(c, F.lit(""))
    for x in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        out = F.replace(out, F.lit(x), F.lit(""))
    return out


def private_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't have, whatever the case."""
    have = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in have:
        name = f"_{name}"
    return name
