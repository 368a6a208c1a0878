"""Plumbing that the training-data operators share: the shared scratch folder and column hygiene."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this subpackage: runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``.  A private one is set only where that is unset, and only
    by a session that runs on this machine alone."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weftwork-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/weftwork/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage is cut and lost executors lose nothing."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add (names compare without case, as Spark's do)."""
    taken = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in taken])


def quoted(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: how the held-out rows are named."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
