"""Where intermediate results are kept so that a lost executor costs a re-read, not a re-computation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StructType, TimestampType

#: Bytes up to which a side of a join is broadcast; its rows are counted first and larger sides are shuffled.
BROADCAST_BYTES = 16 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared ``spark.checkpoint.dir``; only in local mode, where it is unset, a temporary one."""
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set, and a folder of this machine is of no use to a cluster")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder, and read from there: its lineage ends with the files.

    Unlike ``checkpoint()`` this computes every row once, compresses, and tells the optimiser the size.
    """
    path = new_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _row_bytes(schema: StructType) -> int | None:
    """Bytes of a row of fixed-width columns and what a hash table adds; None if a column has no fixed width."""
    total = 16
    for field in schema:
        if isinstance(field.dataType, StructType):
            inner = _row_bytes(field.dataType)
            if inner is None:
                return None
            total += inner
        elif isinstance(field.dataType, (NumericType, BooleanType, DateType, TimestampType)):
            total += 8
        else:
            return None
    return total


def sized(df: DataFrame, *texts: str) -> DataFrame:
    """``df``, materialised before, marked for broadcast if its rows, counted, allow it.

    Its columns have a fixed width but for the strings ``texts``, whose lengths are added up.
    """
    if texts:
        found = df.agg(F.count("*").alias("n"), *[F.sum(F.octet_length(F.col(c))).alias(f"l{k}") for k, c in enumerate(texts)]).first()
        return F.broadcast(df) if sum(x or 0 for x in found[1:]) + found.n * 128 <= BROADCAST_BYTES else df
    width = _row_bytes(df.schema)
    return F.broadcast(df) if width and df.count() * width <= BROADCAST_BYTES else df


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def plainly_named(docs: DataFrame, *known: str) -> DataFrame:
    """``docs`` with every column but ``known`` renamed by its place, so that no other name can clash, whatever its case."""
    found = {k: next((c for c in (*[c for c in docs.columns if c == k], *[c for c in docs.columns if c.lower() == k])), None) for k in known}
    places = {docs.columns.index(c): k for k, c in found.items() if c is not None}
    return docs.toDF(*(places.get(k, f"other_{k}") for k in range(len(docs.columns))))
