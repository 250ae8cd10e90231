"""Where iterative operators keep intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder in ``spark.checkpoint.dir`` and read from there.

    Every row is computed once and the lineage ends with the files.  In local mode a temporary folder stands in for a setting
    that is missing; on a cluster that is an error, as other machines would not see it.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set, and a folder of this machine is of no use to a cluster")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
    path = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``place``, the number of rows before each in the order of the columns ``order``, which must tell rows apart.

    The rows are sorted in ranges, and only the number of rows of each partition is put together.
    """
    # the id holds the partition above bit 33 and the row within it below
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before, offsets = 0, []
    for row in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").toLocalIterator():  # a row a partition
        offsets.append((row.part, before))
        before += row.n
    starts = rows.sparkSession.createDataFrame(offsets, "_part long, _before long")
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn("place", F.col("_before") + F.col("_at") % F.lit(1 << 33)).drop("_part", "_before", "_at")
