"""Tables that are written once and read again: intermediates in the shared folder, and positions in an order."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables up to so many rows are sent to every task.
MAX_BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, one of our own, on a single machine only."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="lakesieve-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """`df` as a table in the shared folder: it is made once, however often it is read, and outlives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, what: str = "table") -> DataFrame:
    """`df`, written, and broadcast if it has few rows."""
    df = written(df, what)
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt to all cores where it has fewer partitions than there are; a large table has more and stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df._jdf.queryExecution().toRdd().getNumPartitions() >= n else df.repartition(n)


def positions(df: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """`df` with the place of each row in an order, from 0, without a task that sees all rows.

    Rows are sorted by range; what each range holds is counted, and its rows are numbered from there on.
    """
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place = F.monotonically_increasing_id()  # the partition, and the row within it
    ranged = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(name, place), "ranged")
    part = F.shiftright(F.col(name), 33)
    counts = {r.part: r["count"] for r in ranged.groupBy(part.alias("part")).count().collect()}  # a row for each partition
    before, offsets = 0, []
    for p in range(max(counts, default=-1) + 1):
        offsets.append(before)
        before += counts.get(p, 0)
    start = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in offsets or [0]]), (part + 1).cast("int"))
    return ranged.withColumn(name, start + F.col(name).bitwiseAND(F.lit((1 << 33) - 1)))
