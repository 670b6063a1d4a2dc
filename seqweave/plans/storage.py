"""Tables in the folder that driver and executors share, for cutting lineage between iterations and stages."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest table, in rows, that is sent to every executor. Every use counts the rows first and has a shuffled join for more.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it's unset, a local folder if driver and executors are one process; else an error."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return f"file://{tempfile.gettempdir()}/seqweave-shared"
    raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def materialize(df: DataFrame, label: str, folders: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: later jobs, and tasks that run again after an executor is lost, start from the written
    files. Every call gets a folder of its own below ``<shared>/seqweave/<application>/``, and in it one for each value of
    the columns ``folders``; ``forget`` deletes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seqweave/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path)
    out = spark.read.schema(df.schema).parquet(path).select(df.columns)
    out._written = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote of these tables, which nothing may read any more."""
    for df in tables:
        if path := getattr(df, "_written", None):
            context = df.sparkSession.sparkContext
            p = context._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; as it is, for a shuffled join, if it has more.

    ``df`` should be materialised, as its rows are counted here.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dense_ids(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with the long ``name``: its place, from 0, in the given order.

    The rows are range-partitioned, sorted and counted by partition; only a row for each partition meets in one task.
    Rows that tie in ``order`` get their places in no fixed order.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranged").withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = ranged.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
