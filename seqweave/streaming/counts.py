"""Structured Streaming counterparts of the counting operators (an extension: the batch operators define the results)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kmers import explode_kmers


def stream_kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    """Running k-mer counts of a stream of reads (complete or update mode)."""
    return explode_kmers(reads, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt"))


def stream_event_windows(events: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type in tumbling windows; events later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
