"""The covering path plan: reads to k-mers, unitigs, matches, paths, support, sequences, containment, placements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kmers, overlaps, paths, reads, unitigs
from .stages import run_stages


def path_stages(source: DataFrame, k: int = 31, solid: int = 2, least_support: int = 2, reduce: bool = True, keys: list[str] | None = None) -> list:
    """Stages over ``source`` (insert, end, seq): the tables counts, unitigs, matches, placed, good, sequences, reduction,
    final. ``keys`` are the columns that name a read, the last of them its end."""
    keys = keys or ["insert", "end"]

    def good(_: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        return reads.support_counts(t["placed"], "sr", keys[:-1], least_support)

    def sequences(_: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        kept = t["placed"].join(t["good"].select("sr"), "sr", "left_semi")
        return paths.rank_by_length(paths.path_sequences(kept, t["unitigs"], k))

    def reduction(_: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        kept = t["placed"].join(t["sequences"].select("sr"), "sr", "left_semi")
        found = paths.contained(kept, t["sequences"], k, t["unitigs"])
        return found if reduce else found.limit(0)

    def final(_: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
        return paths.replace_placements(t["placed"].select(*keys, "sr", "off", "ori"), t["sequences"], t["reduction"])

    return [
        ("counts", lambda s, t: kmers.count_kmers(source, k)),
        ("unitigs", lambda s, t: unitigs.compact(t["counts"], k, solid)),
        ("matches", lambda s, t: overlaps.read_matches(source, t["unitigs"], k, *keys)),
        ("placed", lambda s, t: paths.read_paths(t["matches"], t["unitigs"], k, *keys)),
        ("good", good),
        ("sequences", sequences),
        ("reduction", reduction),
        ("final", final),
    ]


def covering_paths(spark: SparkSession, source: DataFrame, folder: str, k: int = 31, stop_after: str | None = None, **options) -> dict[str, DataFrame]:
    return run_stages(spark, folder, path_stages(source, k, **options), stop_after)


def end_counts(final: DataFrame) -> DataFrame:
    """(sr, reads): placements of each covering path left."""
    return final.groupBy("sr").agg(F.count(F.lit(1)).alias("reads"))
