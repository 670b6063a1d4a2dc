"""Scaffold gaps closed together: one graph of all reads for each k, from the largest down, until a gap's ends are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import kmers, overlaps, paths, unitigs
from .storage import forget, materialize


def joined_ends(gaps: DataFrame, reads: DataFrame, k: int, mean: float, stdev: float, solid: int = 1, sigmas: float = 5.0, most_nodes: int = 2000) -> DataFrame:
    """(gap, outcome, seq): what joins each gap's two ends in the graph of the k-mers of all reads and ends.

    ``seq`` runs from the left end's first base to the right end's last; it's null where nothing, or more than one way,
    joins them. ``mean`` and ``stdev`` are of that length.
    """
    sides = F.array(F.struct(F.lit(0).alias("end"), F.col("left_seq").alias("seq")), F.struct(F.lit(1).alias("end"), S.revcomp(F.col("right_seq")).alias("seq")))
    ends = materialize(gaps.select("gap", F.explode(sides).alias("e")).select("gap", "e.*"), "ends")
    counts = kmers.count_kmers(reads.select("seq").unionByName(ends.select("seq")), k)
    u = materialize(unitigs.compact(counts, k, solid), "unitigs")
    placed = materialize(paths.read_paths(overlaps.read_matches(ends, u, k, "gap", "end"), u, k, "gap", "end"), "placed")
    placed = placed.join(paths.path_lengths(placed.select("sr", "path").distinct(), u, k), "sr")
    # Paths as the ends read them, and how far into them they begin.
    ahead = F.col("ori") == "F"
    placed = placed.select("gap", "end", F.when(ahead, F.col("path")).otherwise(S.reverse_path(F.col("path"))).alias("path"), F.when(ahead, F.col("off")).otherwise(F.col("len") - F.col("off")).cast("long").alias("skip"))
    side = lambda e, p, s: placed.filter(F.col("end") == e).select("gap", F.col("path").alias(p), F.col("skip").alias(s))
    pairs = side(0, "even", "before").join(side(1, "odd", "after"), "gap").join(u.select(F.col("ku").alias("_ku"), F.length("seq").cast("long").alias("len")), F.col("even")[0]["ku"] == F.col("_ku")).drop("_ku")
    pairs = materialize(pairs.withColumnsRenamed({"gap": "insert"}).withColumn("mean", F.lit(float(mean))).withColumn("stdev", F.lit(float(stdev))), "pairs")
    adjacent = materialize(overlaps.adjacency(overlaps.end_overlaps(u, k), u), "adjacent")
    joined = paths.join_mates(pairs, adjacent, k, sigmas, most_nodes)
    # Ends on one unitig are joined by it.
    joined = joined.join(pairs.select("insert", "even", "before", "after"), "insert").withColumn("path", F.when(F.col("outcome") == "same unitig", F.array(F.col("even")[0])).otherwise(F.col("path")))
    joined = materialize(joined.withColumn("sr", S.name_of_path(F.col("path"))).select("insert", "outcome", "sr", "path", "before", "after"), "joined")
    seqs = paths.path_sequences(joined.filter("path is not null").select("sr", "path"), u, k)
    cut = F.substr("seq", (F.col("before") + 1).cast("int"), F.greatest(F.length("seq") - F.col("before") - F.col("after"), F.lit(0)).cast("int"))
    found = joined.join(seqs.select("sr", "seq"), "sr", "left").select(F.col("insert").alias("gap"), "outcome", F.nullif(cut, F.lit("")).alias("seq"))
    return gaps.select("gap").join(found, "gap", "left").select("gap", F.coalesce("outcome", F.lit("missing sequence")).alias("outcome"), "seq")


def close_globally(gaps: DataFrame, reads: DataFrame, ks: list[int], mean: float, stdev: float, **options) -> DataFrame:
    """(gap, k, seq): each gap with the largest k that joins its ends, from a graph of all reads for each k.

    ``gaps`` (gap, left_seq, right_seq); ``reads`` (seq); odd ks. Gaps that are closed take no part in smaller ks; those
    that none closes are left out. Each k is one pass over the reads.
    """
    open_, closed = materialize(gaps.select("gap", "left_seq", "right_seq"), "open"), None
    for k in sorted(ks, reverse=True):
        if open_.isEmpty():
            break
        found = materialize(joined_ends(open_, reads, k, mean, stdev, **options).filter("seq is not null").select("gap", F.lit(k).alias("k"), "seq"), "closed")
        closed = found if closed is None else closed.unionByName(found)
        last, open_ = open_, materialize(open_.join(found, "gap", "left_anti"), "open")
        forget(last)
    return closed if closed is not None else gaps.limit(0).select("gap", F.lit(0).alias("k"), F.col("left_seq").alias("seq"))
