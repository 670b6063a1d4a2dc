"""k-mer counting and what is derived from counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequences as S


def explode_kmers(reads: DataFrame, k: int, *keys: str, seq: str = "seq", canonical: bool = True) -> DataFrame:
    """(keys, kmer): a row for each k-mer of each stretch of bases."""
    out = reads.select(*keys, F.explode(S.runs(F.col(seq))).alias("_run")).filter(F.length("_run") >= k).select(*keys, F.explode(S.kmers_of_run(F.col("_run"), k)).alias("kmer"))
    return out.withColumn("kmer", S.canonical(F.col("kmer"))) if canonical else out


def count_kmers(reads: DataFrame, k: int, *keys: str, seq: str = "seq") -> DataFrame:
    """(keys, kmer, cnt): partial counts are made before the shuffle, so frequent k-mers cost a row for each task."""
    return explode_kmers(reads, k, *keys, seq=seq).groupBy(*keys, "kmer").agg(F.count(F.lit(1)).alias("cnt"))


def saturated(cnt: Column, most: int = 2) -> Column:
    return F.least(cnt, F.lit(most))


def mask_low_quality(seq: Column, qual: Column, least: int, offset: int = 33) -> Column:
    """Bases below a quality become N."""
    each = F.zip_with(F.split(seq, ""), F.split(qual, ""), lambda b, q: F.when(F.ascii(q) - offset >= least, b).otherwise(F.lit("N")))
    return F.array_join(each, "")


def phred_offset(reads: DataFrame, qual: str = "qual") -> DataFrame:
    """One row: 33 if any quality character is below @, else 64."""
    return reads.select(F.array_min(F.transform(F.split(F.col(qual), ""), F.ascii)).alias("q")).agg(F.when(F.min("q") < 64, 33).otherwise(64).alias("phred_offset"))


def histogram(counts: DataFrame, cnt: str = "cnt") -> DataFrame:
    return counts.groupBy(F.col(cnt).alias("cnt")).agg(F.count(F.lit(1)).alias("n_kmers"))


def error_cutoff(hist: DataFrame, rate: float = 0.01, limit: float = 1e-6) -> DataFrame:
    """One row: the count above which k-mers are taken for real, from a Poisson tail at the mean count of repeated ones."""
    mean = hist.filter("cnt > 1").agg((F.sum(F.col("cnt") * F.col("n_kmers")) / F.sum("n_kmers")).alias("c"))
    x, c = F.col("x").cast("double"), F.col("c")
    tail = F.lit(rate) / F.sqrt(2 * 3.1415927 * x) * F.pow(F.lit(rate) * c / 3 / x, x) * F.exp(-(F.lit(rate) * c / 3) + x)
    return mean.select("c", F.explode(F.sequence(F.lit(2), F.lit(999))).alias("x")).filter(tail < limit).agg((F.min("x") + 1).cast("long").alias("cutoff"))


def genome_size(counts: DataFrame) -> DataFrame:
    """One row: distinct k-mers that occur more than once."""
    return counts.agg(F.count_if(F.col("cnt") > 1).alias("genome_size"))


def cumulative_threshold(hist: DataFrame, share: float = 0.98, least: int = 75) -> DataFrame:
    """One row: the first count at which k-mers of counts from 2 on make up over ``share`` of all such, at least ``least``."""
    repeated = hist.filter("cnt > 1")
    total = repeated.agg(F.floor(F.sum("n_kmers") * share).alias("goal"))
    running = repeated.withColumn("dist", F.sum("n_kmers").over(Window.orderBy("cnt").rowsBetween(Window.unboundedPreceding, 0)))
    return running.crossJoin(F.broadcast(total)).filter("dist > goal").agg(F.greatest(F.coalesce(F.min("cnt"), F.lit(least)), F.lit(least)).cast("long").alias("threshold"))


def tiered_merge(counts: DataFrame, level: str = "level", least: int = 2) -> DataFrame:
    """(kmer, level, cnt): each k-mer with its count at the best level at which it is frequent enough."""
    return counts.filter(F.col("cnt") >= least).groupBy("kmer").agg(F.max(level).alias("level"), F.max_by("cnt", level).alias("cnt"))


def with_contaminant(reads: DataFrame, contaminants: DataFrame, k: int, key: str, how: str = "left_semi") -> DataFrame:
    """Keys of the reads that share (or with left_anti: share no) k-mer with any contaminant."""
    bad = explode_kmers(contaminants, k).distinct()
    hit = explode_kmers(reads, k, key).join(bad, "kmer", "left_semi").select(key).distinct()
    return reads.select(key).join(hit, key, how)


def auto_k(reads: DataFrame, seq: str = "seq", floor: int = 31) -> DataFrame:
    """One row: k from the shortest read, by GC content."""
    agg = reads.agg(F.min(F.length(seq)).alias("shortest"), (F.sum(S.gc_count(F.col(seq))) / F.sum(F.length(seq))).alias("gc_ratio"))
    factor = F.when(F.col("gc_ratio") < 0.5, 0.7).when(F.col("gc_ratio") < 0.6, 0.5).otherwise(0.33)
    return agg.select(F.greatest(F.floor(F.col("shortest") * factor), F.lit(floor)).cast("long").alias("k"), "gc_ratio")


def replay(counts: DataFrame, most: int) -> DataFrame:
    """Each k-mer min(cnt, most) times."""
    return counts.select("kmer", F.explode(F.sequence(F.lit(1), F.least("cnt", F.lit(most)))).alias("nth"))


def packed_bits(kmer: Column, k: int) -> Column:
    """A k-mer of at most 31 bases as a long, two bits a base, A C G T = 0 to 3."""
    if k > 31:
        raise ValueError("more than 31 bases don't fit in a long")
    digits = F.translate(kmer, "ACGT", "0123")
    return F.conv(digits, 4, 10).cast("long") if k <= 31 and math.log2(4) * k < 63 else F.lit(None).cast("long")


def quality_filtered_counts(reads: DataFrame, k: int, least: int = 5, offset: int = 33, seq: str = "seq", qual: str = "qual") -> DataFrame:
    """(kmer, cnt, good): counts over all bases, and over those of quality ``least`` or more alone."""
    masked = reads.withColumn("_good", mask_low_quality(F.col(seq), F.col(qual), least, offset))
    both = explode_kmers(masked, k, seq=seq).withColumn("g", F.lit(0)).unionByName(explode_kmers(masked, k, seq="_good").withColumn("g", F.lit(1)))
    return both.groupBy("kmer").agg(F.count_if(F.col("g") == 0).alias("cnt"), F.count_if(F.col("g") == 1).alias("good"))


def lookup(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(kmer, cnt) of the k-mers of ``wanted`` (kmer, either strand), 0 for those that aren't counted."""
    asked = wanted.select(S.canonical(F.col("kmer")).alias("kmer")).distinct()
    return asked.join(counts.select("kmer", "cnt"), "kmer", "left").select("kmer", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def save_counts(counts: DataFrame, path: str) -> None:
    """A table of counts that ``load_counts`` and later runs read."""
    counts.select("kmer", "cnt").write.mode("overwrite").parquet(path)


def load_counts(spark: SparkSession, path: str, lower: int = 1, upper: int | None = None) -> DataFrame:
    """(kmer, cnt) of a saved table, counts from ``lower`` to ``upper``; the bounds reach the scan."""
    df = spark.read.schema("kmer string, cnt long").parquet(path).filter(F.col("cnt") >= lower)
    return df if upper is None else df.filter(F.col("cnt") <= upper)


def dump_kmers(counts: DataFrame, path: str, lower: int = 1, upper: int | None = None) -> None:
    """Lines "kmer count" of the k-mers with counts from ``lower`` to ``upper``."""
    df = counts.filter(F.col("cnt") >= lower)
    df = df if upper is None else df.filter(F.col("cnt") <= upper)
    df.select(F.concat_ws(" ", "kmer", F.col("cnt").cast("string")).alias("value")).write.mode("overwrite").text(path)
