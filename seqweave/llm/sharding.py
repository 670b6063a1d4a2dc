"""Sharding by a two-pass external shuffle, with DataFrame functions only.

First pass: a seeded hash scatters the records over shards, and within a shard over buckets that fit in memory; a bucket
that turns out larger, as a key has many records, is scattered once more. A record's shard is the one with the highest hash
of (key, shard), so its key and the number of shards decide, and one more shard takes records only into itself. Second
pass: each bucket is shuffled as one array by Fisher-Yates (Spark's ``shuffle``) and written to its shard's folder; a
shard's buckets follow each other. What is given is read back from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small

SHARDS, SEED = 40, 7
#: Bytes and rows of a bucket that a task holds at once.
BUCKET_BYTES, BUCKET_ROWS = 32 << 20, 100_000


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard from 0 with the highest hash; null keys are a key of their own."""
    scores = [F.struct(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(i)) for i in range(shards)]
    return (F.greatest(*scores) if shards > 1 else scores[0])["col2"]


def shuffle_into_shards(records: DataFrame, key: str, size: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``records`` with shard, grown_shard (with one shard more) and slot, a record's place in its shard, gapless from 0.

    ``size`` names the column of a record's bytes. The number of buckets comes from the totals over all records, and what
    a bucket has beyond twice its share from its own, so each stays near ``bucket_bytes`` and ``bucket_rows`` at any input
    and whatever key is frequent. Within a bucket, records are put in an order of their own before they are shuffled, so
    the result doesn't depend on which task came first. Null keys share a shard; repeated rows keep a slot each and are
    interchangeable; an empty table gives no rows. Columns named shard, slot or grown_shard are replaced. ``records`` is
    read three times, for sizes alone in the first two.
    """
    records = records.select(*(c for c in records.columns if c not in {"shard", "slot", "grown_shard"}))
    total = records.agg(F.sum(size), F.count(F.lit(1))).first()
    per_shard = max(1, -(-int(total[0] or 0) // (bucket_bytes * shards)), -(-total[1] // (bucket_rows * shards)))
    buckets = per_shard * shards
    now = shard_of(F.col(key), shards, seed)
    rival = F.xxhash64(F.col(key), F.lit(seed), F.lit(shards))
    best = F.xxhash64(F.col(key), F.lit(seed), now)
    dealt = records.withColumn("shard", now).withColumn("grown_shard", F.when(rival > best, F.lit(shards)).otherwise(F.col("shard")))
    part = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.lit(per_shard))
    dealt = dealt.withColumn("_bucket", (F.col("shard") * per_shard + part).cast("int"))
    # What is more than a bucket holds is dealt over further ones, numbered on from the last, by all columns and at random.
    pieces = F.greatest(F.ceil(F.col("bytes") / bucket_bytes), F.ceil(F.col("n") / bucket_rows)).cast("long")
    crowded = dealt.groupBy("_bucket").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n")).filter((F.col("bytes") > 2 * bucket_bytes) | (F.col("n") > 2 * bucket_rows))
    crowded = materialize(crowded.select("_bucket", pieces.alias("_pieces"), (F.sum(pieces - 1).over(Window.orderBy("_bucket")) - pieces + 1).alias("_before")), "crowded")
    more = crowded.agg(F.sum(F.col("_pieces") - 1)).first()[0]
    if more:
        nth = F.pmod(F.xxhash64(F.rand(seed), *(F.col(c) for c in records.columns)), F.col("_pieces"))
        dealt = dealt.withColumn("_nth", F.lit(0)).join(small(crowded), "_bucket", "left").withColumn("_nth", F.when(F.col("_pieces").isNotNull(), nth).otherwise(0))
        dealt = dealt.withColumn("_bucket", F.when(F.col("_nth") > 0, buckets - 1 + F.col("_before") + F.col("_nth")).otherwise(F.col("_bucket")).cast("int")).drop("_pieces", "_before", "_nth")
        buckets += int(more)
    # Each bucket is a partition of its own, so the generator, which a partition's number seeds, starts anew for it.
    gathered = dealt.repartitionById(buckets, F.col("_bucket")).groupBy("_bucket").agg(F.sort_array(F.collect_list(F.struct(*(c for c in dealt.columns if c != "_bucket")))).alias("rows"))
    shuffled = gathered.select("_bucket", F.posexplode(F.shuffle("rows", seed)).alias("_at", "_row"))
    shuffled = materialize(shuffled.select("_bucket", F.col("_at").cast("long").alias("_at"), "_row.*"), "shuffled", ("shard",))
    counts = shuffled.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialize(counts.select(F.col("_bucket").alias("_b"), before.alias("_before")), "offsets")
    out = shuffled.join(small(offsets), F.col("_bucket") == F.col("_b")).withColumn("slot", F.col("_before") + F.col("_at"))
    return out.select(*records.columns, "shard", "slot", "grown_shard")


def write_shards(sharded: DataFrame, path: str, max_records: int = 0) -> None:
    """Write one folder for each shard, its records in the order of their slots."""
    ordered = sharded.repartition("shard").sortWithinPartitions("shard", "slot")
    ordered.write.option("maxRecordsPerFile", max_records).partitionBy("shard").parquet(path)
