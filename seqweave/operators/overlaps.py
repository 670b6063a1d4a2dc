"""Joins between unitigs, reads and fragments on shared k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..plans.storage import materialize, small
from .kmers import explode_kmers


def unitig_ends(unitigs: DataFrame, k: int) -> DataFrame:
    """(mer, ku, len, at_end, flipped): the first and last k - 1 bases of each unitig, in canonical form."""
    n = k - 1
    ends = F.array(F.struct(F.lit(0).alias("at_end"), F.left("seq", F.lit(n)).alias("m")), F.struct(F.lit(1).alias("at_end"), F.right("seq", F.lit(n)).alias("m")))
    rows = unitigs.filter(F.length("seq") >= n).select("ku", F.length("seq").alias("len"), F.explode(ends).alias("e")).select("ku", "len", "e.*")
    # A mer that is its own reverse complement stands for both strands.
    flips = F.when(F.col("m") == S.revcomp(F.col("m")), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.when(F.col("m") < S.revcomp(F.col("m")), 0).otherwise(1)))
    return rows.select(S.canonical(F.col("m")).alias("mer"), "ku", "len", "at_end", F.explode(flips).alias("flipped"))


def end_overlaps(unitigs: DataFrame, k: int) -> DataFrame:
    """(u1, u2, ahg, bhg, ori): exact overlaps of k - 1 bases between ends of different unitigs, each from both sides.

    One shuffle of two thin rows for each unitig; ori is N for the same strand, I for opposite ones.
    """
    n, ends = k - 1, unitig_ends(unitigs, k)
    one, two = (ends.select("mer", *(F.col(c).alias(f"{c}{i}") for c in ("ku", "len", "at_end", "flipped"))) for i in (1, 2))
    met = one.join(two, "mer").filter("ku1 < ku2 and (at_end1 + at_end2 + flipped1 + flipped2) % 2 = 1")
    ahg = F.when(F.col("at_end1") == 0, n - F.col("len2")).otherwise(F.col("len1") - n)
    bhg = F.when(F.col("at_end1") == 0, n - F.col("len1")).otherwise(F.col("len2") - n)
    found = met.select("ku1", "ku2", ahg.alias("ahg"), bhg.alias("bhg"), F.when(F.col("flipped1") == F.col("flipped2"), "N").otherwise("I").alias("ori")).distinct()
    same = F.col("ori") == "N"
    mirrored = F.struct(F.col("ku2").alias("u1"), F.col("ku1").alias("u2"), F.when(same, -F.col("ahg")).otherwise(F.col("bhg")).alias("ahg"), F.when(same, -F.col("bhg")).otherwise(F.col("ahg")).alias("bhg"), "ori")
    asis = F.struct(F.col("ku1").alias("u1"), F.col("ku2").alias("u2"), "ahg", "bhg", "ori")
    return found.select(F.explode(F.array(asis, mirrored)).alias("o")).select("o.*")


def adjacency(overlaps: DataFrame, unitigs: DataFrame) -> DataFrame:
    """(ku, ori, nku, nori, nlen): which oriented unitig follows which."""
    ahead = F.col("ahg") > 0
    flipped = F.col("ori") == "I"
    out = overlaps.select(F.col("u1").alias("ku"), F.when(ahead, "F").otherwise("R").alias("ori"), F.col("u2").alias("nku"), F.when(ahead != flipped, "F").otherwise("R").alias("nori"))
    return out.join(unitigs.select(F.col("ku").alias("nku"), F.length("seq").alias("nlen")), "nku").select("ku", "ori", "nku", "nori", "nlen")


def placed_kmers(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """(keys, mer, at, flipped): each k-mer without other characters, at its offset from 0, in canonical form."""
    # Long sequences are cut into blocks first: a substring of a string costs the way to its offset.
    block = 512
    blocks = df.filter(F.length("seq") >= k).select(*keys, F.explode(F.transform(F.sequence(F.lit(0), ((F.length("seq") - k) / block).cast("int")), lambda i: F.struct((i * block).alias("from"), F.substr("seq", i * block + 1, F.lit(block + k - 1)).alias("s")))).alias("_b"))
    out = blocks.select(*keys, "_b", F.explode(F.sequence(F.lit(0), F.length("_b.s") - k)).alias("_i"))
    out = out.select(*keys, (F.col("_b.from") + F.col("_i")).alias("at"), F.substr(F.col("_b.s"), F.col("_i") + 1, F.lit(k)).alias("m")).filter(~F.col("m").rlike("[^ACGT]"))
    return out.select(*keys, S.canonical(F.col("m")).alias("mer"), "at", F.when(F.col("m") <= S.revcomp(F.col("m")), 0).otherwise(1).alias("flipped"))


def unitig_kmers(unitigs: DataFrame, k: int) -> DataFrame:
    """(mer, ku, off, ku_flipped), a row for each k-mer of each unitig."""
    return placed_kmers(unitigs, k, "ku").select("mer", "ku", F.col("at").alias("off"), F.col("flipped").alias("ku_flipped"))


def unitig_index(unitigs: DataFrame, k: int) -> DataFrame:
    """(mer, ku, off, ku_flipped) of the k-mers that occur once in all unitigs: one that occurs again would point nowhere."""
    once = F.min(F.struct("ku", "off", "ku_flipped")).alias("x")
    return unitig_kmers(unitigs, k).groupBy("mer").agg(F.count(F.lit(1)).alias("_n"), once).filter("_n = 1").select("mer", "x.*")


def read_matches(reads: DataFrame, unitigs: DataFrame, k: int, *keys: str) -> DataFrame:
    """(keys, read_len, nth, ku, ahg, ori, hit_begin, hit_end): the unitigs along each read, an island of hits for each.

    A new island begins where unitig, strand or implied start changes, or a k-mer begins after the last hit's end.
    ``hit_begin`` and ``hit_end`` are the island's place in the read. Reads are exploded once and probe the unitigs' k-mers,
    which are unique, so a read's k-mer gives one hit at most; a small index is broadcast and the reads aren't shuffled.
    """
    index = small(materialize(unitig_index(unitigs, k), "index"))
    hits = placed_kmers(reads.withColumn("read_len", F.length("seq")), k, *keys, "read_len").join(index, "mer")
    same = F.col("flipped") == F.col("ku_flipped")
    hits = hits.select(*keys, "read_len", "at", "ku", F.when(same, "F").otherwise("R").alias("ori"), F.when(same, F.col("off") - F.col("at")).otherwise(F.col("off") + F.col("at") + k).alias("start"))
    w = Window.partitionBy(*keys).orderBy("at", "ku", "start")
    before = lambda c: F.lag(c).over(w)
    fresh = before("at").isNull() | (before("ku") != F.col("ku")) | (before("ori") != F.col("ori")) | (before("start") != F.col("start")) | (F.col("at") > before("at") + k)
    islands = hits.withColumn("_new", fresh.cast("int")).withColumn("nth", F.sum("_new").over(w))
    out = islands.groupBy(*keys, "read_len", "nth", "ku", "ori", "start").agg(F.min("at").alias("hit_begin"), (F.max("at") + k).alias("hit_end"))
    return out.select(*keys, "read_len", F.col("nth").cast("long").alias("nth"), "ku", F.when(F.col("ori") == "F", F.col("start")).otherwise(F.col("start") - F.col("read_len")).alias("ahg"), "ori", "hit_begin", "hit_end")


def translate_matches(matches: DataFrame, translation: DataFrame) -> DataFrame:
    """Matches on merged unitigs: (old_ku, new_ku, begin, end) maps coordinates, reversed where begin > end."""
    met = matches.join(translation.select(F.col("old_ku").alias("ku"), "new_ku", F.col("begin").alias("_b"), F.col("end").alias("_e")), "ku", "left")
    turned = F.col("_b") > F.col("_e")
    ahg = F.when(F.col("new_ku").isNull(), F.col("ahg")).when(turned, F.col("_b") - F.col("ahg") - F.col("read_len")).otherwise(F.col("_b") + F.col("ahg"))
    ori = F.when(turned, F.translate("ori", "FR", "RF")).otherwise(F.col("ori"))
    return met.withColumn("ahg", ahg).withColumn("ori", ori).withColumn("ku", F.coalesce("new_ku", "ku")).drop("new_ku", "_b", "_e")


def good_overlaps(overlaps: DataFrame, fragments: DataFrame, bad: DataFrame, k: int) -> DataFrame:
    """Overlaps (id1 < id2, both known) of fragments that share a k-mer which isn't bad."""
    own = explode_kmers(fragments.select("id", "seq"), k, "id").distinct().join(bad.select("kmer"), "kmer", "left_anti")
    pairs = overlaps.filter("id1 < id2").select("id1", "id2").distinct()
    shared = pairs.join(own.withColumnRenamed("id", "id1"), "id1").join(own.withColumnRenamed("id", "id2"), ["id2", "kmer"]).select("id1", "id2").distinct()
    return overlaps.join(shared, ["id1", "id2"], "left_semi")


def save_overlaps(overlaps: DataFrame, path: str) -> None:
    """A table whose files hold all overlaps of a unitig together, in order, so that a scan for some reads few of them."""
    overlaps.repartition("u1").sortWithinPartitions("u1", "u2").write.mode("overwrite").parquet(path)


def load_overlaps(spark: SparkSession, path: str, unitigs: list[int] | None = None) -> DataFrame:
    """A saved table, of the given unitigs alone if any are named; the filter reaches the scan."""
    df = spark.read.schema("u1 long, u2 long, ahg int, bhg int, ori string").parquet(path)
    return df if unitigs is None else df.filter(F.col("u1").isin(unitigs))
