"""Filters, mates, libraries, placements and counts of reads."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..plans.storage import dense_ids, forget, materialize, small


def rename_interleaved(raw: DataFrame, lib: str, order: str, seq: str = "seq") -> DataFrame:
    """(lib, read_no, seq): numbered in the given order; reads with characters other than ACGTN go but use a number up."""
    return dense_ids(raw, "read_no", order).filter(~F.col(seq).rlike("[^ACGTN]")).select(F.lit(lib).alias("lib"), "read_no", F.col(seq).alias("seq"))


def listed(df: DataFrame, names: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """Rows whose key is (or with ``keep=False``: isn't) on a list. Null keys are on no list."""
    return df.join(names.select(key).distinct(), key, "left_semi" if keep else "left_anti")


def pad_missing_mates(reads: DataFrame, insert: list[str], end: str, seq: str, filler: str = "N") -> DataFrame:
    """(insert, end, seq) with both ends of each insert; a missing mate's sequence is ``filler``."""
    both = reads.groupBy(*insert).agg(F.min_by(seq, F.struct(F.col(end) != 0, seq)).alias("_a"), F.min_by(seq, F.struct(F.col(end) != 1, seq)).alias("_b"), F.min(end).alias("_lo"), F.max(end).alias("_hi"))
    ends = F.array(F.struct(F.lit(0).alias("end"), F.when(F.col("_lo") == 0, F.col("_a")).otherwise(filler).alias("seq")), F.struct(F.lit(1).alias("end"), F.when(F.col("_hi") == 1, F.col("_b")).otherwise(filler).alias("seq")))
    return both.select(*insert, F.explode(ends).alias("e")).select(*insert, F.col("e.end").alias("end"), F.col("e.seq").alias("seq"))


def both_mates(reads: DataFrame, insert: list[str], good) -> DataFrame:
    """Reads of inserts of which both reads are there and good."""
    w = Window.partitionBy(*insert)
    return reads.withColumn("_good", F.count_if(good).over(w)).filter("_good = 2").drop("_good")


def joined_inserts(placements: DataFrame, insert: list[str], sr: str = "sr") -> DataFrame:
    """(insert, sr) of the inserts both of whose reads are in one covering path."""
    return placements.groupBy(*insert, sr).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 2").drop("_n")


def linking_inserts(placements: DataFrame, insert: list[str], sr: str = "sr") -> DataFrame:
    """(insert, sr1, sr2) of the inserts whose two reads are in different covering paths, the smaller first."""
    both = placements.groupBy(*insert).agg(F.min(sr).alias("sr1"), F.max(sr).alias("sr2"), F.count(F.lit(1)).alias("_n"))
    return both.filter("_n = 2 and sr1 <> sr2").drop("_n")


def chimeric_inserts(placements: DataFrame, insert: list[str], end: str, sr: str, off: str, ori: str, inward: bool = False, most: int = 700) -> DataFrame:
    """Inserts whose reads stand in one covering path within ``most`` bases, facing away from each other (or inward)."""
    side = lambda e: placements.filter(F.col(end) == e).select(*insert, F.col(sr).alias(f"sr{e}"), F.col(off).alias(f"off{e}"), F.col(ori).alias(f"ori{e}"))
    both = side(0).join(side(1), insert).filter("sr0 = sr1")
    one, two = ("F", "R") if inward else ("R", "F")
    away = F.when((F.col("ori0") == two) & (F.col("ori1") == one), F.col("off0") - F.col("off1")).when((F.col("ori0") == one) & (F.col("ori1") == two), F.col("off1") - F.col("off0"))
    return both.withColumn("distance", away).filter((F.col("distance") > 0) & (F.col("distance") < most)).select(*insert, F.col("sr0").alias("sr"), "distance")


def greedy_redundancy(pairs: DataFrame, group: list[str], order: list[str], off1: str, off2: str, reach: int = 2, rounds: int = 12) -> DataFrame:
    """``pairs`` with ``redundant``: an earlier kept pair of the group has both offsets within ``reach``.

    Of pairs at the same place only the first can be kept. Places, one row for each, are joined with the earlier ones near
    by through cells of offsets, at most (2 reach + 1)^2 to a place however many pairs there are. Then all groups are
    decided together: places with an earlier kept neighbour are redundant, those with no earlier one undecided are kept.
    What chains leave undecided after ``rounds`` is walked in order, stretch by stretch of neighbouring offsets.
    """
    places = pairs.groupBy(*group, off1, off2).agg(F.min(F.struct(*order)).alias("_first"))
    places = materialize(places.withColumn("_id", F.monotonically_increasing_id()), "places")
    size = 2 * reach + 1
    cell = lambda c: F.floor(F.col(c) / size)
    spread = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - reach) / size), F.floor((F.col(c) + reach) / size)))
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    on = [f"_g{i}" for i in range(len(group))] + ["_c1", "_c2"]
    held = places.select(*keys, cell(off1).alias("_c1"), cell(off2).alias("_c2"), F.col("_id").alias("before"), F.col(off1).alias("_a"), F.col(off2).alias("_b"), F.col("_first").alias("_f"))
    asking = places.select(*keys, F.explode(spread(off1)).alias("_c1"), off1, off2, "_first", "_id").select("*", F.explode(spread(off2)).alias("_c2"))
    near = (F.abs(F.col(off1) - F.col("_a")) <= reach) & (F.abs(F.col(off2) - F.col("_b")) <= reach) & (F.col("_f") < F.col("_first"))
    edges = materialize(asking.join(held, on).filter(near).select(F.col("_id").alias("id"), "before"), "edges")
    # Places that no earlier one is near are kept; only those with some are gone through.
    kept = materialize(places.select(F.col("_id").alias("id")).join(edges.select("id").distinct(), "id", "left_anti"), "kept")
    open_ = materialize(edges.select("id").distinct(), "open")
    fresh, all_kept = kept, [kept]
    for _ in range(rounds):
        near_kept = edges.join(fresh.select(F.col("id").alias("before")), "before", "left_semi").select("id").distinct()
        last, open_ = open_, materialize(open_.join(near_kept, "id", "left_anti"), "open")
        forget(last)
        if open_.isEmpty():
            break
        waiting = edges.join(open_, "id", "left_semi").join(open_.select(F.col("id").alias("before")), "before", "left_semi").select("id").distinct()
        fresh = materialize(open_.join(waiting, "id", "left_anti"), "kept")
        all_kept.append(fresh)
        last, open_ = open_, materialize(open_.join(fresh, "id", "left_anti"), "open")
        forget(last)
    kept = all_kept[0]
    for more in all_kept[1:]:
        kept = kept.unionByName(more)
    near_kept = edges.join(fresh.select(F.col("id").alias("before")), "before", "left_semi").select("id").distinct()
    left = materialize(open_.join(near_kept, "id", "left_anti"), "open")
    if not left.isEmpty():
        kept = kept.unionByName(_walked(places, left, group, off1, off2, reach))
    mark = places.join(kept.select(F.col("id").alias("_id"), F.lit(True).alias("_kept")), "_id", "left").select(*group, off1, off2, F.when(F.col("_kept"), F.col("_first")).alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in (*group, off1, off2)]
    met = pairs.join(mark.select("_first", *(F.col(c).alias(f"_m_{c}") for c in (*group, off1, off2))), reduce(lambda x, y: x & y, same), "left")
    return met.select(*pairs.columns, F.coalesce(F.struct(*order) != F.col("_first"), F.lit(True)).alias("redundant"))


def _walked(places: DataFrame, left: DataFrame, group: list[str], off1: str, off2: str, reach: int) -> DataFrame:
    """(id) of the places in ``left`` that are kept, walked in order; none of them has a decided earlier neighbour that is kept."""
    rows = places.join(left.select(F.col("id").alias("_id")), "_id", "left_semi").select(*group, off1, off2, "_first", "_id")
    w = Window.partitionBy(*group).orderBy(off1)
    cut = F.when(F.col(off1) - F.lag(off1).over(w) <= reach, 0).otherwise(1)
    celled = rows.withColumn("_cut", cut).withColumn("_cell", F.sum("_cut").over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_nth", F.row_number().over(Window.partitionBy(*group, "_cell").orderBy("_first")))

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_nth")
        kept, out = set(), []
        for place, a, b in zip(frame["_id"], frame[off1], frame[off2], strict=True):
            if not any((a + i, b + j) in kept for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)):
                kept.add((a, b))
                out.append(place)
        return pd.DataFrame({"id": out})

    return materialize(celled.drop("_cut", "_first").groupBy(*group, "_cell").applyInPandas(walk, "id long"), "walked")


def clean_jumps(reads: DataFrame, placements: DataFrame, insert: list[str], end: str = "end", sr: str = "sr", off: str = "off", ori: str = "ori", seq: str = "seq", reach: int = 2, most: int = 700) -> DataFrame:
    """Reads of jumping libraries that are left, reverse-complemented: inserts both of whose reads are placed, that aren't
    chimeric (both on one path, close and facing away) and whose two places no earlier insert has within ``reach``."""
    side = lambda e: placements.filter(F.col(end) == e).select(*insert, F.col(sr).alias(f"sr{e}"), F.col(off).alias(f"off{e}"))
    both = materialize(side(0).join(side(1), insert), "pairs")
    chimeric = chimeric_inserts(placements, insert, end, sr, off, ori, most=most).select(*insert)
    redundant = greedy_redundancy(pair_places(both), ["sr1", "sr2"], insert, "off1", "off2", reach).filter("redundant").select(*insert)
    good = both.select(*insert).join(chimeric, insert, "left_anti").join(redundant, insert, "left_anti")
    return reads.join(good, insert, "left_semi").withColumn(seq, S.revcomp(F.col(seq), "N"))


def pair_places(both: DataFrame) -> DataFrame:
    """Pairs (sr0, off0, sr1, off1) with the smaller path, and on one path the smaller offset, first: (sr1, sr2, off1, off2)."""
    swap = (F.col("sr0") > F.col("sr1")) | (F.col("sr0") == F.col("sr1")) & (F.col("off0") > F.col("off1"))
    one, two = F.struct(F.col("sr0").alias("s"), F.col("off0").alias("o")), F.struct(F.col("sr1").alias("s"), F.col("off1").alias("o"))
    first, second = F.when(swap, two).otherwise(one), F.when(swap, one).otherwise(two)
    keys = [c for c in both.columns if c not in {"sr0", "off0", "sr1", "off1"}]
    return both.select(*keys, first["s"].alias("sr1"), second["s"].alias("sr2"), first["o"].alias("off1"), second["o"].alias("off2"))


def support_counts(placements: DataFrame, sr: str, insert: list[str], least: int = 2) -> DataFrame:
    """(sr, cnt): distinct inserts with a read in the covering path, of those with at least ``least``."""
    return placements.select(sr, *insert).distinct().groupBy(sr).agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") >= least)


def library_stats(values: DataFrame, lib: str, value: str) -> DataFrame:
    return values.groupBy(lib).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("stdev"), F.count(value).alias("n"))


def trimmed_stats(values: DataFrame, value: str, sigmas: float = 6.0, rounds: int = 100) -> DataFrame:
    """One row (mean, stdev, n, rounds): values further than ``sigmas`` from the mean go until nothing changes.

    Each round is one aggregation over all values against the last round's bounds; only three numbers come back.
    """
    spark, v = values.sparkSession, F.col(value).cast("double")
    now = values.agg(F.avg(v), F.stddev_pop(v), F.count(v)).first()
    done = 0
    while now[2] and done < rounds:
        done += 1
        new = values.filter(v.between(now[0] - sigmas * now[1], now[0] + sigmas * now[1])).agg(F.avg(v), F.stddev_pop(v), F.count(v)).first()
        if new[2] in (now[2], 0):
            break
        now = new
    return spark.createDataFrame([(*now, done)], "mean double, stdev double, n long, rounds int")


def insert_sizes(placements: DataFrame, insert: list[str], end: str, sr: str, off: str, ori: str) -> DataFrame:
    """(insert, insert_size) of pairs with opposite orientations in one covering path; F first counts positive."""
    fwd, rev = placements.filter(F.col(ori) == "F"), placements.filter(F.col(ori) == "R")
    return fwd.select(*insert, sr, F.col(off).alias("_f"), F.col(end).alias("_fe")).join(rev.select(*insert, sr, F.col(off).alias("_r"), F.col(end).alias("_re")), [*insert, sr]).filter("_fe <> _re").select(*insert, sr, (F.col("_r") - F.col("_f")).alias("insert_size"))


def size_sample(sizes: DataFrame, lib: str, size: str, dist: str, least: int = 400, goal: int = 20_000) -> DataFrame:
    """Per library the sizes of the inserts furthest from an end: from the largest distance down to where ``goal`` inserts
    are gathered. Libraries in which over a tenth of the ``least`` furthest are longer than half their distance are left out."""
    counts = sizes.groupBy(lib, dist).agg(F.count(F.lit(1)).alias("_n"))
    got = counts.withColumn("_got", F.sum("_n").over(Window.partitionBy(lib).orderBy(F.desc(dist))))
    limits = got.groupBy(lib).agg(F.max(F.when(F.col("_got") >= least, F.col(dist))).alias("_near"), F.max(F.when(F.col("_got") >= goal, F.col(dist))).alias("_far")).filter("_near is not null and _far > 0")
    limits = limits.join(got.select(lib, F.col(dist).alias("_near"), F.col("_got").alias("_have")), [lib, "_near"])
    met = sizes.join(limits, lib)
    bad = met.filter((F.col(dist) >= F.col("_near")) & (F.col(size) > F.col("_near") / 2)).groupBy(lib).agg(F.count(F.lit(1)).alias("_bad"), F.first("_have").alias("_of")).filter(F.col("_bad") > F.col("_of") * 0.1)
    return met.filter(F.col(dist) >= F.col("_far")).join(bad, lib, "left_anti").select(lib, size)


def number_blocks(reads: DataFrame, lib: str, read_no: str) -> DataFrame:
    """(lib, first, total): each library's block in one numbering, its size the largest number rounded up to even."""
    tops = reads.groupBy(lib).agg(F.max(read_no).alias("_top")).withColumn("total", F.col("_top") + F.when(F.col("_top") % 2 == 0, 2).otherwise(1))
    before = F.sum("total").over(Window.orderBy(lib).rowsBetween(Window.unboundedPreceding, -1))
    return tops.select(lib, F.coalesce(before, F.lit(0)).alias("first"), "total")


def to_number(reads: DataFrame, blocks: DataFrame, lib: str, read_no: str) -> DataFrame:
    return reads.join(F.broadcast(blocks), lib).withColumn("number", F.col("first") + F.col(read_no)).drop("first", "total")


def from_number(numbers: DataFrame, blocks: DataFrame, lib: str, number: str = "number") -> DataFrame:
    """The library and read of each number: a range join against one row for each library."""
    b = F.broadcast(blocks.withColumnRenamed(lib, "_lib"))
    met = numbers.join(b, (F.col(number) >= F.col("first")) & (F.col(number) < F.col("first") + F.col("total")))
    return met.withColumn(lib, F.col("_lib")).withColumn("read_no", F.col(number) - F.col("first")).drop("_lib", "first", "total")


def unjoined_pairs(placements: DataFrame, insert: list[str], sr: str = "sr") -> DataFrame:
    """(sr1, sr2, inserts, cnt): the inserts between each unordered pair of covering paths."""
    return linking_inserts(placements, insert, sr).groupBy("sr1", "sr2").agg(F.sort_array(F.collect_list(F.struct(*insert))).alias("inserts"), F.count(F.lit(1)).alias("cnt"))


def sampled_inserts(reads: DataFrame, insert: list[str], share: float, seed: int = 1) -> DataFrame:
    """Reads of a share of the inserts, chosen by a seeded hash, so mates stay together and reruns agree."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in insert))), 1, 8), 16, 10).cast("long")
    return reads.filter(F.pmod(drawn, F.lit(1_000_000)) < int(share * 1_000_000))


def library_slice(reads: DataFrame, prefix: str, lib: str = "lib") -> DataFrame:
    """The reads of one library."""
    return reads.filter(F.col(lib) == prefix)


def reads_by_path(placements: DataFrame, sr: str, read: str, most: int = 1000) -> DataFrame:
    """(sr, block, reads): the sorted reads of each path, in blocks of about ``most`` for paths that have more."""
    sizes = materialize(placements.groupBy(sr).agg(F.ceil(F.count(F.lit(1)) / most).alias("_blocks")).filter("_blocks > 1"), "sizes")
    met = placements.join(small(sizes), sr, "left")
    block = F.when(F.col("_blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64(read), F.col("_blocks"))).cast("long")
    return met.groupBy(sr, block.alias("block")).agg(F.sort_array(F.collect_list(read)).alias("reads"))


def infrequent(counts: DataFrame, sr: str = "sr", most: int = 1) -> DataFrame:
    """(sr) of the paths with at most ``most`` inserts."""
    return counts.filter(F.col("cnt") <= most).select(sr)


def insert_coverage(links: DataFrame, libraries: DataFrame, genome: int, lib: str = "lib") -> DataFrame:
    """One row (bases, coverage): the mean insert times the linked inserts of each library, over the genome's size."""
    per = links.groupBy(lib).agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(libraries.select(lib, "mean")), lib)
    return per.agg(F.sum(F.col("mean") * F.col("_n")).alias("bases")).withColumn("coverage", F.col("bases") / genome)


def jump_reads(placements: DataFrame, seqs: DataFrame, least: int = 64, most: int = 2047) -> DataFrame:
    """(lib, read_no, seq): each read's stretch of its covering path from (off, ori) on, extended to ``least`` bases."""
    met = placements.join(seqs.select("sr", F.col("seq").alias("_s")), "sr")
    n = F.length("_s")
    forward = F.substr("_s", F.greatest(F.least(F.col("off"), n - least), F.lit(0)).cast("int") + 1, F.lit(most))
    end = F.least(F.greatest(F.col("off"), F.lit(least)), n)
    begin = F.greatest(end - most, F.lit(0))
    backward = S.revcomp(F.substr("_s", (begin + 1).cast("int"), (end - begin).cast("int")))
    return met.select("lib", "read_no", F.when(F.col("ori") == "F", forward).otherwise(backward).alias("seq"))


def coverage_stat(unitigs: DataFrame, fragments: DataFrame, utg: str, read_length: int, long: int = 2000) -> DataFrame:
    """(utg, rho, cnt, gc_ratio, astat): how far a unitig's reads are from those of a single copy.

    ``fragments`` (utg, end, weight); ``unitigs`` (utg, seq). The arrival rate is over unitigs longer than ``long``.
    """
    per = fragments.groupBy(utg).agg(F.max("end").alias("_r"), F.sum("weight").alias("cnt")).filter("cnt > 0")
    per = per.withColumn("rho", F.when(F.col("_r") - read_length < 0, F.lit(1)).otherwise(F.col("_r") - read_length))
    rate = per.filter(F.col("_r") > long).agg((F.sum("cnt") / F.sum("rho")).alias("_rate"))
    gc = unitigs.select(utg, (S.gc_count(F.col("seq")) / (F.length("seq") + 1)).alias("gc_ratio"))
    out = per.crossJoin(F.broadcast(rate)).join(gc, utg, "left")
    return out.select(utg, "rho", "cnt", "gc_ratio", (F.col("rho") * F.col("_rate") - 0.6931471805599453 * F.col("cnt")).alias("astat"))


def repeated(df: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """The rows of keys that occur ``least`` times or more."""
    often = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).drop("_n")
    return df.join(often, keys, "left_semi")


def with_mates_together(df: DataFrame, insert: list[str], end: str = "end") -> DataFrame:
    """All rows of an insert in one partition, next to each other."""
    return df.repartition(*insert).sortWithinPartitions(*insert, end)


def head_sample(df: DataFrame, n: int, *order) -> DataFrame:
    """The first ``n`` rows in an order, for estimates."""
    return df.orderBy(*order).limit(n)
