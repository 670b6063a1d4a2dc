"""Mixing sources to target weights, with DataFrame functions only.

Each source's words are laid end to end, in a seeded order, in one or more cells (source, shard) of bounded size, and cut
into blocks of equal numbers of words. Sainte-Laguë's rule (highest quotients of target / (2 j - 1)) gives each source an
integer number of blocks, then each group of its shards, then each shard an integer quota of these. A shard takes its quota from a seeded first
block on, around its end if need be; quotas beyond the whole shard take it once more. What is left between a source's
blocks and its target is added to (or taken from) the quota of its largest shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small

WORD = r"[^\x20\x09-\x0D]+"
#: Weights that repeat over the sources, the share of all words that is taken, and the most of one source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
BLOCK, SHARD_WORDS, SEED = 256, 2_000_000, "mix-1"
#: Shards among which blocks are shared at a time, and rows that one draw may have before they draw again.
GROUP, HOT = 1024, 20_000


def words_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str, size: str, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target): shares by weight, none above ``most`` times its size.

    Targets are min(most * size, level * weight) with the level at which they add up to ``share`` of all words: what
    sharing the excess again and again leads to. Sources are in the order of their code points, null last. The windows
    run over one row for each source.
    """
    every = Window.partitionBy(F.lit(0))
    listed = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    nth = F.row_number().over(every.orderBy(F.col(source).isNull(), F.col(source)))
    of = F.array(*(F.lit(w) for w in weights))
    listed = listed.withColumn("nth", nth).withColumn("weight", F.element_at(of, F.pmod(F.col("nth") - 1, F.lit(len(weights))).cast("int") + 1))
    listed = listed.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    w = every.orderBy("ratio", "nth")
    listed = listed.withColumn("capped", F.coalesce(F.sum("cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("open", F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing)))
    listed = listed.withColumn("level", (F.lit(share) * F.sum("source_size").over(every) - F.col("capped")) / F.col("open"))
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "nth", "level"))
    level = F.min(fits).over(every)["level"]
    return listed.withColumn("target", F.coalesce(F.least("cap", level * F.col("weight")), F.col("cap"))).select(source, "nth", "source_size", "weight", "target")


def sainte_lague(parties: DataFrame, group: list[str], order: list[str], weight: str, seats: str) -> DataFrame:
    """``parties`` with ``won``: the seats that each gets when its group's ``seats`` go to the highest weight / (2 j - 1).

    Ties go by ``order``, which tells the parties of a group apart. Only quotients between two divisors that certainly
    give too few and enough seats are ranked, about four for each party, whatever the number of seats. Null weights
    count as 0; a group whose weights are all 0 gets no seats.
    """
    every = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    df = parties.withColumn("_w", w).withColumn("_sum", F.sum("_w").over(every)).withColumn("_n", F.count(F.lit(1)).over(every))
    share = lambda b: F.when(F.col("_sum") > 0, F.col("_w") / F.col("_sum") * b).otherwise(F.lit(0.0))
    low = F.greatest(F.ceil(share(F.greatest(F.col(seats) - F.col("_n") / 2, F.lit(0.0))) - 0.5) - 1, F.lit(0)).cast("long")
    high = F.floor(share(F.col(seats) + F.col("_n") / 2) + 0.5).cast("long") + 1
    df = df.withColumn("_low", low).withColumn("_high", F.when(F.col("_w") > 0, high).otherwise(F.lit(0)))
    df = df.withColumn("_left", F.col(seats) - F.sum("_low").over(every))
    tried = df.withColumn("_j", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high")))))
    quotient = F.col("_w") / (2 * F.col("_j") - 1)
    tried = tried.withColumn("_place", F.row_number().over(every.orderBy(quotient.desc_nulls_last(), *order, "_j")))
    won = F.first("_low") + F.sum(F.when(F.col("_j").isNotNull() & (F.col("_place") <= F.col("_left")), 1).otherwise(0))
    kept = [c for c in parties.columns if c not in {*group, *order}]
    return tried.groupBy(*group, *order).agg(*(F.first(c).alias(c) for c in kept), won.alias("won"))


def _draw(seed: str, *of: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("null")) for c in of)))


def _number(digest: Column) -> Column:
    """The first eight digits of a hex digest as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", content: str | None = None, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``docs`` (which has a column of sizes in words) with what the mix takes of each row.

    Adds source_size, target, taken (words, repeats counted), shard, epochs (times the whole row is taken), and
    cut_from, cut_words, head_words: besides, the words from ``cut_from`` on and the first ``head_words`` are taken.
    ``content`` names a column that tells rows with the same key apart. Rows without words take nothing; null sources are a
    source, the last; null keys are a key. Rows alike in key, content and size are interchangeable; where there are more
    than ``HOT`` of a draw, each draws again by its place in ``docs``. An empty table gives no rows. Where the columns that
    are added clash with columns of ``docs``, the added ones replace them. ``docs`` is read three times, so it should be
    thin or written.
    """
    names = {"source_size", "target", "taken", "shard", "epochs", "cut_from", "cut_words", "head_words"}
    # Whole rows travel as one column, so that none of theirs is taken for one of these.
    told = F.lit(None).cast("string") if content is None else F.col(content)
    docs = docs.select(F.struct(*(c for c in docs.columns if c not in names)).alias("_row"), F.col(key).alias("key"), F.col(source).alias("source"), F.col(size).alias("size"), told.alias("content"))
    key, source, size, content = "key", "source", "size", None if content is None else "content"
    sources = source_targets(docs.select(F.col(source).alias("_source"), F.col(size).alias("_size")), "_source", "_size", weights, share, most)
    sources = sources.withColumn("blocks", F.sum(F.round(F.col("target") / block)).over(Window.partitionBy(F.lit(0))).cast("long"))
    sources = sainte_lague(sources, [], ["nth"], "target", "blocks").withColumnRenamed("won", "source_blocks")
    sources = materialize(sources.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long")), "sources")
    drawn = docs.withColumn("_draw", _draw(seed, F.col(key), *([] if content is None else [F.col(content)])))
    hot = materialize(drawn.groupBy("_draw").count().filter(F.col("count") > HOT).select("_draw", F.lit(True).alias("_hot")), "hot")
    if not hot.isEmpty():
        drawn = drawn.withColumn("_at", F.monotonically_increasing_id()).join(small(hot), "_draw", "left")
        drawn = drawn.withColumn("_draw", F.when(F.col("_hot"), _draw(seed, F.col("_draw"), F.col("_at"))).otherwise(F.col("_draw"))).drop("_at", "_hot")
    own = small(sources.select(F.col("_source"), "source_size", "target", "shards"))
    drawn = drawn.join(own, drawn[source].eqNullSafe(own["_source"])).drop("_source").withColumn("shard", F.pmod(_number(F.col("_draw")), F.col("shards")))
    cells = drawn.groupBy(F.col(source).alias("_source"), F.col("shard").alias("_shard")).agg(F.sum(size).alias("words"))
    cells = cells.join(small(sources.select(F.col("_source").alias("_s"), "nth", "target", "source_blocks")), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    cells = materialize(cells.withColumn("_group", F.floor(F.col("_shard") / GROUP)), "cells")
    groups = cells.groupBy("nth", "_group").agg(F.sum("words").alias("group_words"), F.first("source_blocks").alias("source_blocks"))
    groups = materialize(sainte_lague(groups, ["nth"], ["_group"], "group_words", "source_blocks").select("nth", "_group", F.col("won").alias("group_blocks")), "groups")
    cells = sainte_lague(cells.join(small(groups), ["nth", "_group"]), ["nth", "_group"], ["_shard"], "words", "group_blocks")
    # The first shard of those with most words.
    cells = materialize(cells, "quotas")
    largest = cells.groupBy("nth").agg(F.max_by("_shard", F.struct("words", -F.col("_shard"))).alias("_largest"))
    cells = cells.join(small(materialize(largest, "largest")), "nth")
    largest = F.col("_shard") == F.col("_largest")
    rest = F.round("target").cast("long") - F.col("source_blocks") * block
    quota = F.col("won") * block + F.when(largest, rest).otherwise(F.lit(0))
    cells = cells.withColumn("quota", F.least(F.greatest(quota, F.lit(0)), F.col("words") * int(most)))
    first = F.pmod(_number(_draw(seed, F.col("_source"), F.col("_shard"))), F.greatest(F.ceil(F.col("words") / block), F.lit(1))) * block
    cells = cells.withColumn("turns", F.when(F.col("words") > 0, F.floor(F.col("quota") / F.col("words"))).otherwise(F.lit(0)).cast("long")).withColumn("first", first)
    cells = cells.withColumn("part", F.col("quota") - F.col("turns") * F.col("words"))
    cells = small(materialize(cells.select("_source", "_shard", "words", "turns", "part", "first"), "cells"))
    w = Window.partitionBy(source, "shard").orderBy(F.substring("_draw", 9, 24), key, size)
    laid = drawn.withColumn("_end", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.join(cells, F.col(source).eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    begin, end = F.col("_end") - F.col(size), F.col("_end")
    stop = F.col("first") + F.col("part")
    cut_from = F.greatest(begin, F.col("first"))
    cut = F.greatest(F.least(end, stop, F.col("words")) - cut_from, F.lit(0))
    head = F.greatest(F.least(end, stop - F.col("words")) - begin, F.lit(0))
    laid = laid.withColumn("epochs", F.when(F.col(size) > 0, F.col("turns")).otherwise(F.lit(0))).withColumn("cut_words", cut).withColumn("cut_from", F.when(cut > 0, cut_from - begin).otherwise(F.lit(0))).withColumn("head_words", head)
    laid = laid.withColumn("taken", F.col("epochs") * F.col(size) + F.col("cut_words") + F.col("head_words"))
    return laid.select("_row.*", "source_size", "target", "taken", "shard", "epochs", "cut_from", "cut_words", "head_words")


def mixed_texts(mixed: DataFrame, text: str = "text", size: str = "size") -> DataFrame:
    """The rows that the mix consists of: for each time that (a part of) a row is taken, the row with that text.

    Whole rows keep their texts; of cut ones the words and the white space between them stay.
    """
    words = F.regexp_extract_all(F.col(text), F.lit(rf"{WORD}[\x20\x09-\x0D]*"), F.lit(0))
    span = lambda begin, n: F.struct(begin.cast("long").alias("at"), n.cast("long").alias("n"))
    spans = F.concat(F.array_repeat(span(F.lit(0), F.col(size)), F.col("epochs").cast("int")), F.array(span(F.col("cut_from"), F.col("cut_words")), span(F.lit(0), F.col("head_words"))))
    out = mixed.withColumn("_span", F.explode(F.filter(spans, lambda x: x["n"] > 0)))
    part = F.rtrim(F.array_join(F.slice(words, (F.col("_span.at") + 1).cast("int"), F.col("_span.n").cast("int")), ""))
    return out.withColumn(text, F.when(F.col("_span.n") == F.col(size), F.col(text)).otherwise(part)).drop("_span")
