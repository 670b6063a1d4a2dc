"""Graph operators on k-mers and unitigs. Iterations work on DataFrames and write each round to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..plans.storage import dense_ids, forget, materialize


#: Nodes of a chain whose bases are put together at a time.
BLOCK = 4096


def _oriented(counts: DataFrame) -> DataFrame:
    """(node, cnt): both strands of each canonical k-mer."""
    return counts.select(F.explode(F.array_distinct(F.array("kmer", S.revcomp(F.col("kmer"))))).alias("node"), "cnt")


def chain_heads(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, head, pos): of chains given by ``links`` (node, prev), each node's first node and distance. Cycles are left out.

    Pointer doubling: after r rounds every pointer spans 2^r nodes, so rounds grow with the logarithm of the longest chain.
    """
    now = materialize(nodes.join(links, "node", "left").select("node", F.coalesce("prev", "node").alias("ptr"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("pos"), F.col("prev").isNull().alias("done")), "chains")
    left = now.filter("not done").count()
    while left:
        far = now.select(F.col("node").alias("ptr"), F.col("ptr").alias("_p"), F.col("pos").alias("_d"), F.col("done").alias("_done"))
        last, now = now, materialize(now.filter("done").unionByName(now.filter("not done").join(far, "ptr").select("node", F.col("_p").alias("ptr"), (F.col("pos") + F.col("_d")).alias("pos"), F.col("_done").alias("done"))), "chains")
        forget(last)
        still = now.filter("not done").count()
        # On a cycle nobody gets done; a chain's unfinished nodes at least halve.
        if still == left and now.filter("not done and pos > 0").agg(F.min("pos")).first()[0] > now.count():
            break
        left = still
    return now.filter("done").select("node", F.col("ptr").alias("head"), "pos")


def compact(counts: DataFrame, k: int, solid: int = 2, low_run: int = 0, least: int | None = None) -> DataFrame:
    """(ku, seq): unitigs, the maximal unbranched paths of solid k-mers, up to reverse complement.

    ``counts`` (kmer, cnt) of canonical k-mers of odd length. An extension is followed if it is the only solid one, or,
    where none is solid, the only one at all; up to ``low_run`` k-mers in a row may be below ``solid`` if solid ones
    follow. Paths begin and end solid; cycles give none; ids follow length (longest first), then sequence.
    """
    if k % 2 == 0:
        raise ValueError("k must be odd: a k-mer could be its own reverse complement")
    nodes = _oriented(counts.filter(F.col("cnt") >= (1 if low_run else solid)))
    nodes = materialize(nodes.withColumn("solid", F.col("cnt") >= solid), "nodes")
    # A row for each node and k - 1 bases that it begins or ends with; nodes meet where these agree.
    tails = nodes.select(F.col("node").alias("a"), F.right("node", F.lit(k - 1)).alias("mid"))
    fronts = nodes.select(F.col("node").alias("b"), F.left("node", F.lit(k - 1)).alias("mid"), "solid")
    steps = tails.join(fronts, "mid")
    best = steps.groupBy("a").agg(F.count_if("solid").alias("n_solid"), F.count(F.lit(1)).alias("n"), F.max_by("b", "solid").alias("next"))
    follows = materialize(best.filter("n_solid = 1 or n_solid = 0 and n = 1").select("a", "next"), "follows")
    # The predecessor is the reverse complement's follower, seen from the other strand.
    back = follows.select(S.revcomp(F.col("a")).alias("b"), S.revcomp(F.col("next")).alias("p"))
    links = follows.join(back, (F.col("next") == F.col("b")) & (F.col("a") == F.col("p"))).select(F.col("next").alias("node"), F.col("a").alias("prev"))
    placed = chain_heads(materialize(links, "links"), nodes.select("node")).join(nodes.select("node", "solid"), "node")
    if low_run:
        w = Window.partitionBy("head").orderBy("pos")
        solids = placed.filter("solid").withColumn("_new", F.coalesce((F.col("pos") - F.lag("pos").over(w) > low_run + 1).cast("int"), F.lit(1))).withColumn("part", F.sum("_new").over(w))
        spans = solids.groupBy("head", "part").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
        members = placed.join(spans, "head").filter("pos between lo and hi")
    else:  # all nodes are solid, so a chain is one part from its head on
        members = placed.withColumn("part", F.lit(1)).withColumn("lo", F.lit(0).cast("long"))
    # A node adds its last base, the first one all; blocks of a chain are put together, then its blocks.
    piece = F.when(F.col("pos") == F.col("lo"), F.col("node")).otherwise(F.right("node", F.lit(1)))
    joined = lambda at, what: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, what))), lambda v: v[what]), "")
    blocks = members.select("head", "part", "pos", F.floor(F.col("pos") / BLOCK).alias("block"), piece.alias("piece")).groupBy("head", "part", "block").agg(joined("pos", "piece").alias("bases"))
    whole = blocks.groupBy("head", "part").agg(joined("block", "bases").alias("seq"))
    seqs = whole.select(S.canonical(F.col("seq"), largest=True).alias("seq")).distinct().filter(F.length("seq") >= (least or k))
    return dense_ids(seqs.withColumn("_n", F.length("seq")), "ku", F.desc("_n"), F.col("seq")).select("ku", "seq")


def unitig_stats(unitigs: DataFrame) -> DataFrame:
    """One row: how many, the largest id + 1, all bases, longest."""
    return unitigs.agg(F.count(F.lit(1)).alias("n"), (F.max("ku") + 1).alias("next_id"), F.sum(F.length("seq")).alias("bases"), F.max(F.length("seq")).cast("long").alias("longest"))


def lengths_by_id(unitigs: DataFrame) -> DataFrame:
    """(ku, len) for every id from 0 to the largest, 0 for missing ones."""
    top = unitigs.agg(F.max("ku").alias("top")).filter("top is not null")
    ids = top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("ku"))
    return ids.join(unitigs.select("ku", F.length("seq").alias("len")), "ku", "left").select("ku", F.coalesce("len", F.lit(0)).alias("len"))


def spur_lengths(adjacent: DataFrame, unitigs: DataFrame, k: int, most: int) -> DataFrame:
    """(ku, ori, bases): oriented unitigs on which every way ahead is a dead end of at most ``most`` new bases."""
    own = unitigs.select("ku", (F.length("seq") - (k - 1)).alias("own"))
    sides = own.crossJoin(adjacent.sparkSession.createDataFrame([("F",), ("R",)], "ori string"))
    edges = materialize(adjacent.select("ku", "ori", "nku", "nori"), "edges")
    degree = edges.groupBy("ku", "ori").agg(F.count(F.lit(1)).alias("n"))
    sides = materialize(sides.join(degree, ["ku", "ori"], "left").fillna(0, "n").filter(F.col("own") <= most), "sides")
    known = materialize(sides.filter("n = 0").select("ku", "ori", F.col("own").alias("bases")), "spurs")
    size = known.count()
    while size:
        ahead = edges.join(known.select(F.col("ku").alias("nku"), F.col("ori").alias("nori"), "bases"), ["nku", "nori"])
        closed = ahead.groupBy("ku", "ori").agg(F.count(F.lit(1)).alias("closed"), F.max("bases").alias("further"))
        new = sides.filter("n > 0").join(closed, ["ku", "ori"]).filter("closed = n").select("ku", "ori", (F.col("own") + F.col("further")).alias("bases")).filter(F.col("bases") <= most)
        last, known = known, materialize(sides.filter("n = 0").select("ku", "ori", F.col("own").alias("bases")).unionByName(new), "spurs")
        forget(last)
        if (now := known.count()) == size:
            break
        size = now
    return known


def kill_spurs(adjacent: DataFrame, unitigs: DataFrame, k: int, most: int) -> DataFrame:
    """(ku) to remove: unitigs that are spurs beside a way that goes on, then those left with dead neighbours only."""
    edges = materialize(adjacent.select("ku", "ori", "nku", "nori"), "edges")
    spurs = materialize(spur_lengths(edges, unitigs, k, most), "spurs")
    # Ends from which some way goes on.
    open_ends = edges.join(spurs.select(F.col("ku").alias("nku"), F.col("ori").alias("nori")), ["nku", "nori"], "left_anti").select("ku", "ori").distinct()
    # What leads into a spur, seen from the unitig before: it must have another way on.
    into = edges.select(F.col("nku").alias("ku"), F.col("nori").alias("ori"), F.col("ku").alias("pku"), F.col("ori").alias("pori"))
    led = spurs.join(into, ["ku", "ori"], "left").join(open_ends.select(F.col("ku").alias("pku"), F.col("ori").alias("pori"), F.lit(True).alias("open")), ["pku", "pori"], "left")
    dead = materialize(led.groupBy("ku", "ori").agg(F.bool_and(F.coalesce("open", F.col("pku").isNull())).alias("ok")).filter("ok").select("ku").distinct(), "dead")
    candidates = spurs.select("ku").distinct()
    size = dead.count()
    while True:
        gone = edges.join(dead.select(F.col("ku").alias("nku"), F.lit(1).alias("gone")), "nku", "left").groupBy("ku", "ori").agg(F.count("gone").alias("g"), F.count(F.lit(1)).alias("n"))
        more = gone.filter("g = n").select("ku").join(candidates, "ku", "left_semi")
        last, dead = dead, materialize(dead.union(more).distinct(), "dead")
        forget(last)
        if (now := dead.count()) == size:
            return dead
        size = now


def unique_joins(adjacent: DataFrame, dead: DataFrame) -> DataFrame:
    """(ku, ori, nku, nori): ends that, among unitigs left, have only each other."""
    live = adjacent.select("ku", "ori", "nku", "nori").join(dead, "ku", "left_anti").join(dead.select(F.col("ku").alias("nku")), "nku", "left_anti")
    out = live.groupBy("ku", "ori").agg(F.count(F.lit(1)).alias("n"), F.first("nku").alias("nku"), F.first("nori").alias("nori")).filter("n = 1").drop("n")
    flip = lambda c: F.translate(c, "FR", "RF")
    back = out.select(F.col("nku").alias("ku"), flip(F.col("nori")).alias("ori"), F.col("ku").alias("nku"), flip(F.col("ori")).alias("nori"))
    return out.join(back, ["ku", "ori", "nku", "nori"], "left_semi")
