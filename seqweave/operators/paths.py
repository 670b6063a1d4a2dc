"""Covering paths: paths of unitigs that reads or mate pairs cover, their sequences, containment and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..plans.storage import dense_ids, forget, materialize, small
from .unitigs import chain_heads

PATH = "array<struct<ku: bigint, ori: string>>"
#: Elements that paths are looked up by.
GRAM = 4


def read_paths(matches: DataFrame, unitigs: DataFrame, k: int, *keys: str, loose_ends: int = 2) -> DataFrame:
    """(keys, read_len, path, sr, off, ori): the covering path of each read whose matches cover it.

    Matches are taken in order; those within what is covered, or overlapping it by over k - 1 bases, are passed over; a
    gap, or over ``loose_ends`` uncovered bases at the ends together, gives none. Neighbours overlap by k - 1 bases.
    ``off`` and ``ori`` are the read's begin and strand on the canonical path ``sr``.
    """
    n = k - 1
    m = matches.join(unitigs.select("ku", F.length("seq").alias("len")), "ku")
    fwd = F.col("ori") == "F"
    left = F.when(fwd, F.col("ahg")).otherwise(F.col("len") - F.col("ahg") - F.col("read_len"))
    m = m.withColumn("_left", left).withColumn("_b", F.greatest(-F.col("_left"), F.lit(0))).withColumn("_e", F.least(F.col("len") - F.col("_left"), F.col("read_len")))
    rows = m.groupBy(*keys, "read_len").agg(F.array_sort(F.collect_list(F.struct("nth", F.col("_b").cast("long").alias("b"), F.col("_e").cast("long").alias("e"), F.col("ku"), F.col("ori"), F.col("len").cast("long").alias("len"), F.col("_left").cast("long").alias("left")))).alias("ms"))
    start = F.struct(F.lit(True).alias("ok"), F.lit(-1).cast("long").alias("covered"), F.array().cast(PATH).alias("path"), F.lit(0).cast("long").alias("bases"))

    def step(a, x):
        first = a["covered"] < 0
        skip = ~first & ((x["e"] <= a["covered"]) | (a["covered"] - x["b"] > n))
        exact = first | (a["covered"] - x["b"] == n)
        used = F.struct((a["ok"] & exact).alias("ok"), x["e"].alias("covered"), F.concat(a["path"], F.array(F.struct(x["ku"].alias("ku"), x["ori"].alias("ori")))).alias("path"), (a["bases"] + x["len"] - F.when(first, 0).otherwise(n)).alias("bases"))
        return F.when(skip | ~a["ok"], a).otherwise(used)

    folded = rows.withColumn("f", F.aggregate("ms", start, step)).withColumn("_first", F.col("ms")[0])
    folded = folded.filter((F.col("f.ok")) & (F.col("_first.b") + F.col("read_len") - F.col("f.covered") <= loose_ends))
    canon = S.canonical_path(F.col("f.path"))
    same = canon == F.col("f.path")
    off = F.when(same, F.col("_first.left")).otherwise(F.col("f.bases") - F.col("_first.left"))
    return folded.select(*keys, "read_len", canon.alias("path"), S.name_of_path(canon).alias("sr"), off.alias("off"), F.when(same, "F").otherwise("R").alias("ori"))


def path_sequences(paths: DataFrame, unitigs: DataFrame, k: int, most_differences: int = 0) -> DataFrame:
    """(sr, seq, len) of distinct (sr, path): oriented unitigs joined at their k - 1 common bases.

    Paths with a unitig that isn't there, or whose overlaps differ in more than ``most_differences`` places, are left out.
    """
    n = k - 1
    steps = paths.select("sr", "path").distinct().select("sr", F.size("path").alias("size"), F.posexplode("path").alias("at", "x")).select("sr", "size", "at", "x.*")
    piece = F.when(F.col("ori") == "F", F.col("seq")).otherwise(S.revcomp(F.col("seq")))
    met = steps.join(unitigs.select("ku", "seq"), "ku").select("sr", "size", "at", piece.alias("piece"))
    rows = met.groupBy("sr", "size").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("x")).filter("size(x) = size")
    differ = F.transform(F.sequence(F.lit(1), F.size("x") - 1), lambda i: F.levenshtein(F.right(F.get("x", i - 1)["piece"], F.lit(n)), F.left(F.get("x", i)["piece"], F.lit(n))))
    rows = rows.withColumn("worst", F.when(F.size("x") > 1, F.array_max(differ)).otherwise(0)).filter(F.col("worst") <= most_differences)
    seq = F.concat(F.col("x")[0]["piece"], F.array_join(F.transform(F.slice("x", F.lit(2), F.size("x")), lambda v: F.substr(v["piece"], F.lit(n + 1))), ""))
    return rows.select("sr", seq.alias("seq")).withColumn("len", F.length("seq").cast("long"))


def path_lengths(paths: DataFrame, unitigs: DataFrame, k: int) -> DataFrame:
    """(sr, len): the first unitig and what each further one adds."""
    steps = paths.select("sr", F.posexplode("path").alias("at", "x")).select("sr", "at", F.col("x.ku").alias("ku"))
    return steps.join(unitigs.select("ku", F.length("seq").alias("n")), "ku").groupBy("sr").agg((F.sum(F.col("n") - (k - 1)) + (k - 1)).cast("long").alias("len"))


def rank_by_length(seqs: DataFrame) -> DataFrame:
    """``seqs`` (sr, len, ...) with sr_id: 0 for the longest, ties by name."""
    return dense_ids(seqs, "sr_id", F.desc("len"), F.col("sr"))


def contained(paths: DataFrame, lengths: DataFrame | None = None, k: int = 0, unitigs: DataFrame | None = None) -> DataFrame:
    """(sr, container, rel_ori, adj): paths that are a stretch of another, read either way.

    The container is the one with most bases (else elements; then by name) that isn't contained itself. ``adj`` is the
    sum of what the container's unitigs before the place add (F), or up to its end and k - 1 more (R); with
    ``unitigs`` left out each counts 1. Matching is by whole elements, so 1F_2F isn't within 11F_2F.
    """
    p = paths.select("sr", "path").distinct().withColumn("n", F.size("path"))
    p = p.join(lengths.select("sr", "len"), "sr") if lengths is not None else p.withColumn("len", F.col("n").cast("long"))
    framed = lambda path: F.concat(F.lit("_"), S.name_of_path(path), F.lit("_"))
    p = p.withColumn("f", framed(F.col("path"))).withColumn("r", framed(S.reverse_path(F.col("path"))))
    p = materialize(p.withColumn("id", F.monotonically_increasing_id()), "paths")
    gram = lambda part: F.least(S.name_of_path(part), S.name_of_path(S.reverse_path(part)))
    every = lambda m: F.when(F.col("n") >= m, F.transform(F.sequence(F.lit(1), F.col("n") - (m - 1)), lambda i: gram(F.slice("path", i, m)))).otherwise(F.array().cast("array<string>"))
    # Up to four elements, a path is in what holds the whole of it, read either way: a row for each gram and task tells.
    grams = p.select("id", "sr", "len", "n", F.explode(F.array_distinct(F.concat(*(every(m) for m in range(1, GRAM + 1))))).alias("gram"))
    held = materialize(grams.groupBy("gram").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("holders")), "grams")
    brief = p.filter(F.col("n") <= GRAM).withColumn("gram", gram(F.col("path")))
    inside = brief.join(held, "gram").filter("most > n").select("id")
    # Longer ones meet the holders of their rarest gram; names are compared only there.
    long = p.filter(F.col("n") > GRAM)
    own = long.select("id", F.explode(F.array_distinct(every(GRAM))).alias("gram")).join(held, "gram").groupBy("id").agg(F.min_by("gram", F.struct("holders", "gram")).alias("gram"))
    holders = grams.join(own.select("gram").distinct(), "gram", "left_semi").select(F.col("id").alias("in_id"), F.col("n").alias("in_n"), "gram")
    near = long.select("id", "n").join(own, "id").join(holders, "gram").filter("in_n > n").select("id", "in_id")
    near = near.join(p.select("id", "sr", "n", "f", "r"), "id").join(p.select(F.col("id").alias("in_id"), F.col("sr").alias("container"), F.col("len").alias("in_len"), F.col("f").alias("in_f")), "in_id")
    met = materialize(near.filter(F.col("in_f").contains(F.col("f")) | F.col("in_f").contains(F.col("r"))).select("id", "in_id", "container", "in_len"), "contained")
    inside = materialize(inside.union(met.select("id")).distinct(), "inside")
    # Of containers that aren't contained themselves, the one of most bases, then by name.
    top = grams.join(inside, "id", "left_anti").groupBy("gram").agg(F.min_by(F.struct(F.col("id").alias("in_id"), "n"), F.struct(-F.col("len"), F.col("sr"))).alias("x"))
    of_brief = brief.join(inside, "id", "left_semi").join(top, "gram").select("id", "x.in_id")
    of_long = met.join(inside.select(F.col("id").alias("in_id")), "in_id", "left_anti").groupBy("id").agg(F.min_by("in_id", F.struct(-F.col("in_len"), F.col("container"))).alias("in_id"))
    best = of_brief.union(of_long).join(p.select("id", "sr", "n", "f", "r"), "id").join(p.select(F.col("id").alias("in_id"), F.col("sr").alias("container"), F.col("f").alias("in_f")), "in_id")
    ahead = F.col("in_f").contains(F.col("f"))
    best = best.select("sr", "container", "in_f", "n", F.when(ahead, F.col("f")).otherwise(F.col("r")).alias("as"), F.when(ahead, "F").otherwise("R").alias("rel_ori"))
    before = F.expr("size(split(substring(in_f, 1, instr(in_f, `as`)), '_')) - 2")
    best = best.withColumn("at", before)
    upto = F.when(F.col("rel_ori") == "F", F.col("at")).otherwise(F.col("at") + F.col("n"))
    if unitigs is None:
        return best.select("sr", "container", "rel_ori", upto.cast("long").alias("adj"))
    counted = best.select("sr", "container", "rel_ori", upto.alias("upto"), F.posexplode(S.path_of_name(F.col("container"))).alias("i", "x")).filter("i < upto").join(unitigs.select(F.col("ku").alias("_ku"), F.length("seq").alias("_n")), F.col("x.ku") == F.col("_ku"))
    sums = counted.groupBy("sr").agg(F.sum(F.col("_n") - (k - 1)).alias("s"))
    adj = F.coalesce("s", F.lit(0)) + F.when(F.col("rel_ori") == "R", k - 1).otherwise(0)
    return best.join(sums, "sr", "left").select("sr", "container", "rel_ori", adj.cast("long").alias("adj"))


def translate_reduction(reduction: DataFrame, ranks: DataFrame) -> DataFrame:
    """(sr_id, container_id, rel_ori, adj): a reduction by ids instead of names."""
    one, two = (ranks.select(F.col("sr").alias(name), F.col("sr_id").alias(f"{name}_id")) for name in ("sr", "container"))
    return reduction.join(one, "sr").join(two, "container").select("sr_id", "container_id", "rel_ori", "adj")


def replace_placements(placements: DataFrame, good: DataFrame, reduction: DataFrame) -> DataFrame:
    """Placements in covering paths that are good, moved into their containers."""
    kept = placements.join(good.select("sr"), "sr", "left_semi").join(reduction, "sr", "left")
    turned = F.col("rel_ori") == "R"
    off = F.when(F.col("container").isNull(), F.col("off")).when(turned, F.col("adj") - F.col("off")).otherwise(F.col("off") + F.col("adj"))
    ori = F.when(turned, F.translate("ori", "FR", "RF")).otherwise(F.col("ori"))
    return kept.withColumn("off", off).withColumn("ori", ori).withColumn("sr", F.coalesce("container", "sr")).drop("container", "rel_ori", "adj")


def join_mates(pairs: DataFrame, adjacent: DataFrame, k: int, sigmas: float = 5.0, most_nodes: int = 4000, aggressive: bool = False) -> DataFrame:
    """(insert, outcome, path): the one path of unitigs between a pair's reads that its library allows.

    ``pairs`` (insert, even, odd: paths in reading direction of each read, len, before, after, mean, stdev): ``len`` of
    the even read's first unitig, ``before`` its bases ahead of that read, ``after`` those of the odd read's first unitig
    behind that read. All frontiers step together, one join with ``adjacent`` a round; a pair that has made over
    ``most_nodes`` steps in all rounds stops. Paths are told apart by their unitigs, not merged where offsets are alike. Of several paths those stay that hold both reads' paths; still several are ambiguous, unless
    ``aggressive`` takes the first.
    """
    n = k - 1
    goal = S.reverse_path(F.col("odd"))
    base = pairs.select("insert", "even", goal.alias("far"), (F.col("mean") + sigmas * F.col("stdev") + F.col("before") + F.col("after")).alias("most"), F.col("even")[0].alias("x"), F.col("len").cast("long").alias("bases"))
    base = materialize(base.withColumn("goal", F.element_at("far", -1)).withColumn("path", F.array("x")), "pairs")
    at_goal = lambda df: df.filter((F.col("ku") == F.col("goal.ku")) & (F.col("ori") == F.col("goal.ori"))).select("insert", "path")
    front = base.select("insert", "most", "goal", "path", "bases", F.col("x.ku").alias("ku"), F.col("x.ori").alias("ori"), F.lit(0).cast("long").alias("made"))
    found, stopped = at_goal(front), None
    while True:
        step = front.join(adjacent, ["ku", "ori"]).withColumn("bases", F.col("bases") + F.col("nlen") - n).filter(F.col("bases") <= F.col("most"))
        step = step.select("insert", "most", "goal", F.concat("path", F.array(F.struct(F.col("nku").alias("ku"), F.col("nori").alias("ori")))).alias("path"), "bases", F.col("nku").alias("ku"), F.col("nori").alias("ori"), "made")
        step = materialize(step, "steps")
        # All steps that an insert has made so far count, not this round's alone.
        made = materialize(step.groupBy("insert").agg((F.first("made") + F.count(F.lit(1))).alias("made")), "made")
        many = made.filter(F.col("made") > most_nodes).select("insert")
        stopped = many if stopped is None else stopped.union(many)
        front = materialize(step.drop("made").join(small(made.filter(F.col("made") <= most_nodes)), "insert"), "front")
        forget(step)
        if front.isEmpty():
            break
        found = found.unionByName(at_goal(front))
    found = materialize(found, "paths")
    held = lambda path, part: F.concat(F.lit("_"), S.name_of_path(path), F.lit("_")).contains(F.concat(F.lit("_"), S.name_of_path(part), F.lit("_")))
    met = found.join(base.select("insert", "even", "far"), "insert").withColumn("fits", (held(F.col("path"), F.col("even"))).cast("int") + held(F.col("path"), F.col("far")).cast("int"))
    got = met.groupBy("insert").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("fits") == 2).alias("n2"), F.count_if(F.col("fits") >= 1).alias("n1"), F.max_by(F.struct("path"), F.struct("fits", S.name_of_path(F.col("path")))).alias("best"))
    out = base.select("insert", (F.col("x") == F.col("goal")).alias("same")).join(got, "insert", "left")
    if stopped is not None:
        out = out.join(stopped.distinct().withColumn("_stop", F.lit(True)), "insert", "left")
    else:
        out = out.withColumn("_stop", F.lit(None).cast("boolean"))
    outcome = F.when(F.col("same"), "same unitig").when(F.col("_stop"), "too many nodes").when(F.col("n").isNull(), "missing sequence").when(F.col("n") == 1, "joined").when(F.col("n2") == 1, "joined after reads").when((F.col("n2") == 0) & (F.col("n1") == 1), "joined after reads").otherwise("joined aggressively" if aggressive else "ambiguous")
    return out.select("insert", outcome.alias("outcome"), F.when(outcome.startswith("joined"), F.col("best.path")).alias("path"))


def merge_chains(paths: DataFrame) -> DataFrame:
    """(sr, chain, pos, turned): covering paths chained at unitigs that are an end of exactly two and inside none.

    Each chain is named by its first covering path; ``turned`` ones are read from their other end. Rings stay unmerged.
    """
    p = paths.select("sr", "path").distinct()
    ends = p.select("sr", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("path")[0]["ku"].alias("ku")), F.struct(F.lit(1).alias("side"), F.element_at("path", -1)["ku"].alias("ku")))).alias("e")).select("sr", "e.*")
    inside = p.select(F.explode(F.transform(F.slice("path", 2, F.greatest(F.size("path") - 2, F.lit(0))), lambda x: x["ku"])).alias("ku")).distinct()
    joints = ends.groupBy("ku").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("sr", "side"))).alias("two")).filter("n = 2").join(inside, "ku", "left_anti")
    joints = joints.filter("two[0].sr <> two[1].sr")
    # A node is a covering path in a reading direction; leaving at side s continues into the other covering path at its side t.
    lead = F.array(F.struct(F.col("two")[0].alias("a"), F.col("two")[1].alias("b")), F.struct(F.col("two")[1].alias("a"), F.col("two")[0].alias("b")))
    hops = joints.select(F.explode(lead).alias("h")).select(F.concat_ws("|", F.col("h.a.sr"), F.when(F.col("h.a.side") == 1, "F").otherwise("R")).alias("prev"), F.concat_ws("|", F.col("h.b.sr"), F.when(F.col("h.b.side") == 0, "F").otherwise("R")).alias("node"))
    nodes = p.select(F.explode(F.array(F.concat_ws("|", "sr", F.lit("F")), F.concat_ws("|", "sr", F.lit("R")))).alias("node"))
    placed = chain_heads(materialize(hops, "hops"), materialize(nodes, "nodes")).withColumn("sr", F.substring_index("node", "|", 1)).withColumn("turned", F.substring_index("node", "|", -1) == "R")
    placed = placed.withColumn("chain", F.substring_index("head", "|", 1))
    # Each chain is there from both ends: the one with the smaller head stays.
    return placed.groupBy("sr").agg(F.min_by(F.struct("chain", "pos", "turned"), F.struct("head", "pos")).alias("b")).select("sr", "b.*")


def outcomes(joined: DataFrame) -> DataFrame:
    """(outcome, n): how the pairs ended."""
    return joined.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


