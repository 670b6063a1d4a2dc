"""Scaffold gaps: end pairs, links, reads near gaps, local closing, and contigs merged through closed gaps."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..plans.storage import materialize
from .overlaps import placed_kmers

_FLIP = str.maketrans("ACGT", "TGCA")


def end_slices(contigs: DataFrame, lengths: list[int]) -> DataFrame:
    """(ctg, length, left, right): first and last bases of each contig."""
    n = F.explode(F.array(*(F.lit(x) for x in lengths))).alias("length")
    return contigs.select("ctg", "seq", n).select("ctg", "length", F.left("seq", F.col("length")).alias("left"), F.right("seq", F.col("length")).alias("right"))


def scaffold_gaps(layout: DataFrame, contigs: DataFrame | None = None, end_bases: int = 100) -> DataFrame:
    """(scf, left_ctg, left_ori, right_ctg, right_ori, gap): neighbours along each scaffold, with the sequences that face
    the gap if ``contigs`` (ctg, seq) are given. ``layout`` is (ctg, scf, begin, end, ori)."""
    w = Window.partitionBy("scf").orderBy("begin", "end", "ctg")
    out = layout.select("scf", F.col("ctg").alias("left_ctg"), F.col("ori").alias("left_ori"), F.lead("ctg").over(w).alias("right_ctg"), F.lead("ori").over(w).alias("right_ori"), (F.lead("begin").over(w) - F.col("end")).alias("gap")).filter("right_ctg is not null")
    if contigs is None:
        return out
    ends = contigs.select("ctg", F.left("seq", F.lit(end_bases)).alias("_b"), F.right("seq", F.lit(end_bases)).alias("_e"))
    left = ends.select(F.col("ctg").alias("left_ctg"), F.col("_b").alias("_lb"), F.col("_e").alias("_le"))
    right = ends.select(F.col("ctg").alias("right_ctg"), F.col("_b").alias("_rb"), F.col("_e").alias("_re"))
    out = out.join(left, "left_ctg").join(right, "right_ctg")
    left_seq = F.when(F.col("left_ori") == "f", F.col("_le")).otherwise(S.revcomp(F.col("_lb")))
    right_seq = F.when(F.col("right_ori") == "f", F.col("_rb")).otherwise(S.revcomp(F.col("_re")))
    return out.select("scf", "left_ctg", "left_ori", "right_ctg", "right_ori", "gap", left_seq.alias("left_seq"), right_seq.alias("right_seq"))


def link_stats(gaps: DataFrame, links: DataFrame, order: str) -> DataFrame:
    """``gaps`` with (mean, stdev) of the last link between the two contigs, whichever way it is written."""
    pair = lambda a, b: (F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b"))
    last = links.select(*pair("ctg1", "ctg2"), order, "mean", "stdev").groupBy("_a", "_b").agg(F.max_by(F.struct("mean", "stdev"), order).alias("s"))
    return gaps.select("*", *pair("left_ctg", "right_ctg")).join(last, ["_a", "_b"], "left").select(*gaps.columns, "s.mean", "s.stdev")


def expected_link(left_ori, right_ori):
    """The link orientation that two neighbours' strands call for: N, I, O or A."""
    return F.when(left_ori == "f", F.when(right_ori == "f", "N").otherwise("I")).otherwise(F.when(right_ori == "f", "O").otherwise("A"))


def unique_links(gaps: DataFrame, links: DataFrame) -> DataFrame:
    """``gaps`` with (mean, stdev, status) of the only fitting link: of status U if there is just one, else of the others."""
    wanted = gaps.withColumn("_want", expected_link(F.col("left_ori"), F.col("right_ori")))
    both = links.select("ctg1", "ctg2", "ori", "mean", "stdev", "status").unionByName(links.select(F.col("ctg2").alias("ctg1"), F.col("ctg1").alias("ctg2"), F.when(F.col("ori") == "N", "A").when(F.col("ori") == "A", "N").otherwise(F.col("ori")).alias("ori"), "mean", "stdev", "status"))
    met = wanted.join(both, (F.col("left_ctg") == F.col("ctg1")) & (F.col("right_ctg") == F.col("ctg2")) & (F.col("_want") == F.col("ori")), "left").drop("ori")
    tier = F.when(F.col("status") == "U", 0).when(F.col("status").isNotNull(), 1)
    got = met.withColumn("_tier", tier).groupBy(*gaps.columns).agg(F.count_if(F.col("_tier") == 0).alias("_u"), F.count_if(F.col("_tier") == 1).alias("_o"), F.min_by(F.struct("mean", "stdev", "status"), F.when(F.col("_tier") == 0, 0)).alias("u"), F.min_by(F.struct("mean", "stdev", "status"), F.when(F.col("_tier") == 1, 0)).alias("o"))
    pick = F.when(F.col("_u") == 1, F.col("u")).when((F.col("_u") == 0) & (F.col("_o") == 1), F.col("o"))
    return got.withColumn("_s", pick).select(*gaps.columns, "_s.mean", "_s.stdev", "_s.status")


def compose_placements(reads: DataFrame, unitigs: DataFrame, status: DataFrame, placed: DataFrame) -> DataFrame:
    """(read, ctg, begin, end, ori): placements known, and those of reads in surrogate unitigs (status S) through the
    unitig's own places, reversed ones turned; reads that are in that contig already are left as they are."""
    u = unitigs.select("utg", "ctg", F.col("begin").alias("_b"), F.col("end").alias("_e"), F.col("ori").alias("_o"))
    met = reads.join(status.filter("status = 'S'").select("utg"), "utg", "left_semi").join(u, "utg")
    fwd = F.col("_o") == "f"
    begin = F.when(fwd, F.col("_b") + F.col("begin")).otherwise(F.col("_e") - F.col("end"))
    end = F.when(fwd, F.col("_b") + F.col("end")).otherwise(F.col("_e") - F.col("begin"))
    ori = F.when(fwd, F.col("ori")).otherwise(F.translate("ori", "fr", "rf"))
    new = met.select("read", "ctg", begin.alias("begin"), end.alias("end"), ori.alias("ori")).join(placed.select("read", "ctg"), ["read", "ctg"], "left_anti")
    return placed.select("read", "ctg", "begin", "end", "ori").unionByName(new)


def fish_reads(ends: DataFrame, reads: DataFrame, k: int, most: int = 1000) -> DataFrame:
    """(gap, insert, end, how): the reads that gaps are closed with.

    A read is caught if it shares a k-mer with a gap's end sequence. It brings its mate if it points into the gap: on the
    strand of the end F, which reads towards the gap, or on the other strand of the end R, which reads away from it. ``how``
    is B if both mates are caught, M for a read and the mate it brings, O for a read alone. k-mers of ``most`` reads or
    more don't count. ``ends`` (gap, side: F or R, seq); ``reads`` (insert, end, seq).
    """
    own = placed_kmers(ends, k, "gap", "side").select("gap", "side", "mer", F.col("flipped").alias("_f")).distinct()
    caught = placed_kmers(reads, k, "insert", "end").select("insert", "end", "mer", "flipped").join(own.select("mer").distinct(), "mer", "left_semi").distinct()
    caught = materialize(caught, "caught")
    frequent = caught.select("mer", "insert", "end").distinct().groupBy("mer").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= most).select("mer")
    hits = caught.join(frequent, "mer", "left_anti").join(own, "mer")
    inward = (F.col("side") == "F") == (F.col("flipped") == F.col("_f"))
    seen = lambda e: F.bool_or(F.col("end") == e)
    brings = lambda e: F.bool_or((F.col("end") == e) & inward)
    per = hits.groupBy("gap", "insert").agg(seen(0).alias("s0"), seen(1).alias("s1"), brings(0).alias("b0"), brings(1).alias("b1"))
    how = F.when(F.col("s0") & F.col("s1"), "B").when(F.col("b0") | F.col("b1"), "M").otherwise("O")
    used = F.filter(F.array(F.when(F.col("s0") | (how != "O"), 0), F.when(F.col("s1") | (how != "O"), 1)), lambda x: x.isNotNull())
    return per.select("gap", "insert", F.explode(used).alias("end"), how.alias("how"))


def mates_of_matched(reads: DataFrame, matched: DataFrame, insert: list[str]) -> DataFrame:
    """Both reads of each insert of which any read is matched."""
    return reads.join(matched.select(*insert).distinct(), insert, "left_semi")


def close_gap(left: str, right: str, reads: list[str], k: int, most: int, solid: int = 1, most_nodes: int = 4000) -> tuple[str, str | None]:
    """(outcome, sequence from left's first to right's last base): the only path of k-mers of the reads between them."""
    if min(len(left), len(right)) < k:
        return "missing sequence", None
    counts: Counter[str] = Counter()
    for seq in [left, right, *reads]:
        for s in (seq, seq[::-1].translate(_FLIP)):
            counts.update(s[i : i + k] for i in range(len(s) - k + 1))
    known = {m for m, n in counts.items() if n >= solid and set(m) <= set("ACGT")}
    start, goal = left[-k:], right[:k]
    if start == goal:
        return "same unitig", left + right[k:]
    front, found, made = [start], [], 0
    for _ in range(most):
        new = []
        for path in front:
            for c in "ACGT":
                if (path[-(k - 1) :] + c) in known:
                    made += 1
                    (found if path[-(k - 1) :] + c == goal else new).append(path + c)
        if made > most_nodes * k:
            return "too many nodes", None
        if len(found) > 1:
            return "not uniquely joinable", None
        front = new
        if not front:
            break
    return ("joined", left[:-k] + found[0] + right[k:]) if found else ("missing sequence", None)


def search_k(left: str, right: str, reads: list[str], ks: list[int], most: int, most_nodes: int = 4000) -> tuple[int, str, str | None]:
    """(k, outcome, sequence) of the first k that joins, by bisection over the runs of untried ks: too many ways ask for
    a larger k, missing sequence for a smaller one. k is 11 if none does."""
    tried = [False] * len(ks)
    lo, hi, last = 0, len(ks) - 1, "missing sequence"
    while True:
        runs, begin = [], None
        for i in range(lo, hi + 2):
            free = i <= hi and not tried[i]
            if free and begin is None:
                begin = i
            elif not free and begin is not None:
                runs.append((begin, i - 1))
                begin = None
        if not runs:
            return 11, last, None
        a, b = max(runs, key=lambda r: r[1] - r[0])
        at = (a + b) // 2
        last, seq = close_gap(left, right, reads, ks[at], most, most_nodes=most_nodes)
        tried[at] = True
        if seq is not None and last != "same unitig":
            return ks[at], last, seq
        if last in ("same unitig", "not uniquely joinable", "too many nodes"):
            lo = at + 1
        else:
            hi = at - 1


def close_gaps(gaps: DataFrame, fished: DataFrame, reads: DataFrame, least_k: int = 17, most_k: int = 65, most_bases: int = 1500, most_nodes: int = 200_000, descending: bool = False) -> DataFrame:
    """(gap, k, outcome, seq): every gap for itself, from its own reads.

    ``gaps`` (gap, left_seq, right_seq); ``fished`` (gap, insert, end); ``reads`` (insert, end, seq). Every k of the range
    may be tried: by bisection, or, with ``descending``, from the largest down to the first that joins. A gap's reads are
    those fished for it, so a group is bounded by the depth of coverage; a failure is an outcome of its gap and stops no
    other.
    """
    own_reads = fished.select("gap", "insert", "end").join(reads.select("insert", "end", F.col("seq").alias("read")), ["insert", "end"]).select("gap", "read")
    with_reads = gaps.join(own_reads, "gap", "left").select("gap", "left_seq", "right_seq", "read")
    ks = list(range(least_k, most_k + 1))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        gap, left, right = frame.iloc[0][["gap", "left_seq", "right_seq"]]
        own = sorted(x for x in frame["read"] if x is not None)
        try:
            if descending:
                k, outcome, seq = 11, "missing sequence", None
                for k_now in reversed(ks):
                    outcome, seq = close_gap(left, right, own, k_now, most_bases, most_nodes=most_nodes)
                    if seq is not None:
                        k = k_now
                        break
            else:
                k, outcome, seq = search_k(left, right, own, ks, most_bases, most_nodes)
        except Exception as e:  # noqa: BLE001
            k, outcome, seq = 11, f"failed: {e}"[:200], None
        return pd.DataFrame([(gap, k, outcome, seq)], columns=["gap", "k", "outcome", "seq"])

    return with_reads.groupBy("gap").applyInPandas(run, f"gap {gaps.schema['gap'].dataType.simpleString()}, k int, outcome string, seq string")


def _merged_rows(layout: DataFrame, contigs: DataFrame, closed: DataFrame, end_bases: int) -> DataFrame:
    """A row for each contig of a scaffold: its part (contigs joined through closed gaps), its piece of the part's sequence
    and the gap before it."""
    w = Window.partitionBy("scf").orderBy("begin", "end", "ctg")
    rows = layout.join(contigs.select("ctg", "seq"), "ctg").withColumn("seq", F.when(F.col("ori") == "f", F.col("seq")).otherwise(S.revcomp(F.col("seq"))))
    rows = rows.join(closed.select(F.col("left_ctg").alias("ctg"), F.col("seq").alias("bridge")), "ctg", "left")
    rows = rows.withColumn("bridge", F.when(F.lead("ctg").over(w).isNotNull(), F.col("bridge")))  # nothing follows the last
    rows = rows.withColumn("_before", F.lag(F.col("bridge")).over(w)).withColumn("_part", F.sum(F.col("_before").isNull().cast("int")).over(w)).withColumn("_gap", F.col("begin") - F.lag("end").over(w))
    inner = F.substr("seq", F.when(F.col("_before").isNotNull(), end_bases).otherwise(0) + F.lit(1))
    cut = F.when(F.col("bridge").isNotNull(), F.expr(f"left(_s, greatest(length(_s) - {end_bases}, 0))")).otherwise(F.col("_s"))
    return rows.withColumn("_s", inner).withColumn("piece", F.concat(cut, F.coalesce("bridge", F.lit(""))))


def merge_contigs(layout: DataFrame, contigs: DataFrame, closed: DataFrame, end_bases: int) -> DataFrame:
    """(scf, name, begin, ori, gap, seq): contigs joined through closed gaps (left_ctg, seq: from end sequence to end sequence).

    A gap's sequence replaces ``end_bases`` of both neighbours. Contigs without a closed gap keep name, strand ``ori`` and
    (as the scaffold has it) sequence; a merged one is named by its parts and strands and lies forward. ``gap`` is the
    distance from the contig before, null for the first. A merged contig is one row, so it has to fit in a task.
    """
    rows = _merged_rows(layout, contigs, closed, end_bases)
    out = rows.groupBy("scf", "_part").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "ctg", "ori", "piece", "_gap"))).alias("x"))
    merged = F.size("x") > 1
    name = F.when(merged, F.array_join(F.transform("x", lambda v: F.concat(v["ctg"].cast("string"), v["ori"])), "_")).otherwise(F.col("x")[0]["ctg"].cast("string"))
    return out.select("scf", name.alias("name"), F.col("x")[0]["begin"].alias("begin"), F.when(merged, "f").otherwise(F.col("x")[0]["ori"]).alias("ori"), F.col("x")[0]["_gap"].alias("gap"), F.array_join(F.transform("x", lambda v: v["piece"]), "").alias("seq"))


def scaffold_places(merged: DataFrame) -> DataFrame:
    """(name, scf, begin, end, ori): where the contigs of ``merge_contigs`` lie in the scaffolds made of them and of the
    gaps left."""
    w = Window.partitionBy("scf").orderBy("begin", "name")
    n, gap = F.length("seq").cast("long"), F.greatest(F.coalesce("gap", F.lit(0)), F.lit(0))
    rows = merged.select("scf", "name", "begin", "ori", n.alias("_n"), F.when(F.lag("name").over(w).isNull(), 0).otherwise(gap).alias("_gap"))
    end = F.sum(F.col("_n") + F.col("_gap")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("name", "scf", (end - F.col("_n")).cast("long").alias("begin"), end.cast("long").alias("end"), "ori")


def scaffold_sequences(merged: DataFrame) -> DataFrame:
    """(scf, seq): each scaffold, N for the bases of the gaps left. A scaffold is one row, so it has to fit in a task."""
    w = Window.partitionBy("scf").orderBy("begin", "name")
    gap = F.when(F.lag("name").over(w).isNull(), 0).otherwise(F.greatest(F.coalesce("gap", F.lit(0)), F.lit(0))).cast("int")
    rows = merged.select("scf", "begin", "name", F.concat(F.repeat(F.lit("N"), gap), F.col("seq")).alias("s"))
    x = F.array_sort(F.collect_list(F.struct("begin", "name", "s")))
    return rows.groupBy("scf").agg(F.array_join(F.transform(x, lambda v: v["s"]), "").alias("seq"))


def split_joined(rows: DataFrame, stats: DataFrame | None = None, sigmas: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """((gap, seq), (gap, read, off, ori)) of result rows (gap, seq, read1, off1, ori1, read2, off2, ori2).

    With ``stats`` (gap, mean, stdev) gaps go whose reads are further than ``sigmas`` deviations from the mean apart.
    """
    if stats is not None:
        apart, reach = F.abs(F.col("off2") - F.col("off1")), sigmas * F.col("stdev")
        bad = rows.join(stats, "gap").filter((apart < F.col("mean") - reach) | (apart > F.col("mean") + reach)).select("gap")
        rows = rows.join(bad, "gap", "left_anti")
    each = F.array(*(F.struct(F.col(f"read{i}").alias("read"), F.col(f"off{i}").alias("off"), F.col(f"ori{i}").alias("ori")) for i in (1, 2)))
    return rows.select("gap", "seq"), rows.select("gap", F.explode(each).alias("e")).select("gap", "e.*")


def sorted_placements(placements: DataFrame) -> DataFrame:
    """Placements by contig, then begin, strand, end and read."""
    return placements.orderBy("ctg", "begin", "ori", "end", "read")


def first_wins(*results: DataFrame, key: str) -> DataFrame:
    """The rows of all results, of equal keys those of the first result that has them."""
    tagged = [r.withColumn("_nth", F.lit(i)) for i, r in enumerate(results)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    w = Window.partitionBy(key).orderBy("_nth")
    return every.withColumn("_rank", F.rank().over(w)).filter("_rank = 1").drop("_rank", "_nth")
