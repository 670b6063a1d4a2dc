"""The whole plan, from a configuration to what an assembler takes, and from its scaffolds to closed gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gaps, kmers, reads
from ..sources import sequences as io
from .assembly import path_stages
from .closing import close_globally
from .stages import Config, run_stages
from .storage import dense_ids

KEYS = ["lib", "insert", "end"]


def library_reads(spark: SparkSession, config: Config, kind: str) -> DataFrame:
    """(lib, insert, end, seq) of all libraries of a kind. A pair's reads alternate in one file, or are the rows of two files
    in the same order; reads of other characters than bases go, but use their numbers up."""
    out = None
    for lib in [x for x in config.libraries if x["kind"] == kind]:
        parts = [io.read_sequences(spark, [f]).withColumn("_at", F.monotonically_increasing_id()) for f in lib["files"]]
        if len(parts) == 2:
            parts = [dense_ids(p, "_nth", "_at").select((F.col("_nth") * 2 + e).alias("_at"), "seq") for e, p in enumerate(parts)]
            numbered = parts[0].unionByName(parts[1])
        else:
            numbered = parts[0].select("_at", "seq")
        named = reads.rename_interleaved(numbered, lib["prefix"], "_at")
        out = named if out is None else out.unionByName(named)
    if out is None:
        return spark.createDataFrame([], "lib string, insert long, end int, seq string")
    return out.select("lib", F.expr("read_no div 2").alias("insert"), (F.col("read_no") % 2).cast("int").alias("end"), "seq")


def whole_plan(spark: SparkSession, config: Config, folder: str, k: int | None = None, stop_after: str | None = None) -> dict[str, DataFrame]:
    """Stages below ``folder``: reads of paired and jumping libraries, counts and their error cutoff, covering paths and
    placements of all reads, inserts that link paths, jumping reads left after clean-up, and the messages of both."""
    with_jumps = any(x["kind"] == "JUMP" for x in config.libraries)
    size = config.parameters["GRAPH_KMER_SIZE"]
    first = run_stages(spark, folder, [("paired", lambda s, t: library_reads(s, config, "PE")), ("jumping", lambda s, t: library_reads(s, config, "JUMP"))], stop_after)
    if stop_after in first:
        return first
    if k is None:
        k = int(kmers.auto_k(first["paired"]).first()["k"]) if size == "auto" else int(size)
        k += 1 - k % 2  # odd, as a k-mer may not be its own reverse complement
    source = first["paired"].unionByName(first["jumping"])
    stages = [(name, lambda s, t, f=f: f(s, t)) for name, f in path_stages(source, k, keys=KEYS)]
    solid = next(i for i, (name, _) in enumerate(stages) if name == "unitigs")
    stages.insert(solid, ("cutoff", lambda s, t: kmers.error_cutoff(kmers.histogram(t["counts"]))))
    stages += [
        ("linking", lambda s, t: reads.linking_inserts(t["final"].join(first["paired"].select(*KEYS), KEYS, "left_semi"), ["lib", "insert"])),
        ("cleaned", lambda s, t: reads.clean_jumps(first["jumping"], t["final"].join(first["jumping"].select(*KEYS), KEYS, "left_semi"), ["lib", "insert"]) if with_jumps else first["jumping"]),
        ("messages", lambda s, t: _messages(config, t, first["paired"])),
    ]
    return first | run_stages(spark, folder, stages, stop_after)


def _messages(config: Config, tables: dict[str, DataFrame], paired: DataFrame) -> DataFrame:
    """(lib, nth, value): fragments of the paths' sequences, pairs that link paths, and cleaned jumping pairs."""
    named = tables["sequences"].select(F.col("sr").alias("name"), "seq")
    out = io.fragment_messages(io.path_fragments(named), "paths").select(F.lit("paths").alias("lib"), F.xxhash64("name").alias("nth"), "value")
    linking = paired.join(tables["linking"].select("lib", "insert"), ["lib", "insert"], "left_semi")
    for source, kind in ((linking, "PE"), (tables["cleaned"], "JUMP")):
        for lib in [x for x in config.libraries if x["kind"] == kind]:
            own = reads.library_slice(source, lib["prefix"]).select("insert", "end", "seq")
            out = out.unionByName(io.frg_messages(own, lib["prefix"], lib["mean"], lib["stdev"]).select(F.lit(lib["prefix"]).alias("lib"), "nth", "value"))
    return out


def close_scaffolds(layout: DataFrame, contigs: DataFrame, source: DataFrame, ks: list[int], mean: float = 500.0, stdev: float = 200.0, end_bases: int = 100, globally: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contigs, places, scaffolds) after the gaps of ``layout`` (ctg, scf, begin, end, ori) that reads close are closed: each
    from the reads fished for it, or ``globally`` in one graph. ``source`` (insert, end, seq)."""
    found = gaps.scaffold_gaps(layout, contigs, end_bases)
    ends = found.select(F.col("left_ctg").alias("gap"), "left_seq", "right_seq")
    if globally:
        closed = close_globally(ends, source, ks, mean, stdev)
    else:
        side = lambda which, c: F.struct(F.lit(which).alias("side"), F.col(c).alias("seq"))
        bait = ends.select("gap", F.explode(F.array(side("F", "left_seq"), side("R", "right_seq"))).alias("e")).select("gap", "e.*")
        closed = gaps.close_gaps(ends, gaps.fish_reads(bait, source, min(ks)), source, min(ks), max(ks)).filter("seq is not null")
    merged = gaps.merge_contigs(layout, contigs, closed.select(F.col("gap").alias("left_ctg"), "seq"), end_bases)
    return merged, gaps.scaffold_places(merged), gaps.scaffold_sequences(merged)
