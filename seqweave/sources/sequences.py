"""Sequence files as tables and back: FASTA, FASTQ, FRG messages, tab-separated placements, assembler messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..plans.storage import materialize, small


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, comment, seq) of each record; lines of a sequence are joined. Compressed files are read by their endings."""
    # A record begins at > after a line end; one at the start of the file follows no line end.
    text = spark.read.option("lineSep", "\n>").text(paths).select(F.regexp_replace("value", "^>", "").alias("value")).filter("trim(value) <> ''")
    head = F.regexp_replace(F.substring_index("value", "\n", 1), "\r$", "")
    seq = F.when(F.instr("value", "\n") > 0, F.regexp_replace(F.expr("substring(value, instr(value, '\n') + 1)"), r"\s", "")).otherwise("")
    return text.select(F.substring_index(head, " ", 1).alias("name"), F.when(F.instr(head, " ") > 0, F.expr("substring(regexp_replace(substring_index(value, '\n', 1), '\r$', ''), instr(value, ' ') + 1)")).alias("comment"), seq.alias("seq"))


def parse_fastq(text: str) -> Iterator[tuple[str, str, str]]:
    """(name, seq, qual); sequence and quality may span lines. ValueError if a header isn't @ or the lengths differ."""
    lines, i = text.splitlines(), 0
    while i < len(lines):
        if not lines[i]:
            i += 1
            continue
        if lines[i][0] != "@":
            raise ValueError(f"a record begins with {lines[i][:20]!r}, not @")
        name, seq, qual = lines[i][1:], [], []
        i += 1
        while i < len(lines) and not lines[i].startswith("+"):
            seq.append(lines[i])
            i += 1
        i, bases, got = i + 1, sum(map(len, seq)), 0
        while i < len(lines) and got < bases:
            qual.append(lines[i])
            got += len(lines[i])
            i += 1
        if got != bases:
            raise ValueError(f"{name}: {bases} bases and {got} qualities")
        yield name, "".join(seq), "".join(qual)


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, seq, qual) of records that may span lines. A file is one task, as these can't be told apart from inside; use
    many files, or ``read_fastq_lines``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame["value"]:
                rows = pd.DataFrame(parse_fastq(text), columns=["name", "seq", "qual"])
                yield rows

    return spark.read.text(paths, wholetext=True).mapInPandas(run, "name string, seq string, qual string")


def read_fastq_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, seq, qual) of files whose records have four lines each. Files are split: lines are numbered within their split,
    and splits by the lines before them, so a large file is as many tasks as it has splits. Compressed files are one split.
    A header that isn't @, or lengths that differ, fail the query."""
    text = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    text = materialize(text.filter(F.trim("value") != ""), "lines")
    sizes = materialize(text.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")), "splits")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    lines = text.withColumn("nth", nth).join(small(sizes.select("file", "block", before.alias("before"))), ["file", "block"]).withColumn("nth", F.col("nth") + F.col("before"))
    line = lambda i: F.max(F.when(F.col("nth") % 4 == i, F.regexp_replace("value", "\r$", "")))
    records = lines.groupBy("file", F.expr("nth div 4").alias("record")).agg(line(0).alias("name"), line(1).alias("seq"), line(2).alias("plus"), line(3).alias("qual"))
    good = F.coalesce(F.col("name").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual")), F.lit(False))
    checked = F.when(good, F.substr("name", F.lit(2))).otherwise(F.raise_error(F.concat(F.lit("not a record of four lines: "), F.coalesce("name", F.lit("")))))
    return records.select(checked.alias("name"), "seq", "qual")


def read_sequences(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(name, seq, qual) of FASTA and FASTQ files, told apart by their first byte; ValueError for others."""
    fasta, fastq = [], []
    for path in paths:
        first = spark.read.text(path).filter("value <> ''").limit(1).collect()
        mark = first[0][0][:1] if first else ">"
        if mark not in ">@":
            raise ValueError(f"{path}: invalid file format")
        (fasta if mark == ">" else fastq).append(path)
    parts = []
    if fasta:
        parts.append(read_fasta(spark, fasta).select("name", "seq", F.lit(None).cast("string").alias("qual")))
    if fastq:
        parts.append(read_fastq(spark, fastq))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq", width: int = 0, compression: str = "none") -> None:
    body = S.wrapped(F.col(seq), width) if width else F.col(seq)
    df.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), body).alias("value")).write.option("compression", compression).text(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """White-space separated fields by position."""
    names = [x.strip().rsplit(" ", 1) for x in schema.split(",")]
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter("trim(value) <> ''").select(*(F.get(parts, F.lit(i)).cast(kind).alias(name) for i, (name, kind) in enumerate(names)))


def read_posmap(spark: SparkSession, path: str, name: str, target: str) -> DataFrame:
    """(name, target, begin, end, ori), tab-separated."""
    return spark.read.csv(path, sep="\t", schema=f"{name} string, {target} string, begin long, end long, ori string")


def read_messages(spark: SparkSession, path: str, kind: str, **fields: str) -> DataFrame:
    """Columns of the assembler's {KIND ...} messages, each by its line's tag: ``id='acc'`` reads the line acc:..."""
    text = spark.read.option("lineSep", "{").text(path).filter(F.col("value").startswith(kind + "\n"))
    return text.select(*(F.nullif(F.regexp_extract("value", rf"(?m)^{tag}:([^\n]*)$", 1), F.lit("")).alias(name) for name, tag in fields.items()))


def frg_messages(reads: DataFrame, lib: str, mean: float, stdev: float, least: int = 64) -> DataFrame:
    """(nth, value): the messages of a paired library: version, library, both fragments and link of each pair.

    Pairs of which a read is shorter than ``least`` are left out. ``reads`` is (insert, end, seq).
    """
    pairs = reads.filter(F.length("seq") >= least).groupBy("insert").agg(F.count(F.lit(1)).alias("n"), F.min_by("seq", "end").alias("s0"), F.max_by("seq", "end").alias("s1")).filter("n = 2")
    frg = lambda end, s: F.concat(F.lit("{FRG\nact:A\nacc:"), F.lit(lib), F.col("insert") * 2 + end, F.lit("\nrnd:1\nsta:G\nlib:"), F.lit(lib), F.lit("\npla:0\nloc:0\nsrc:\n.\nseq:\n"), s, F.lit("\n.\nqlt:\n"), F.repeat(F.lit("E"), F.length(s)), F.lit("\n.\nhps:\n.\nclr:0,"), F.length(s).cast("string"), F.lit("\n}"))
    link = F.concat(F.lit("{LKG\nact:A\nfrg:"), F.lit(lib), F.col("insert") * 2, F.lit("\nfrg:"), F.lit(lib), F.col("insert") * 2 + 1, F.lit("\n}"))
    body = pairs.select((F.col("insert") + 1).alias("nth"), F.concat_ws("\n", frg(0, F.col("s0")), frg(1, F.col("s1")), link).alias("value"))
    head = f"{{VER\nver:2\n}}\n{{LIB\nact:A\nacc:{lib}\nori:I\nmea:{mean}\nstd:{stdev}\nsrc:\n.\nnft:1\nfea:\ndoNotOverlapTrim=1\n.\n}}"
    return reads.sparkSession.createDataFrame([(0, head)], "nth long, value string").unionByName(body)


def path_fragments(seqs: DataFrame, least: int = 64, size: int = 2047, step: int = 1550) -> DataFrame:
    """(name, seq): covering paths as fragments: shorter ones dropped, long ones in overlapping windows named .offset."""
    named = seqs.withColumn("name", F.when(F.length("name") > 100, F.concat(F.lit("SR"), F.xxhash64("name").cast("string"))).otherwise(F.col("name")))
    w = named.select("name", F.length("seq").alias("n"), F.explode(S.windows(F.col("seq"), size, step)).alias("w"))
    return w.filter(F.length("w.piece") >= least).select(F.when(F.col("n") <= size, F.col("name")).otherwise(F.concat_ws(".", "name", F.col("w.off").cast("string"))).alias("name"), F.col("w.piece").alias("seq"))


def fragment_messages(fragments: DataFrame, lib: str, least: int = 64) -> DataFrame:
    """(name, value): FRG messages of long sequences (name, seq, optionally clr_begin and clr_end), those of ``least`` bases
    or more, with the same quality for all bases."""
    n = F.length("seq").cast("string")
    begin, end = (F.coalesce(F.col(c).cast("string"), default) if c in fragments.columns else default for c, default in (("clr_begin", F.lit("0")), ("clr_end", n)))
    value = F.concat(F.lit("{FRG\nact:A\nacc:"), "name", F.lit(f"\nrnd:0\nsta:G\nlib:{lib}\npla:0\nloc:0\nsrc:\n.\nseq:\n"), "seq", F.lit("\n.\nqlt:\n"), F.regexp_replace("seq", "[ACGTNacgtn]", "G"), F.lit("\n.\nhps:\n.\nclv:"), begin, F.lit(","), end, F.lit("\nclr:"), begin, F.lit(","), end, F.lit("\n}"))
    return fragments.filter(F.length("seq") >= least).select("name", value.alias("value"))


def read_fragment_dump(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq) of fragments: FASTA records >name,id, or lines fragmentIdent = name,id and fragmentSequence = bases."""
    if spark.read.text(path).filter("value like 'fragmentIdent%'").isEmpty():
        return read_fasta(spark, path).select(F.element_at(F.split("name", ","), -1).cast("long").alias("id"), "seq")
    text = spark.read.option("lineSep", "fragmentIdent").text(path)
    return text.select(F.regexp_extract("value", r"^[^\n]*?,\s*(\d+)", 1).alias("id"), F.regexp_extract("value", r"\nfragmentSequence\s*=\s([^\n]*)", 1).alias("seq")).filter("id <> ''").withColumn("id", F.col("id").cast("long"))


def write_library_stats(stats: DataFrame, path: str, lib: str = "lib") -> None:
    """Lines "library mean deviation"."""
    stats.select(F.concat_ws(" ", lib, F.col("mean").cast("string"), F.col("stdev").cast("string")).alias("value")).write.mode("overwrite").text(path)


def read_library_stats(spark: SparkSession, path: str, jumping: tuple[str, ...] = ()) -> DataFrame:
    """(lib, mean, stdev); jumping libraries have 500 and 100, whatever the file says."""
    jump = F.col("lib").isin(*jumping) if jumping else F.lit(False)
    stats = read_table(spark, path, "lib string, mean double, stdev double")
    return stats.select("lib", F.when(jump, 500.0).otherwise(F.col("mean")).alias("mean"), F.when(jump, 100.0).otherwise(F.col("stdev")).alias("stdev"))
