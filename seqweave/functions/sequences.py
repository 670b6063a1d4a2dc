"""Column functions on nucleotide sequences, read names and covering path paths. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES, COMPLEMENT = "ACGTacgt", "TGCAtgca"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def as_sequence(text: Column) -> Column:
    """Any text read as a sequence: blanks and line ends go, letters map onto ACGT in turn, all else breaks (-)."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), "[ \n]", "")
    return F.translate(F.regexp_replace(kept, "[^A-Za-z]", "-"), _LETTERS, "ACGT" * 13)


def revcomp(seq: Column, others: str = "keep") -> Column:
    """Reverse complement. Characters other than bases stay, or become N with ``others='N'``."""
    out = F.reverse(F.translate(seq, BASES, COMPLEMENT))
    return F.regexp_replace(out, "[^ACGTacgt]", "N") if others == "N" else out


def canonical(seq: Column, largest: bool = False) -> Column:
    """The smaller (or larger) of a sequence and its reverse complement."""
    return (F.greatest if largest else F.least)(seq, revcomp(seq))


def runs(seq: Column) -> Column:
    """The stretches of bases between other characters."""
    return F.filter(F.split(seq, "[^ACGTacgt]+"), lambda x: x != "")


def kmers_of_run(run: Column, k: int) -> Column:
    """All substrings of length ``k``, in order; none of shorter runs."""
    return F.when(F.length(run) >= k, F.transform(F.sequence(F.lit(1), F.length(run) - (k - 1)), lambda i: F.substr(run, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def submer(seq: Column, at: int, k: int) -> Column:
    """The k-mer at offset ``at`` from 0."""
    return F.substring(seq, at + 1, k)


def gc_count(seq: Column) -> Column:
    return (F.length(seq) - F.length(F.translate(seq, "GCgc", ""))).cast("long")


def windows(seq: Column, size: int = 2047, step: int = 1550) -> Column:
    """(off, piece): the whole sequence if it fits, else pieces of ``size`` every ``step``."""
    last = F.greatest(F.ceil((F.length(seq) - size) / step), F.lit(0))
    starts = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: i * step)
    return F.transform(starts, lambda at: F.struct(at.cast("long").alias("off"), F.substr(seq, at + 1, F.lit(size)).alias("piece")))


def mate_no(read_no: Column) -> Column:
    """The number of a read's mate: pairs are (2n, 2n + 1)."""
    return read_no.bitwiseXOR(F.lit(1))


def tail_trim_length(seq: Column, threshold: int = 2) -> Column:
    """Length after the 3' tail is cut: from the end, repeats of the letter add 1, changes take 1 and switch the letter;
    the cut is at the first highest score, if that is at least ``threshold``."""
    at = F.struct(F.lit(0).alias("score"), F.lit(0).alias("best"), F.lit(0).alias("cut"), F.lit(0).alias("i"), F.lit("").alias("last"))

    def step(a: Column, c: Column) -> Column:
        score = F.when(a["i"] == 0, F.lit(0)).when(c == a["last"], a["score"] + 1).otherwise(a["score"] - 1)
        better = score > a["best"]
        return F.struct(score.alias("score"), F.when(better, score).otherwise(a["best"]).alias("best"), F.when(better, a["i"]).otherwise(a["cut"]).alias("cut"), (a["i"] + 1).alias("i"), c.alias("last"))

    return F.aggregate(F.reverse(F.split(seq, "")), at, step, lambda a: (F.length(seq) - F.when(a["best"] >= threshold, a["cut"]).otherwise(0)).cast("long"))


def path_of_name(name: Column) -> Column:
    """12F_7R as an array of (ku, ori)."""
    return F.transform(F.split(name, "_"), lambda x: F.struct(F.regexp_extract(x, "^([0-9]+)", 1).cast("long").alias("ku"), F.right(x, F.lit(1)).alias("ori")))


def name_of_path(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda x: F.concat(x["ku"].cast("string"), x["ori"])), "_")


def reverse_path(path: Column) -> Column:
    """The path read from its other end, every orientation flipped."""
    return F.reverse(F.transform(path, lambda x: F.struct(x["ku"].alias("ku"), F.translate(x["ori"], "FR", "RF").alias("ori"))))


def canonical_path(path: Column) -> Column:
    """The path or its reverse: the outermost pair of unitigs that tells them apart decides, the smaller id (then F) first."""
    sides = lambda p: F.transform(p, lambda x: F.struct(x["ku"], F.when(x["ori"] == "F", 0).otherwise(1)))
    return F.when(sides(path) <= sides(reverse_path(path)), path).otherwise(reverse_path(path))


def wrapped(seq: Column, width: int) -> Column:
    """A sequence with a line end after every ``width`` characters."""
    return F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n"))
