import random

import brute
from pyspark.sql import functions as F

from seqweave.functions import sequences as S
from seqweave.operators import kmers


def col(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


def test_kmer_golden(spark):
    """Three reads, of which one has an N at index 3, have 11 + 42 + 38 k-mers of length 10."""
    a, b = brute.genome(20, 1), brute.genome(51, 2)
    df = spark.createDataFrame([("r0", a), ("r1", b), ("r2", b[:3] + "N" + b[4:])], "name string, seq string")
    assert kmers.explode_kmers(df, 10, canonical=False).count() == 11 + 42 + 38


def test_counts_match_brute_force(spark):
    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACGTN-") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["", "ACGT" * 20]
    df = spark.createDataFrame([(s,) for s in [*seqs, None]], "seq string")
    assert {r["kmer"]: r["cnt"] for r in kmers.count_kmers(df, 5).collect()} == dict(brute.counts(seqs, 5))


def test_revcomp_and_submer(spark):
    s = brute.genome(50, 4)
    assert col(spark, s, lambda c: S.revcomp(S.revcomp(c))) == s
    assert col(spark, s, S.revcomp) == brute.rc(s)
    assert col(spark, "ACxN", lambda c: S.revcomp(c, "N")) == "NNGT"
    assert col(spark, s, lambda c: S.submer(c, 7, 10)) == s[7:17]


def test_names(spark):
    name = "12F_7R_9F"
    assert col(spark, name, lambda c: S.name_of_path(S.path_of_name(c))) == name
    assert col(spark, name, lambda c: S.name_of_path(S.reverse_path(S.path_of_name(c)))) == "9R_7F_12R"
    assert col(spark, name, lambda c: S.name_of_path(S.canonical_path(S.path_of_name(c)))) == "9R_7F_12R"
    assert col(spark, "3R_3F", lambda c: S.name_of_path(S.canonical_path(S.path_of_name(c)))) in ("3R_3F",)


def trim(s, t):
    best, cut, score, last = 0, 0, 0, s[-1:]
    for i, c in enumerate(reversed(s[:-1]), 1):
        score += 1 if c == last else -1
        last = c
        if score > best:
            best, cut = score, i
    return len(s) - (cut if best >= t else 0)


def test_tail_trim(spark):
    rng = random.Random(5)
    seqs = ["".join(rng.choice("AAC") for _ in range(rng.randint(1, 40))) for _ in range(80)] + ["ACGTTTTT", "A"]
    df = spark.createDataFrame([(s,) for s in seqs], "s string").select("s", S.tail_trim_length(F.col("s"), 2).alias("n"))
    assert all(r["n"] == trim(r["s"], 2) for r in df.collect())


def test_windows_and_wrapping(spark):
    s = brute.genome(5000, 6)
    got = col(spark, s, S.windows)
    assert [(w["off"], w["piece"]) for w in got] == [(o, s[o : o + 2047]) for o in (0, 1550, 3100)]
    assert col(spark, "ACGTACGTA", lambda c: S.wrapped(c, 4)) == "ACGT\nACGT\nA"


def test_histogram_functions(spark):
    hist = spark.createDataFrame([(1, 1000), (2, 10), (40, 500), (90, 400)], "cnt long, n_kmers long")
    assert kmers.cumulative_threshold(hist).first()[0] == 90
    assert kmers.error_cutoff(hist).first()[0] >= 3
    packed = spark.createDataFrame([("ACGT",)], "m string").select(kmers.packed_bits(F.col("m"), 4)).first()[0]
    assert packed == 0b00011011


def test_quality(spark):
    df = spark.createDataFrame([("ACGT", "!I#I"), ("AAAA", "IIII")], "seq string, qual string")
    assert [r[0] for r in df.select(kmers.mask_low_quality(F.col("seq"), F.col("qual"), 5)).collect()] == ["NCNT", "AAAA"]
    assert kmers.phred_offset(df).first()[0] == 33
