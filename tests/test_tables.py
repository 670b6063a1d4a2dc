import random

import brute
import pytest
from pyspark.sql import functions as F

from seqweave.operators import gaps, kmers, reads
from seqweave.plans.stages import Config
from seqweave.plans.storage import dense_ids
from seqweave.sources import sequences as io
from seqweave.streaming.counts import stream_event_windows, stream_kmer_counts


def test_fasta_round_trip(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"r{i}", brute.genome(rng.randint(1, 200), i)) for i in range(50)]
    io.write_fasta(spark.createDataFrame(rows, "name string, seq string"), str(tmp_path / "x"), width=37, compression="gzip")
    got = io.read_fasta(spark, str(tmp_path / "x"))
    assert sorted((r["name"], r["seq"]) for r in got.collect()) == sorted(rows)
    (tmp_path / "y.fa").write_text(">a first one\nAC\r\nGT\n\n>b\n>c x\nA>C\n")
    assert sorted(tuple(r) for r in io.read_fasta(spark, str(tmp_path / "y.fa")).collect()) == [("a", "first one", "ACGT"), ("b", None, ""), ("c", "x", "A>C")]


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1 x\nACG\nT\n+\n@@\nII\n@r2\nA\n+r2\nI\n")
    assert sorted(tuple(r) for r in io.read_fastq(spark, str(tmp_path / "a.fq")).collect()) == [("r1 x", "ACGT", "@@II"), ("r2", "A", "I")]
    assert io.read_sequences(spark, [str(tmp_path / "a.fq")]).count() == 2
    with pytest.raises(ValueError, match="2 bases and 1"):
        list(io.parse_fastq("@a\nAC\n+\nI\n"))
    with pytest.raises(ValueError, match="not @"):
        list(io.parse_fastq("#a\nAC\n+\nII\n"))
    (tmp_path / "z").write_text("nothing")
    with pytest.raises(ValueError, match="invalid file format"):
        io.read_sequences(spark, [str(tmp_path / "z")])


def test_fastq_by_lines(spark, tmp_path):
    """Records of four lines, over files cut into many splits."""
    rng = random.Random(6)
    want = []
    (tmp_path / "q").mkdir()
    for f in range(3):
        rows = [(f"r{f}.{i} x", brute.genome(n, 1000 * f + i), "".join(rng.choice("@+I!") for _ in range(n))) for i in range(150) for n in [rng.randint(1, 80)]]
        (tmp_path / "q" / f"{f}.fq").write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in rows))
        want += rows
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = sorted(tuple(r) for r in io.read_fastq_lines(spark, str(tmp_path / "q")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted(want) == sorted(tuple(r) for r in io.read_fastq(spark, str(tmp_path / "q")).collect())
    (tmp_path / "bad.fq").write_text("@a\nACG\n+\nII\n")
    with pytest.raises(Exception, match="not a record of four lines"):
        io.read_fastq_lines(spark, str(tmp_path / "bad.fq")).collect()


def test_messages_and_fragments(spark, tmp_path):
    (tmp_path / "m.asm").write_text("{MDI\nref:1\n}\n{UTG\nacc:(7,1)\nsta:S\n}\n{UTG\nacc:(8,2)\nsta:U\n}\n")
    got = io.read_messages(spark, str(tmp_path / "m.asm"), "UTG", id="acc", status="sta")
    assert sorted(tuple(r) for r in got.collect()) == [("(7,1)", "S"), ("(8,2)", "U")]
    df = spark.createDataFrame([(0, 0, "A" * 70), (0, 1, "C" * 64), (1, 0, "G" * 70), (1, 1, "T" * 10)], "insert long, end int, seq string")
    out = {r["nth"]: r["value"] for r in io.frg_messages(df, "pe", 300.0, 30.0).collect()}
    assert set(out) == {0, 1} and out[1].count("{FRG") == 2 and "frg:pe0\nfrg:pe1" in out[1] and "clr:0,64" in out[1]
    (tmp_path / "t.txt").write_text("  pe 300 30 \n\nsh\t500 100\n")
    assert sorted(tuple(r) for r in io.read_table(spark, str(tmp_path / "t.txt"), "lib string, mean double, stdev double").collect()) == [("pe", 300.0, 30.0), ("sh", 500.0, 100.0)]


def test_long_fragments_and_dumps(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGT" * 20, None, None), ("b", "A" * 63, 1, 2), ("c", "N" * 70, 3, 60)], "name string, seq string, clr_begin int, clr_end int")
    out = {r["name"]: r["value"] for r in io.fragment_messages(df, "sr").collect()}
    assert set(out) == {"a", "c"} and "clr:0,80\n}" in out["a"] and "clv:3,60\nclr:3,60" in out["c"] and "qlt:\n" + "G" * 70 in out["c"]
    (tmp_path / "d.txt").write_text("fragmentIdent           = x,17\nother = 1\nfragmentSequence = ACGT\nfragmentIdent = y,18\nfragmentSequence = GG\n")
    assert sorted(tuple(r) for r in io.read_fragment_dump(spark, str(tmp_path / "d.txt")).collect()) == [(17, "ACGT"), (18, "GG")]
    (tmp_path / "d.fa").write_text(">x,17 more\nAC\n>y,18\nGG\n")
    assert sorted(tuple(r) for r in io.read_fragment_dump(spark, str(tmp_path / "d.fa")).collect()) == [(17, "AC"), (18, "GG")]
    io.write_library_stats(spark.createDataFrame([("pe", 300.0, 30.0), ("sh", 3600.0, 200.0)], "lib string, mean double, stdev double"), str(tmp_path / "libs"))
    assert sorted(tuple(r) for r in io.read_library_stats(spark, str(tmp_path / "libs"), ("sh",)).collect()) == [("pe", 300.0, 30.0), ("sh", 500.0, 100.0)]


def test_kmer_tables(spark, tmp_path):
    rng = random.Random(4)
    seqs = [brute.genome(60, i % 5) for i in range(20)]
    df = spark.createDataFrame([(s, "".join(rng.choice("!+I") for _ in s)) for s in seqs], "seq string, qual string")
    counts = kmers.count_kmers(df, 9)
    kmers.save_counts(counts, str(tmp_path / "c"))
    plain = brute.counts(seqs, 9)
    assert {tuple(r) for r in kmers.load_counts(spark, str(tmp_path / "c"), 2, 3).collect()} == {(m, n) for m, n in plain.items() if 2 <= n <= 3}
    kmers.dump_kmers(counts, str(tmp_path / "d"), 4)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "d")).collect()) == sorted(f"{m} {n}" for m, n in plain.items() if n >= 4)
    asked = spark.createDataFrame([(brute.rc(m),) for m in list(plain)[:5]] + [("A" * 9,)], "kmer string")
    assert {tuple(r) for r in kmers.lookup(counts, asked).collect()} == {(m, plain[m]) for m in list(plain)[:5]} | {("A" * 9, plain.get("A" * 9, 0))}
    good = brute.counts(["".join(b if q != "!" else "N" for b, q in zip(s, r["qual"], strict=True)) for r in df.collect() for s in [r["seq"]]], 9)
    assert {(r["kmer"], r["good"]) for r in kmers.quality_filtered_counts(df, 9).collect() if r["good"]} == set(good.items())


def test_config():
    c = Config.parse("PATHS\nX = /a\nEND\nDATA\nPE = pe 300 30 a.fq b.fq\nJUMP = sh 3600 200 c.fq\nEND\nPARAMETERS\nCLOSE_GAPS = 0 # no\nEND")
    assert c.paths["X"] == "/a" and [x["prefix"] for x in c.libraries] == ["pe", "sh"] and c.parameters["CLOSE_GAPS"] == "0"
    for bad in ("DATA\nPE = p 300 30 a\n", "DATA\nPE = pe 3 3 a\nPE = pe 3 3 b\n", "DATA\nJUMP = pe 3 3 a\n", "X = 1\n", "DATA\nPE = pe 3 3 a\nEND\nPARAMETERS\nCLOSE_GAPS = x\n"):
        with pytest.raises(ValueError):
            Config.parse(bad)


@pytest.mark.parametrize("rounds", [0, 1, 12])
def test_greedy_redundancy(spark, rounds):
    """Random orders, chains that hang on their first places, ties at one place, and many pairs at one."""
    rng = random.Random(2)
    places = [(i % 3, rng.randint(0, 30), rng.randint(0, 30)) for i in range(300)] + [(5, i, i) for i in range(80)] + [(6, 7, 7)] * 500 + [(7, 2 * i, 0) for i in range(40)]
    rows = [(g, i, a, b) for i, (g, a, b) in enumerate(places)]
    got = reads.greedy_redundancy(spark.createDataFrame(rows, "g int, i int, a long, b long"), ["g"], ["i"], "a", "b", rounds=rounds)
    want, kept = set(), {}
    for g, i, a, b in rows:
        if any(abs(a - x) <= 2 and abs(b - y) <= 2 for x, y in kept.setdefault(g, [])):
            want.add(i)
        else:
            kept[g].append((a, b))
    assert {r["i"] for r in got.filter("redundant").collect()} == want and got.count() == len(rows)


def test_clean_jumps(spark):
    """Chimeric, redundant and unpaired inserts go; the others' reads are reverse-complemented."""
    rows = [(0, 0, "p", 10, "F"), (0, 1, "q", 50, "R"), (1, 0, "q", 51, "R"), (1, 1, "p", 9, "F"), (2, 0, "p", 100, "R"), (2, 1, "p", 300, "F"), (3, 0, "p", 500, "F"), (4, 0, "p", 10, "F"), (4, 1, "q", 90, "R")]
    placed = spark.createDataFrame(rows, "insert long, end int, sr string, off long, ori string")
    df = spark.createDataFrame([(i, e, f"AC{'GT'[e]}N{i}") for i in range(6) for e in (0, 1)], "insert long, end int, seq string")
    got = sorted(tuple(r) for r in reads.clean_jumps(df, placed, ["insert"]).collect())
    chimeric = {r["insert"] for r in reads.chimeric_inserts(placed, ["insert"], "end", "sr", "off", "ori").collect()}
    want = [i for i in (0, 2, 4) if i not in chimeric]
    assert chimeric == {2} and got == [(i, e, f"NN{'CA'[e]}GT") for i in want for e in (0, 1)]


def test_trimmed_stats(spark):
    rng = random.Random(3)
    values = [rng.gauss(300, 30) for _ in range(2000)] + [5000.0, 90000.0, -8000.0]
    mean, stdev, n, rounds = reads.trimmed_stats(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert n == 2000 and abs(mean - 300) < 5 and abs(stdev - 30) < 3 and rounds > 1
    assert reads.trimmed_stats(spark.createDataFrame([], "v double"), "v").first()["n"] == 0


def test_mates(spark):
    df = spark.createDataFrame([(1, 0, "A"), (2, 1, "C"), (3, 0, "G"), (3, 1, "T")], "insert long, end int, seq string")
    got = sorted(tuple(r) for r in reads.pad_missing_mates(df, ["insert"], "end", "seq").collect())
    assert got == [(1, 0, "A"), (1, 1, "N"), (2, 0, "N"), (2, 1, "C"), (3, 0, "G"), (3, 1, "T")]
    jump = spark.createDataFrame([("sh", 0, "x", 10, "F"), ("sh", 1, "x", 90, "R"), ("sh", 2, "x", 95, "F")], "lib string, read_no long, sr string, off long, ori string")
    seqs = spark.createDataFrame([("x", brute.genome(100, 9))], "sr string, seq string")
    out = {r["read_no"]: r["seq"] for r in reads.jump_reads(jump, seqs, 64).collect()}
    g = brute.genome(100, 9)
    assert out == {0: g[10:], 1: brute.rc(g[:90]), 2: g[36:]}
    part = reads.sampled_inserts(spark.range(10_000).toDF("insert"), ["insert"], 0.3).count()
    assert 2700 < part < 3300


def test_size_sample(spark):
    rows = [("pe", 100 + i % 7, 1000 - i) for i in range(900)]
    got = reads.size_sample(spark.createDataFrame(rows, "lib string, size long, dist long"), "lib", "size", "dist", 100, 300)
    assert got.count() == 300


def test_scaffolds_and_closing(spark):
    g = brute.genome(700, 71)
    layout = spark.createDataFrame([("a", "s", 0, 300, "f"), ("b", "s", 400, 700, "r"), ("c", "s", 900, 950, "f")], "ctg string, scf string, begin long, end long, ori string")
    contigs = spark.createDataFrame([("a", g[:300]), ("b", brute.rc(g[400:])), ("c", brute.genome(50, 72))], "ctg string, seq string")
    found = gaps.scaffold_gaps(layout, contigs, 60).withColumn("gap_id", F.col("left_ctg"))
    rows = {r["left_ctg"]: r for r in found.collect()}
    assert rows["a"]["left_seq"] == g[240:300] and rows["a"]["right_seq"] == g[400:460] and rows["a"]["gap"] == 100
    rng = random.Random(73)
    rs = [(i // 2, i % 2, (lambda s: brute.rc(s) if i % 3 else s)(g[j : j + 70])) for i, j in enumerate(rng.randint(200, 500) for _ in range(160))]
    mates = spark.createDataFrame(rs, "insert long, end int, seq string")
    ids = found.select(F.col("left_ctg").alias("gap"), "left_seq", "right_seq")
    ends = ids.select("gap", F.explode(F.array(F.struct(F.lit("F").alias("side"), F.col("left_seq").alias("seq")), F.struct(F.lit("R").alias("side"), F.col("right_seq").alias("seq")))).alias("e")).select("gap", "e.*")
    fished = gaps.fish_reads(ends, mates, 21)
    everything = ids.select("gap").crossJoin(mates.select("insert", "end"))
    # Against a plain version: strands, mates that are brought, and reads alone.
    kmers_of = lambda x: {x[i : i + 21] for i in range(len(x) - 20)}
    want = set()
    for r in ids.collect():
        for i in range(80):
            caught, brings = set(), False
            for e in (0, 1):
                seq = rs[2 * i + e][2]
                for side, bait in (("F", r["left_seq"]), ("R", r["right_seq"])):
                    same, other = kmers_of(bait) & kmers_of(seq), kmers_of(bait) & kmers_of(brute.rc(seq))
                    caught |= {e} if same or other else set()
                    brings |= bool(same) if side == "F" else bool(other)
            if caught:
                how = "B" if len(caught) == 2 else "M" if brings else "O"
                want |= {(r["gap"], i, e, how) for e in (caught if how == "O" else (0, 1))}
    assert {tuple(r) for r in fished.collect()} == want and {w[3] for w in want} >= {"B", "M", "O"}
    for descending in (False, True):
        got = {r["gap"]: r for r in gaps.close_gaps(ids, everything, mates, 21, 41, descending=descending).collect()}
        assert got["a"]["outcome"] == "joined" and got["a"]["seq"] == g[240:460]
        assert got["b"]["k"] == 11 and got["b"]["seq"] is None
    closed = gaps.close_gaps(ids, everything, mates, 21, 41).filter("seq is not null").select(F.col("gap").alias("left_ctg"), "seq")
    merged = {r["name"]: r["seq"] for r in gaps.merge_contigs(layout, contigs, closed, 60).collect()}
    assert merged == {"af_br": g, "c": brute.genome(50, 72)}
    whole = gaps.merge_contigs(layout, contigs, closed, 60)
    assert sorted(tuple(r) for r in gaps.scaffold_places(whole).collect()) == [("af_br", "s", 0, 700, "f"), ("c", "s", 900, 950, "f")]
    assert gaps.scaffold_sequences(whole).first()["seq"] == g + "N" * 200 + brute.genome(50, 72)


def test_joined_rows_are_split(spark):
    rows = [(0, "ACGT", "cc0", 0, "F", "cc1", 300, "R"), (1, "AC", "cc2", 900, "R", "cc3", 10, "F"), (2, "GG", "cc4", 5, "F", "cc5", 6, "F")]
    df = spark.createDataFrame(rows, "gap int, seq string, read1 string, off1 long, ori1 string, read2 string, off2 long, ori2 string")
    stats = spark.createDataFrame([(0, 280.0, 10.0), (1, 100.0, 10.0)], "gap int, mean double, stdev double")
    seqs, placed = gaps.split_joined(df, stats)
    assert sorted(r["gap"] for r in seqs.collect()) == [0, 2]
    assert sorted(tuple(r) for r in placed.collect()) == [(0, "cc0", 0, "F"), (0, "cc1", 300, "R"), (2, "cc4", 5, "F"), (2, "cc5", 6, "F")]


def test_dense_ids(spark):
    df = spark.range(1000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(997)))
    got = sorted((r["v"], r["id"], r["n"]) for r in dense_ids(df, "n", "v", "id").collect())
    assert [x[2] for x in got] == list(range(1000))


def test_streams(spark, tmp_path):
    spark.createDataFrame([("ACGTA",), ("TACGT",)], "seq string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq string").parquet(str(tmp_path / "in"))
    q = stream_kmer_counts(stream, 3).writeStream.outputMode("complete").format("memory").queryName("kmers").start()
    q.processAllAvailable()
    q.stop()
    assert {r["kmer"]: r["cnt"] for r in spark.table("kmers").collect()} == dict(brute.counts(["ACGTA", "TACGT"], 3))
    assert stream_event_windows(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))).isStreaming
