import random

import brute
import pytest
from pyspark.sql import functions as F

from seqweave.functions import sequences as S
from seqweave.operators import kmers, overlaps, paths, unitigs
from seqweave.plans import closing, whole
from seqweave.plans.assembly import covering_paths
from seqweave.plans.stages import Config, run_stages

K = 11


def reads_of(g, n, size, seed, both=True):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        i = rng.randint(0, len(g) - size)
        s = g[i : i + size]
        out.append(brute.rc(s) if both and rng.random() < 0.5 else s)
    return out


def shapes():
    a, b, c, d = (brute.genome(60, s) for s in (11, 12, 13, 14))
    ring = brute.genome(40, 15)
    yield "linear", [a + b], 0
    yield "bubble", [a + b + c, a + d + c], 0
    yield "tip", [a + b + c, a + b[:20] + "T" + d[:4]], 0
    yield "cycle", [ring + ring[: K + 5]], 0
    yield "repeat", [a + c + b, d + c + brute.genome(60, 16)], 0
    yield "low run", [a + b], 4


@pytest.mark.parametrize("name,seqs,low", list(shapes()), ids=[s[0] for s in shapes()])
def test_compaction_of_small_graphs(spark, name, seqs, low):
    twice = [*seqs, *map(brute.rc, seqs)]
    if low:  # the middle three k-mers are there once only
        g = seqs[0]
        twice = [g, g[:62], g[55:], g[66 - 3 :]]
    df = spark.createDataFrame([(s,) for s in twice], "seq string")
    got = unitigs.compact(kmers.count_kmers(df, K), K, 2, low)
    want = brute.unitigs(brute.counts(twice, K), K, 2, low)
    assert {r["seq"] for r in got.collect()} == want
    assert sorted(r["ku"] for r in got.collect()) == list(range(len(want)))
    if name == "cycle":
        assert not want


def test_compaction_of_reads_with_errors(spark):
    g = brute.genome(800, 21)
    rng, rs = random.Random(22), reads_of(brute.genome(800, 21), 150, 60, 23)
    rs = ["".join(rng.choice("ACGT") if rng.random() < 0.01 else c for c in r) for r in rs]
    df = spark.createDataFrame([(s,) for s in rs], "seq string")
    got = {r["seq"] for r in unitigs.compact(kmers.count_kmers(df, K), K, 2).collect()}
    assert got == brute.unitigs(brute.counts(rs, K), K, 2)
    members = [m for s in got for m in brute.counts([s], K).elements()]
    assert len(members) == len(set(members)) and g


@pytest.fixture(scope="module")
def bubble(spark):
    a, b, c, d = (brute.genome(60, s) for s in (31, 32, 33, 34))
    seqs = [a + b + c, a + d + c]
    df = spark.createDataFrame([(s,) for s in seqs * 2], "seq string")
    u = unitigs.compact(kmers.count_kmers(df, K), K, 2).cache()
    return seqs, u, {r["ku"]: r["seq"] for r in u.collect()}


def test_overlaps_and_adjacency(spark, bubble):
    _, u, us = bubble
    got = overlaps.end_overlaps(u, K)
    assert {tuple(r) for r in got.collect()} == brute.overlaps(us, K)
    adj = overlaps.adjacency(got, u).collect()
    want = brute.adjacency(us, K)
    assert {(r["ku"], r["ori"], r["nku"], r["nori"]) for r in adj} == {(*x, *y) for x, ys in want.items() for y in ys}


def test_matches_paths_and_sequences(spark, bubble):
    seqs, u, us = bubble
    rs = [(i, 0, s) for i, s in enumerate(reads_of(seqs[0], 20, 80, 41) + reads_of(seqs[1], 20, 80, 42))]
    df = spark.createDataFrame(rs, "insert long, end int, seq string")
    m = overlaps.read_matches(df, u, K, "insert", "end")
    placed = paths.read_paths(m, u, K, "insert", "end")
    rows = {r["insert"]: r for r in placed.collect()}
    assert len(rows) == len(rs)
    found = {r["sr"]: r["seq"] for r in paths.path_sequences(placed, u, K).collect()}
    for i, _, s in rs:
        r = rows[i]
        whole = found[r["sr"]]
        got = whole[r["off"] : r["off"] + len(s)] if r["ori"] == "F" else brute.rc(whole[r["off"] - len(s) : r["off"]])
        assert got == s
    lens = {r["sr"]: r["len"] for r in paths.path_lengths(placed.select("sr", "path").distinct(), u, K).collect()}
    assert all(lens[n] == len(s) for n, s in found.items())


def test_short_and_strange_reads_match_nothing(spark, bubble):
    _, u, _ = bubble
    df = spark.createDataFrame([(1, "ACG"), (2, "N" * 50), (3, ""), (4, None)], "insert long, seq string")
    assert overlaps.read_matches(df, u, K, "insert").count() == 0


def test_mate_join(spark, bubble):
    seqs, u, us = bubble
    adj = overlaps.adjacency(overlaps.end_overlaps(u, K), u)
    long = seqs[0]
    pairs = [(0, long[:50], brute.rc(long[-50:])), (1, long[:50], brute.rc(long[80:130])), (2, long[:90], brute.rc(long[-50:]))]
    df = spark.createDataFrame([(i, e, s) for i, a, b in pairs for e, s in ((0, a), (1, b))], "insert long, end int, seq string")
    placed = paths.read_paths(overlaps.read_matches(df, u, K, "insert", "end"), u, K, "insert", "end")
    way = F.when(F.col("ori") == "F", F.col("path")).otherwise(S.reverse_path(F.col("path")))
    sides = placed.withColumn("way", way)
    p = sides.filter("end = 0").select("insert", F.col("way").alias("even")).join(sides.filter("end = 1").select("insert", F.col("way").alias("odd")), "insert")
    p = p.join(u.select("ku", F.length("seq").alias("len")), F.col("even")[0]["ku"] == F.col("ku")).drop("ku")
    p = p.select("*", F.lit(0).alias("before"), F.lit(0).alias("after"), F.lit(180.0).alias("mean"), F.lit(20.0).alias("stdev"))
    got = {r["insert"]: r for r in paths.join_mates(p, adj, K).collect()}
    assert got[0]["outcome"] == "ambiguous"  # both arms of the bubble fit
    assert got[2]["outcome"] in ("joined", "joined after reads")
    assert len(got[2]["path"]) == 3
    assert paths.join_mates(p, adj, K, most_nodes=0).filter("outcome = 'too many nodes'").count() >= 1


def test_containment(spark):
    names = ["1F_2F", "11F_2F", "0F_1F_2F_3R", "3F_2R", "9F", "4F_9R_5F", "9R_5F"]
    df = spark.createDataFrame([(n,) for n in names], "sr string").withColumn("path", S.path_of_name(F.col("sr")))
    got = {r["sr"]: (r["container"], r["rel_ori"], r["adj"]) for r in paths.contained(df).collect()}
    assert got == {"1F_2F": ("0F_1F_2F_3R", "F", 1), "3F_2R": ("0F_1F_2F_3R", "R", 4), "9F": ("4F_9R_5F", "R", 2), "9R_5F": ("4F_9R_5F", "F", 1)}


def test_spurs_and_joins(spark):
    a, b = brute.genome(100, 51), brute.genome(100, 52)
    seqs = [a + b, a + brute.genome(8, 53)]
    df = spark.createDataFrame([(s,) for s in seqs * 2], "seq string")
    u = unitigs.compact(kmers.count_kmers(df, K), K, 2)
    us = {r["ku"]: r["seq"] for r in u.collect()}
    adj = overlaps.adjacency(overlaps.end_overlaps(u, K), u)
    dead = {r["ku"] for r in unitigs.kill_spurs(adj, u, K, 15).collect()}
    assert {len(us[x]) for x in dead} == {min(map(len, us.values()))}
    left = unitigs.unique_joins(adj, unitigs.kill_spurs(adj, u, K, 15)).collect()
    assert {r["ku"] for r in left} == set(us) - dead


def test_chains(spark):
    names = ["1F_2F", "2F_3F", "3F_4F", "7F_8F", "8F_9F", "5F_8R"]
    df = spark.createDataFrame([(n,) for n in names], "sr string").withColumn("path", S.path_of_name(F.col("sr")))
    got = {r["sr"]: (r["chain"], r["pos"]) for r in paths.merge_chains(df).collect()}
    assert len({got[n][0] for n in names[:3]}) == 1 and sorted(got[n][1] for n in names[:3]) == [0, 1, 2]
    assert len({got[n][0] for n in names[3:]}) == 3  # 8 is an end three times


def test_whole_plan(spark, tmp_path):
    g = brute.genome(1500, 61)
    rs = reads_of(g, 200, 70, 62)
    df = spark.createDataFrame([(i // 2, i % 2, s) for i, s in enumerate(rs)], "insert long, end int, seq string")
    t = covering_paths(spark, df, str(tmp_path), 21)
    seqs = {r["sr"]: r["seq"] for r in t["sequences"].collect()}
    final = t["final"].collect()
    assert final and set(t) == {"counts", "unitigs", "matches", "placed", "good", "sequences", "reduction", "final"}
    by = {(i // 2, i % 2): s for i, s in enumerate(rs)}
    for r in final:
        s, whole = by[r["insert"], r["end"]], seqs[r["sr"]]
        got = whole[r["off"] : r["off"] + len(s)] if r["ori"] == "F" else brute.rc(whole[r["off"] - len(s) : r["off"]])
        assert got == s
    before = (tmp_path / "unitigs" / "_SUCCESS").stat().st_mtime_ns
    again = covering_paths(spark, df, str(tmp_path), 21, stop_after="matches")
    assert set(again) == {"counts", "unitigs", "matches"} and (tmp_path / "unitigs" / "_SUCCESS").stat().st_mtime_ns == before


def test_piped_stages(spark, tmp_path):
    """A stage that is piped isn't written; the result is the same."""
    stages = [("a", lambda s, t: s.range(10)), ("b", lambda s, t: t["a"].filter("id > 3")), ("c", lambda s, t: t["b"].union(t["a"]))]
    written, piped = run_stages(spark, str(tmp_path / "w"), stages), run_stages(spark, str(tmp_path / "p"), stages, piped=("b",))
    assert sorted(r[0] for r in written["c"].collect()) == sorted(r[0] for r in piped["c"].collect())
    assert (tmp_path / "w" / "b").exists() and not (tmp_path / "p" / "b").exists()
    with pytest.raises(RuntimeError, match="fewer than 99"):
        run_stages(spark, str(tmp_path / "w"), stages, least_rows={"c": 99})


def test_gaps_closed_together(spark):
    """The larger k closes what reads cover well, the smaller one a gap where reads overlap by less; a hole stays."""
    g, h, other = brute.genome(500, 81), brute.genome(500, 82), brute.genome(400, 83)
    starts = {0: range(100, 360, 12), 1: [*range(100, 186, 12), 215, 245, 275, 305, 335, 360]}
    rows = [(brute.rc(s) if i % 2 else s,) for seq, at in ((g, starts[0]), (h, starts[1])) for i, a in enumerate(at) for s in [seq[a : a + 60]]]
    source = spark.createDataFrame(rows, "seq string")
    df = spark.createDataFrame([("g", g[120:180], g[320:380]), ("h", h[120:180], h[320:380]), ("x", other[:60], other[300:360])], "gap string, left_seq string, right_seq string")
    got = {r["gap"]: (r["k"], r["seq"]) for r in closing.close_globally(df, source, [23, 41], 260, 30).collect()}
    assert got == {"g": (41, g[120:380]), "h": (23, h[120:380])}


def test_whole_plan(spark, tmp_path):
    """From files and a configuration to messages; interrupted and taken up again."""
    g = brute.genome(900, 91)
    rng = random.Random(5)
    pairs = [(g[a : a + 80], brute.rc(g[a + 120 : a + 200])) for a in (rng.randint(0, 700) for _ in range(160))]
    (tmp_path / "a.fa").write_text("".join(f">x{i}\n{s}\n" for i, (s, _) in enumerate(pairs)))
    (tmp_path / "b.fq").write_text("".join(f"@x{i}\n{s}\n+\n{'I' * len(s)}\n" for i, (_, s) in enumerate(pairs)))
    jumps = [x for a in (rng.randint(0, 500) for _ in range(30)) for x in (brute.rc(g[a : a + 70]), g[a + 300 : a + 370])]
    (tmp_path / "c.fa").write_text("".join(f">y{i}\n{s}\n" for i, s in enumerate(jumps)))
    config = Config.parse(f"DATA\nPE = pe 200 20 {tmp_path}/a.fa {tmp_path}/b.fq\nJUMP = sh 370 30 {tmp_path}/c.fa\nEND\nPARAMETERS\nGRAPH_KMER_SIZE = 31\nEND")
    assert set(whole.whole_plan(spark, config, str(tmp_path / "w"), stop_after="jumping")) == {"paired", "jumping"}
    t = whole.whole_plan(spark, config, str(tmp_path / "w"))
    assert t["paired"].count() == 320 and t["jumping"].count() == 60
    both = {(r["insert"], r["end"]): r["seq"] for r in t["paired"].collect()}
    assert [(both[i, 0], both[i, 1]) for i in range(160)] == pairs
    assert t["cleaned"].count() % 2 == 0 and t["cleaned"].count() <= 60
    assert all(s in g or brute.rc(s) in g for s in [r["seq"] for r in t["sequences"].collect()])
    kinds = {r["lib"] for r in t["messages"].collect()}
    assert {"paths", "pe", "sh"} >= kinds >= {"paths", "sh"}
    layout = spark.createDataFrame([("a", "s", 0, 300, "f"), ("b", "s", 400, 900, "f")], "ctg string, scf string, begin long, end long, ori string")
    contigs = spark.createDataFrame([("a", g[:300]), ("b", g[400:])], "ctg string, seq string")
    merged, places, scaffolds = whole.close_scaffolds(layout, contigs, t["paired"].select("insert", "end", "seq"), [31, 33], end_bases=60)
    assert merged.first()["seq"] == g == scaffolds.first()["seq"] and tuple(places.first()) == ("af_bf", "s", 0, 900, "f")
