"""Queries of sources and sinks: tables written as files of each format, read back, and the SQL that says what they hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import sequences as S
from .operators import kmers
from .registry import _HITS, _MATES, _R, K, _letters_sql, _mates, benchmark_reads, doc_reads, letters, new_folder, query, table
from .sources import sequences as io


@query(f"{_R} SELECT doc_id::VARCHAR AS name, 'of ' || doc_id % 7 AS comment, seq FROM r WHERE length(seq) > 0")
def fasta_round_trip(spark, sf_dir):
    """FASTA, wrapped and compressed."""
    path = new_folder(spark, "fasta")
    docs = doc_reads(spark, sf_dir).filter("length(seq) > 0").select(F.concat(F.col("doc_id").cast("string"), F.lit(" of "), (F.col("doc_id") % 7).cast("string")).alias("name"), "seq")
    io.write_fasta(docs, path, width=60, compression="gzip")
    return io.read_fasta(spark, path)


@query(f"WITH s AS (SELECT item_id, {_letters_sql()} AS seq FROM benchmark) SELECT 'b' || item_id AS name, seq, CASE WHEN item_id % 2 = 0 THEN repeat('I', length(seq)) END AS qual FROM s")
def mixed_sequence_files(spark, sf_dir):
    """FASTQ and FASTA files, told apart by their first byte."""
    path = new_folder(spark, "mixed")
    seqs = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("name"), letters().alias("seq"))
    io.write_fasta(seqs.filter("item_id % 2 = 1"), f"{path}/fasta", width=50)
    half = F.floor(F.length("seq") / 2).cast("int")
    fastq = F.concat(F.lit("@"), "name", F.lit("\n"), F.left("seq", half), F.lit("\n"), F.substr("seq", half + 1), F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("seq")))
    seqs.filter("item_id % 2 = 0").select(fastq.alias("value")).write.text(f"{path}/fastq")
    return io.read_sequences(spark, [f"{path}/fasta", f"{path}/fastq"])


_FRG = "'{FRG' || chr(10) || 'act:A' || chr(10) || 'acc:'"
_TAIL = "chr(10) || '.' || chr(10) || 'hps:' || chr(10) || '.' || chr(10) || "


def _frg_sql(number: str, seq: str) -> str:
    return f"{_FRG} || 'cv' || ({number}) || chr(10) || 'rnd:1' || chr(10) || 'sta:G' || chr(10) || 'lib:cv' || chr(10) || 'pla:0' || chr(10) || 'loc:0' || chr(10) || 'src:' || chr(10) || '.' || chr(10) || 'seq:' || chr(10) || {seq} || chr(10) || '.' || chr(10) || 'qlt:' || chr(10) || repeat('E', length({seq})) || {_TAIL}'clr:0,' || length({seq}) || chr(10) || '}}'"


@query(f"""{_MATES}, s AS (SELECT conv_id * 1000 + pair AS insert, "end" AS e, translate(regexp_replace(seq, '[^A-Za-z]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', '{'ACGT' * 13}') AS seq FROM m),
p AS (SELECT insert, min(seq) FILTER (e = 0) AS s0, min(seq) FILTER (e = 1) AS s1 FROM s WHERE length(seq) >= 64 GROUP BY insert HAVING count(*) = 2)
SELECT insert + 1 AS nth, {_frg_sql('2 * insert', 's0')} || chr(10) || {_frg_sql('2 * insert + 1', 's1')} || chr(10) || '{{LKG' || chr(10) || 'act:A' || chr(10) || 'frg:cv' || 2 * insert || chr(10) || 'frg:cv' || (2 * insert + 1) || chr(10) || '}}' AS value FROM p""")
def paired_messages(spark, sf_dir):
    """Fragments and links of pairs; the version and library that go before have number 0 and are left out here."""
    mates = _mates(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("pair")).alias("insert"), "end", S.as_sequence(F.regexp_replace("seq", "[^A-Za-z]", "")).alias("seq"))
    return io.frg_messages(mates, "cv", 300.0, 30.0).filter("nth > 0")


@query(f"""{_R} SELECT 'd' || doc_id AS name, {_FRG} || 'd' || doc_id || chr(10) || 'rnd:0' || chr(10) || 'sta:G' || chr(10) || 'lib:long' || chr(10) || 'pla:0' || chr(10) || 'loc:0' || chr(10) || 'src:' || chr(10) || '.' || chr(10) || 'seq:' || chr(10) || seq || chr(10) || '.' || chr(10) || 'qlt:' || chr(10) || regexp_replace(seq, '[ACGTNacgtn]', 'G', 'g') || {_TAIL}
'clv:0,' || length(seq) || chr(10) || 'clr:0,' || length(seq) || chr(10) || '}}' AS value FROM r WHERE length(seq) >= 64""")
def long_messages(spark, sf_dir):
    return io.fragment_messages(doc_reads(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), "seq"), "long")


@query("SELECT '(' || n_nationkey || ',7)' AS acc, CASE WHEN n_regionkey % 2 = 0 THEN 'S' ELSE 'U' END AS status FROM nation")
def assembler_messages(spark, sf_dir):
    """Messages of two kinds, of which one is read."""
    path = new_folder(spark, "messages")
    n = table(spark, sf_dir, "nation")
    utg = n.select(F.concat(F.lit("{UTG\nacc:("), F.col("n_nationkey").cast("string"), F.lit(",7)\nsta:"), F.when(F.col("n_regionkey") % 2 == 0, "S").otherwise("U"), F.lit("\nlen:9\n}")).alias("value"))
    utg.unionByName(n.select(F.concat(F.lit("{CCO\nacc:("), F.col("n_nationkey").cast("string"), F.lit(",8)\n}")).alias("value"))).write.text(path)
    return io.read_messages(spark, path, "UTG", acc="acc", status="sta")


@query("""SELECT (l_partkey * 100 + l_suppkey % 100)::VARCHAR AS ctg, l_orderkey::VARCHAR AS scf, l_linenumber::BIGINT AS "begin", (l_linenumber + l_quantity)::BIGINT AS "end", CASE WHEN l_linestatus = 'F' THEN 'f' ELSE 'r' END AS ori FROM lineitem WHERE l_orderkey % 10 = 0""")
def posmap_round_trip(spark, sf_dir):
    path = new_folder(spark, "posmap")
    rows = table(spark, sf_dir, "lineitem").filter("l_orderkey % 10 = 0").select((F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("ctg"), "l_orderkey", F.col("l_linenumber").alias("begin"), (F.col("l_linenumber") + F.col("l_quantity")).cast("long").alias("end"), F.when(F.col("l_linestatus") == "F", "f").otherwise("r").alias("ori"))
    rows.write.csv(path, sep="\t")
    return io.read_posmap(spark, path, "ctg", "scf")


@query("SELECT event_type AS lib, CASE WHEN event_type = 'click' THEN 500.0::DOUBLE ELSE round(avg(value), 6) END AS mean, CASE WHEN event_type = 'click' THEN 100.0::DOUBLE ELSE round(stddev_pop(value), 6) END AS stdev FROM events GROUP BY event_type")
def library_stats_round_trip(spark, sf_dir):
    path = new_folder(spark, "libraries")
    stats = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("lib")).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("stdev"))
    io.write_library_stats(stats, path)
    return io.read_library_stats(spark, path, ("click",))


@query(f"WITH s AS (SELECT item_id AS id, {_letters_sql()} AS seq FROM benchmark) SELECT id, seq FROM s")
def fragment_dump_scan(spark, sf_dir):
    """Half of the items as one form of dump, half as the other."""
    path = new_folder(spark, "fragments")
    seqs = table(spark, sf_dir, "benchmark").select("item_id", letters().alias("seq"))
    name = F.concat(F.lit("u"), F.col("item_id").cast("string"), F.lit(","), F.col("item_id").cast("string"))
    io.write_fasta(seqs.filter("item_id % 2 = 0").withColumn("name", name), f"{path}/fasta")
    seqs.filter("item_id % 2 = 1").select(F.concat(F.lit("fragmentIdent           = "), name, F.lit("\nfragmentLibrary = 1\nfragmentSequence        = "), "seq").alias("value")).write.text(f"{path}/dump")
    return io.read_fragment_dump(spark, f"{path}/fasta").unionByName(io.read_fragment_dump(spark, f"{path}/dump"))


@query(f"WITH s AS (SELECT item_id, {_letters_sql()} AS seq FROM benchmark) SELECT 'q' || item_id AS name, seq, translate(seq, 'ACGT', '@+I!') AS qual FROM s")
def fastq_by_lines(spark, sf_dir):
    path = new_folder(spark, "fastq")
    seqs = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("@q"), F.col("item_id").cast("string")).alias("name"), letters().alias("seq"))
    seqs.select(F.concat_ws("\n", "name", "seq", F.lit("+"), F.translate("seq", "ACGT", "@+I!")).alias("value")).write.text(path)
    return io.read_fastq_lines(spark, path)


@query(f"{_HITS} SELECT doc_id FROM hit")
def contaminant_file(spark, sf_dir):
    """The contaminants come from a file of sequences."""
    path = new_folder(spark, "contaminants")
    io.write_fasta(benchmark_reads(spark, sf_dir).filter("length(seq) > 0").withColumnRenamed("item_id", "name"), path, width=70)
    return kmers.with_contaminant(doc_reads(spark, sf_dir), io.read_fasta(spark, path), K, "doc_id")
