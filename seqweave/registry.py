"""Queries over the test tables, one for each operator, and the SQL that says what they return.

The tables hold no sequences, so texts are read as such: letters map onto bases, blanks go, all else breaks a sequence.
Rows of ``conversations`` stand in for mate pairs, order lines for placements and paths.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sequences as S
from .operators import gaps, kmers, overlaps, paths, reads
from .plans.storage import dense_ids, materialize, shared_dir
from .sources import sequences as sources

K = 21
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _seq_sql(text: str = "text") -> str:
    return f"translate(regexp_replace(regexp_replace(coalesce({text}, ''), '[ \n]', '', 'g'), '[^A-Za-z]', '-', 'g'), '{_LETTERS}', '{'ACGT' * 13}')"


def _rc(e: str) -> str:
    return f"reverse(translate({e}, 'ACGTacgt', 'TGCAtgca'))"


def _kmers_sql(table: str, keys: str, where: str = "") -> str:
    """CTEs runs_<table> and kmers_<table>(keys, kmer)."""
    return f"""runs_{table} AS (SELECT {keys}, unnest(string_split({_seq_sql()}, '-')) AS run FROM {table} {where}),
raw_{table} AS (SELECT {keys}, unnest(list_transform(range(1, length(run) - {K - 2}), lambda i: substr(run, i, {K}))) AS m FROM runs_{table} WHERE length(run) >= {K}),
kmers_{table} AS (SELECT {keys}, least(m, {_rc('m')}) AS kmer FROM raw_{table})"""


COUNTS_SQL = f"{_kmers_sql('documents', 'doc_id')}, counts AS (SELECT kmer, count(*) AS cnt FROM kmers_documents GROUP BY kmer), hist AS (SELECT cnt, count(*) AS n_kmers FROM counts GROUP BY cnt)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_dir(spark)}/seqweave/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_reads(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(doc_id, seq): documents as sequences. Only a table of fewer file splits than cores is dealt out; a large one isn't."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", *more)
    cores = spark.sparkContext.defaultParallelism
    docs = docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs
    return docs.select("doc_id", *more, S.as_sequence(F.col("text")).alias("seq"))


def letters(text: str = "text"):
    """A text's letters alone as bases, without breaks."""
    return S.as_sequence(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^A-Za-z]", ""))


def _letters_sql(text: str = "text") -> str:
    return f"translate(regexp_replace(coalesce({text}, ''), '[^A-Za-z]', '', 'g'), '{_LETTERS}', '{'ACGT' * 13}')"


def benchmark_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", S.as_sequence(F.col("text")).alias("seq"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.count_kmers(doc_reads(spark, sf_dir), K)


# k-mers ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {COUNTS_SQL} SELECT kmer, cnt, least(cnt, 2) AS sat FROM counts")
def kmer_count_canonical(spark, sf_dir):
    return _counts(spark, sf_dir).select("kmer", "cnt", kmers.saturated(F.col("cnt")).cast("long").alias("sat"))


@query(f"WITH {COUNTS_SQL} SELECT cnt, n_kmers FROM hist")
def kmer_histogram(spark, sf_dir):
    return kmers.histogram(_counts(spark, sf_dir))


@query(f"""WITH {COUNTS_SQL}, c AS (SELECT sum(cnt * n_kmers) / sum(n_kmers)::DOUBLE AS c FROM hist WHERE cnt > 1),
x AS (SELECT unnest(range(2, 1000))::DOUBLE AS x)
SELECT (min(x) + 1)::BIGINT AS cutoff FROM x, c WHERE 0.01 / sqrt(2 * 3.1415927 * x) * pow(0.01 * c / 3 / x, x) * exp(-(0.01 * c / 3) + x) < 1e-6""")
def kmer_error_cutoff(spark, sf_dir):
    return kmers.error_cutoff(kmers.histogram(_counts(spark, sf_dir)))


@query(f"""WITH {COUNTS_SQL}, r AS (SELECT cnt, sum(n_kmers) OVER (ORDER BY cnt) AS dist, floor(sum(n_kmers) OVER () * 0.98) AS goal FROM hist WHERE cnt > 1)
SELECT greatest(coalesce(min(cnt), 75), 75)::BIGINT AS threshold FROM r WHERE dist > goal""")
def kmer_cumulative_threshold(spark, sf_dir):
    return kmers.cumulative_threshold(kmers.histogram(_counts(spark, sf_dir)))


@query(f"WITH {COUNTS_SQL} SELECT count(*) FILTER (cnt > 1) AS genome_size FROM counts")
def genome_size_estimate(spark, sf_dir):
    return kmers.genome_size(_counts(spark, sf_dir))


_TIER = "CASE lang WHEN 'en' THEN 3 WHEN 'de' THEN 2 WHEN 'fr' THEN 1 ELSE 0 END"


@query(f"WITH {_kmers_sql('documents', _TIER + ' AS level').replace(f'SELECT {_TIER} AS level, unnest(list', 'SELECT level, unnest(list').replace(f'SELECT {_TIER} AS level, least', 'SELECT level, least')}, c AS (SELECT level, kmer, count(*) AS cnt FROM kmers_documents GROUP BY ALL HAVING count(*) >= 2) SELECT kmer, max(level)::INT AS level, arg_max(cnt, level) AS cnt FROM c GROUP BY kmer")
def kmer_tiered_merge(spark, sf_dir):
    leveled = doc_reads(spark, sf_dir, "lang").withColumn("level", F.expr(_TIER))
    return kmers.tiered_merge(kmers.count_kmers(leveled, K, "level"))


@query(f"WITH {COUNTS_SQL} SELECT sum(least(cnt, 5))::BIGINT AS rows_replayed, count(*) AS distinct_kmers FROM counts")
def kmer_replay(spark, sf_dir):
    return kmers.replay(_counts(spark, sf_dir), 5).agg(F.count(F.lit(1)).alias("rows_replayed"), F.count_if(F.col("nth") == 1).alias("distinct_kmers"))


_HITS = f"WITH {_kmers_sql('documents', 'doc_id')}, {_kmers_sql('benchmark', 'item_id')}, hit AS (SELECT DISTINCT doc_id FROM kmers_documents WHERE kmer IN (SELECT kmer FROM kmers_benchmark))"


@query(f"{_HITS} SELECT doc_id FROM hit")
def contaminant_semi_join(spark, sf_dir):
    return kmers.with_contaminant(doc_reads(spark, sf_dir), benchmark_reads(spark, sf_dir), K, "doc_id")


@query(f"{_HITS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit)")
def contaminant_anti_join(spark, sf_dir):
    return kmers.with_contaminant(doc_reads(spark, sf_dir), benchmark_reads(spark, sf_dir), K, "doc_id", "left_anti")


# Sequences ------------------------------------------------------------------------------------------------------------

_R = f"WITH r AS (SELECT doc_id, {_seq_sql()} AS seq FROM documents)"


@query(f"{_R} SELECT doc_id, {_rc('seq')} AS rc, regexp_replace({_rc('seq')}, '[^ACGTacgt]', 'N', 'g') AS rc_n FROM r")
def seq_revcomp(spark, sf_dir):
    return doc_reads(spark, sf_dir).select("doc_id", S.revcomp(F.col("seq")).alias("rc"), S.revcomp(F.col("seq"), "N").alias("rc_n"))


@query(f"{_R} SELECT DISTINCT greatest(seq, {_rc('seq')}) AS seq FROM r")
def seq_canonical_dedup(spark, sf_dir):
    return doc_reads(spark, sf_dir).select(S.canonical(F.col("seq"), largest=True).alias("seq")).distinct()


@query(f"{_R} SELECT doc_id, length(seq) AS len, length(seq) - length(translate(seq, 'GCgc', '')) AS gc FROM r")
def seq_gc_stats(spark, sf_dir):
    return doc_reads(spark, sf_dir).select("doc_id", F.length("seq").cast("long").alias("len"), S.gc_count(F.col("seq")).alias("gc"))


@query(f"{_R}, a AS (SELECT min(length(seq)) AS s, sum(length(seq) - length(translate(seq, 'GCgc', ''))) / sum(length(seq))::DOUBLE AS gc_ratio FROM r) SELECT greatest(floor(s * CASE WHEN gc_ratio < 0.5 THEN 0.7 WHEN gc_ratio < 0.6 THEN 0.5 ELSE 0.33 END), 31)::BIGINT AS k, gc_ratio FROM a")
def seq_auto_k(spark, sf_dir):
    return kmers.auto_k(doc_reads(spark, sf_dir))


@query(f"{_R}, w AS (SELECT doc_id, seq, unnest(range(0, greatest(ceil((length(seq) - 2047) / 1550.0), 0)::BIGINT + 1)) * 1550 AS off FROM r) SELECT doc_id, off, substr(seq, off + 1, 2047) AS piece FROM w")
def seq_windows(spark, sf_dir):
    return doc_reads(spark, sf_dir).select("doc_id", F.explode(S.windows(F.col("seq"))).alias("w")).select("doc_id", "w.off", "w.piece")


@query(f'{_R} SELECT doc_id AS ctg, l AS length, left(seq, l) AS "left", right(seq, l) AS "right" FROM r, (VALUES (100), (500), (1000)) v(l)')
def seq_end_slices(spark, sf_dir):
    return gaps.end_slices(doc_reads(spark, sf_dir).withColumnRenamed("doc_id", "ctg"), [100, 500, 1000])


@query(f"""{_R}, c AS (SELECT doc_id, unnest(string_split(reverse(seq), '')) AS c, generate_subscripts(string_split(reverse(seq), ''), 1) - 1 AS i FROM r), d AS (SELECT doc_id, i, CASE WHEN c = lag(c) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE -1 END AS up FROM c),
s AS (SELECT doc_id, i, sum(up) OVER (PARTITION BY doc_id ORDER BY i) AS score FROM d WHERE i > 0), t AS (SELECT doc_id, max(score) AS best FROM s GROUP BY doc_id), b AS (SELECT doc_id, best, min(i) AS cut FROM s JOIN t USING (doc_id) WHERE score = best GROUP BY doc_id, best)
SELECT doc_id, (length(seq) - CASE WHEN best >= 2 THEN cut ELSE 0 END)::BIGINT AS trimmed_len FROM r LEFT JOIN b USING (doc_id)""")
def tail_trim(spark, sf_dir):
    return doc_reads(spark, sf_dir).select("doc_id", S.tail_trim_length(F.col("seq")).alias("trimmed_len"))


@query(f"{_R}, n AS (SELECT CASE WHEN doc_id % 3 > 0 THEN translate(seq, '-', 'N') ELSE seq END AS seq, row_number() OVER (ORDER BY doc_id) - 1 AS read_no FROM r) SELECT 'pe' AS lib, read_no, seq FROM n WHERE NOT regexp_matches(seq, '[^ACGTN]')")
def rename_interleave(spark, sf_dir):
    """Two thirds of the documents have N for what breaks a sequence; the others go where they hold such."""
    docs = doc_reads(spark, sf_dir).withColumn("seq", F.when(F.col("doc_id") % 3 > 0, F.translate("seq", "-", "N")).otherwise(F.col("seq")))
    return reads.rename_interleaved(docs, "pe", "doc_id")


@query(f"{_R} SELECT doc_id, substr(seq, 6, 21) AS mer, doc_id + 1 - 2 * (doc_id % 2) AS mate FROM r")
def sub_mers_and_mates(spark, sf_dir):
    return doc_reads(spark, sf_dir).select("doc_id", S.submer(F.col("seq"), 5, 21).alias("mer"), S.mate_no(F.col("doc_id")).alias("mate"))


@query("SELECT CASE WHEN min(ascii(c)) < 64 THEN 33 ELSE 64 END AS phred_offset FROM (SELECT unnest(string_split(props, '')) AS c FROM events) WHERE c <> ''")
def phred_offset(spark, sf_dir):
    return kmers.phred_offset(table(spark, sf_dir, "events").withColumnRenamed("props", "qual"))


# Tables of k-mers -------------------------------------------------------------------------------------------------------


@query(f"""WITH r AS (SELECT {_seq_sql()} AS seq FROM benchmark), q AS (SELECT seq, 0 AS g FROM r UNION ALL SELECT translate(seq, 'A-', 'NN'), 1 FROM r), runs AS (SELECT g, unnest(regexp_split_to_array(seq, '[^ACGT]+')) AS run FROM q),
m AS (SELECT g, unnest(list_transform(range(1, length(run) - 3), lambda i: substr(run, i, 5))) AS m FROM runs WHERE length(run) >= 5) SELECT least(m, {_rc('m')}) AS kmer, count(*) FILTER (g = 0) AS cnt, count(*) FILTER (g = 1) AS good FROM m GROUP BY 1""")
def kmer_quality_filtered(spark, sf_dir):
    """Qualities by base: that of A, and of what breaks a sequence, is 4, below the least."""
    source = benchmark_reads(spark, sf_dir).withColumn("qual", F.translate("seq", "ACGT-", "%&IJ#"))
    return kmers.quality_filtered_counts(source, 5)


@query(f"WITH {_kmers_sql('documents', 'doc_id')}, {_kmers_sql('benchmark', 'item_id')}, counts AS (SELECT kmer, count(*) AS cnt FROM kmers_documents GROUP BY kmer) SELECT kmer, coalesce(cnt, 0) AS cnt FROM (SELECT DISTINCT kmer FROM kmers_benchmark) LEFT JOIN counts USING (kmer)")
def kmer_lookup(spark, sf_dir):
    return kmers.lookup(_counts(spark, sf_dir), kmers.explode_kmers(benchmark_reads(spark, sf_dir), K, canonical=False))


@query(f"WITH {COUNTS_SQL} SELECT kmer, cnt FROM counts WHERE cnt BETWEEN 2 AND 1000")
def kmer_store(spark, sf_dir):
    path = new_folder(spark, "counts")
    kmers.save_counts(_counts(spark, sf_dir), path)
    return kmers.load_counts(spark, path, 2, 1000)


@query(f"WITH {COUNTS_SQL} SELECT kmer || ' ' || cnt AS line FROM counts WHERE cnt BETWEEN 3 AND 200")
def kmer_dump(spark, sf_dir):
    path = new_folder(spark, "dump")
    kmers.dump_kmers(_counts(spark, sf_dir), path, 3, 200)
    return spark.read.text(path).withColumnRenamed("value", "line")


# Mates ----------------------------------------------------------------------------------------------------------------

_MATES = 'WITH m AS (SELECT conv_id, turn // 2 AS pair, (turn % 2)::INT AS "end", text AS seq FROM conversations)'
_INSERT = ["conv_id", "pair"]


def _mates(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", F.expr("turn div 2").alias("pair"), (F.col("turn") % 2).cast("int").alias("end"), F.col("text").alias("seq"))


@query(f"""{_MATES}, i AS (SELECT DISTINCT conv_id, pair FROM m) SELECT i.conv_id, i.pair, e AS "end", coalesce(min(m.seq), 'N') AS seq FROM i CROSS JOIN (VALUES (0), (1)) v(e) LEFT JOIN m ON m.conv_id = i.conv_id AND m.pair = i.pair AND m."end" = e GROUP BY ALL""")
def mate_pad_missing(spark, sf_dir):
    return reads.pad_missing_mates(_mates(spark, sf_dir), _INSERT, "end", "seq")


@query(f"""{_MATES}, g AS (SELECT *, count(*) FILTER (length(seq) >= 64) OVER (PARTITION BY conv_id, pair) AS ok FROM m) SELECT conv_id, pair, "end", seq FROM g WHERE ok = 2""")
def mate_pair_min_length(spark, sf_dir):
    return reads.both_mates(_mates(spark, sf_dir), _INSERT, F.length("seq") >= 64)


_PLACED = _MATES + ', p AS (SELECT conv_id, pair, "end", length(seq) % 12 AS sr FROM m)'


def _placed(spark, sf_dir):
    return _mates(spark, sf_dir).withColumn("sr", (F.length("seq") % 12).cast("long"))


@query(f"{_PLACED} SELECT conv_id, pair, min(sr) AS sr1, max(sr) AS sr2 FROM p GROUP BY conv_id, pair HAVING count(*) = 2 AND min(sr) <> max(sr)")
def mate_linking(spark, sf_dir):
    return reads.linking_inserts(_placed(spark, sf_dir), _INSERT)


@query(f"{_PLACED} SELECT conv_id, pair, sr FROM p GROUP BY conv_id, pair, sr HAVING count(*) = 2")
def mate_same_group(spark, sf_dir):
    return reads.joined_inserts(_placed(spark, sf_dir), _INSERT)


@query(f"{_PLACED}, l AS (SELECT conv_id, pair, min(sr) AS sr1, max(sr) AS sr2 FROM p GROUP BY conv_id, pair HAVING count(*) = 2 AND min(sr) <> max(sr)) SELECT sr1, sr2, count(*) AS cnt, string_agg(conv_id || '.' || pair, ',' ORDER BY conv_id, pair) AS inserts FROM l GROUP BY sr1, sr2")
def mate_unjoined_pairs(spark, sf_dir):
    found = reads.unjoined_pairs(_placed(spark, sf_dir), _INSERT)
    return found.withColumn("inserts", F.array_join(F.transform("inserts", lambda x: F.concat_ws(".", x["conv_id"], x["pair"])), ","))


@query(f'{_MATES} SELECT m.* FROM m WHERE (conv_id, pair) IN (SELECT conv_id, pair FROM m WHERE length(seq) % 5 = 0)')
def mates_of_matched(spark, sf_dir):
    mates = _mates(spark, sf_dir)
    return gaps.mates_of_matched(mates, mates.filter("length(seq) % 5 = 0"), _INSERT)


@query(f"{_MATES} SELECT m.* FROM m WHERE ('0x' || substr(md5('1:' || conv_id || ':' || pair), 1, 8))::BIGINT % 1000000 < 300000")
def sampled_inserts(spark, sf_dir):
    return reads.sampled_inserts(_mates(spark, sf_dir), _INSERT, 0.3)


_EVENTS = "WITH p AS (SELECT event_id // 2 AS pair, event_id % 2 AS e, event_type AS sr, floor(value * 10)::BIGINT AS off, CASE WHEN user_id % 2 = 0 THEN 'F' ELSE 'R' END AS ori FROM events)"


def _event_placements(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.expr("event_id div 2").alias("pair"), (F.col("event_id") % 2).alias("end"), F.col("event_type").alias("sr"), F.floor(F.col("value") * 10).alias("off"), F.when(F.col("user_id") % 2 == 0, "F").otherwise("R").alias("ori"))


@query(f"""{_EVENTS}, d AS (SELECT a.pair, a.sr, CASE WHEN a.ori = 'F' AND b.ori = 'R' THEN a.off - b.off WHEN a.ori = 'R' AND b.ori = 'F' THEN b.off - a.off END AS distance FROM p a JOIN p b ON a.pair = b.pair AND a.sr = b.sr AND a.e = 0 AND b.e = 1) SELECT pair, sr, distance FROM d WHERE distance > 0 AND distance < 700""")
def mate_chimeric_window(spark, sf_dir):
    return reads.chimeric_inserts(_event_placements(spark, sf_dir), ["pair"], "end", "sr", "off", "ori")


@query(f"{_EVENTS} SELECT a.pair, a.sr, b.off - a.off AS insert_size FROM p a JOIN p b ON a.pair = b.pair AND a.sr = b.sr AND a.e <> b.e AND a.ori = 'F' AND b.ori = 'R'")
def mate_insert_size(spark, sf_dir):
    return reads.insert_sizes(_event_placements(spark, sf_dir), ["pair"], "end", "sr", "off", "ori")


_JUMPS = """WITH RECURSIVE p AS (SELECT event_id // 2 AS pair, event_id % 2 AS e, event_type AS sr, floor(value)::BIGINT AS off, CASE WHEN user_id % 2 = 0 THEN 'F' ELSE 'R' END AS ori FROM events WHERE event_id % 11 > 0), j AS (SELECT a.pair, a.sr AS s0, a.off AS o0, b.sr AS s1, b.off AS o1 FROM p a JOIN p b ON a.pair = b.pair AND a.e = 0 AND b.e = 1),
q AS (SELECT pair, CASE WHEN w THEN s1 ELSE s0 END AS sr1, CASE WHEN w THEN s0 ELSE s1 END AS sr2, CASE WHEN w THEN o1 ELSE o0 END AS off1, CASE WHEN w THEN o0 ELSE o1 END AS off2 FROM (SELECT *, s0 > s1 OR (s0 = s1 AND o0 > o1) AS w FROM j)), o AS (SELECT *, row_number() OVER (PARTITION BY sr1, sr2 ORDER BY pair) AS i FROM q),
w AS (SELECT sr1, sr2, pair, i, false AS redundant, [{'a': off1, 'b': off2}] AS kept FROM o WHERE i = 1 UNION ALL SELECT sr1, sr2, pair, i, redundant, CASE WHEN redundant THEN kept ELSE list_append(kept, {'a': off1, 'b': off2}) END FROM (SELECT o.*, w.kept, len(list_filter(w.kept, lambda x: abs(x.a - o.off1) <= 2 AND abs(x.b - o.off2) <= 2)) > 0 AS redundant FROM w JOIN o ON o.sr1 = w.sr1 AND o.sr2 = w.sr2 AND o.i = w.i + 1))"""


def _jumps(spark, sf_dir):
    """Placements of pairs of events, of which some lack a mate."""
    return _event_placements(spark, sf_dir).withColumn("off", F.floor(F.col("off") / 10)).filter((F.col("pair") * 2 + F.col("end")) % 11 > 0)


@query(f"{_JUMPS} SELECT pair, sr1, sr2, off1, off2, redundant FROM w JOIN q USING (pair, sr1, sr2)")
def greedy_redundancy(spark, sf_dir):
    """Pairs of events, each event a place on its type's path."""
    side = lambda e: _jumps(spark, sf_dir).filter(F.col("end") == e).select("pair", F.col("sr").alias(f"sr{e}"), F.col("off").alias(f"off{e}"))
    return reads.greedy_redundancy(reads.pair_places(side(0).join(side(1), "pair")), ["sr1", "sr2"], ["pair"], "off1", "off2")


@query(f"""{_JUMPS}, c AS (SELECT a.pair, CASE WHEN a.ori = 'F' AND b.ori = 'R' THEN a.off - b.off WHEN a.ori = 'R' AND b.ori = 'F' THEN b.off - a.off END AS d FROM p a JOIN p b ON a.pair = b.pair AND a.sr = b.sr AND a.e = 0 AND b.e = 1),
good AS (SELECT pair FROM w WHERE NOT redundant AND pair NOT IN (SELECT pair FROM c WHERE d > 0 AND d < 700)), s AS (SELECT event_id // 2 AS pair, event_id % 2 AS e, {_seq_sql("event_type || '-' || event_id || event_type")} AS seq FROM events)
SELECT pair, e AS "end", regexp_replace({_rc('seq')}, '[^ACGTacgt]', 'N', 'g') AS seq FROM s JOIN good USING (pair)""")
def jump_clean_up(spark, sf_dir):
    source = table(spark, sf_dir, "events").select(F.expr("event_id div 2").alias("pair"), (F.col("event_id") % 2).alias("end"), S.as_sequence(F.concat("event_type", F.lit("-"), F.col("event_id").cast("string"), "event_type")).alias("seq"))
    return reads.clean_jumps(source, _jumps(spark, sf_dir), ["pair"])


@query("SELECT event_id, user_id, event_type FROM events WHERE (user_id, event_type) IN (SELECT user_id, event_type FROM events GROUP BY ALL HAVING count(*) >= 15)")
def repeated_keys(spark, sf_dir):
    return reads.repeated(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], 15)


@query("SELECT source AS lib, count(*) AS n FROM documents GROUP BY source")
def reads_by_library(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("lib")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_MATES} SELECT DISTINCT conv_id, pair, 1 AS partitions FROM m")
def mates_together(spark, sf_dir):
    """In how many partitions the reads of each insert are."""
    rows = reads.with_mates_together(_mates(spark, sf_dir), _INSERT).withColumn("part", F.spark_partition_id())
    return materialize(rows.select(*_INSERT, "part"), "parts").groupBy(*_INSERT).agg(F.count_distinct("part").cast("int").alias("partitions"))


@query("SELECT round(avg(length(text)), 6) AS average FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 100)")
def head_average_length(spark, sf_dir):
    head = reads.head_sample(table(spark, sf_dir, "documents").select("doc_id", "text"), 100, "doc_id")
    return head.agg(F.round(F.avg(F.length("text")), 6).alias("average"))


# Counts and statistics ------------------------------------------------------------------------------------------------


@query("SELECT l_partkey, count(DISTINCT l_orderkey) AS cnt FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) >= 2")
def insert_support_counts(spark, sf_dir):
    return reads.support_counts(table(spark, sf_dir, "lineitem"), "l_partkey", ["l_orderkey"])


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stdev, count(value) AS n FROM events GROUP BY event_type")
def library_mean_stdev(spark, sf_dir):
    return reads.library_stats(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"), "n")


@query("""WITH RECURSIVE t AS (SELECT avg(value) AS m, stddev_pop(value) AS s, count(value) AS n, 0 AS r, true AS go FROM events
UNION ALL SELECT CASE WHEN n2 IN (n, 0) THEN m ELSE m2 END, CASE WHEN n2 IN (n, 0) THEN s ELSE s2 END, CASE WHEN n2 IN (n, 0) THEN n ELSE n2 END, r + 1, n2 NOT IN (n, 0) FROM (SELECT t.m, t.s, t.n, t.r, avg(value) AS m2, stddev_pop(value) AS s2, count(value) AS n2 FROM t, events WHERE go AND value BETWEEN t.m - 6 * t.s AND t.m + 6 * t.s GROUP BY ALL))
SELECT round(m, 6) AS mean, round(s, 6) AS stdev, n, r AS rounds FROM t ORDER BY r DESC LIMIT 1""")
def trimmed_mean_stdev(spark, sf_dir):
    return reads.trimmed_stats(table(spark, sf_dir, "events"), "value").select(F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"), "n", "rounds")


@query("""WITH v AS (SELECT event_type AS lib, floor(value)::BIGINT AS size, user_id * 3 AS dist FROM events), g AS (SELECT lib, dist, sum(count(*)) OVER (PARTITION BY lib ORDER BY dist DESC) AS got FROM v GROUP BY lib, dist),
l AS (SELECT lib, max(dist) FILTER (got >= 400) AS near, max(dist) FILTER (got >= 900) AS far FROM g GROUP BY lib), k AS (SELECT l.*, got AS have FROM l JOIN g ON g.lib = l.lib AND g.dist = l.near WHERE far > 0),
bad AS (SELECT k.lib FROM v JOIN k ON v.lib = k.lib AND dist >= near AND size > near / 2.0 GROUP BY k.lib, have HAVING count(*) > have * 0.1) SELECT v.lib, size FROM v JOIN k ON v.lib = k.lib AND dist >= far WHERE v.lib NOT IN (SELECT lib FROM bad)""")
def insert_size_sample(spark, sf_dir):
    sizes = table(spark, sf_dir, "events").select(F.col("event_type").alias("lib"), F.floor("value").alias("size"), (F.col("user_id") * 3).alias("dist"))
    return reads.size_sample(sizes, "lib", "size", "dist", 400, 900)


@query("SELECT l_partkey, string_agg(l_orderkey || '.' || l_linenumber, ',' ORDER BY l_orderkey || '.' || l_linenumber) AS reads FROM lineitem GROUP BY l_partkey")
def reads_by_path(spark, sf_dir):
    placed = table(spark, sf_dir, "lineitem").select("l_partkey", F.concat_ws(".", "l_orderkey", "l_linenumber").alias("read"))
    return reads.reads_by_path(placed, "l_partkey", "read").select("l_partkey", F.array_join("reads", ",").alias("reads"))


@query("WITH c AS (SELECT l_partkey AS sr, count(DISTINCT l_orderkey) AS cnt FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT sr FROM c WHERE cnt <= 28)")
def infrequent_removed(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    rare = reads.infrequent(reads.support_counts(lines, "l_partkey", ["l_orderkey"], 1), "l_partkey", 28)
    return reads.listed(lines, rare, "l_partkey", keep=False)


@query("WITH l AS (SELECT event_type AS lib, avg(value) AS mean FROM events GROUP BY 1) SELECT round(sum(mean), 4) AS bases, round(sum(mean) / 12345, 8) AS coverage FROM events JOIN l ON event_type = lib WHERE user_id % 3 = 0")
def insert_coverage(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("event_type", "lib")
    found = reads.insert_coverage(events.filter("user_id % 3 = 0"), reads.library_stats(events, "lib", "value"), 12345)
    return found.select(F.round("bases", 4).alias("bases"), F.round("coverage", 8).alias("coverage"))


@query("SELECT event_id, value FROM events WHERE event_type = 'view'")
def library_slice(spark, sf_dir):
    return reads.library_slice(table(spark, sf_dir, "events"), "view", "event_type").select("event_id", "value")


@query(f"""WITH r AS (SELECT doc_id, {_seq_sql()} AS s FROM documents), p AS (SELECT event_id AS read_no, user_id * 3 AS off, CASE WHEN event_id % 2 = 0 THEN 'F' ELSE 'R' END AS ori, event_id % 500 AS doc_id FROM events), m AS (SELECT *, length(s) AS n, least(greatest(off, 64), length(s)) AS stop FROM p JOIN r USING (doc_id)), x AS (SELECT *, greatest(stop - 300, 0) AS start FROM m),
y AS (SELECT *, substr(s, start + 1, stop - start) AS back FROM x) SELECT 'ev' AS lib, read_no, CASE WHEN ori = 'F' THEN substr(s, greatest(least(off, n - 64), 0) + 1, 300) ELSE {_rc('back')} END AS seq FROM y""")
def jump_read_extraction(spark, sf_dir):
    placed = table(spark, sf_dir, "events").select(F.lit("ev").alias("lib"), F.col("event_id").alias("read_no"), (F.col("event_id") % 500).alias("sr"), (F.col("user_id") * 3).alias("off"), F.when(F.col("event_id") % 2 == 0, "F").otherwise("R").alias("ori"))
    return reads.jump_reads(placed, doc_reads(spark, sf_dir).withColumnRenamed("doc_id", "sr"), 64, 300)


@query("""WITH f AS (SELECT l_partkey AS utg, l_quantity * 60 AS e, 1.0 / l_linenumber AS w FROM lineitem), per AS (SELECT utg, max(e) AS r, sum(w) AS cnt FROM f GROUP BY utg), rho AS (SELECT *, CASE WHEN r - 100 < 0 THEN 1 ELSE r - 100 END AS rho FROM per),
rate AS (SELECT sum(cnt) / sum(rho) AS rate FROM rho WHERE r > 2000) SELECT utg, rho, round(cnt, 6) AS cnt, round((length(p_name) - length(translate(p_name, 'GCgc', ''))) / (length(p_name) + 1), 6) AS gc_ratio, round(rho * rate - 0.6931471805599453 * cnt, 4) AS astat FROM rho JOIN part ON utg = p_partkey, rate""")
def astat_like(spark, sf_dir):
    frags = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("utg"), (F.col("l_quantity") * 60).alias("end"), (F.lit(1.0) / F.col("l_linenumber")).alias("weight"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("utg"), F.col("p_name").alias("seq"))
    out = reads.coverage_stat(parts, frags, "utg", 100).filter("gc_ratio is not null")
    return out.select("utg", F.col("rho").cast("double"), *(F.round(c, d).alias(c) for c, d in (("cnt", 6), ("gc_ratio", 6), ("astat", 4))))


_BLOCKS = "WITH t AS (SELECT source AS lib, max(doc_id) AS top FROM documents GROUP BY source), b AS (SELECT lib, top + CASE WHEN top % 2 = 0 THEN 2 ELSE 1 END AS total FROM t), o AS (SELECT lib, coalesce(sum(total) OVER (ORDER BY lib ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first, total FROM b)"


@query(f"{_BLOCKS} SELECT d.doc_id AS read_no, lib, (first + d.doc_id)::BIGINT AS number FROM documents d JOIN o ON d.source = o.lib")
def range_block_lookup(spark, sf_dir):
    named = table(spark, sf_dir, "documents").select(F.col("source").alias("lib"), F.col("doc_id").alias("read_no"))
    blocks = materialize(reads.number_blocks(named, "lib", "read_no"), "blocks")
    return reads.from_number(reads.to_number(named, blocks, "lib", "read_no").select("number"), blocks, "lib").select("read_no", "lib", "number")


# Sorting and sets -----------------------------------------------------------------------------------------------------


@query("SELECT (row_number() OVER (ORDER BY length(text) DESC, doc_id) - 1)::BIGINT AS sr_id, doc_id AS sr, length(text) AS len FROM documents")
def rank_by_length(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sr"), F.length("text").cast("long").alias("len"))
    return paths.rank_by_length(docs).select("sr_id", "sr", "len")


@query("SELECT c_custkey AS key, c_acctbal AS amount FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def merge_sorted_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("amount"))
    return c.unionByName(s).orderBy("key")


@query("SELECT c_nationkey AS nation, 'customer' AS which, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, 'supplier', count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer) GROUP BY 1")
def first_wins_union(spark, sf_dir):
    side = lambda t, k: table(spark, sf_dir, t).groupBy(F.col(k).alias("nation")).agg(F.lit(t).alias("which"), F.count(F.lit(1)).alias("n"))
    return gaps.first_wins(side("customer", "c_nationkey"), side("supplier", "s_nationkey"), key="nation")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def set_difference(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return reads.listed(table(spark, sf_dir, "orders").select("o_orderkey"), returned, "o_orderkey", keep=False)


# Joins of reads and unitigs -------------------------------------------------------------------------------------------

_LIB = f"""WITH pieces AS (SELECT DISTINCT substr(run, off + 1, 60) AS seq FROM (SELECT run, unnest(range(0, length(run) - 59, 40)) AS off FROM (SELECT {_letters_sql()} AS run FROM benchmark) WHERE length(run) >= 60)),
lib AS (SELECT (row_number() OVER (ORDER BY seq) - 1)::BIGINT AS ku, seq FROM pieces)"""


def piece_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ku, seq): stretches of 60 bases that follow each other with 20 in common, as in a library of unitigs for k = 21."""
    runs = table(spark, sf_dir, "benchmark").select(letters().alias("run")).filter("length(run) >= 60")
    pieces = runs.select(F.explode(F.transform(F.sequence(F.lit(0), ((F.length("run") - 60) / 40).cast("int")), lambda i: F.substr("run", i * 40 + 1, F.lit(60)))).alias("seq")).distinct()
    return dense_ids(pieces, "ku", "seq").select("ku", "seq")


_OVERLAPS = f"""{_LIB}, ends AS (SELECT ku, 60 AS len, e, m, least(m, {_rc('m')}) AS mer FROM (SELECT ku, 0 AS e, left(seq, 20) AS m FROM lib UNION ALL SELECT ku, 1, right(seq, 20) FROM lib)),
rows AS (SELECT *, f FROM ends, (VALUES (0), (1)) v(f) WHERE (f = 0 AND m = mer) OR (f = 1 AND {_rc('m')} = mer)),
half AS (SELECT DISTINCT a.ku AS u1, b.ku AS u2, CASE WHEN a.e = 0 THEN 20 - b.len ELSE a.len - 20 END AS ahg, CASE WHEN a.e = 0 THEN 20 - a.len ELSE b.len - 20 END AS bhg, CASE WHEN a.f = b.f THEN 'N' ELSE 'I' END AS ori FROM rows a JOIN rows b ON a.mer = b.mer AND a.ku < b.ku WHERE (a.e + b.e + a.f + b.f) % 2 = 1),
ov AS (SELECT * FROM half UNION ALL SELECT u2, u1, CASE WHEN ori = 'N' THEN -ahg ELSE bhg END, CASE WHEN ori = 'N' THEN -bhg ELSE ahg END, ori FROM half)"""


@query(f"{_OVERLAPS} SELECT u1, u2, ahg::INT AS ahg, bhg::INT AS bhg, ori FROM ov")
def overlap_end_join(spark, sf_dir):
    return overlaps.end_overlaps(piece_library(spark, sf_dir), K)


@query(f"{_OVERLAPS} SELECT u1, u2, ahg::INT AS ahg, bhg::INT AS bhg, ori FROM ov WHERE u1 IN (0, 5, 6, 7, 40)")
def overlap_store(spark, sf_dir):
    path = new_folder(spark, "overlaps")
    overlaps.save_overlaps(overlaps.end_overlaps(piece_library(spark, sf_dir), K), path)
    return overlaps.load_overlaps(spark, path, [0, 5, 6, 7, 40])


_ULIB = f"""{_LIB}, uk AS (SELECT ku, off, substr(seq, off + 1, 21) AS m FROM (SELECT ku, seq, unnest(range(0, 40)) AS off FROM lib)), one AS (SELECT least(m, {_rc('m')}) AS mer FROM uk GROUP BY 1 HAVING count(*) = 1),
bad AS (SELECT DISTINCT ku FROM uk WHERE least(m, {_rc('m')}) NOT IN (SELECT mer FROM one)), ul AS (SELECT * FROM lib WHERE ku NOT IN (SELECT ku FROM bad)), uu AS (SELECT ku, off, least(m, {_rc('m')}) AS mer, (m > {_rc('m')})::INT AS f FROM uk WHERE ku NOT IN (SELECT ku FROM bad))"""


def unique_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces none of whose k-mers occurs twice."""
    lib = materialize(piece_library(spark, sf_dir), "library")
    own = overlaps.unitig_kmers(lib, K).select("mer", "ku")
    twice = own.groupBy("mer").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mer")
    return materialize(lib.join(own.join(twice, "mer", "left_semi").select("ku").distinct(), "ku", "left_anti"), "unique")


@query(f"""{_ULIB}, rk AS (SELECT doc_id, j, len, substr(seq, j + 1, 21) AS m FROM (SELECT doc_id, seq, length(seq) AS len, unnest(range(0, length(seq) - 20)) AS j FROM (SELECT doc_id, {_seq_sql()} AS seq FROM documents) WHERE length(seq) >= 21)),
hits AS (SELECT doc_id, len, j, ku, CASE WHEN f = (m > {_rc('m')})::INT THEN 'F' ELSE 'R' END AS ori, CASE WHEN f = (m > {_rc('m')})::INT THEN off - j ELSE off + j + 21 END AS start FROM rk JOIN uu ON mer = least(m, {_rc('m')}) WHERE NOT contains(m, '-')),
n AS (SELECT *, CASE WHEN lag(j) OVER w IS NULL OR lag(ku) OVER w <> ku OR lag(ori) OVER w <> ori OR lag(start) OVER w <> start OR j > lag(j) OVER w + 21 THEN 1 ELSE 0 END AS fresh FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY j, ku, start)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY j, ku, start) AS nth FROM n)
SELECT doc_id, nth::BIGINT AS nth, ku, (CASE WHEN ori = 'F' THEN start ELSE start - len END)::INT AS ahg, ori, min(j)::INT AS hit_begin, (max(j) + 21)::INT AS hit_end FROM g GROUP BY doc_id, len, nth, ku, ori, start""")
def read_match_islands(spark, sf_dir):
    return overlaps.read_matches(doc_reads(spark, sf_dir), unique_library(spark, sf_dir), K, "doc_id").drop("read_len")


@query(f"""{_OVERLAPS}, fk AS (SELECT DISTINCT ku, least(m, {_rc('m')}) AS kmer FROM (SELECT ku, substr(seq, o + 1, 15) AS m FROM (SELECT ku, seq, unnest(range(0, 46)) AS o FROM lib))), cc AS (SELECT kmer FROM fk GROUP BY kmer HAVING count(*) > 2),
good AS (SELECT * FROM fk WHERE kmer NOT IN (SELECT kmer FROM cc)) SELECT u1 AS id1, u2 AS id2, ahg::INT AS ahg, bhg::INT AS bhg, ori FROM ov o WHERE u1 < u2 AND EXISTS (SELECT 1 FROM good a JOIN good b ON a.kmer = b.kmer WHERE a.ku = o.u1 AND b.ku = o.u2)""")
def overlap_filter_bad_kmers(spark, sf_dir):
    lib = materialize(piece_library(spark, sf_dir), "library")
    frags = lib.withColumnRenamed("ku", "id")
    bad = kmers.explode_kmers(frags, 15, "id").distinct().groupBy("kmer").count().filter("count > 2")
    found = overlaps.end_overlaps(lib, K).withColumnRenamed("u1", "id1").withColumnRenamed("u2", "id2")
    return overlaps.good_overlaps(found, frags, bad, 15).select("id1", "id2", "ahg", "bhg", "ori")


_PATHS = "WITH named AS (SELECT DISTINCT string_agg((l_suppkey % 7)::VARCHAR || CASE WHEN l_linestatus = 'F' THEN 'F' ELSE 'R' END, '_' ORDER BY l_linenumber, l_suppkey, l_partkey) AS sr FROM lineitem GROUP BY l_orderkey)"


def order_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sr, path): each order's lines as a path of unitigs."""
    item = F.struct("l_linenumber", "l_suppkey", "l_partkey", (F.col("l_suppkey") % 7).alias("ku"), F.when(F.col("l_linestatus") == "F", "F").otherwise("R").alias("ori"))
    paths = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("x"))
    paths = paths.select(F.transform("x", lambda v: F.struct(v["ku"].alias("ku"), v["ori"].alias("ori"))).alias("path"))
    return paths.select(S.name_of_path(F.col("path")).alias("sr"), "path").distinct()


@query(f"""{_PATHS}, p AS (SELECT sr, string_split(sr, '_') AS t, '_' || sr || '_' AS f FROM named), q AS (SELECT sr, t, f, len(t) AS n, '_' || array_to_string(list_transform(list_reverse(t), lambda x: translate(x, 'FR', 'RF')), '_') || '_' AS r FROM p),
ix AS (SELECT sr, f, n, unnest(list_distinct(list_transform(t, lambda x: x[:-2]))) AS ku FROM q), met AS (SELECT q.sr, ix.sr AS container, ix.n AS in_n, ix.f AS in_f, q.n, CASE WHEN contains(ix.f, q.f) THEN 'F' ELSE 'R' END AS rel_ori, CASE WHEN contains(ix.f, q.f) THEN q.f ELSE q.r END AS s FROM q JOIN ix ON q.t[1][:-2] = ix.ku AND ix.n > q.n AND (contains(ix.f, q.f) OR contains(ix.f, q.r))),
top AS (SELECT * FROM met WHERE container NOT IN (SELECT sr FROM met)), best AS (SELECT *, row_number() OVER (PARTITION BY sr ORDER BY in_n DESC, container) AS k FROM top)
SELECT sr, container, rel_ori, (len(string_split(left(in_f, instr(in_f, s)), '_')) - 2 + CASE WHEN rel_ori = 'R' THEN n ELSE 0 END)::BIGINT AS adj FROM best WHERE k = 1""")
def path_containment_reduce(spark, sf_dir):
    return paths.contained(order_paths(spark, sf_dir))


# Scaffolds and gaps ---------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT l_orderkey AS scf, l_linenumber AS b, (l_partkey * 100 + l_suppkey % 100)::BIGINT AS ctg, CASE WHEN l_linestatus = 'F' THEN 'f' ELSE 'r' END AS ori FROM lineitem), w AS (SELECT scf, ctg AS left_ctg, ori AS left_ori, lead(ctg) OVER w AS right_ctg, lead(ori) OVER w AS right_ori, (lead(b) OVER w - b)::INT AS gap FROM r WINDOW w AS (PARTITION BY scf ORDER BY b, ctg)) SELECT * FROM w WHERE right_ctg IS NOT NULL""")
def scaffold_lead_pairs(spark, sf_dir):
    return gaps.scaffold_gaps(_layout(spark, sf_dir))


def _layout(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scf"), F.col("l_linenumber").alias("begin"), F.col("l_linenumber").alias("end"), (F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("ctg"), F.when(F.col("l_linestatus") == "F", "f").otherwise("r").alias("ori"))


_GAPS = "WITH g AS (SELECT DISTINCT o_custkey AS left_ctg, o_custkey + 1 AS right_ctg, CASE WHEN o_custkey % 2 = 0 THEN 'f' ELSE 'r' END AS left_ori, CASE WHEN o_custkey % 3 = 0 THEN 'f' ELSE 'r' END AS right_ori FROM orders)"
_LINKS = "l AS (SELECT o_custkey + o_orderkey % 2 AS ctg1, o_custkey + 1 - o_orderkey % 2 AS ctg2, o_totalprice AS mean, 1.0::DOUBLE AS stdev, substr('NIOA', (o_orderkey % 4 + 1)::INT, 1) AS ori, CASE WHEN o_orderstatus = 'F' THEN 'U' ELSE 'X' END AS status, o_orderkey AS seen FROM orders)"


def _gap_links(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    g = o.select(F.col("o_custkey").alias("left_ctg"), (F.col("o_custkey") + 1).alias("right_ctg"), F.when(F.col("o_custkey") % 2 == 0, "f").otherwise("r").alias("left_ori"), F.when(F.col("o_custkey") % 3 == 0, "f").otherwise("r").alias("right_ori")).distinct()
    odd = F.col("o_orderkey") % 2
    links = o.select((F.col("o_custkey") + odd).alias("ctg1"), (F.col("o_custkey") + 1 - odd).alias("ctg2"), F.col("o_totalprice").alias("mean"), F.lit(1.0).alias("stdev"), F.substr(F.lit("NIOA"), (F.col("o_orderkey") % 4 + 1).cast("int"), F.lit(1)).alias("ori"), F.when(F.col("o_orderstatus") == "F", "U").otherwise("X").alias("status"), F.col("o_orderkey").alias("seen"))
    return g, links


@query(f"{_GAPS}, {_LINKS}, s AS (SELECT least(ctg1, ctg2) AS a, greatest(ctg1, ctg2) AS b, arg_max(mean, seen) AS mean, arg_max(stdev, seen) AS stdev FROM l GROUP BY 1, 2) SELECT g.*, mean, stdev FROM g LEFT JOIN s ON a = left_ctg AND b = right_ctg")
def gap_link_last(spark, sf_dir):
    g, links = _gap_links(spark, sf_dir)
    return gaps.link_stats(g, links, "seen")


@query(f"""{_GAPS}, {_LINKS}, b AS (SELECT ctg1, ctg2, ori, mean, stdev, status FROM l UNION ALL SELECT ctg2, ctg1, CASE ori WHEN 'N' THEN 'A' WHEN 'A' THEN 'N' ELSE ori END, mean, stdev, status FROM l),
m AS (SELECT g.*, b.mean, b.stdev, b.status FROM g LEFT JOIN b ON left_ctg = ctg1 AND right_ctg = ctg2 AND b.ori = CASE WHEN left_ori = 'f' AND right_ori = 'f' THEN 'N' WHEN left_ori = 'f' THEN 'I' WHEN right_ori = 'f' THEN 'O' ELSE 'A' END),
c AS (SELECT left_ctg, right_ctg, left_ori, right_ori, count(*) FILTER (status = 'U') AS u, count(*) FILTER (status <> 'U') AS x, min(mean) FILTER (status = 'U') AS um, min(mean) FILTER (status <> 'U') AS xm FROM m GROUP BY ALL)
SELECT left_ctg, right_ctg, left_ori, right_ori, CASE WHEN u = 1 THEN um WHEN u = 0 AND x = 1 THEN xm END AS mean, CASE WHEN u = 1 OR (u = 0 AND x = 1) THEN 1.0::DOUBLE END AS stdev, CASE WHEN u = 1 THEN 'U' WHEN u = 0 AND x = 1 THEN 'X' END AS status FROM c""")
def gap_link_unique(spark, sf_dir):
    return gaps.unique_links(*_gap_links(spark, sf_dir))


@query("""WITH rd AS (SELECT c_custkey AS read, c_nationkey AS utg, c_custkey * 10 AS b, c_custkey * 10 + 100 AS e, CASE WHEN c_custkey % 2 = 0 THEN 'f' ELSE 'r' END AS ori FROM customer), un AS (SELECT n_nationkey AS utg, n_regionkey AS ctg, n_nationkey * 100000 AS b, n_nationkey * 100000 + 50000 AS e, CASE WHEN n_nationkey % 2 = 0 THEN 'f' ELSE 'r' END AS ori FROM nation),
placed AS (SELECT c_custkey AS read, 0 AS ctg, 0::BIGINT AS b, 100::BIGINT AS e, 'f' AS ori FROM customer WHERE c_acctbal > 5000),
new AS (SELECT read, ctg, CASE WHEN un.ori = 'f' THEN un.b + rd.b ELSE un.e - rd.e END AS b, CASE WHEN un.ori = 'f' THEN un.b + rd.e ELSE un.e - rd.b END AS e, CASE WHEN un.ori = 'f' THEN rd.ori ELSE translate(rd.ori, 'fr', 'rf') END AS ori FROM rd JOIN un USING (utg) WHERE utg % 3 = 0 AND NOT EXISTS (SELECT 1 FROM placed p WHERE p.read = rd.read AND p.ctg = un.ctg))
SELECT read, ctg, b AS "begin", e AS "end", ori FROM placed UNION ALL SELECT * FROM new""")
def placement_compose(spark, sf_dir):
    side = lambda c: F.when(F.col(c) % 2 == 0, "f").otherwise("r").alias("ori")
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rd = c.select(F.col("c_custkey").alias("read"), F.col("c_nationkey").alias("utg"), (F.col("c_custkey") * 10).alias("begin"), (F.col("c_custkey") * 10 + 100).alias("end"), side("c_custkey"))
    un = n.select(F.col("n_nationkey").alias("utg"), F.col("n_regionkey").alias("ctg"), (F.col("n_nationkey") * 100000).alias("begin"), (F.col("n_nationkey") * 100000 + 50000).alias("end"), side("n_nationkey"))
    status = n.select(F.col("n_nationkey").alias("utg"), F.when(F.col("n_nationkey") % 3 == 0, "S").otherwise("U").alias("status"))
    placed = c.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("read"), F.lit(0).alias("ctg"), F.lit(0).cast("long").alias("begin"), F.lit(100).cast("long").alias("end"), F.lit("f").alias("ori"))
    return gaps.compose_placements(rd, un, status, placed)


@query(f"""WITH ends AS (SELECT item_id AS gap, 'F' AS side, left({_seq_sql()}, 100) AS seq FROM benchmark UNION ALL SELECT item_id, 'R', substr({_seq_sql()}, 101) FROM benchmark), rd AS (SELECT doc_id, {_seq_sql()} AS seq FROM documents),
em AS (SELECT gap, side, unnest(list_transform(range(1, length(seq) - {K - 2}), lambda i: substr(seq, i, {K}))) AS m FROM ends WHERE length(seq) >= {K}), own AS (SELECT DISTINCT gap, side, least(m, {_rc('m')}) AS mer, m <= {_rc('m')} AS f FROM em WHERE NOT contains(m, '-')),
rm AS (SELECT doc_id, unnest(list_transform(range(1, length(seq) - {K - 2}), lambda i: substr(seq, i, {K}))) AS m FROM rd WHERE length(seq) >= {K}), caught AS (SELECT DISTINCT doc_id // 2 AS pair, doc_id % 2 AS e, least(m, {_rc('m')}) AS mer, m <= {_rc('m')} AS f FROM rm WHERE NOT contains(m, '-') AND least(m, {_rc('m')}) IN (SELECT mer FROM own)),
freq AS (SELECT mer FROM caught GROUP BY mer HAVING count(DISTINCT (pair, e)) >= 1000), hits AS (SELECT gap, pair, e, (side = 'F') = (caught.f = own.f) AS inward FROM caught JOIN own USING (mer) WHERE mer NOT IN (SELECT mer FROM freq)),
per AS (SELECT gap, pair, bool_or(e = 0) AS s0, bool_or(e = 1) AS s1, bool_or(inward) AS b FROM hits GROUP BY gap, pair), how AS (SELECT *, CASE WHEN s0 AND s1 THEN 'B' WHEN b THEN 'M' ELSE 'O' END AS how FROM per)
SELECT gap, pair AS insert, e::INT AS "end", how FROM how, (VALUES (0), (1)) v(e) WHERE how <> 'O' OR (e = 0 AND s0) OR (e = 1 AND s1)""")
def gap_fishing(spark, sf_dir):
    """Each item is a gap, its first 100 bases the end F and the others the end R; documents 2n and 2n + 1 are mates."""
    mates = doc_reads(spark, sf_dir).select(F.expr("doc_id div 2").alias("insert"), (F.col("doc_id") % 2).alias("end"), "seq")
    half = lambda side, s: F.struct(F.lit(side).alias("side"), s.alias("seq"))
    ends = benchmark_reads(spark, sf_dir).select(F.col("item_id").alias("gap"), F.explode(F.array(half("F", F.left("seq", F.lit(100))), half("R", F.substr("seq", F.lit(101))))).alias("x")).select("gap", "x.*")
    found = gaps.fish_reads(ends, mates, K)
    return found.select("gap", "insert", F.col("end").cast("int").alias("end"), "how")


@query(f"""{_R}, w AS (SELECT doc_id, seq, length(seq) AS n, unnest(range(0, greatest(ceil((length(seq) - 2047) / 1550.0), 0)::BIGINT + 1)) * 1550 AS off FROM r) SELECT CASE WHEN n <= 2047 THEN doc_id::VARCHAR ELSE doc_id || '.' || off END AS name, substr(seq, off + 1, 2047) AS seq FROM w WHERE length(substr(seq, off + 1, 2047)) >= 64""")
def fragment_sink_rows(spark, sf_dir):
    return sources.path_fragments(doc_reads(spark, sf_dir).select(F.col("doc_id").cast("string").alias("name"), "seq"))


# The queries of graphs and of files are in modules of their own.
from . import registry_files, registry_graphs  # noqa: E402, F401
