"""Queries of graphs of k-mers and of scaffolds, and the SQL that says what they return: recursive, for tables as small as
``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import sequences as S
from .operators import gaps, kmers, overlaps, paths, unitigs
from .plans.closing import close_globally
from .plans.storage import dense_ids, materialize
from .registry import K, _letters_sql, _rc, letters, order_paths, query, table

N = K - 1
#: Most new bases of a dead end that is a spur.
SPUR = 30

# Sequences with branches: each item's letters, a copy of a stretch that ends otherwise (a dead end), for every other item a
# copy with one base changed (a bubble), and for every third a stretch that goes on into the next item.
_G = f"""WITH RECURSIVE items AS (SELECT item_id, {_letters_sql()} AS s FROM benchmark), g AS (SELECT item_id, 0 AS nth, s AS seq FROM items UNION ALL SELECT item_id, 1, substr(s, 41, 25) || translate(substr(s, 66, 6), 'ACGT', 'CATG') FROM items
UNION ALL SELECT item_id, 2, substr(s, 11, 24) || translate(substr(s, 35, 1), 'ACGT', 'GTAC') || substr(s, 36, 24) FROM items WHERE item_id % 2 = 0 UNION ALL SELECT a.item_id, 3, right(a.s, 30) || left(b.s, 30) FROM items a JOIN items b ON b.item_id = a.item_id + 1 WHERE a.item_id % 3 = 0)"""


def graph_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, nth, seq)."""
    s = table(spark, sf_dir, "benchmark").select("item_id", letters().alias("s"))
    part = lambda a, n: F.substr("s", F.lit(a), F.lit(n))
    own = s.select("item_id", F.lit(0).alias("nth"), F.col("s").alias("seq"))
    ends = s.select("item_id", F.lit(1).alias("nth"), F.concat(part(41, 25), F.translate(part(66, 6), "ACGT", "CATG")).alias("seq"))
    changed = s.filter("item_id % 2 = 0").select("item_id", F.lit(2).alias("nth"), F.concat(part(11, 24), F.translate(part(35, 1), "ACGT", "GTAC"), part(36, 24)).alias("seq"))
    after = s.select((F.col("item_id") - 1).alias("item_id"), F.left("s", F.lit(30)).alias("b"))
    on = s.filter("item_id % 3 = 0").join(after, "item_id").select("item_id", F.lit(3).alias("nth"), F.concat(F.right("s", F.lit(30)), "b").alias("seq"))
    return own.unionByName(ends).unionByName(changed).unionByName(on)


# Chains are followed from the k-mers that no unique step leads to.
_U = f"""{_G}, km AS (SELECT DISTINCT unnest(list_transform(range(1, length(seq) - {K - 2}), lambda i: substr(seq, i, {K}))) AS m FROM g), nodes AS (SELECT m AS node FROM km UNION SELECT {_rc('m')} FROM km), st AS (SELECT a.node AS a, b.node AS b FROM nodes a JOIN nodes b ON right(a.node, {N}) = left(b.node, {N})),
lk AS (SELECT a, min(b) AS b FROM st GROUP BY a HAVING count(*) = 1), links AS (SELECT a, b FROM lk WHERE b IN (SELECT b FROM st GROUP BY b HAVING count(*) = 1)),
ch AS (SELECT node AS head, node AS last, node AS seq FROM nodes WHERE node NOT IN (SELECT b FROM links) UNION ALL SELECT head, b, seq || right(b, 1) FROM ch JOIN links ON a = last), whole AS (SELECT head, arg_max(seq, length(seq)) AS seq FROM ch GROUP BY head),
u AS (SELECT (row_number() OVER (ORDER BY length(seq) DESC, seq) - 1)::BIGINT AS ku, seq FROM (SELECT DISTINCT greatest(seq, {_rc('seq')}) AS seq FROM whole))"""


def _unitigs(spark, sf_dir):
    return materialize(unitigs.compact(kmers.count_kmers(graph_reads(spark, sf_dir), K), K, solid=1), "unitigs")


def _adjacent(u):
    return materialize(overlaps.adjacency(overlaps.end_overlaps(u, K), u), "adjacent")


@query(f"{_U} SELECT ku, seq FROM u")
def unitig_compaction(spark, sf_dir):
    return _unitigs(spark, sf_dir)


@query(f"{_U} SELECT count(*) AS n, max(ku) + 1 AS next_id, sum(length(seq))::BIGINT AS bases, max(length(seq)) AS longest FROM u")
def unitig_stats(spark, sf_dir):
    return unitigs.unitig_stats(_unitigs(spark, sf_dir))


@query(f"{_U} SELECT i AS ku, coalesce(length(seq), 0) AS len FROM (SELECT unnest(range(0, (SELECT max(ku) + 1 FROM u WHERE ku % 3 > 0))) AS i) LEFT JOIN u ON u.ku = i AND ku % 3 > 0")
def unitig_lengths(spark, sf_dir):
    """Every third id is missing."""
    return unitigs.lengths_by_id(_unitigs(spark, sf_dir).filter("ku % 3 > 0")).select("ku", F.col("len").cast("long").alias("len"))


_A = f"""{_U}, e AS (SELECT ku, length(seq) AS len, 0 AS at_end, left(seq, {N}) AS m FROM u UNION ALL SELECT ku, length(seq), 1, right(seq, {N}) FROM u), x AS (SELECT ku, len, at_end, f, least(m, {_rc('m')}) AS mer FROM e, (VALUES (0), (1)) v(f) WHERE (f = 0 AND m <= {_rc('m')}) OR (f = 1 AND {_rc('m')} <= m)),
half AS (SELECT DISTINCT a.ku AS u1, b.ku AS u2, CASE WHEN a.at_end = 0 THEN {N} - b.len ELSE a.len - {N} END AS ahg, CASE WHEN a.at_end = 0 THEN {N} - a.len ELSE b.len - {N} END AS bhg, CASE WHEN a.f = b.f THEN 'N' ELSE 'I' END AS o FROM x a JOIN x b ON a.mer = b.mer AND a.ku < b.ku WHERE (a.at_end + b.at_end + a.f + b.f) % 2 = 1),
ov AS (SELECT * FROM half UNION ALL SELECT u2, u1, CASE WHEN o = 'N' THEN -ahg ELSE bhg END, CASE WHEN o = 'N' THEN -bhg ELSE ahg END, o FROM half), adj AS (SELECT u1 AS ku, CASE WHEN ahg > 0 THEN 'F' ELSE 'R' END AS ori, u2 AS nku, CASE WHEN (ahg > 0) <> (o = 'I') THEN 'F' ELSE 'R' END AS nori, length(seq) AS nlen FROM ov JOIN u ON u.ku = u2)"""

# Ways are walked as long as they are within the bound; a spur is what no longer way leaves.
_SPURS = f"""{_A}, sides AS (SELECT ku, o AS ori, length(seq) - {N} AS own FROM u, (VALUES ('F'), ('R')) v(o)), wk AS (SELECT ku AS k0, ori AS o0, ku, ori, own AS bases FROM sides WHERE own <= {SPUR} UNION ALL SELECT k0, o0, nku, nori, bases + nlen - {N} FROM wk JOIN adj USING (ku, ori) WHERE bases <= {SPUR}),
spurs AS (SELECT k0 AS ku, o0 AS ori, max(bases) AS bases FROM wk GROUP BY ALL HAVING max(bases) <= {SPUR}), opened AS (SELECT DISTINCT a.ku, a.ori FROM adj a LEFT JOIN spurs s ON s.ku = a.nku AND s.ori = a.nori WHERE s.ku IS NULL),
led AS (SELECT s.ku, s.ori, bool_and(a.ku IS NULL OR p.ku IS NOT NULL) AS ok FROM spurs s LEFT JOIN adj a ON a.nku = s.ku AND a.nori = s.ori LEFT JOIN opened p ON p.ku = a.ku AND p.ori = a.ori GROUP BY s.ku, s.ori), d0 AS (SELECT DISTINCT ku FROM led WHERE ok),
""" + ", ".join(f"d{i + 1} AS (SELECT ku FROM d{i} UNION SELECT ku FROM adj WHERE ku IN (SELECT ku FROM spurs) GROUP BY ku, ori HAVING bool_and(nku IN (SELECT ku FROM d{i})))" for i in range(6))


@query(f"{_SPURS} SELECT ku FROM d6")
def spur_removal(spark, sf_dir):
    u = _unitigs(spark, sf_dir)
    return unitigs.kill_spurs(_adjacent(u), u, K, SPUR)


@query(f"{_SPURS} SELECT ku, ori, bases::INT AS bases FROM spurs")
def spur_lengths(spark, sf_dir):
    u = _unitigs(spark, sf_dir)
    return unitigs.spur_lengths(_adjacent(u), u, K, SPUR).select("ku", "ori", F.col("bases").cast("int").alias("bases"))


@query(f"""{_SPURS}, live AS (SELECT ku, ori, nku, nori FROM adj WHERE ku NOT IN (SELECT ku FROM d6) AND nku NOT IN (SELECT ku FROM d6)), one AS (SELECT ku, ori, min(nku) AS nku, min(nori) AS nori FROM live GROUP BY ku, ori HAVING count(*) = 1)
SELECT a.* FROM one a JOIN one b ON b.ku = a.nku AND b.ori = translate(a.nori, 'FR', 'RF') AND b.nku = a.ku AND b.nori = translate(a.ori, 'FR', 'RF')""")
def unique_merge_report(spark, sf_dir):
    u = _unitigs(spark, sf_dir)
    adjacent = _adjacent(u)
    return unitigs.unique_joins(adjacent, unitigs.kill_spurs(adjacent, u, K, SPUR))


# Each read's matches, taken in order; the canonical one of the path and its reverse names it.
_flip = "list_transform(list_reverse(p), lambda x: {'ku': x.ku, 'o': 1 - x.o})"
_name = "array_to_string(list_transform({}, lambda x: x.ku || CASE WHEN x.o = 0 THEN 'F' ELSE 'R' END), '_')"
_P = f"""{_A}, uk AS (SELECT ku, off, substr(seq, off + 1, {K}) AS m FROM (SELECT ku, seq, unnest(range(0, length(seq) - {N})) AS off FROM u)), rk AS (SELECT item_id, nth AS read_nth, n, j, substr(seq, j + 1, {K}) AS m FROM (SELECT item_id, nth, seq, length(seq) AS n, unnest(range(0, length(seq) - {N})) AS j FROM g)),
hits AS (SELECT item_id, read_nth, n, j, ku, same, CASE WHEN same THEN off - j ELSE off + j + {K} END AS start FROM (SELECT rk.*, ku, off, (rk.m <= {_rc('rk.m')}) = (uk.m <= {_rc('uk.m')}) AS same FROM rk JOIN uk ON least(rk.m, {_rc('rk.m')}) = least(uk.m, {_rc('uk.m')}))),
fr AS (SELECT *, CASE WHEN lag(j) OVER w IS NULL OR lag(ku) OVER w <> ku OR lag(same) OVER w <> same OR lag(start) OVER w <> start OR j > lag(j) OVER w + {K} THEN 1 ELSE 0 END AS fresh FROM hits WINDOW w AS (PARTITION BY item_id, read_nth ORDER BY j, ku, start)),
isl AS (SELECT item_id, read_nth, n, i, ku, same, any_value(CASE WHEN same THEN start ELSE start - n END) AS ahg FROM (SELECT *, sum(fresh) OVER (PARTITION BY item_id, read_nth ORDER BY j, ku, start) AS i FROM fr) GROUP BY item_id, read_nth, n, i, ku, same, start),
ms AS (SELECT item_id, read_nth, n, ku, same, length(seq) AS len, CASE WHEN same THEN ahg ELSE length(seq) - ahg - n END AS le, row_number() OVER (PARTITION BY item_id, read_nth ORDER BY i) AS i FROM isl JOIN u USING (ku)),
mb AS (SELECT *, greatest(-le, 0) AS b, least(len - le, n) AS e FROM ms),
fold AS (SELECT item_id, read_nth, n, i, true AS ok, b AS first_b, le AS first_le, e AS covered, [{{'ku': ku, 'o': CASE WHEN same THEN 0 ELSE 1 END}}] AS p, len AS bases FROM mb WHERE i = 1
UNION ALL SELECT f.item_id, f.read_nth, f.n, m.i, CASE WHEN skip THEN ok ELSE ok AND covered - m.b = {N} END, first_b, first_le, CASE WHEN skip THEN covered ELSE m.e END, CASE WHEN skip THEN p ELSE list_append(p, {{'ku': m.ku, 'o': CASE WHEN m.same THEN 0 ELSE 1 END}}) END, CASE WHEN skip THEN bases ELSE bases + m.len - {N} END
FROM (SELECT f.*, NOT ok OR m.e <= covered OR covered - m.b > {N} AS skip FROM fold f JOIN mb m ON m.item_id = f.item_id AND m.read_nth = f.read_nth AND m.i = f.i + 1) f JOIN mb m ON m.item_id = f.item_id AND m.read_nth = f.read_nth AND m.i = f.i + 1),
ended AS (SELECT item_id, read_nth, n, arg_max({{'ok': ok, 'b': first_b, 'le': first_le, 'c': covered, 'p': p, 'bases': bases}}, i) AS f FROM fold GROUP BY ALL),
folded AS (SELECT item_id, read_nth, n, f.p AS p, f.le AS le, f.bases AS bases FROM ended WHERE f.ok AND f.b + n - f.c <= 2),
placed AS (SELECT item_id, read_nth, CASE WHEN p <= {_flip} THEN p ELSE {_flip} END AS path, p <= {_flip} AS fwd, CASE WHEN p <= {_flip} THEN le ELSE bases - le END AS off, bases FROM folded), named AS (SELECT *, {_name.format('path')} AS sr FROM placed)"""


def _covering(spark, sf_dir):
    u = _unitigs(spark, sf_dir)
    m = overlaps.read_matches(graph_reads(spark, sf_dir).withColumnRenamed("nth", "read_nth"), u, K, "item_id", "read_nth")
    return u, materialize(paths.read_paths(m, u, K, "item_id", "read_nth"), "placed")


@query(f"{_P} SELECT item_id, read_nth, sr, off::BIGINT AS off, CASE WHEN fwd THEN 'F' ELSE 'R' END AS ori FROM named")
def read_paths(spark, sf_dir):
    return _covering(spark, sf_dir)[1].select("item_id", "read_nth", "sr", F.col("off").cast("long").alias("off"), "ori")


@query(f"{_P} SELECT DISTINCT sr, bases::BIGINT AS len FROM named")
def path_lengths(spark, sf_dir):
    u, placed = _covering(spark, sf_dir)
    return paths.path_lengths(placed.select("sr", "path").distinct(), u, K)


# The container has most bases, then the first name, and is in no other; its unitigs before the place are added up.
_CONTAINED = f"""{_P}, ps AS (SELECT sr, any_value(path) AS p, any_value(bases) AS len FROM named GROUP BY sr), fr2 AS (SELECT sr, p, len, len(p) AS n, '_' || sr || '_' AS f, '_' || {_name.format(f'({_flip})')} || '_' AS r FROM ps),
met AS (SELECT a.sr, b.sr AS container, b.len AS in_len, b.f AS in_f, a.n, CASE WHEN contains(b.f, a.f) THEN 'F' ELSE 'R' END AS rel_ori, CASE WHEN contains(b.f, a.f) THEN a.f ELSE a.r END AS s FROM fr2 a JOIN fr2 b ON b.n > a.n AND (contains(b.f, a.f) OR contains(b.f, a.r))),
best AS (SELECT * FROM met WHERE container NOT IN (SELECT sr FROM met) QUALIFY row_number() OVER (PARTITION BY sr ORDER BY in_len DESC, container) = 1), upto AS (SELECT *, len(string_split(left(in_f, instr(in_f, s)), '_')) - 2 + CASE WHEN rel_ori = 'R' THEN n ELSE 0 END AS upto FROM best),
steps AS (SELECT sr, container, rel_ori, upto, unnest(range(0, upto)) AS i FROM upto), sums AS (SELECT s.sr, sum(length(seq) - {N}) AS bases FROM steps s JOIN ps ON ps.sr = s.container JOIN u ON u.ku = ps.p[i + 1].ku GROUP BY s.sr),
red AS (SELECT upto.sr, container, rel_ori, (coalesce(bases, 0) + CASE WHEN rel_ori = 'R' THEN {N} ELSE 0 END)::BIGINT AS adj FROM upto LEFT JOIN sums USING (sr))"""


def _reduced(spark, sf_dir):
    u, placed = _covering(spark, sf_dir)
    seqs = materialize(paths.path_sequences(placed, u, K), "sequences")
    return placed, seqs, materialize(paths.contained(placed, seqs, K, u), "reduction")


@query(f"{_CONTAINED} SELECT item_id, read_nth, coalesce(container, n.sr) AS sr, (CASE WHEN container IS NULL THEN off WHEN rel_ori = 'R' THEN adj - off ELSE off + adj END)::BIGINT AS off, CASE WHEN (rel_ori = 'R') IS TRUE THEN CASE WHEN fwd THEN 'R' ELSE 'F' END ELSE CASE WHEN fwd THEN 'F' ELSE 'R' END END AS ori FROM named n LEFT JOIN red ON red.sr = n.sr")
def path_placements(spark, sf_dir):
    placed, seqs, reduction = _reduced(spark, sf_dir)
    return paths.replace_placements(placed.select("item_id", "read_nth", "sr", "off", "ori"), seqs, reduction).withColumn("off", F.col("off").cast("long"))


@query(f"{_CONTAINED}, ranked AS (SELECT sr, row_number() OVER (ORDER BY len DESC, sr) - 1 AS id FROM ps) SELECT a.id AS sr_id, b.id AS container_id, rel_ori, adj FROM red JOIN ranked a ON a.sr = red.sr JOIN ranked b ON b.sr = container")
def translated_reduction(spark, sf_dir):
    _, seqs, reduction = _reduced(spark, sf_dir)
    return paths.translate_reduction(reduction, paths.rank_by_length(seqs))


_CHAINS = f"""{_P}, ps AS (SELECT sr, any_value(path) AS p FROM named GROUP BY sr), ends AS (SELECT sr, 0 AS side, p[1].ku AS ku FROM ps UNION ALL SELECT sr, 1, p[-1].ku FROM ps), inside AS (SELECT DISTINCT x.ku AS ku FROM (SELECT unnest(p[2:-2]) AS x FROM ps WHERE len(p) > 2)),
joints AS (SELECT ku, list({{'sr': sr, 'side': side}} ORDER BY sr, side) AS two FROM ends WHERE ku NOT IN (SELECT ku FROM inside) GROUP BY ku HAVING count(*) = 2 AND count(DISTINCT sr) = 2), hop AS (SELECT two[1] AS a, two[2] AS b FROM joints UNION ALL SELECT two[2], two[1] FROM joints),
hops AS (SELECT a.sr || '|' || CASE WHEN a.side = 1 THEN 'F' ELSE 'R' END AS prev, b.sr || '|' || CASE WHEN b.side = 0 THEN 'F' ELSE 'R' END AS node FROM hop), cn AS (SELECT sr || '|F' AS node FROM ps UNION ALL SELECT sr || '|R' FROM ps),
chn AS (SELECT node AS head, node, 0 AS pos FROM cn WHERE node NOT IN (SELECT node FROM hops) UNION ALL SELECT head, hops.node, pos + 1 FROM chn JOIN hops ON prev = chn.node)"""


@query(f"{_CHAINS} SELECT split_part(node, '|', 1) AS sr, split_part(head, '|', 1) AS chain, pos::BIGINT AS pos, split_part(node, '|', 2) = 'R' AS turned FROM chn QUALIFY row_number() OVER (PARTITION BY split_part(node, '|', 1) ORDER BY head, pos) = 1")
def chain_merge(spark, sf_dir):
    return paths.merge_chains(_covering(spark, sf_dir)[1])


_MEAN, _STDEV = 200.0, 10.0
# All ways within the bound are walked; those that end at the goal are the paths.
_JOIN = f"""{_P}, pr AS (SELECT item_id || '/' || read_nth AS insert, path AS p, lead(path) OVER (PARTITION BY item_id ORDER BY read_nth) AS other FROM named), pf AS (SELECT insert, p AS even, list_transform(list_reverse(other), lambda x: {{'ku': x.ku, 'o': 1 - x.o}}) AS odd FROM pr WHERE other IS NOT NULL),
pg AS (SELECT insert, even, list_transform(list_reverse(odd), lambda x: {{'ku': x.ku, 'o': 1 - x.o}}) AS far, length(seq) AS len FROM pf JOIN u ON u.ku = even[1].ku), ways AS (SELECT insert, far[-1].ku AS gk, far[-1].o AS go, even[1].ku AS ku, even[1].o AS o, len AS bases, even[1].ku || CASE WHEN even[1].o = 0 THEN 'F' ELSE 'R' END AS way FROM pg
UNION ALL SELECT insert, gk, go, nku, CASE WHEN nori = 'F' THEN 0 ELSE 1 END, bases + nlen - {N}, way || '_' || nku || nori FROM ways JOIN adj ON adj.ku = ways.ku AND adj.ori = CASE WHEN o = 0 THEN 'F' ELSE 'R' END WHERE bases + nlen - {N} <= {_MEAN + 5 * _STDEV}),
got AS (SELECT insert, way FROM ways WHERE ku = gk AND o = go), ft AS (SELECT got.insert, way, contains('_' || way || '_', '_' || {_name.format('even')} || '_')::INT + contains('_' || way || '_', '_' || {_name.format('far')} || '_')::INT AS fits FROM got JOIN pg ON pg.insert = got.insert),
agg AS (SELECT insert, count(*) AS n, count(*) FILTER (fits = 2) AS n2, count(*) FILTER (fits >= 1) AS n1, arg_max(way, (fits, way)) AS best FROM ft GROUP BY insert),
res AS (SELECT pg.insert, CASE WHEN even[1] = far[-1] THEN 'same unitig' WHEN n IS NULL THEN 'missing sequence' WHEN n = 1 THEN 'joined' WHEN n2 = 1 OR (n2 = 0 AND n1 = 1) THEN 'joined after reads' ELSE 'ambiguous' END AS outcome, best FROM pg LEFT JOIN agg ON agg.insert = pg.insert)"""


@query(f"{_JOIN} SELECT insert, outcome, CASE WHEN starts_with(outcome, 'joined') THEN best END AS sr FROM res")
def mate_path_join(spark, sf_dir):
    """Neighbouring reads of an item are the mates."""
    u, placed = _covering(spark, sf_dir)
    adjacent = _adjacent(u)
    lengths = u.select(F.col("ku").alias("_ku"), F.length("seq").cast("long").alias("len"))
    w = Window.partitionBy("item_id").orderBy("read_nth")
    pairs = placed.withColumn("other", F.lead("path").over(w)).filter("other is not null")
    pairs = pairs.select(F.concat_ws("/", "item_id", "read_nth").alias("insert"), F.col("path").alias("even"), S.reverse_path(F.col("other")).alias("odd"), F.lit(0).alias("before"), F.lit(0).alias("after"), F.lit(_MEAN).alias("mean"), F.lit(_STDEV).alias("stdev"))
    pairs = pairs.join(lengths, F.col("even")[0]["ku"] == F.col("_ku")).drop("_ku")
    return paths.join_mates(pairs, adjacent, K).select("insert", "outcome", S.name_of_path(F.col("path")).alias("sr"))


@query("""WITH named AS (SELECT l_orderkey, list({'ku': l_suppkey % 7, 'o': CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END} ORDER BY l_linenumber, l_suppkey, l_partkey) AS p FROM lineitem GROUP BY l_orderkey), two AS (SELECT p, list_transform(list_reverse(p), lambda x: {'ku': x.ku, 'o': 1 - x.o}) AS q FROM named)
SELECT DISTINCT array_to_string(list_transform(CASE WHEN p <= q THEN p ELSE q END, lambda x: x.ku || CASE WHEN x.o = 0 THEN 'F' ELSE 'R' END), '_') AS sr FROM two""")
def canonical_paths(spark, sf_dir):
    return order_paths(spark, sf_dir).select(S.name_of_path(S.canonical_path(S.path_of_name(F.col("sr")))).alias("sr")).distinct()


@query("""WITH m AS (SELECT event_id, user_id AS ku, floor(value)::BIGINT AS ahg, CASE WHEN event_id % 2 = 0 THEN 'F' ELSE 'R' END AS ori, 100 AS read_len FROM events), t AS (SELECT p_partkey AS old_ku, p_partkey // 4 AS new_ku, CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_size + 500 END AS b, CASE WHEN p_size % 2 = 0 THEN p_size + 500 ELSE p_size END AS e FROM part WHERE p_partkey % 3 > 0)
SELECT event_id, coalesce(new_ku, ku) AS ku, CASE WHEN new_ku IS NULL THEN ahg WHEN b > e THEN b - ahg - read_len ELSE b + ahg END::BIGINT AS ahg, CASE WHEN (b > e) IS TRUE THEN translate(ori, 'FR', 'RF') ELSE ori END AS ori FROM m LEFT JOIN t ON ku = old_ku""")
def translated_matches(spark, sf_dir):
    """Users stand for unitigs, parts for what merged them."""
    m = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("ku"), F.floor("value").alias("ahg"), F.when(F.col("event_id") % 2 == 0, "F").otherwise("R").alias("ori"), F.lit(100).alias("read_len"))
    size, turned = F.col("p_size"), F.col("p_size") % 2 == 1
    t = table(spark, sf_dir, "part").filter("p_partkey % 3 > 0").select(F.col("p_partkey").alias("old_ku"), F.expr("p_partkey div 4").alias("new_ku"), F.when(turned, size + 500).otherwise(size).alias("begin"), F.when(turned, size).otherwise(size + 500).alias("end"))
    return overlaps.translate_matches(m, t).select("event_id", "ku", F.col("ahg").cast("long").alias("ahg"), "ori")


@query("""WITH p AS (SELECT c_custkey AS read, c_nationkey AS ctg, c_custkey % 97 AS b, c_custkey % 97 + 100 AS e, CASE WHEN c_custkey % 2 = 0 THEN 'f' ELSE 'r' END AS ori FROM customer) SELECT ctg, read, (row_number() OVER (ORDER BY ctg, b, ori, e, read) - 1)::BIGINT AS place FROM p""")
def placement_sort(spark, sf_dir):
    """Placements in their order, and where in it each stands."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("read"), F.col("c_nationkey").alias("ctg"), (F.col("c_custkey") % 97).alias("begin"), (F.col("c_custkey") % 97 + 100).alias("end"), F.when(F.col("c_custkey") % 2 == 0, "f").otherwise("r").alias("ori"))
    return dense_ids(gaps.sorted_placements(c), "place", "ctg", "begin", "ori", "end", "read").select("ctg", "read", "place")


# Contigs of a scaffold: an order's lines; gaps after lines of every third part are closed.
_SCAFFOLDS = f"""WITH l AS (SELECT l_orderkey AS scf, l_orderkey * 10 + l_linenumber AS ctg, l_linenumber * 1000 + l_partkey % 50 AS b, CASE WHEN l_linestatus = 'F' THEN 'f' ELSE 'r' END AS ori, translate(regexp_replace(p_name || p_type || p_name, '[^A-Za-z]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', '{'ACGT' * 13}') AS s, l_partkey % 3 = 0 AS shut FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 5 = 0),
o AS (SELECT *, b + length(s) AS e, CASE WHEN ori = 'f' THEN s ELSE {_rc('s')} END AS seq FROM l QUALIFY count(*) OVER (PARTITION BY ctg) = 1), x AS (SELECT *, lead(ctg) OVER w AS next, left(lead(seq) OVER w, 5) AS after, lag(e) OVER w AS before_e FROM o WINDOW w AS (PARTITION BY scf ORDER BY b, e, ctg)),
c AS (SELECT *, CASE WHEN shut AND next IS NOT NULL THEN right(seq, 5) || 'NNACGTNN' || after END AS bridge FROM x), y AS (SELECT *, lag(bridge) OVER (PARTITION BY scf ORDER BY b, e, ctg) AS prior FROM c), z AS (SELECT *, sum((prior IS NULL)::INT) OVER (PARTITION BY scf ORDER BY b, e, ctg) AS part, substr(seq, CASE WHEN prior IS NULL THEN 1 ELSE 6 END) AS rest FROM y),
parts AS (SELECT scf, part, count(*) AS n, min(b) AS "begin", arg_min(ori, (b, e, ctg)) AS o1, arg_min(b - before_e, (b, e, ctg)) AS gap, string_agg(ctg || ori, '_' ORDER BY b, e, ctg) AS long_name, min(ctg)::VARCHAR AS short_name, string_agg(CASE WHEN bridge IS NULL THEN rest ELSE left(rest, greatest(length(rest) - 5, 0)) || bridge END, '' ORDER BY b, e, ctg) AS seq FROM z GROUP BY scf, part),
merged AS (SELECT scf, CASE WHEN n > 1 THEN long_name ELSE short_name END AS name, "begin", CASE WHEN n > 1 THEN 'f' ELSE o1 END AS ori, CASE WHEN part = 1 THEN NULL ELSE gap END AS gap, seq FROM parts)"""


def _scaffolds(spark, sf_dir):
    """(layout, contigs, closed)."""
    parts = table(spark, sf_dir, "part").select("p_partkey", S.as_sequence(F.regexp_replace(F.concat("p_name", "p_type", "p_name"), "[^A-Za-z]", "")).alias("seq"))
    lines = table(spark, sf_dir, "lineitem").filter("l_orderkey % 5 = 0").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.select(F.col("l_orderkey").alias("scf"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ctg"), (F.col("l_linenumber") * 1000 + F.col("l_partkey") % 50).alias("begin"), F.when(F.col("l_linestatus") == "F", "f").otherwise("r").alias("ori"), "seq", (F.col("l_partkey") % 3 == 0).alias("shut"))
    once = lines.groupBy("ctg").count().filter("count = 1").select("ctg")
    lines = materialize(lines.join(once, "ctg").withColumn("end", F.col("begin") + F.length("seq")), "lines")
    w = Window.partitionBy("scf").orderBy("begin", "end", "ctg")
    laid = lines.withColumn("s", F.when(F.col("ori") == "f", F.col("seq")).otherwise(S.revcomp(F.col("seq"))))
    closed = laid.withColumn("after", F.left(F.lead("s").over(w), F.lit(5))).filter("shut and after is not null").select(F.col("ctg").alias("left_ctg"), F.concat(F.right("s", F.lit(5)), F.lit("NNACGTNN"), "after").alias("seq"))
    return lines.select("ctg", "scf", "begin", "end", "ori"), lines.select("ctg", "seq"), closed


@query(f'{_SCAFFOLDS} SELECT scf, name, "begin", ori, coalesce(gap::VARCHAR, \'first\') AS gap, seq FROM merged')
def contig_merge(spark, sf_dir):
    return gaps.merge_contigs(*_scaffolds(spark, sf_dir), 5).withColumn("gap", F.coalesce(F.col("gap").cast("string"), F.lit("first")))


_PLACES = f"{_SCAFFOLDS}, pl AS (SELECT *, CASE WHEN gap IS NULL THEN 0 ELSE greatest(gap, 0) END AS ns FROM merged)"


@query(f'{_PLACES}, q AS (SELECT *, sum(length(seq) + ns) OVER (PARTITION BY scf ORDER BY "begin", name) AS e FROM pl) SELECT name, scf, (e - length(seq))::BIGINT AS "begin", e::BIGINT AS "end", ori FROM q')
def scaffold_places(spark, sf_dir):
    return gaps.scaffold_places(gaps.merge_contigs(*_scaffolds(spark, sf_dir), 5))


@query(f"{_PLACES} SELECT scf, string_agg(repeat('N', ns::INT) || seq, '' ORDER BY \"begin\", name) AS seq FROM pl GROUP BY scf")
def scaffold_sequences(spark, sf_dir):
    return gaps.scaffold_sequences(gaps.merge_contigs(*_scaffolds(spark, sf_dir), 5))


_RESULTS = "WITH j AS (SELECT o_orderkey AS gap, o_orderpriority AS seq, o_custkey AS off1, o_custkey + (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) * (o_orderkey % 400) AS off2 FROM orders), s AS (SELECT o_orderkey AS gap, 150.0 AS mean, 30.0 AS stdev FROM orders WHERE o_orderkey % 4 > 0), ok AS (SELECT j.* FROM j LEFT JOIN s USING (gap) WHERE mean IS NULL OR abs(off2 - off1) BETWEEN mean - 5 * stdev AND mean + 5 * stdev)"


@query(f"{_RESULTS} SELECT gap, 'joined' AS read, '-' AS off, '-' AS ori, seq FROM ok UNION ALL SELECT gap, 'a' || gap, off1::VARCHAR, 'F', '-' FROM ok UNION ALL SELECT gap, 'b' || gap, off2::VARCHAR, 'R', '-' FROM ok")
def joined_rows_split(spark, sf_dir):
    """Both tables, one below the other."""
    key, sign = F.col("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    o = table(spark, sf_dir, "orders")
    rows = o.select(key.alias("gap"), F.col("o_orderpriority").alias("seq"), F.concat(F.lit("a"), key.cast("string")).alias("read1"), F.col("o_custkey").alias("off1"), F.lit("F").alias("ori1"), F.concat(F.lit("b"), key.cast("string")).alias("read2"), (F.col("o_custkey") + sign * (key % 400)).alias("off2"), F.lit("R").alias("ori2"))
    stats = o.filter("o_orderkey % 4 > 0").select(key.alias("gap"), F.lit(150.0).alias("mean"), F.lit(30.0).alias("stdev"))
    seqs, placed = gaps.split_joined(rows, stats)
    below = seqs.select("gap", F.lit("joined").alias("read"), F.lit("-").alias("off"), F.lit("-").alias("ori"), "seq")
    return placed.withColumn("off", F.col("off").cast("string")).withColumn("seq", F.lit("-")).unionByName(below)


def _gap_reads(spark, sf_dir):
    """(gaps, mates): each item's first and last 45 bases are the ends of a gap, its stretches of 70 bases the reads; those
    of every third item leave a part out."""
    s = table(spark, sf_dir, "benchmark").select("item_id", letters().alias("s")).filter("length(s) >= 150")
    g = s.select(F.col("item_id").alias("gap"), F.left("s", F.lit(45)).alias("left_seq"), F.right("s", F.lit(45)).alias("right_seq"))
    starts = F.filter(F.sequence(F.lit(1), F.length("s") - 60, F.lit(9)), lambda i: (F.col("item_id") % 3 > 0) | (i < 30) | (i > 100))
    mates = s.select("item_id", "s", F.posexplode(starts).alias("nth", "at")).select((F.col("item_id") * 1000 + F.expr("nth div 2")).alias("insert"), (F.col("nth") % 2).alias("end"), F.substr("s", F.col("at"), F.lit(70)).alias("seq"))
    return g, materialize(mates, "mates")


@query()
def gap_k_search(spark, sf_dir):
    """Each gap for itself, from the reads fished for it."""
    g, mates = _gap_reads(spark, sf_dir)
    ends = g.select("gap", F.explode(F.array(F.struct(F.lit("F").alias("side"), F.col("left_seq").alias("seq")), F.struct(F.lit("R").alias("side"), F.col("right_seq").alias("seq")))).alias("e")).select("gap", "e.*")
    return gaps.close_gaps(g, gaps.fish_reads(ends, mates, K), mates)


@query()
def gaps_closed_together(spark, sf_dir):
    """All gaps in one graph for each k."""
    g, mates = _gap_reads(spark, sf_dir)
    return close_globally(g, mates, [K, 41], 220, 60)
