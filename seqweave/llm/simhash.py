"""SimHash near-duplicates through a Gray-order hierarchical index.

1. Each text gets a 64-bit fingerprint: a bit is 1 if it is set in over half of its shingles' XXH64 values.
2. Distinct fingerprints go into buckets. Two fingerprints at most ``k`` bits apart agree on one of ``k + 1`` blocks of
   bits, so every link lies in a bucket (block, value). A bucket with more than ``hot`` fingerprints is dealt once more,
   by ``k + 1`` blocks of its remaining bits, so no bucket grows with one hot pattern.
3. In each bucket the fingerprints are in the order of their Gray rank, where neighbours differ in few bits. An index of
   nodes lies over them: a node holds the bits on which all below it agree, without those an upper node already holds.
   Each fingerprint goes down from the root, adds up its differences from the nodes' bits, and leaves a whole group as
   soon as they exceed ``k``.
4. Buckets give a spanning forest of their links (never all pairs), and alternating star contraction joins these into
   components. Nothing is collected: all tables stay distributed and thin (fingerprints, not texts).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialize, small

SEED = 42
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16
#: Children of an index node.
FANOUT = 8


def fingerprint(text: str | None, width: int) -> int:
    """The SimHash of ``width``-word shingles as an unsigned number; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and blanks only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) > width else iter([b" ".join(words)])
    hashes, ones, left = map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.zeros(64, np.int64), n
    while left:
        got = np.fromiter(hashes, np.uint64, min(CHUNK, left))
        left -= len(got)
        ones += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


#: Words of a wide fingerprint, and what makes further hashes of a shingle's hash.
WORDS = 8
_SALT = np.random.RandomState(64).randint(1, 1 << 62, WORDS - 1).astype(np.uint64)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The distinct XXH64 values of a text's shingles; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) > width else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n))


def wide_fingerprint(text: str | None, width: int) -> bytes:
    """``WORDS`` SimHashes of a text by as many hashes of each distinct shingle; zero without words."""
    return wide_fingerprint_of(shingle_hashes(text, width))


def wide_fingerprint_of(hashes: np.ndarray) -> bytes:
    n, ones = len(hashes), np.zeros(64 * WORDS, np.int64)
    for at in range(0, n, CHUNK // WORDS):
        h = hashes[at : at + CHUNK // WORDS]
        more = (h[:, None] ^ _SALT) * np.uint64(0x9E3779B97F4A7C15)
        more = (more ^ (more >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        each = np.unpackbits(np.column_stack([h, more ^ (more >> np.uint64(29))]).view(np.uint8), axis=1, bitorder="little")
        for i in range(0, len(each), 255):
            ones += np.add.reduce(each[i : i + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").tobytes()


def fingerprint_column(text: Column, width: int) -> Column:
    """The fingerprint as a long with the same bits. A null text counts as empty."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, width) for x in texts], np.uint64).view(np.int64))

    return of(text)


def _blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """(offset, width) of ``parts`` nearly equal blocks of ``bits`` bits."""
    cuts = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _keyed(value: str, bits: int, parts: int) -> str:
    """SQL: an array of (part, its value, the bits left) for the blocks of ``value``."""
    out = []
    for i, (at, width) in enumerate(_blocks(bits, parts)):
        low = f"({value} & {(1 << at) - 1}L)" if at else "0L"
        high = f"shiftleft(shiftrightunsigned({value}, {at + width}), {at})" if at + width < bits else "0L"
        out.append(f"struct({i}L as part, shiftrightunsigned({value}, {at}) & {(1 << width) - 1}L as val, {low} | {high} as rest)")
    return f"array({', '.join(out)})"


def _gray_rank(value: str) -> Column:
    """The place of a word in Gray order (the inverse of i ^ i >> 1), so that signed order is the unsigned one."""
    e = value
    for s in (1, 2, 4, 8, 16, 32):
        e = f"({e} ^ shiftrightunsigned({e}, {s}))" if s == 1 else f"transform(array({e}), x -> x ^ shiftrightunsigned(x, {s}))[0]"
    return F.expr(f"{e} ^ shiftleft(1L, 63)")


def _forest(label: np.ndarray, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which links (a, b) make a spanning forest of the groups in ``label``, the nearest first (Boruvka's rounds)."""
    order, group, picked = np.argsort(apart, kind="stable"), label.copy(), []
    while True:
        order = order[group[a[order]] != group[b[order]]]
        if not len(order):
            return np.concatenate(picked) if picked else order
        best, at = np.full(len(group), len(order)), np.arange(len(order))
        np.minimum.at(best, group[a[order]], at)
        np.minimum.at(best, group[b[order]], at)
        new = order[np.unique(best[best < len(order)])]
        picked.append(new)
        root = np.arange(len(group))
        x, y = group[a[new]], group[b[new]]
        while True:
            low = np.minimum(root[x], root[y])
            now = root.copy()
            for z in (x, y, root[x], root[y]):
                np.minimum.at(now, z, low)
            now = now[now]
            if np.array_equal(now, root):
                break
            root = now
        group = root[group]


def gray_pairs(buckets: np.ndarray, fps: np.ndarray, bounds: tuple[int, ...], label: np.ndarray, budget: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, bits apart) of the pairs of a bucket within each of the rising ``bounds`` whose labels differ, slice by slice.

    ``fps`` (uint64, one word for each row, or a row of words) are sorted by bucket, then by Gray rank. ``budget`` bounds
    the words of (row, node) pairs in work at once. Rows ask in slices; groups in which all have the label of the asking
    row aren't entered. ``label`` may change between slices; if it doesn't, every pair within the bound is given.
    """
    n = len(fps)
    if n < 2:
        return
    fps = fps.reshape(n, -1)
    starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    sizes = np.diff(np.r_[starts, n])
    if sizes.max() < 2:
        return
    bucket_of = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(n) - starts[bucket_of]
    bits = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int32)
    # Levels from single rows to whole buckets: first row, bits on which all rows agree, their values.
    levels, span = [(np.arange(n), np.full(fps.shape, ~np.uint64(0)), fps)], 1
    while span < sizes.max():
        span *= FANOUT
        first = np.flatnonzero(place % span == 0)
        ands, ors = np.bitwise_and.reduceat(fps, first, axis=0), np.bitwise_or.reduceat(fps, first, axis=0)
        levels.append((first, ~(ands ^ ors), ands))
    own, child_from = [], []  # by level: bits that no upper node has; where a node's children begin on the level below
    for i, (first, mask, _) in enumerate(levels):
        if i + 1 < len(levels):
            up = np.searchsorted(levels[i + 1][0], first, "right") - 1
            own.append(mask & ~levels[i + 1][1][up])
        else:
            own.append(mask)
        child_from.append(np.r_[np.searchsorted(levels[i - 1][0], first), len(levels[i - 1][0])] if i else None)
    top = len(levels) - 1
    root = np.searchsorted(levels[top][0], np.arange(n), "right") - 1
    step = int(np.clip(budget // sizes.max() // fps.shape[1], 16, 1 << 16))
    for bound in bounds:
        # The first rows of large buckets connect what is close; the slices double from there.
        begin, now = 0, 32 if sizes.max() > 256 else 1 << 16
        while begin < n:
            now = min(now, step)
            query = np.arange(begin, min(n, begin + now))
            begin, now = begin + now, now * 2
            query = query[sizes[bucket_of[query]] > 1]
            node, apart = root[query], np.zeros(len(query), np.int32)
            for i in range(top, 0, -1):
                kids = child_from[i][node + 1] - child_from[i][node]
                at = np.repeat(np.arange(len(query)), kids)
                child = child_from[i][node][at] + np.arange(len(at)) - np.repeat(np.cumsum(kids) - kids, kids)
                first, _, value = levels[i - 1]
                q = query[at]
                keep = np.r_[first[1:], n][child] - 1 > q  # each link is found from its smaller row
                lows, highs = (np.minimum.reduceat(label, first), np.maximum.reduceat(label, first)) if i > 1 else (label, label)
                keep &= (lows[child] != label[q]) | (highs[child] != label[q])
                q, child, at = q[keep], child[keep], at[keep]
                diff = apart[at] + bits((fps[q] ^ value[child]) & own[i - 1][child])
                keep = diff <= bound
                query, node, apart = q[keep], child[keep], diff[keep]
            yield query, node, apart


def gray_links(buckets: np.ndarray, fps: np.ndarray, k: int, budget: int = 2_000_000, nearer: tuple[int, ...] = (), links: list | None = None) -> np.ndarray:
    """For each row the smallest row that it is connected to, over links of at most ``k`` bits in its bucket.

    With ``nearer`` (rising bounds below ``k``) links within these are made first. ``links`` receives (row, row, bits apart)
    of a spanning forest of direct links. Rows are as ``gray_pairs`` takes them; groups that earlier slices have connected
    aren't entered again, so a large cluster costs no comparison of all its pairs.
    """
    label = np.arange(len(fps))
    for a, b, apart in gray_pairs(buckets, fps, (*nearer, k), label, budget):
        if links is not None and len(a):
            tree = _forest(label, a, b, apart)
            links.append((a[tree], b[tree], apart[tree]))
        while len(a):
            low = np.minimum(label[a], label[b])
            new = label.copy()
            for x in (a, b, label[a], label[b]):
                np.minimum.at(new, x, low)
            new = new[new]
            if np.array_equal(new, label):
                break
            label[:] = new
        while not np.array_equal(label, label[label]):
            label[:] = label[label]
    return label


def _bucket_links(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; whole buckets are worked on as they are complete."""
        held_b, held_f, held = [], [], 0

        def done(b: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            label = gray_links(b, f, k)
            at = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(f[at].view(np.int64)), pa.array(f[label[at]].view(np.int64))], names=["a", "b"])

        for batch in batches:
            b, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(b):
                continue
            held_b.append(b)
            held_f.append(f)
            held += len(b)
            if held >= CHUNK and held_b[0][0] != b[-1]:
                b, f = np.concatenate(held_b), np.concatenate(held_f)
                cut = int(np.searchsorted(b, b[-1]))
                yield done(b[:cut], f[:cut])
                held_b, held_f, held = [b[cut:]], [f[cut:]], len(b) - cut
        if held:
            yield done(np.concatenate(held_b), np.concatenate(held_f))

    return run


def fingerprint_links(fps: DataFrame, k: int, hot: int = 1 << 14) -> DataFrame:
    """(a, b): a spanning forest, bucket by bucket, of all links of at most ``k`` bits between the distinct longs ``fp``."""
    parts = k + 1
    keyed = fps.select("fp", F.explode(F.expr(_keyed("fp", 64, parts))).alias("x")).select("fp", F.expr("shiftleft(x.part, 60) | shiftleft(x.val, 40)").alias("bucket"), "x.rest")
    width = max(w for _, w in _blocks(64, parts))
    crowded = materialize(keyed.groupBy("bucket").count().filter(F.col("count") > hot).select("bucket"), "crowded")
    rows = keyed.select("bucket", "fp")
    if not crowded.isEmpty():
        rest_bits = 64 - width  # narrower blocks leave more bits; those above belong to the last part
        again = keyed.join(crowded, "bucket", "left_semi")
        dealt = again.select("fp", "bucket", F.explode(F.expr(_keyed("rest", rest_bits + (1 if 64 % parts else 0), parts))).alias("x"))
        rows = keyed.join(crowded, "bucket", "left_anti").select("bucket", "fp").unionByName(dealt.select(F.expr("bucket | shiftleft(x.part + 1, 32) | x.val").alias("bucket"), "fp"))
    ordered = rows.repartition("bucket").withColumn("rank", _gray_rank("fp")).sortWithinPartitions("bucket", "rank").select("bucket", "fp")
    return ordered.mapInArrow(_bucket_links(k), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of ``edges`` (a, b) the smallest node it is connected to.

    Alternating large-star and small-star contraction; each round is written to the shared folder, and the last one
    deleted. The number of rounds grows with the logarithm of the largest component's diameter, not with its size. The
    smallest neighbours are written before they are joined, so that they are broadcast if few, and else both sides of the
    join are shuffles, of which Spark splits the partition of a node with many edges.
    """

    def star(pairs: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
        both = pairs.union(pairs.select("b", "a")).toDF("u", "v") if large else pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lows")
        met = both.join(small(low), "u")
        out = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
        return out.filter("a != b").distinct(), low

    now, seen = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen or not state[0]:
            return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        seen = state
        large, low = star(now, True)
        new, lower = star(large, False)
        last, now = now, materialize(new, "star")
        forget(last, low, lower)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, k: int = 4, hot: int = 1 << 14) -> DataFrame:
    """One row for each row of ``docs``: (key, fingerprint as a long, component_id).

    ``component_id`` is the smallest ``key`` over all documents whose fingerprints can be reached by steps of at most
    ``k`` differing bits, its own included. Null or blank texts have fingerprint 0 and link like any other. Rows with a
    null key belong to components but never name one (null if no key is there). Repeated rows stay, extra columns are
    left out, an empty table gives no rows.
    """
    marked = materialize(docs.select(F.col(key).alias("_key"), fingerprint_column(F.col(text), width).alias("fp")), "fingerprints")
    firsts = marked.groupBy("fp").agg(F.min("_key").alias("first"))
    root = components(fingerprint_links(firsts.select("fp"), k, hot))
    rooted = firsts.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(F.col("_key").alias(key), F.col("fp").alias("fingerprint"), "component_id")


#: Bits of a band at least, and differing bits of all 64 * WORDS up to which wide fingerprints are compared. At a share s
#: of common shingles a bit differs with probability arccos(2 s / (1 + s)) / pi: at 0.8 in 77 of 512 bits, give or take 8.
BAND_BITS, WIDE_BITS = 14, 104
#: Fingerprints that a bucket holds on average at most (bands get wider with the corpus), share of pairs at 0.8 that agree in
#: some band, and fingerprints of a bucket that a task holds.
BAND_ROWS, AGREE, HOT = 1 << 12, 0.995, 1 << 16
#: Nearer bounds, whose links come first: within the first, texts are alike beyond doubt (0.8 lies over three deviations off).
NEARER = (48, 72)
#: Share of common shingles from which texts count as near duplicates.
SIMILARITY = 0.8
#: Shingle sets of so many elements are linked exactly, to those with one element more.
SHORT = range(4, 8)
#: Shingles of a block of texts, and the least that a text counts for: a task compares texts of two blocks at a time.
BLOCK_SHINGLES, LEAST_SHINGLES = 1 << 21, 1 << 11


def band_plan(rows: int, similarity: float = SIMILARITY) -> np.ndarray:
    """The bits of each band, a row for each: as wide as ``rows`` fingerprints ask for, as many as find ``AGREE`` of the pairs.

    The first bands are cut from the bits in order; beyond that, from seeded orders of all bits.
    """
    width = BAND_BITS + max(0, math.ceil(math.log2(max(1, rows) / (BAND_ROWS << BAND_BITS))))
    same = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = max(64 * WORDS // width, math.ceil(math.log(1 - AGREE) / math.log(1 - same**width)))
    orders, rng = [np.arange(64 * WORDS)], np.random.RandomState(SEED)
    while len(orders) * (64 * WORDS // width) < n:
        orders.append(rng.permutation(64 * WORDS))
    return np.concatenate([o[: 64 * WORDS // width * width].reshape(-1, width) for o in orders])[:n]


def _by_groups(work, least: int):
    """An iterator of batches sorted by their first column, which hands whole groups, at least ``least`` bytes, to ``work``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= least and held[0].column(0)[0] != batch.column(0)[-1]:
                table = pa.Table.from_batches(held).combine_chunks()
                group = table.column(0).to_numpy()
                cut = int(np.searchsorted(group, group[-1]))
                yield from work(table.slice(0, cut).combine_chunks())
                held = table.slice(cut).combine_chunks().to_batches()
                size = sum(x.nbytes for x in held)
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    return run


def _words_of(fp: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(fp.to_pylist()), "<u8").reshape(-1, WORDS)


def _gray_sorted(groups: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """The order by group, then by Gray rank of the first word."""
    rank = fps[:, 0].copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return np.lexsort((rank, groups))


def _wide_links(k: int):
    """Rows (bucket, id, fp) come sorted by bucket; (a, b, apart) of a spanning forest of each bucket's candidates."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        b, ids, fps = table["bucket"].to_numpy(), table["id"].to_numpy(), _words_of(table["fp"])
        order = _gray_sorted(b, fps)
        found: list[tuple] = []
        gray_links(b[order], fps[order], k, nearer=NEARER, links=found)
        ids, none = ids[order], np.zeros(0, np.int64)
        x, y, apart = (np.concatenate(c) for c in zip((none, none, none), *found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y]), pa.array(apart.astype(np.int64))], names=["a", "b", "apart"])

    return _by_groups(work, 8 * WORDS * CHUNK)


def _bands(plan: np.ndarray):
    """(bucket, id, fp) of each row for each of its bands."""
    power = 1 << np.arange(plan.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, -1), axis=1, bitorder="little")
            for band, at in enumerate(plan):
                bucket = bits[:, at].astype(np.int64) @ power | band << plan.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns], names=["bucket", *batch.schema.names])

    return run


def _banded(firsts: DataFrame, plan: np.ndarray, hot: int) -> DataFrame:
    """(bucket, id, fp), dealt and sorted by bucket. Buckets of more than about ``hot`` rows are cut into blocks, and each
    pair of blocks is a bucket, so no task holds more and no pair is lost."""
    rows = firsts.select("id", "fp").mapInArrow(_bands(plan), "bucket long, id long, fp binary")
    # Which buckets are cut decides nothing but who does the work, so a share of the rows is counted.
    share = 16 if hot >= 1024 else 1
    some = firsts.select("id", "fp").filter(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).mapInArrow(_bands(plan), "bucket long, id long, fp binary")
    crowded = materialize(some.groupBy("bucket").count().filter(F.col("count") > hot / share).select("bucket", F.ceil(F.col("count") * (2 * share) / hot).alias("blocks")), "crowded")
    if not crowded.isEmpty():
        cut = rows.join(small(crowded), "bucket", "left")
        block = F.pmod(F.xxhash64("id"), F.col("blocks"))
        other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        cut = cut.select("bucket", "id", "fp", block.alias("_block"), other.alias("_other"))
        rows = cut.select(F.when(F.col("_block").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("_block", "_other"), F.greatest("_block", "_other"))).alias("bucket"), "id", "fp")
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def alike_links(cells: np.ndarray, ids: np.ndarray, fps: np.ndarray, classes: np.ndarray, sizes: np.ndarray, values: np.ndarray, k: int, similarity: float) -> list[tuple[int, int]]:
    """Links (id, id) that join, cell by cell, all classes between which some texts at most ``k`` bits apart are alike.

    Texts are alike within ``NEARER[0]`` bits, or if ``similarity`` or more of their shingles are in common, exactly.
    Shingle sets, of the given sizes, follow each other in ``values``. Pairs of classes that a link has joined already
    aren't compared any more.
    """
    order = _gray_sorted(cells, fps)
    starts = (np.cumsum(sizes) - sizes)[order]
    cells, ids, fps, sizes = cells[order], ids[order], fps[order], sizes[order]
    _, first, at = np.unique(np.stack([cells, classes[order]]), axis=1, return_index=True, return_inverse=True)
    label = first[at.ravel()]
    cuts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True])
    cell_of = np.searchsorted(cuts, np.arange(len(cells)), "right") - 1
    distinct, values = np.unique(values, return_inverse=True)
    mark, links = np.zeros(len(distinct), bool), []
    for x, y, apart in gray_pairs(cells, fps, (k,), label):
        near = apart <= NEARER[0]
        todo = np.flatnonzero(near | (np.minimum(sizes[x], sizes[y]) >= similarity * np.maximum(sizes[x], sizes[y])) & (sizes[y] > 0))
        todo = todo[np.argsort(x[todo], kind="stable")]
        for part in np.split(todo, np.flatnonzero(np.diff(x[todo])) + 1) if len(todo) else ():
            i = x[part[0]]
            part = part[label[y[part]] != label[i]]
            if not len(part):
                continue
            with_ = y[part]
            own = values[starts[i] : starts[i] + sizes[i]]
            mark[own] = True
            n = sizes[with_]
            begin = np.cumsum(n) - n
            there = mark[values[np.repeat(starts[with_] - begin, n) + np.arange(n.sum())]]
            total = np.r_[0, np.cumsum(there)]
            common = total[begin + n] - total[begin]
            mark[own] = False
            hit = with_[near[part] | ((n > 0) & (common >= similarity * (sizes[i] + n - common)))]
            if len(hit):
                met, one = np.unique(label[hit], return_index=True)
                links += [(int(ids[i]), int(ids[j])) for j in hit[one]]
                here = label[cuts[cell_of[i]] : cuts[cell_of[i] + 1]]
                here[np.isin(here, np.r_[met, label[i]])] = min(int(met[0]), int(label[i]))
    return links


def _settle(k: int, similarity: float):
    """Rows (cell, id, fp, class, s) come sorted by cell; (a, b) of the links that ``alike_links`` finds."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        sets = table["s"].combine_chunks()
        sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
        found = alike_links(table["cell"].to_numpy(), table["id"].to_numpy(), _words_of(table["fp"]), table["class"].to_numpy(), np.asarray(sets.value_lengths(), np.int64), sets.flatten().to_numpy(), k, similarity)
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _by_groups(work, 16 << 20)


def _classes(docs: DataFrame, text: str, key: str, width: int, k: int, similarity: float, hot: int) -> DataFrame:
    """(key, hash, root), a row for each row: its key, its text's hash and the number of its component."""

    @F.pandas_udf("fp binary, whole bigint, less array<bigint>")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for x in texts:
            h = shingle_hashes(x, width)
            whole = h.sum(dtype=np.uint64).view(np.int64) if len(h) in SHORT else None
            less = (h.sum(dtype=np.uint64) - h).view(np.int64).tolist() if len(h) - 1 in SHORT else None
            out.append((wide_fingerprint_of(h), whole, less))
        return pd.DataFrame(out, columns=["fp", "whole", "less"], dtype=object)

    hashed = F.xxhash64(F.coalesce(text, F.lit("")))
    marked = materialize(docs.select(F.col(key).alias("key"), hashed.alias("hash"), of(F.col(text)).alias("x")).select("key", "hash", "x.*"), "wide")
    # The row whose text stands for a fingerprint has its first key and the hash ``_of``.
    firsts = marked.groupBy("fp").agg(F.min(F.struct(F.col("key").isNull(), "key", "hash")).alias("_first"), F.first("whole").alias("whole"), F.first("less").alias("less"))
    firsts = materialize(firsts.withColumn("id", F.monotonically_increasing_id()), "classes")
    links = materialize(_banded(firsts, band_plan(firsts.count(), similarity), hot).mapInArrow(_wide_links(k), "a long, b long, apart long").withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")}).distinct(), "links")
    # Of few shingles, one more or less turns many bits; those sets are alike if the larger one has one element more.
    brief = firsts.filter("whole is not null").select("id", "whole")
    longer = firsts.filter("less is not null").select(F.col("id").alias("_id"), F.explode("less").alias("whole"))
    brief = longer.join(small(materialize(brief, "brief")), "whole").select(F.col("_id").alias("a"), F.col("id").alias("b"))
    sure = links.filter(F.col("apart") <= NEARER[0]).select("a", "b").union(brief)
    root = materialize(components(sure), "roots")
    # Candidates that meet somewhere but are in different classes.
    classed = firsts.select("id").join(root.toDF("id", "class"), "id", "left").select("id", F.coalesce("class", "id").alias("class"))
    classed = materialize(classed, "classed")
    open_ = links.filter(F.col("apart") > NEARER[0]).join(classed.toDF("a", "x"), "a").join(classed.toDF("b", "y"), "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    met = components(open_).toDF("class", "met")
    met = materialize(met.union(met.select("met", "met")).distinct(), "met")
    if not met.isEmpty():
        members = classed.join(met, "class").join(firsts.select("id", "fp", "_first"), "id").select("id", "class", "met", "fp", F.col("_first.key").alias("_key"), F.col("_first.hash").alias("_hash"))
        members = small(materialize(members, "members"))

        @F.pandas_udf("array<bigint>")
        def shingles(texts: pd.Series) -> pd.Series:
            return pd.Series([shingle_hashes(x, width).view(np.int64) for x in texts], dtype=object)

        texts = docs.select(F.col(key).alias("key"), hashed.alias("hash"), F.col(text).alias("_text"))
        sets = texts.join(members, (F.col("hash") == F.col("_hash")) & F.col("key").eqNullSafe(F.col("_key"))).select("id", "class", "met", "fp", shingles("_text").alias("s"))
        sets = materialize(sets.dropDuplicates(["id"]), "sets")
        # Texts that may meet lie in blocks that a task can hold; a cell is two blocks, in which all that differ in class are compared.
        weight = F.greatest(F.size("s"), F.lit(LEAST_SHINGLES)).cast("long")
        blocks = materialize(sets.groupBy("met").agg(F.ceil(F.sum(weight) / BLOCK_SHINGLES).alias("blocks")).filter("blocks > 1"), "blocks")
        celled = sets.join(small(blocks), "met", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        block, other = F.pmod(F.xxhash64("id"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        celled = celled.select("met", "id", "fp", "class", "s", block.alias("_x"), other.alias("_y"))
        celled = celled.select(F.xxhash64("met", F.least("_x", "_y"), F.greatest("_x", "_y")).alias("cell"), "id", "fp", "class", "s")
        more = celled.repartition("cell").sortWithinPartitions("cell").mapInArrow(_settle(k, similarity), "a long, b long")
        root = materialize(components(root.toDF("a", "b").union(more)), "roots")
        forget(sets)
    rooted = firsts.select("id", "fp").join(root.toDF("id", "root"), "id", "left").select("fp", F.coalesce("root", "id").alias("root"))
    forget(links)
    return marked.join(rooted, "fp").select("key", "hash", "root")


def similar_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, k: int = WIDE_BITS, similarity: float = SIMILARITY, hot: int = HOT) -> DataFrame:
    """One row for each row of ``docs``: (key, component_id), for documents that share most of their shingles.

    64 bits tell only nearly equal texts from others; here fingerprints have ``64 * WORDS`` bits, and those that agree in
    a band meet in a bucket, are indexed in Gray order there and are candidates at ``k`` differing bits. Bands get wider
    with the corpus, crowded buckets are cut. Each bucket gives a spanning forest of its candidates; links within
    ``NEARER[0]`` bits stand. Where the others connect different classes, all texts of these are compared, in blocks that a
    task can hold, through the same index and by their exact shingle sets, so no link is lost to the forest. Sets of a few
    shingles are linked exactly beside that. Null or blank texts are alike; null keys belong to components but never name
    one; repeated rows stay; an empty table gives no rows.
    """
    rows = materialize(_classes(docs, text, key, width, k, similarity, hot), "rooted")
    named = rows.groupBy("root").agg(F.min("key").alias("component_id"))
    return rows.join(named, "root").select(F.col("key").alias(key), "component_id")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, k: int = WIDE_BITS, similarity: float = SIMILARITY, hot: int = HOT) -> DataFrame:
    """The rows of ``docs``, one of each component of ``similar_documents``: that with the smallest key (nulls last), and of
    rows that share it the one with the smallest hash of its text.

    Rows are told apart by key and text, so of rows that share a key only those go that are copies, and null keys are
    treated like others. Of rows alike in both, the first by their other columns stays. ``docs`` has no maps.
    """
    rows = materialize(_classes(docs, text, key, width, k, similarity, hot), "rooted")
    row = F.struct(F.col("key").isNull(), F.col("key").alias("key"), F.col("hash").alias("hash"))
    first = rows.groupBy("root").agg(F.min(row).alias("x"), F.count(F.lit(1)).alias("n")).select(F.col("x.key").alias("key"), F.col("x.hash").alias("hash"), "root", "n")
    first = materialize(first, "firsts")
    stay = (F.col("key").eqNullSafe(F.col("_key"))) & (F.col("hash") == F.col("_hash"))
    gone = rows.select(F.col("key").alias("_key"), F.col("hash").alias("_hash"), "root").join(first.filter("n > 1"), "root").filter(~stay).select("_key", "_hash").distinct()
    # Whole rows travel as one column, so that none of theirs is taken for one of these.
    hashed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_of"))
    same = F.col("_doc").eqNullSafe(F.col("_key")) & (F.col("_of") == F.col("_hash"))
    kept = hashed.join(gone, same, "left_anti")
    # Rows alike in key and text would all stay: one of them does.
    twice = materialize(rows.groupBy("key", "hash").count().filter("count > 1").select(F.col("key").alias("_key"), F.col("hash").alias("_hash")), "repeated")
    if not twice.isEmpty():
        others = [F.col("_row").getField(c) for c in docs.columns if c not in {text, key}]
        w = Window.partitionBy("_doc", "_of").orderBy(*others, F.col("_row").getField(text))
        firsts = kept.join(twice, same, "left_semi").withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")
        kept = kept.join(twice, same, "left_anti").unionByName(firsts)
    return kept.select("_row.*")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
