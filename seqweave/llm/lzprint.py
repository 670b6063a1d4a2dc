"""Lempel-Ziv phrase fingerprints.

A document is parsed as in LZ78: the next phrase is the longest known phrase and one symbol more, and is then known too.
Symbols are words; a word of over 24 characters is read character by character, so texts without blanks get phrases as
well. The phrase set is hashed, and a signature of minimum hashes estimates the Jaccard likeness of two sets, which for
such sets behaves like the likeness that a shared compressor finds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Minimum hashes of a signature.
SIZE = 128
LONG_WORD = 24
CHUNK = 2048
_draw = np.random.RandomState(20_011)
_A = (_draw.randint(0, 1 << 62, SIZE).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _draw.randint(0, 1 << 62, SIZE).astype(np.uint64)


def extended(phrase: int, symbol: str) -> int:
    """The hash of a phrase (0: none) and one symbol more, which stands for the phrase."""
    return xxhash.xxh3_64_intdigest(symbol.encode("utf-8", "surrogatepass"), phrase)


def phrases(text: str) -> dict[int, None]:
    """The dictionary of the parse, in order, as hashes; a rest that is a known phrase adds nothing new."""
    known: dict[int, None] = {}
    now = 0
    for word in text.split():
        for symbol in (word,) if len(word) <= LONG_WORD else word:
            now = extended(now, symbol)
            if now not in known:
                known[now] = None
                now = 0
    return known


def signature(text: str | None) -> np.ndarray:
    """The low 16 bits of ``SIZE`` minimum hashes of 32 bits; all ones without phrases."""
    known = phrases(text or "")
    out = np.full(SIZE, 0xFFFFFFFF, np.uint32)
    if known:
        hashes = np.fromiter(known, np.uint64, len(known))
        for i in range(0, len(hashes), CHUNK):
            mixed = (hashes[i : i + CHUNK, None] * _A + _B) >> np.uint64(32)
            out = np.minimum(out, mixed.min(axis=0).astype(np.uint32))
    return out.astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal minimum hashes."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many characters (or all) of the beginning of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _pack(sig: np.ndarray) -> bytes:
    return sig.astype(">u2").tobytes()


def _unpack(sig: bytes) -> np.ndarray:
    return np.frombuffer(sig, ">u2")


def _compare(text: str, sig: np.ndarray, after: str, after_sig: np.ndarray) -> tuple:
    """What is known of a document once the one after it is: edited_sha256, edited_fingerprint, near_edited, near_next."""
    changed = edited(text, after)
    changed_sig = sig if changed == text else signature(changed)
    return hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest(), _pack(changed_sig), likeness(sig, changed_sig), likeness(sig, after_sig)


SCHEMA = "key string, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, part int, text string, head boolean"
_TYPES = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.bool_()]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document but the partition's last; the first (head) and the last come with their texts."""
    part, before, out, held = TaskContext.get().partitionId(), None, [], 0

    def flush() -> pa.RecordBatch:
        cols = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), _TYPES, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            sig = signature(text)
            if before is None:
                out.append((None, None, None, _pack(sig), None, None, None, part, text, True))
            else:
                k, t, s = before
                out.append((k, len(t), *_row(t, s, text, sig), None, None, False))
            before = key, text, sig
            if len(out) >= 1024:
                yield flush()
    if before is not None:
        k, t, s = before
        out.append((k, len(t), None, _pack(s), None, None, None, part, t, False))
        yield flush()


def _row(text: str, sig: np.ndarray, after: str, after_sig: np.ndarray) -> tuple:
    sha, changed, near_edited, near_next = _compare(text, sig, after, after_sig)
    return sha, _pack(sig), changed, near_edited, near_next


def _join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for batch in batches:
        rows = [(k, n, *_row(t, _unpack(s), after, _unpack(after_s))) for k, n, t, s, after, after_s in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), _TYPES, strict=False)], names=names)


def fingerprint_with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each document.

    The next document is that of the next smaller key; null keys come last, rows with equal keys follow the hashes of their
    texts, and after the last document comes the first. A null text counts as empty. A single document follows itself; an
    empty table gives no rows. Two texts without phrases have likeness 1.

    The texts are range-partitioned once, by key, hash and (of rows alike) place in the table, so no key is too frequent
    for a partition. Within a partition documents follow each other; a partition's last
    document meets the first of the next partition in a second step over two rows for each partition.
    """
    kind = docs.schema[key].dataType.simpleString()
    order = [F.col("_key").desc_nulls_last(), F.col("_hash"), F.col("_at")]
    placed = docs.select(F.col(key).alias("_key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_hash"), F.monotonically_increasing_id().alias("_at"), F.col(text).alias("_text"))
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("_key").cast("string"), F.col("_text"))
    rows = materialize(ranged.mapInArrow(_run, SCHEMA), "phrases")
    names = rows.columns[:7]
    whole = rows.filter("edited_sha256 is not null").select(names)
    heads = rows.filter("head").select("part", F.col("text").alias("after"), F.col("fingerprint").alias("after_sig"))
    # One row for each partition: which partition with rows comes next.
    w = Window.orderBy("part")
    ring = heads.select("part").withColumn("next", F.coalesce(F.lead("part").over(w), F.min("part").over(Window.partitionBy(F.lit(0)))))
    lasts = rows.filter("not head and edited_sha256 is null").select("part", *names, "text")
    met = lasts.join(ring, "part").join(heads.withColumnRenamed("part", "next"), "next").select("key", "n_chars", "text", "fingerprint", "after", "after_sig")
    ends = met.mapInArrow(_join_ends, ", ".join(SCHEMA.split(", ")[:7]))
    out = whole.unionByName(ends)
    return out.select(F.col("key").cast(kind).alias(key), *(F.lower(F.hex(c)).alias(c) if t == "binary" else F.col(c) for c, t in out.dtypes[1:]))
