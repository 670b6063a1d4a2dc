"""Vector bin packing of token sequences.

Tokenising and packing happen in one pass over the documents, without a shuffle: each task keeps a window of waiting
documents and fills one sequence after the other. A sequence has limits on tokens, segments and loss-bearing tokens. The
next piece is the one whose demand vector (what of a waiting document the room holds) has the largest dot product with the
room that is left, both as shares of the limits; pieces are cut where a limit is reached. A sequence that can't be filled,
and what is left when a task ends, is cut back to a length that is a power of two, which needs no padding.

Loss is borne by what follows a document's prompt: a column of prompts, for instruction data, or else the first quarter of
the document's own ids, which is then context. ``END`` bears none.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE, SEGMENTS, LOSSES, END = 2048, 64, 1792, 1
#: Share of a document's ids that is context where it has no prompt.
CONTEXT = 0.25
#: Documents that wait at a time, their ids at most, and words whose ids a task keeps.
WINDOW, WINDOW_IDS, WORDS = 256, 1 << 21, 1_200_000


class WordTokenizer:
    """Token ids by ``tokenizers``, with the ids of words kept.

    The vocabulary's normaliser composes, makes blanks of white space and lower-cases; its splitter cuts a text into runs
    of letters, single digits, contractions and runs of other characters, and each is encoded for itself. So a text's ids
    are those of its parts. New parts are encoded together and told apart by the ids that end a part. Texts in which lower
    case or white space depend on more than one character are encoded as they are.
    """

    def __init__(self, path: str, most: int = WORDS):
        import json

        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"]["end_of_word_suffix"]
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(self.tokenizer.get_vocab_size())])
        self.part = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.ids: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn_parts(self, parts: list[str]) -> None:
        raw = self._encode(" ".join(parts))
        stops = np.flatnonzero(self.ends[np.frombuffer(raw, np.uint32)]) + 1
        if len(stops) != len(parts):
            self.ids.update((p, self._encode(p)) for p in parts)
            return
        at = 0
        for p, e in zip(parts, (4 * stops).tolist(), strict=True):
            self.ids[p] = raw[at:e]
            at = e

    def learn(self, words: set[str]) -> None:
        ids, cut, new = self.ids, {}, set()
        for w in words:
            if w.isalpha():
                new.add(w)
            elif "<|" in w:
                ids[w] = self._encode(w)
            else:
                cut[w] = parts = (w[:-1], w[-1]) if w[-1] in ".,;:!?" and w[:-1].isalpha() else self.part.findall(w)
                new.update(p for p in parts if p not in ids)
        if new:
            self._learn_parts(list(new))
        for w, parts in cut.items():
            ids[w] = b"".join([ids[p] for p in parts])

    def forget(self) -> None:
        """Keep the shorter words, which come again most often: less than half of all."""
        cut = sorted(map(len, self.ids))[len(self.ids) // 2]
        self.ids = {w: i for w, i in self.ids.items() if len(w) < cut}

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        text = text or ""
        if "\u03a3" in text or not text.isascii() and not is_normalized("NFC", text) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._encode(text)
        words = text.lower().split()
        if new := set(words).difference(self.ids):
            if len(self.ids) > self.most:
                self.forget()
                new = set(words).difference(self.ids)
            self.learn(new)
        return b"".join(map(self.ids.__getitem__, words))


@cache
def tokenizer(path: str, words: int = WORDS) -> WordTokenizer:
    """One for each worker process, so that tasks after the first find their words known."""
    return WordTokenizer(path, words)


class Packer:
    """Fills sequences from a window of waiting documents."""

    def __init__(self, first_id: int, tokens: int, segments: int, losses: int, window: int):
        self.limits, self.window, self.next_id = np.array([tokens, segments, losses], float), window, first_id
        self.rows: list[tuple] = []  # key, ids
        # Of each: ids in all, ids left, those of them ahead of the first that bears loss.
        self.whole, self.left, self.free = (np.zeros(0, np.int64) for _ in range(3))
        self.held = 0

    def add(self, key, ids: bytes, prompt: int) -> None:
        """``prompt``: how many of the ids, of which the last is END, bear no loss."""
        n = len(ids) // 4
        self.rows.append((key, ids))
        self.whole, self.left, self.free = (np.append(x, v) for x, v in ((self.whole, n), (self.left, n), (self.free, min(prompt, n - 1))))
        self.held += n

    def full(self) -> bool:
        return len(self.rows) >= self.window or self.held >= WINDOW_IDS

    def pick(self, tokens: int) -> list[tuple[int, int, int]]:
        """(document, ids, losses) of the pieces of one sequence of up to ``tokens`` ids; nothing is taken yet."""
        limits = self.limits.copy()
        limits[0] = tokens
        room, out = [tokens, int(limits[1]), int(limits[2])], []
        left, free = self.left.copy(), self.free.copy()
        last = left - 1  # END bears none
        while room[0] > 0 and room[1] > 0 and len(left):
            n = np.minimum(np.where(last - free <= room[2], left, free + room[2]), room[0])
            loss = np.maximum(np.minimum(n, last) - free, 0)
            # A piece is one segment whichever it is, so that share tells none apart.
            score = n * (room[0] / limits[0] ** 2) + loss * (room[2] / limits[2] ** 2)
            i = int(score.argmax())
            if n[i] <= 0:
                break
            got, lost = int(n[i]), int(loss[i])
            out.append((i, got, lost))
            room = [room[0] - got, room[1] - 1, room[2] - lost]
            left[i] -= got
            last[i] -= got
            free[i] = max(0, int(free[i]) - got)
        return out

    def sequence(self, tokens: int) -> list[tuple]:
        """One sequence of up to ``tokens`` ids: (key, start, ids, whole count, sequence, offset, losses) of each piece."""
        picks = self.pick(tokens)
        filled = sum(n for _, n, _ in picks)
        room = filled if filled == self.limits[0] else 1 << (filled.bit_length() - 1)
        out, offset = [], 0
        for i, n, _ in picks:
            n = min(n, room - offset)
            if n <= 0:
                break
            key, ids = self.rows[i]
            at = int(self.whole[i] - self.left[i])
            lost = max(0, min(n, int(self.left[i]) - 1) - int(self.free[i]))
            out.append((key, at, ids[4 * at : 4 * (at + n)], int(self.whole[i]), self.next_id, offset, lost))
            self.left[i] -= n
            self.free[i] = max(0, int(self.free[i]) - n)
            offset += n
        self.held -= offset
        stay = np.flatnonzero(self.left > 0)
        if len(stay) < len(self.rows):
            self.rows = [self.rows[i] for i in stay]
            self.whole, self.left, self.free = self.whole[stay], self.left[stay], self.free[stay]
        self.next_id += 1
        return out

    def drain(self, all_of_it: bool) -> Iterator[list[tuple]]:
        top = int(self.limits[0])
        while self.held >= top and (all_of_it or self.full()):
            yield self.sequence(top)
        while all_of_it and self.held:
            yield self.sequence(min(top, 1 << (self.held.bit_length() - 1)))


SCHEMA = "key string, start long, length long, ids_crc32 long, ids binary, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", prompt: str | None = None, tokens: int = SEQUENCE, segments: int = SEGMENTS, losses: int = LOSSES, context: float = CONTEXT, window: int = WINDOW, with_ids: bool = True, words: int = WORDS) -> DataFrame:
    """One row for each piece: (key, start, length, ids_crc32, ids, doc_tokens, sequence_id, offset, loss_tokens).

    A document's ids are those of its text (null: empty) and ``END``. ``prompt`` names a column of texts whose ids go
    before and bear no loss; without it (or where it is null) the first ``context`` of the text's ids bear none.
    ``END`` never does. ``tokens``, ``segments`` and ``losses`` limit each sequence. Every id is in exactly one piece, and
    a sequence has ``tokens`` ids or a power of two. ``sequence_id`` is the task's partition times 2**40 plus a count. A
    document longer than a sequence is cut; rows with null or repeated keys are packed each for itself; an empty table
    gives no rows. ``with_ids`` leaves the ids themselves out if false; ``words`` bounds those whose ids a worker keeps.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path, words)
        packer = Packer(TaskContext.get().partitionId() << 40, tokens, segments, losses, window)
        end = array("I", [END]).tobytes()
        ready: list[tuple] = []

        def rows() -> pa.RecordBatch:
            keys, start, ids, whole, seq, offset, lost = (list(x) for x in zip(*ready, strict=True))
            cols = [pa.array(keys, pa.string()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids if with_ids else [None] * len(ids), pa.binary()), *(pa.array(x, pa.int64()) for x in (whole, seq, offset, lost))]
            ready.clear()
            return pa.RecordBatch.from_arrays(cols, names=["key", "start", "length", "ids_crc32", "ids", "doc_tokens", "sequence_id", "offset", "loss_tokens"])

        for batch in batches:
            for k, t, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                ids = tok.encode(t.as_py())
                before = tok.encode(asked.as_py()) if asked.is_valid else None
                packer.add(k, ids + end if before is None else before + ids + end, int(len(ids) // 4 * context) if before is None else len(before) // 4)
                if packer.full():
                    for pieces in packer.drain(False):
                        ready += pieces
                    if len(ready) >= 4096:
                        yield rows()
        for pieces in packer.drain(True):
            ready += pieces
            if len(ready) >= 4096:
                yield rows()
        if ready:
            yield rows()

    asked = F.lit(None).cast("string") if prompt is None else F.col(prompt)
    out = docs.select(F.col(key).cast("string"), F.col(text), asked.alias("_prompt")).mapInArrow(run, SCHEMA)
    return out.select(F.col("key").cast(kind).alias(key), *(c for c in out.columns if c != "key" and (with_ids or c != "ids")))
