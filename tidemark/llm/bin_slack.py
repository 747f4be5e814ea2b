"""Packing by minimum bin slack: a subset-sum over bitsets fills each sequence.

A document is its ids and an end id. Whole sequences are cut off first; what remains of every
document is shorter than a sequence and goes to a pool. For each sequence the longest
remainder is set, and a dynamic programme over the multiset of remaining lengths finds the
sums that fit: bit s of an integer says that s tokens can be filled. The highest bit is the
fill with the least slack, and walking back through the integers gives how many of each length
make it up. If slack is left, that many tokens are cut from another remainder. The last
tokens of a task, fewer than a sequence, are cut at powers of two, so they need no padding.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow
from .tokens import token_ids

CAPACITY = 1024
# Remainders that wait in a task: at most 4096 x 1023 ids of 4 bytes.
POOL_ITEMS = 4096
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


@dataclass(frozen=True)
class Piece:
    doc_id: int | None
    start: int
    doc_tokens: int
    ids: np.ndarray

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc_id, self.start, self.doc_tokens, self.ids[:n]),
            Piece(self.doc_id, self.start + n, self.doc_tokens, self.ids[n:]),
        )


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as near to `room` as can be.

    `counts`: length -> how many there are. Among equal sums the longer lengths come first.
    """
    mask = (1 << room + 1) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        before, left, batch = reach, counts[length], 1
        while left:  # 1, 2, 4, ... copies at a time reach every number of copies
            take = min(batch, left)
            grown = reach | reach << length * take & mask
            if grown == reach:
                break
            reach, left, batch = grown, left - take, batch * 2
        steps.append((length, before))
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> at & 1:
            at -= length
            n += 1
        if n:
            taken[length] = n
    return taken


class Pool:
    """Remainders by length."""

    def __init__(self):
        self.items: dict[int, list[Piece]] = defaultdict(list)
        self.counts: dict[int, int] = {}
        self.tokens = 0
        self.size = 0

    def put(self, piece: Piece) -> None:
        n = len(piece.ids)
        if n:
            self.items[n].append(piece)
            self.counts[n] = self.counts.get(n, 0) + 1
            self.tokens += n
            self.size += 1

    def take(self, n: int) -> Piece:
        self.counts[n] -= 1
        if not self.counts[n]:
            del self.counts[n]
        self.tokens -= n
        self.size -= 1
        return self.items[n].pop()

    def sequence(self, capacity: int) -> list[Piece]:
        """One full sequence; there must be `capacity` tokens in the pool."""
        first = self.take(max(self.counts))
        chosen, room = [first], capacity - len(first.ids)
        for length, n in best_fill(self.counts, room).items():
            for _ in range(n):
                chosen.append(self.take(length))
                room -= length
        if room:  # every remainder left is longer than the slack
            head, rest = self.take(min(self.counts)).cut(room)
            chosen.append(head)
            self.put(rest)
        return chosen

    def last_sequences(self) -> Iterator[list[Piece]]:
        """What is left, cut at powers of two, the largest first."""
        waiting = [p for n in sorted(self.items, reverse=True) for p in self.items[n]]
        size = 1 << max(self.tokens.bit_length() - 1, 0)
        while waiting:
            if self.tokens & size:
                chosen, room = [], size
                while room:
                    piece = waiting.pop(0)
                    head, rest = piece.cut(min(room, len(piece.ids)))
                    chosen.append(head)
                    room -= len(head.ids)
                    if len(rest.ids):
                        waiting.insert(0, rest)
                yield chosen
            size >>= 1


def sequences(
    documents: Iterator[tuple[int | None, np.ndarray]], capacity: int, pool_items: int
) -> Iterator[list[Piece]]:
    """Pack (id, token ids) pairs; every id of every document is in exactly one piece."""
    pool = Pool()
    for doc_id, ids in documents:
        piece = Piece(doc_id, 0, len(ids), ids)
        while len(piece.ids) >= capacity:
            head, piece = piece.cut(capacity)
            yield [head]
        # a copy, so that the pool does not keep whole documents
        pool.put(Piece(doc_id, piece.start, piece.doc_tokens, piece.ids.copy()))
        if pool.size >= pool_items:
            while pool.size > pool_items // 2 and pool.tokens >= capacity:
                yield pool.sequence(capacity)
    while pool.tokens >= capacity:
        yield pool.sequence(capacity)
    yield from pool.last_sequences()


def pack_bin_slack(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    capacity: int = CAPACITY, end_id: int = 0, vocabulary: str | None = None,
    pool_items: int = POOL_ITEMS,
) -> DataFrame:
    """One row per piece of a document: where its ids are in the document and in which sequence.

    `capacity` must be a power of two. Each partition of `docs` packs its own documents;
    sequence ids carry the partition's number, so they are unique without a shuffle, and a task
    that runs again gives the same rows. A null text counts as empty (the end id alone), ids
    may be null or repeated (each row is a document of its own), an empty table gives no rows,
    other columns are not read. Sequences are full or have a power of two of ids.
    """
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches):
        first = TaskContext.get().partitionId() << 40
        rows = []

        def documents():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = token_ids(text.as_py() or "", vocabulary)
                    yield doc_id, np.append(ids, np.uint32(end_id))

        def flushed():
            columns = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for number, pieces in enumerate(sequences(documents(), capacity, pool_items)):
            offset = 0
            for p in pieces:
                rows.append((p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4")),
                             p.doc_tokens, first + number, offset))
                offset += len(p.ids)
            if len(rows) >= 10_000:
                yield flushed()
                rows.clear()
        if rows:
            yield flushed()

    return in_arrow(docs.select(
        F.col(id_column).cast("long").alias("_id"), F.col(text_column).alias("_text")
    ), run, PIECES)
