"""How the tokens of two tokenizers lie on each other, and how often which ids meet.

Tokens A are those of a space and the text by a byte-level BPE, tokens B those of the text by a
sentencepiece model, which puts a space in front itself. Both cover the same bytes. Two tokens that
share a byte are linked; where tokens of both end at the same byte, a group ends.

The number of documents that hold an id pair linked is counted for the whole corpus in these steps:

1. Every task aligns its documents and writes the distinct pairs it has seen with their number of
   documents, in the order of the pairs' hashes.
2. The distinct pairs are dealt into shards by ranges of the hash; every shard gets a minimal perfect
   hash function, stored with its keys in the shared folder.
3. Each task's pairs become dense vectors, one a shard, indexed by the function's numbers (the stored
   key must be the pair). The vectors are added up as a tree.
4. A second pass aligns the documents again and looks the counts up, shard by shard.

A shard has about SHARD_PAIRS pairs. Tasks hold a bounded number of shards at a time, and
only a shard's path and the highest count of every A id pass the driver; the vocabulary bounds both.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .perfect_hash import PerfectHash
from .pieces import SPACE, piece_bytes, piece_ids, word_starts
from .shared import blocks, in_arrow
from .stored import new_name, read_arrays, scratch_folder, write_arrays
from .tokens import token_bytes, token_ids
from .words import mix

SHARD_PAIRS = 1 << 16
# Distinct pairs that a task gathers before it writes them, and code points whose new words are
# looked up together.
HELD_PAIRS, LOOKUP_CHARS = 1 << 20, 1 << 18
# Words whose alignments a task keeps, and links of them.
KEPT_WORDS, KEPT_LINKS = 1 << 18, 1 << 21
# Vectors that one task adds up, and bytes of shards that a worker keeps.
FAN_IN, KEPT_BYTES = 16, 64 << 20
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
          "count_sum long, groups string")


@dataclass(frozen=True)
class Vocabularies:
    """Paths of the two vocabulary files; None is the public one of the machine."""

    a: str | None = None
    b: str | None = None


@lru_cache(maxsize=2)
def _tables(v: Vocabularies) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Bytes a token of A and B has; decimal texts of ids with each separator; number of B ids."""
    a, b = token_bytes(v.a), piece_bytes(v.b)
    most = max(len(a), len(b))
    width = len(str(most)) + 1
    texts = [f"{i}{sep}".encode().ljust(width, b"\0") for i in range(most) for sep in ",|;"]
    written = np.frombuffer(b"".join(texts), np.uint8).reshape(-1, width)
    return (np.array([len(x) for x in a]), np.array([len(x) for x in b]), written, len(b))


def _encoded(text: str, v: Vocabularies) -> tuple[np.ndarray, np.ndarray, int] | None:
    """Ids A, ids B and the number of bytes; None if either does not give the bytes back."""
    raw = (" " + text).encode()
    a, b = token_ids(" " + text, v.a, special=False), piece_ids(text, v.b)
    bytes_a, bytes_b = token_bytes(v.a), piece_bytes(v.b)
    if b"".join([bytes_b[i] for i in b]) != raw or b"".join(
            [bytes_a[i] for i in a.tolist()]) != raw:
        return None
    return a.astype(np.int64), np.array(b, np.int64), len(raw)


def _all_encoded(words: list[str], v: Vocabularies) -> tuple[np.ndarray, ...]:
    """Of all words: has tokens, ids A, ids B; and of those with tokens: numbers of A, B, bytes.

    Words that can follow each other in a text are encoded as one, the others one by one.
    """
    joined = " ".join(words)
    if word_starts(joined, v.b) == words and (whole := _encoded(joined, v)):
        a, b, _ = whole
        size_a, size_b, _, _ = _tables(v)
        sizes = np.array([len(w.encode()) + 1 for w in words])
        stops = np.cumsum(sizes)
        # both have a token's end at the end of every word
        n_a, n_b = (np.diff(np.searchsorted(np.cumsum(size), stops) + 1, prepend=0)
                    for size in (size_a[a], size_b[b]))
        return np.ones(len(words), bool), a, b, n_a, n_b, sizes
    found = [_encoded(word, v) for word in words]
    kept = [f for f in found if f is not None]
    a, b = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in kept)]) for i in (0, 1))
    n_a, n_b = (np.array([len(f[i]) for f in kept], np.int64) for i in (0, 1))
    sizes = np.array([f[2] for f in kept], np.int64)
    return np.array([f is not None for f in found], bool), a, b, n_a, n_b, sizes


class Aligned:
    """The alignment of some texts: arrays over all their tokens, links and groups."""

    def __init__(self, texts: list[str], v: Vocabularies):
        self.v, self.size = v, len(texts)
        size_a, size_b, _, n_b_ids = _tables(v)
        self.has, self.a, self.b, self.n_a, self.n_b, sizes = _all_encoded(texts, v)
        stops = np.cumsum(sizes)
        # ends as marks on the bytes: a token is found by the number of ends before it
        marks = np.zeros((2, int(sizes.sum()) + 1), bool)
        self.end_a, self.end_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        marks[0, self.end_a] = marks[1, self.end_b] = True
        both = marks[0] & marks[1]
        # Every stretch between two ends lies in one token of each side, and two tokens share
        # at most one such stretch: the stretches are the links.
        ends = np.flatnonzero(marks[0] | marks[1])
        at_a = (np.cumsum(marks[0]) - marks[0])[ends]
        at_b = (np.cumsum(marks[1]) - marks[1])[ends]
        self.pairs = self.a[at_a] * n_b_ids + self.b[at_b]
        self.link_a = self.a[at_a]
        self.n_links = np.diff(np.searchsorted(ends, stops, "right"), prepend=0)
        self.link_doc = np.repeat(np.arange(len(sizes)), self.n_links)
        before = np.cumsum(both) - both
        self.group_a, self.group_b = before[self.end_a], before[self.end_b]
        self.n_groups = np.diff(np.cumsum(both)[stops], prepend=0)

    def groups(self) -> list[str]:
        """Each text's groups as written digits and separators; empty without tokens."""
        written = _tables(self.v)[2]
        last_a = np.append(np.diff(self.group_a) > 0, True)[: len(self.a)]
        last_b = np.append(np.diff(self.group_b) > 0, True)[: len(self.b)]
        place_a = np.arange(len(self.a)) + np.searchsorted(self.group_b, self.group_a, "left")
        place_b = np.arange(len(self.b)) + np.searchsorted(self.group_a, self.group_b, "right")
        rows = np.zeros(len(self.a) + len(self.b), np.int64)
        rows[place_a] = 3 * self.a + last_a
        rows[place_b] = 3 * self.b + 2 * last_b
        cells = written[rows]
        shown = cells != 0
        text = cells[shown].tobytes().decode("ascii")
        stops = np.cumsum(shown.sum(1))[np.cumsum(self.n_a + self.n_b) - 1].tolist()
        # without the separator behind the last group
        of_kept = iter(text[start: stop - 1] for start, stop in zip([0, *stops], stops))
        return [next(of_kept) if has else "" for has in self.has]

    def per_text(self, kept: np.ndarray) -> np.ndarray:
        """Numbers of the texts with tokens, 0 for the others."""
        spread = np.zeros(self.size, np.int64)
        spread[self.has] = kept
        return spread

    def sums(self, of_links: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(of_links, dtype=np.int64)])
        stops = np.cumsum(self.n_links)
        return running[stops] - running[stops - self.n_links]


class Words:
    """Alignments of words, each known by a number while it is kept.

    Both tokenizers begin a token at a space that follows something else (`word_starts`), so a text's
    alignment is that of its words one after the other, and a word that was seen before costs a
    lookup. The words used most are kept when there are too many.
    """

    NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

    def __init__(self, v: Vocabularies, values=None):
        """`values(pairs, ids of A)`: two numbers for each link, that n_best and count_sum add up."""
        self.v, self.values = v, values
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.table = np.zeros((len(self.NUMBERS), 1024), np.int64)
        self.has = np.zeros(1024, bool)
        self.uses = np.zeros(1024, np.int64)
        # distinct pairs of the words, one word after the other
        self.pairs, self.stops = np.zeros(1024, np.int64), np.zeros(1025, np.int64)

    def _add(self, words: list[str]) -> None:
        found, n = Aligned(words, self.v), len(self.groups)
        zeros = np.zeros(len(found.pairs), np.int64)
        best, count = self.values(found.pairs, found.link_a) if self.values else (zeros, zeros)
        new = np.array([found.per_text(x) for x in (
            found.n_a, found.n_b, found.n_groups, found.n_links, found.sums(best),
            found.sums(count))])
        while n + len(words) > len(self.has):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
            self.has, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (
                self.has, self.uses))
            self.stops = np.concatenate([self.stops, np.zeros(len(self.stops) - 1, np.int64)])
        self.table[:, n: n + len(words)] = new
        self.has[n: n + len(words)] = found.has
        word = np.flatnonzero(found.has)[found.link_doc]
        size = len(_tables(self.v)[0]) * _tables(self.v)[3]
        distinct = np.unique(word * size + found.pairs)
        at = int(self.stops[n])
        while at + len(distinct) > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
        self.pairs[at: at + len(distinct)] = distinct % size
        self.stops[n + 1: n + 1 + len(words)] = at + np.searchsorted(
            distinct // size, np.arange(len(words)), "right")
        self.groups += found.groups()
        self.number.update(zip(words, range(n, n + len(words))))

    def of(self, words: list[str]) -> np.ndarray:
        """The numbers of the words; they hold until the next call."""
        if len(self.groups) > KEPT_WORDS or self.stops[len(self.groups)] > KEPT_LINKS:
            self._forget()
        look_up = self.number.get
        found = np.array([look_up(w, -1) for w in words], np.int64)
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            new = list(dict.fromkeys(words[i] for i in missing))
            # only the last word of a text can end so; it would swallow the start of the next
            odd = {w for w in new if w[-1].isspace() or SPACE in w}
            for some in ([w for w in new if w not in odd], list(odd)):
                if some:
                    self._add(some)
            found[missing] = [self.number[words[i]] for i in missing]
        np.add.at(self.uses, found, 1)
        return found

    def _forget(self) -> None:
        n = len(self.groups)
        uses, links = self.uses[:n], np.diff(self.stops[: n + 1])
        order = np.argsort(-uses, kind="stable")
        keep = order[(np.cumsum(links[order]) <= KEPT_LINKS // 2) & (uses[order] > 1)]
        keep = np.sort(keep[: KEPT_WORDS // 2])
        names = list(self.number)
        kept = self.__class__(self.v, self.values)
        kept.number = {names[i]: at for at, i in enumerate(keep.tolist())}
        kept.groups = [self.groups[i] for i in keep.tolist()]
        room = 1 << max(10, len(keep).bit_length())
        kept.table = np.zeros((len(self.NUMBERS), room), np.int64)
        kept.table[:, : len(keep)] = self.table[:, keep]
        kept.has, kept.uses = np.zeros(room, bool), np.zeros(room, np.int64)
        kept.has[: len(keep)] = self.has[keep]
        kept.pairs = self.pairs_of(keep)
        kept.pairs = np.concatenate([kept.pairs, np.zeros(1024, np.int64)])
        kept.stops = np.zeros(room + 1, np.int64)
        kept.stops[1: len(keep) + 1] = np.cumsum(links[keep])
        self.__dict__ = kept.__dict__

    def pairs_of(self, numbers: np.ndarray) -> np.ndarray:
        starts, stops = self.stops[numbers], self.stops[numbers + 1]
        n = stops - starts
        return self.pairs[np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n)]


class Texts:
    """The words of a block of texts, and which text each is of."""

    def __init__(self, texts: list[str], words: Words):
        split = [word_starts(t, words.v.b) if t else [] for t in texts]
        self.words, self.n = words, np.array([len(w) for w in split], np.int64)
        self.numbers = words.of([w for of in split for w in of])
        self.text = np.repeat(np.arange(len(texts)), self.n)
        # one word that does not give its bytes back leaves the whole text without tokens
        bad = np.bincount(self.text[~words.has[self.numbers]], minlength=len(texts)) > 0
        self.has = (self.n > 0) & ~bad

    def distinct_pairs(self) -> np.ndarray:
        """Every text's distinct pairs, one text after the other."""
        size = len(_tables(self.words.v)[0]) * _tables(self.words.v)[3]
        n = len(self.words.groups)
        used = self.has[self.text]
        once = np.unique(self.text[used] * n + self.numbers[used])
        text, number = once // n, once % n
        links = self.words.stops[number + 1] - self.words.stops[number]
        return np.unique(np.repeat(text, links) * size + self.words.pairs_of(number)) % size

    def sums(self) -> np.ndarray:
        """The words' numbers added up for each text; 0 for texts without tokens."""
        running = np.zeros((len(Words.NUMBERS), len(self.numbers) + 1), np.int64)
        np.cumsum(self.words.table[:, self.numbers], axis=1, out=running[:, 1:])
        stops = np.cumsum(self.n)
        return (running[:, stops] - running[:, stops - self.n]) * self.has

    def groups(self) -> list[str]:
        """Each text's groups as `a1,a2|b1;a3|b2`; empty without tokens."""
        written, numbers = self.words.groups, self.numbers.tolist()
        stops = np.cumsum(self.n).tolist()
        return [";".join([written[i] for i in numbers[start: stop]]) if has else ""
                for has, start, stop in zip(self.has, [0, *stops], stops)]


def _hashes(pairs: np.ndarray) -> np.ndarray:
    """A pair's hash as a 31-bit number, whose ranges are the shards."""
    return (mix(pairs.astype(np.uint64)) >> np.uint64(33)).astype(np.int64)


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes * shards) >> 31


def seen_pairs(docs: DataFrame, text_column: str, v: Vocabularies) -> DataFrame:
    """(part, hash, pair, n): in how many of a part's documents a pair is, ordered by hash.

    A part is what one task has gathered before it writes; a pair is in many parts.
    """
    def run(batches):
        def part(held):
            pairs = np.concatenate([p for p, _ in held])
            distinct, inverse = np.unique(pairs, return_inverse=True)
            n = np.zeros(len(distinct), np.int64)
            np.add.at(n, inverse, np.concatenate([c for _, c in held]))
            return distinct, n

        def rows(held):
            pairs, n = part(held)
            hashes = _hashes(pairs)
            order = np.argsort(hashes, kind="stable")
            place = np.full(len(pairs), TaskContext.get().partitionId(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (place, hashes[order], pairs[order], n[order])],
                ["part", "hash", "pair", "n"])

        held, size, words = [], 0, Words(v)
        for batch in batches:
            for _, texts in blocks(batch.column(0)):
                held.append(np.unique(Texts(texts, words).distinct_pairs(), return_counts=True))
                size += len(held[-1][0])
                if size >= HELD_PAIRS:
                    held = [part(held)]
                    size = len(held[0][0])
                    if size >= HELD_PAIRS // 2:
                        yield from rows(held)
                        held, size = [], 0
        if held:
            yield from rows(held)

    return in_arrow(docs.select(F.col(text_column).alias("_text")), run,
                    "part long, hash long, pair long, n long")


@dataclass(frozen=True)
class PairCounts:
    """Counts of all pairs: a file for each shard, and every A id's highest count."""

    shards: int
    paths: dict[int, str]
    best: np.ndarray
    folder: str


def count_pairs(
    docs: DataFrame, text_column: str = "text", v: Vocabularies = Vocabularies(),
    shard_pairs: int = SHARD_PAIRS, fan_in: int = FAN_IN,
) -> PairCounts:
    """In how many documents every id pair is linked; the counts lie in the shared folder.

    A null or empty text has no pairs; an empty table has no shards.
    """
    spark = docs.sparkSession
    folder = scratch_folder(spark, "pairs")
    seen_pairs(docs, text_column, v).write.parquet(f"{folder}/seen")
    seen = spark.read.parquet(f"{folder}/seen")
    seen.select("hash", "pair").distinct().write.parquet(f"{folder}/distinct")
    distinct = spark.read.parquet(f"{folder}/distinct")
    shards = max(1, -(-distinct.count() // shard_pairs))
    shard = F.shiftright(F.col("hash") * shards, 31)

    def functions(batches):
        # a shard's pairs come together, as the partition is sorted by shard
        for number, keys in _runs(batches, "shard", "pair"):
            found = PerfectHash.of(keys.astype(np.uint64))
            path = new_name(folder, f"function-{number}.npz")
            write_arrays(path, sizes=found.sizes, bits=found.bits, keys=found.keys)
            yield pa.RecordBatch.from_pydict({"shard": [number], "path": [path]})

    dealt = distinct.select(shard.alias("shard"), "pair").repartition("shard")
    paths = dict(in_arrow(
        dealt.sortWithinPartitions("shard"), functions, "shard long, path string").collect())

    def vectors(batches):
        place = TaskContext.get().partitionId()
        table = pa.schema([("shard", pa.int64()), ("node", pa.int64()), ("vector", pa.binary())])
        for number, (pairs, n) in _runs(batches, "shard", "pair", "n"):
            function = _function(paths[number])
            numbers = function.numbers(pairs.astype(np.uint64))
            if (numbers < 0).any():
                raise RuntimeError("a pair is missing from its shard")
            vector = np.zeros(len(function.keys), np.int64)
            np.add.at(vector, numbers, n)
            yield pa.RecordBatch.from_pydict(
                {"shard": [number], "node": [place], "vector": [vector.tobytes()]}, schema=table)

    def added(batches):
        # The vectors of a node come one after the other; one sum is held.
        key, total = None, None
        for batch in batches:
            for number, node, vector in zip(*(batch.column(i) for i in range(3))):
                found = (number.as_py(), node.as_py())
                if key is not None and found != key:
                    yield _sum_row(key, total)
                    total = None
                key = found
                value = np.frombuffer(vector.as_buffer(), np.int64)
                total = value.copy() if total is None else total + value
        if key is not None:
            yield _sum_row(key, total)

    sums = in_arrow(seen.select(shard.alias("shard"), "pair", "n"), vectors,
                    "shard long, node long, vector binary")
    nodes = max(1, seen.rdd.getNumPartitions())
    while nodes > 1:
        nodes = -(-nodes // fan_in)
        level = sums.withColumn("node", F.floor(F.col("node") / fan_in))
        sums = in_arrow(
            level.repartition("shard", "node").sortWithinPartitions("shard", "node"), added,
            "shard long, node long, vector binary")
    # also adds up the vectors of one task that wrote several parts
    sums = in_arrow(sums.repartition("shard").sortWithinPartitions("shard", "node"), added,
                    "shard long, node long, vector binary")
    _, _, _, n_b_ids = _tables(v)

    def stored(batches):
        for batch in batches:
            for number, vector in zip(batch.column(0).to_pylist(), batch.column(2)):
                counts = np.frombuffer(vector.as_buffer(), np.int64)
                arrays = read_arrays(paths[number])
                path = new_name(folder, f"counts-{number}.npz")
                write_arrays(path, counts=counts, **arrays)
                ids = (arrays["keys"] // np.uint64(n_b_ids)).astype(np.int64)
                found, inverse = np.unique(ids, return_inverse=True)
                highest = np.zeros(len(found), np.int64)
                np.maximum.at(highest, inverse, counts)
                yield pa.RecordBatch.from_pydict({
                    "shard": [number], "path": [path], "ids": [found.tolist()],
                    "highest": [highest.tolist()]})

    in_arrow(sums, stored, "shard long, path string, ids array<long>, highest array<long>"
             ).write.parquet(f"{folder}/counted")
    counted = spark.read.parquet(f"{folder}/counted")
    best = np.zeros(len(token_bytes(v.a)), np.int64)
    rows = counted.select(F.explode(F.arrays_zip("ids", "highest")).alias("x")).groupBy(
        "x.ids").agg(F.max("x.highest").alias("highest")).collect()
    for row in rows:
        best[row["ids"]] = row["highest"]
    return PairCounts(shards, dict(counted.select("shard", "path").collect()), best, folder)


def _sum_row(key: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"shard": [key[0]], "node": [key[1]], "vector": [total.tobytes()]},
        schema=pa.schema([("shard", pa.int64()), ("node", pa.int64()), ("vector", pa.binary())]))


def _runs(batches, key: str, *columns: str):
    """(key, arrays) of consecutive rows with equal keys, across batches."""
    now, held = None, []

    def whole():
        arrays = [np.concatenate(parts) for parts in zip(*held)]
        return now, arrays[0] if len(columns) == 1 else arrays

    for batch in batches:
        keys = batch.column(key).to_numpy()
        if not len(keys):
            continue
        values = [batch.column(c).to_numpy() for c in columns]
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for start, stop in zip(cuts, cuts[1:]):
            if held and keys[start] != now:
                yield whole()
                held = []
            now = int(keys[start])
            held.append([x[start:stop] for x in values])
    if held:
        yield whole()


_kept: OrderedDict[str, tuple] = OrderedDict()


def _loaded(path: str) -> tuple[PerfectHash, np.ndarray | None]:
    """A shard's function and counts; the worker keeps those it used last."""
    if path in _kept:
        _kept.move_to_end(path)
        return _kept[path][0]
    arrays = read_arrays(path)
    function = PerfectHash(arrays["sizes"], arrays["bits"], arrays["keys"])
    found = function, arrays.get("counts")
    _kept[path] = found, sum(x.nbytes for x in arrays.values()) + 9 * int(arrays["sizes"].sum())
    while len(_kept) > 1 and sum(size for _, size in _kept.values()) > KEPT_BYTES:
        _kept.popitem(last=False)
    return found


def _function(path: str) -> PerfectHash:
    return _loaded(path)[0]


def _looked_up(pairs: np.ndarray, counts: PairCounts) -> np.ndarray:
    """The count of each pair, by one visit to every shard that holds some."""
    distinct, inverse = np.unique(pairs, return_inverse=True)
    shard = _shard_of(_hashes(distinct), counts.shards)
    order = np.argsort(shard, kind="stable")
    found = np.zeros(len(distinct), np.int64)
    for rows in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
        path = counts.paths.get(int(shard[rows[0]]))
        if path is None:
            continue
        function, of_shard = _loaded(path)
        numbers = function.numbers(distinct[rows].astype(np.uint64))
        found[rows] = np.where(numbers >= 0, of_shard[numbers], 0)
    return found[inverse]


def align(
    docs: DataFrame, counts: PairCounts, id_column: str = "doc_id", text_column: str = "text",
    v: Vocabularies = Vocabularies(),
) -> DataFrame:
    """One row per document: numbers of tokens, groups and links, and what the links count.

    doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has the highest count of its A id,
    ties included), count_sum (over the links) and groups, written as `a1,a2|b1;a3|b2,b3`. Null and
    empty texts, and those whose tokens do not give the bytes of a space and the text back (U+2581
    in a text becomes a space), have no tokens: zeros and an empty text. Pairs that `counts`
    has not seen count 0. Every row has a row of its own, repeated ones and null ids too; other
    columns are not read.
    """
    def values(pairs, ids):
        n = _looked_up(pairs, counts)
        return (n == counts.best[ids]) & (n > 0), n

    def run(batches):
        words = Words(v, values)
        for batch in batches:
            ids = batch.column(0)
            for first, texts in blocks(batch.column(1), LOOKUP_CHARS):
                found = Texts(texts, words)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(texts)), *map(pa.array, found.sums()),
                     pa.array(found.groups(), pa.string())],
                    [c.split()[0] for c in RESULT.split(", ")])

    return in_arrow(docs.select(
        F.col(id_column).cast("long").alias("_id"), F.col(text_column).alias("_text")), run, RESULT)


def align_corpus(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    v: Vocabularies = Vocabularies(),
) -> DataFrame:
    """`align` with the counts of the documents themselves."""
    return align(docs, count_pairs(docs, text_column, v), id_column, text_column, v)
