"""Token-id output: best-fit-decreasing packing, open sequences found in a segment tree.

Documents are tokenised, ended with the end-of-text id and, where they are longer than a row
of the matrix, split losslessly. A task collects pieces up to a bound of tokens, sorts
them by decreasing length and puts each into the open row with the least room that is
enough. The segment tree's leaves are the amounts of room; a node says if any row below
it is open, so the search takes log2(row length) steps, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow
from .stored import create_folder, new_name, opened
from .tokens import END_OF_TEXT, as_16_bits, token_ids

ROW_TOKENS = 2048
# Tokens that a task collects before it packs: 2 million ids of 4 bytes.
WINDOW_TOKENS = 1 << 21
PACKED = (
    "sequence_id long, n_tokens int, doc_ids array<long>, starts array<long>, "
    "cu_seqlens array<int>, input_ids binary, position_ids binary"
)


@dataclass(frozen=True)
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray


class RoomTree:
    """Open rows by the room that is left in them."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.open = [0] * (2 * self.leaves)  # how many rows are open below the node
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        node = self.leaves + room
        while node:
            self.open[node] += 1
            node >>= 1

    def take(self, room: int) -> int:
        node = self.leaves + room
        while node:
            self.open[node] -= 1
            node >>= 1
        return self.rows[room].pop()

    def least(self, wanted: int) -> int | None:
        """The least room of an open row that is at least `wanted`."""
        node = self.leaves + wanted
        if self.open[node]:
            return wanted
        while node > 1:  # up to the first ancestor with open rows to the right, then down left
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_decreasing(lengths: list[int], most: int) -> list[list[int]]:
    """Rows of item numbers; no row holds more than `most`. Equal lengths keep their order."""
    tree, rows = RoomTree(most), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = tree.least(lengths[item])
        if room is None:
            rows.append([item])
            row, room = len(rows) - 1, most
        else:
            row = tree.take(room)
            rows[row].append(item)
        if room > lengths[item]:
            tree.put(row, room - lengths[item])
    return rows


def packed_rows(
    documents: Iterator[tuple[int | None, np.ndarray]], most: int, window: int
) -> Iterator[list[Piece]]:
    """Rows of pieces; every id of every document is in exactly one piece.

    Rows that a window leaves less than 15/16 full go back to wait for the next one.
    """
    waiting: list[Piece] = []
    size = 0

    def packed(last: bool):
        nonlocal waiting, size
        rows = best_fit_decreasing([len(p.ids) for p in waiting], most)
        pieces, waiting, size = waiting, [], 0
        for row in rows:
            chosen = [pieces[i] for i in row]
            tokens = sum(len(p.ids) for p in chosen)
            if last or tokens * 16 >= most * 15:
                yield chosen
            else:
                waiting += chosen
                size += tokens
        if size * 2 > window:  # too much came back to wait: it has to go
            yield from packed(True)

    for doc_id, ids in documents:
        for start in range(0, len(ids), most):
            part = ids[start: start + most]
            if len(part) == most:
                yield [Piece(doc_id, start, part)]
            else:
                waiting.append(Piece(doc_id, start, part.copy()))
                size += len(part)
        if size >= window:
            yield from packed(False)
    if waiting:
        yield from packed(True)


def pack_best_fit(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    row_tokens: int = ROW_TOKENS, vocabulary: str | None = None, window: int = WINDOW_TOKENS,
    end_id: int = END_OF_TEXT,
) -> DataFrame:
    """One row of the id matrix per row: what a trainer reads, ready to be written.

    `input_ids`: row_tokens little-endian unsigned 16-bit ids, padded with the end id, so that
    rows laid end to end are the matrix; `position_ids`: the same shape, from 0 at the start of
    every segment and 0 in the padding; `cu_seqlens`: segment bounds from 0 to n_tokens;
    `doc_ids` and `starts`: each segment's document and its first id there. Positions restart in
    every piece of a split document. Each partition packs its own documents; a task that runs
    again gives the same rows. A null text counts as empty (the end id alone), ids may be null or
    repeated (each row is a document), an empty table gives no rows, other columns are not
    read. `row_tokens` is at most 65536.
    """
    if not 0 < row_tokens <= 1 << 16:
        raise ValueError("row_tokens must be from 1 to 65536")

    def run(batches):
        number = TaskContext.get().partitionId() << 40

        def documents():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = token_ids(text.as_py() or "", vocabulary, special=False)
                    yield doc_id, as_16_bits(np.append(ids, np.uint32(end_id)))

        rows = []
        for pieces in packed_rows(documents(), row_tokens, window):
            bounds = np.cumsum([0, *(len(p.ids) for p in pieces)])
            ids = np.full(row_tokens, end_id, "<u2")
            positions = np.zeros(row_tokens, "<u2")
            for p, a, b in zip(pieces, bounds, bounds[1:]):
                ids[a:b] = p.ids
                positions[a:b] = np.arange(b - a)
            rows.append((number, int(bounds[-1]), [p.doc_id for p in pieces],
                         [p.start for p in pieces], bounds.tolist(), ids.tobytes(),
                         positions.tobytes()))
            number += 1
            if len(rows) == 512:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return in_arrow(docs.select(
        F.col(id_column).cast("long").alias("_id"), F.col(text_column).alias("_text")
    ), run, PACKED)


# What a file of each kind holds, row after row: the id matrix, the position matrix, the bounds of all
# rows' segments, and how many bounds there are up to each row (so row i has those from i to i + 1).
PACKED_FILES = {"input_ids": "<u2", "position_ids": "<u2", "cu_seqlens": "<i4", "cu_rows": "<i8"}
FILES = "file string, n_rows long, row_tokens long, " + ", ".join(
    f"{name} string" for name in PACKED_FILES)
FILE_BYTES = 256 << 20


def write_packed(packed: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the rows of `pack_best_fit` as flat binary files, and return the list of files.

    A task writes its rows to four files (see PACKED_FILES) and begins new ones after `file_bytes` of
    ids, so the rows of a set of files belong together and are in one order. The list, with the
    paths, rows and row length of every set, is written to `folder`/list; a set of a lost task attempt
    is on no list. No rows give an empty list.
    """
    create_folder(folder)

    def run(batches):
        outs, rows, tokens, bounds, size = None, 0, 0, 0, 0

        def close():
            for out in outs[1].values():
                out.close()
            return pa.RecordBatch.from_pydict({
                "file": [outs[0]], "n_rows": [rows], "row_tokens": [tokens],
                **{name: [f"{outs[0]}.{name}"] for name in PACKED_FILES}})

        for batch in batches:
            columns = (batch.column(name) for name in ("input_ids", "position_ids", "cu_seqlens"))
            for ids, positions, segments in zip(*columns):
                if outs is None:
                    base = new_name(folder, "rows")
                    outs = base, {}
                    for name in PACKED_FILES:
                        store, inner = opened(f"{base}.{name}")
                        outs[1][name] = store.open_output_stream(inner)
                    rows = bounds = size = 0
                    outs[1]["cu_rows"].write(np.array([0], "<i8").tobytes())
                own = segments.values.to_numpy().astype("<i4")
                bounds += len(own)
                for name, data in (("input_ids", ids.as_buffer()), ("cu_seqlens", own.tobytes()),
                                   ("position_ids", positions.as_buffer()),
                                   ("cu_rows", np.array([bounds], "<i8").tobytes())):
                    outs[1][name].write(data)
                rows, size = rows + 1, size + len(ids.as_buffer())
                tokens = len(ids.as_buffer()) // 2
                if size >= file_bytes:
                    yield close()
                    outs = None
        if outs is not None:
            yield close()

    in_arrow(packed.select("input_ids", "position_ids", "cu_seqlens"), run, FILES).write.parquet(
        f"{folder}/list")
    return packed.sparkSession.read.schema(FILES).parquet(f"{folder}/list")


def read_packed(file: dict) -> dict[str, np.ndarray]:
    """The arrays of one set of the list: two matrices, bounds, and where each row's bounds begin."""
    found = {}
    for name, kind in PACKED_FILES.items():
        store, inner = opened(file[name])
        with store.open_input_file(inner) as data:
            found[name] = np.frombuffer(data.read(), kind)
    for name in ("input_ids", "position_ids"):
        found[name] = found[name].reshape(file["n_rows"], file["row_tokens"])
    return found


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()),
             pa.list_(pa.int32()), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in PACKED.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), types)], names
    )
