"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A piece of n tokens costs LINEAR * n + QUADRATIC * n**2, as attention stays within a document. Within
a window of documents the number of full sequences is fixed, pieces are taken in descending length,
and each goes to the lowest-cost sequence with token capacity left. Documents are cut only where they
exceed a sequence or fit in none, and what the full sequences leave over joins the next window, so
every sequence is full except the last of a task, which is cut into powers of two.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._shared import map_arrow, ship
from tesserae.llm._subwords import DEFAULT, by_size, tokenizer

ship(__name__)

CAPACITY, END_ID = 4096, 2
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Tokens of a window; it bounds a task's memory and how many documents are balanced together.
WINDOW = 1 << 20

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def assign(pieces: list[tuple[int, int, int]], capacities: list[int]) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Place (document, start, length) pieces in sequences of the given capacities; also what is left over."""
    placed: list[list[tuple[int, int, int]]] = [[] for _ in capacities]
    room = list(capacities)
    spent = [0.0] * len(room)
    open_ = len(room)
    # by_room[r]: heap of (cost, sequence) with exactly r tokens of room; tree: the least of each over ranges of room
    most = max(room, default=0)
    by_room: list[list[tuple[float, int]]] = [[] for _ in range(most + 1)]
    for i, r in enumerate(room):
        by_room[r].append((0.0, i))
    leaves = 1 << most.bit_length()
    none = (math.inf, -1)
    tree = [none] * (2 * leaves)
    for r in range(most + 1):
        tree[leaves + r] = by_room[r][0] if by_room[r] else none
    for x in range(leaves - 1, 0, -1):
        tree[x] = min(tree[2 * x], tree[2 * x + 1])

    def renew(r: int) -> None:
        x = leaves + r
        tree[x] = by_room[r][0] if by_room[r] else none
        while x > 1:
            x //= 2
            tree[x] = min(tree[2 * x], tree[2 * x + 1])

    def cheapest(least: int) -> tuple[float, int]:
        """The lowest-cost sequence with at least so much room."""
        x = leaves + least
        best = tree[x]
        while x > 1:
            if not x & 1 and tree[x + 1] < best:
                best = tree[x + 1]
            x //= 2
        return best

    todo = sorted(pieces, key=lambda p: (-p[2], p[0], p[1]))
    left = []
    for at, (doc, start, n) in enumerate(todo):
        while n and open_:
            best = cheapest(n) if n <= most else none
            i = (best if best[1] >= 0 else cheapest(1))[1]  # it fits in none: cut it at the cheapest
            r = room[i]
            heapq.heappop(by_room[r])
            renew(r)
            m = min(n, r)
            placed[i].append((doc, start, m))
            room[i] -= m
            spent[i] += cost(m)
            if room[i]:
                heapq.heappush(by_room[room[i]], (spent[i], i))
                renew(room[i])
            else:
                open_ -= 1
            start, n = start + m, n - m
        if n:
            left.append((doc, start, n))
        if not open_:
            left += todo[at + 1 :]
            break
    return placed, left


class Packer:
    """Packs the documents of one task, window by window."""

    def __init__(self, first: int, with_ids: bool):
        self.next, self.with_ids = first, with_ids
        self.docs: dict[int, tuple[int | None, np.ndarray]] = {}
        self.pieces: list[tuple[int, int, int]] = []
        self.tokens = self.count = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        ids = np.append(ids, END_ID).astype("<u4")
        self.docs[self.count] = (doc_id, ids)
        full = len(ids) // CAPACITY * CAPACITY
        for start in range(0, full, CAPACITY):
            self._emit([(self.count, start, CAPACITY)])
        if len(ids) > full:
            self.pieces.append((self.count, full, len(ids) - full))
            self.tokens += len(ids) - full
        self.count += 1
        if self.tokens >= WINDOW:
            self.flush()

    def flush(self, last: bool = False) -> None:
        full, rest = divmod(self.tokens, CAPACITY)
        sizes = [[CAPACITY] * full]
        if last:
            sizes += [[1 << b] for b in reversed(range(CAPACITY.bit_length() - 1)) if rest >> b & 1]
        for capacities in sizes:
            placed, self.pieces = assign(self.pieces, capacities)
            for seq in placed:
                self._emit(seq)
        self.tokens = sum(p[2] for p in self.pieces)
        self.docs = {p[0]: self.docs[p[0]] for p in self.pieces}

    def _emit(self, seq: list[tuple[int, int, int]]) -> None:
        offset = 0
        for doc, start, n in seq:
            doc_id, ids = self.docs[doc]
            part = ids[start : start + n]
            row = (doc_id, start, n, zlib.crc32(part.tobytes()), len(ids), self.next, offset, cost(n))
            self.rows.append(row + (part,) if self.with_ids else row)
            offset += n
        self.next += 1

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            cols = list(zip(*self.rows))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"]
            arrays = [pa.array(c, pa.float64() if n == "cost" else pa.int64()) for n, c in zip(names, cols)]
            if self.with_ids:
                names, arrays = [*names, "ids"], [*arrays, pa.array([x.astype(np.int32) for x in cols[-1]], pa.list_(pa.int32()))]
            self.rows = []
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def _pack(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    tok = tokenizer(path)
    context = TaskContext.get()
    packer = Packer((context.partitionId() if context else 0) << 40, with_ids)
    for b in batches:
        rows = list(zip(b.column(0).to_pylist(), b.column(1)))
        for part in by_size(rows, lambda r: len(r[1].as_buffer() or b"")):
            for (doc_id, _), ids in zip(part, tok.encode_batch([t.as_py() for _, t in part])):
                packer.add(doc_id, ids)
            yield from packer.take()
    packer.flush(last=True)
    yield from packer.take()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str = DEFAULT, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long), cost double.

    A document's ids are its tokenizer's and then id 2; a null or empty text is that id alone. Each row
    of ``docs`` is packed for itself, so a repeated row is packed twice; a null doc_id stays null. An
    empty table gives no pieces; other columns are ignored. sequence_id is unique over all tasks; a
    lost task is packed again with the same result. ``with_ids`` adds the pieces' ids as an array.
    Nothing shuffles: each task packs its own rows and leaves no padding.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, partial(_pack, path=tokenizer_path, with_ids=with_ids), _SCHEMA + (", ids array<int>" if with_ids else ""))
