"""Packing by minimum bin slack: every window is filled as closely as the lengths at hand allow.

Documents longer than a window give full windows first; only what is left over is packed. For
each window a task takes its longest leftover and finds, by a bitset subset-sum over the counts
of the other lengths, the multiset that comes closest to the capacity; the set bits are then
traced back to counts. If no multiset fills the window, one more leftover is cut to fill it.
What remains at a task's end is cut into sequences whose lengths are powers of two, which need
no padding. Tasks pack the rows they read: no shuffle, no group can grow hot, and a lost task is
repeated alone.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pixelloom.llm.common import batch_rows
from pixelloom.llm.tokens import WordEncoder, encoded, tokenizer_path

CAPACITY = 4096
BATCH = 2048  # rows that are read at once
END_ID = 2
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
#: Leftovers that a task gathers before it packs, and those it keeps back for the next round.
GATHER, KEEP = 4096, 512


def closest_multiset(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """``(length, count)`` pairs whose sum is the largest that does not exceed ``room``.

    ``lengths`` ascends; longer ones are tried first, and the search ends as soon as the room
    can be filled exactly.
    """
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    reach, layers = 1, []
    for length in reversed(lengths):
        if length > room:
            continue
        for _ in range(min(counts[length], room // length)):
            wider = (reach | reach << length) & mask
            if wider == reach:
                break
            layers.append((length, reach))
            reach = wider
        if reach & goal:
            break
    at, picked = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        if not before >> at & 1:
            picked[length] = picked.get(length, 0) + 1
            at -= length
    return list(picked.items())


class Packer:
    """Packs pieces ``(doc_id, start, ids, doc_tokens)``; ``emit(piece, sequence, offset)`` gets each."""

    def __init__(self, emit, capacity: int = CAPACITY):
        self.emit, self.capacity = emit, capacity
        self.lengths: list[int] = []
        self.pool: dict[int, list] = {}
        self.counts: dict[int, int] = {}
        self.n = self.total = self.sequence = 0

    def add(self, piece) -> None:
        length = len(piece[2])
        if not self.counts.get(length):
            insort(self.lengths, length)
            self.pool[length], self.counts[length] = [], 0
        self.pool[length].append(piece)
        self.counts[length] += 1
        self.n += 1
        self.total += length

    def take(self, length: int):
        piece = self.pool[length].pop()
        self.counts[length] -= 1
        if not self.counts[length]:
            self.lengths.remove(length)
            del self.pool[length], self.counts[length]
        self.n -= 1
        self.total -= length
        return piece

    def document(self, doc_id, ids: np.ndarray) -> None:
        n = len(ids)
        for start in range(0, n - self.capacity + 1, self.capacity):
            self.emit((doc_id, start, ids[start : start + self.capacity], n), self.sequence, 0)
            self.sequence += 1
        if rest := n % self.capacity:
            self.add((doc_id, n - rest, ids[n - rest :], n))

    def _cut(self, piece, length: int):
        doc_id, start, ids, n = piece
        self.add((doc_id, start + length, ids[length:], n))
        return doc_id, start, ids[:length], n

    def window(self) -> None:
        """Fill one window; only called while the pool holds at least a window."""
        chosen = [self.take(self.lengths[-1])]
        room = self.capacity - len(chosen[0][2])
        for length, count in closest_multiset(self.lengths, self.counts, room):
            chosen += [self.take(length) for _ in range(count)]
            room -= length * count
        while room:  # shorter than every leftover, so the shortest is cut
            longer = self.take(self.lengths[0])
            chosen.append(self._cut(longer, room) if len(longer[2]) > room else longer)
            room -= len(chosen[-1][2])
        self._place(chosen)

    def _place(self, pieces) -> None:
        offset = 0
        for piece in pieces:
            self.emit(piece, self.sequence, offset)
            offset += len(piece[2])
        self.sequence += 1

    def pack(self, keep: int) -> None:
        while self.total >= self.capacity and self.n > keep:
            self.window()

    def finish(self) -> None:
        self.pack(0)
        while self.total:
            room, chosen = 1 << (self.total.bit_length() - 1), []
            while room:
                piece = self.take(self.lengths[-1])
                chosen.append(self._cut(piece, room) if len(piece[2]) > room else piece)
                room -= len(chosen[-1][2])
            self._place(chosen)


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``, placed in sequences of at most ``capacity`` ids.

    A null or empty text is its end id alone; rows that repeat are packed as often as they
    stand; other columns are ignored; an empty table gives no rows. Numbers of sequences hold
    the partition in their upper bits, so they are unique but not consecutive.
    """
    batch_rows(docs.sparkSession, BATCH)
    path = tokenizer or tokenizer_path()
    names = [field.split()[0] for field in PIECES.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, rows = WordEncoder(path), []
        first = TaskContext.get().partitionId() << 36

        def emit(piece, sequence, offset):
            doc_id, start, ids, n = piece
            rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), n, first + sequence, offset))

        def flush():
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7
            rows.clear()
            return pa.record_batch(columns, names=names)

        packer = Packer(emit, capacity)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for i, ids in encoded(batch.column(1), encoder, end_id):
                packer.document(doc_ids[i], ids)
                if packer.n >= GATHER:
                    packer.pack(KEEP)
            if rows:
                yield flush()
        packer.finish()
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(pack, PIECES)
