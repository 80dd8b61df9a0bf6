"""Sum-of-squares online packing of token sequences into windows.

A document's ids fill whole windows first; its tail is placed online: into the fill level whose choice minimises the
sum of squared counts of partially filled windows, tracked in an array by level. What is left open when a task ends is
laid end to end and cut anew into full windows, and the last of it into windows whose sizes are powers of two, which
need no padding. Each task packs its own documents: no shuffle, and a task that runs again gives the same windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strainlake.llm.common import slices

WINDOW = 2048
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])

#: (doc_id, start, ids as bytes, tokens of the document)
Piece = tuple[int | None, int, bytes, int]


class SumOfSquares:
    """Windows of one task, open and closed. counts[h]: open windows filled up to h."""

    def __init__(self, window: int = WINDOW, first_id: int = 0):
        self.window, self.next_id = window, first_id
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: list[Piece]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_id, at))
            at += n
        self.next_id += 1

    def level(self, size: int) -> int:
        """The fill level to place a piece at: 0 opens a window. Of equal choices the fullest is taken."""
        c, w = self.counts, self.window
        h = np.flatnonzero(c[: w - size + 1])
        if not len(h):
            return 0
        grown = np.where(h + size == w, 1 - 2 * c[h], 2 * (c[h + size] - c[h]) + 2)
        best = int(len(h) - 1 - np.argmin(grown[::-1]))
        return int(h[best]) if grown[best] <= (2 * c[size] + 1) else 0

    def place(self, piece: Piece) -> None:
        size = len(piece[2]) // 4
        h = self.level(size)
        pieces = [piece]
        if h:
            pieces = [*self.open[h].pop(), piece]
            self.counts[h] -= 1
        if h + size == self.window:
            self.close(pieces)
        else:
            self.open.setdefault(h + size, []).append(pieces)
            self.counts[h + size] += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        total, step = len(ids) // 4, 4 * self.window
        full = len(ids) // step * step
        for a in range(0, full, step):
            self.close([(doc, a // 4, ids[a : a + step], total)])
        if full < len(ids):
            self.place((doc, full // 4, ids[full:], total))

    def finish(self) -> None:
        rest = [p for h in sorted(self.open, reverse=True) for pieces in self.open[h] for p in pieces]
        self.open.clear()
        self.counts[:] = 0
        left = sum(len(p[2]) // 4 for p in rest)
        some: list[Piece] = []
        room = self._room(left)
        for doc, start, ids, total in rest:
            while ids:
                part = ids[: 4 * room]
                some.append((doc, start, part, total))
                n = len(part) // 4
                ids, start, room, left = ids[4 * n :], start + n, room - n, left - n
                if not room:
                    self.close(some)
                    some, room = [], self._room(left)

    def _room(self, left: int) -> int:
        return self.window if left >= self.window else 1 << (left.bit_length() - 1) if left else 0


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, part_bytes: int = 8 << 20) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty: its document is the end id alone. Repeated rows are packed each for itself; a null id stays
    null; other columns are ignored; an empty table gives no rows. part_bytes: text encoded at once, which the memory of a
    Python worker follows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from strainlake.llm.tokens import encoder

        enc, end = encoder(tokenizer), np.asarray([end_id], "<u4").tobytes()
        packer = SumOfSquares(window, TaskContext.get().partitionId() << 33)

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [()] * len(_ARROW)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ARROW)

        for batch in batches:
            for part in slices(batch, 1, part_bytes):
                ids, offs = enc.encode(part.column(1))
                raw = ids.tobytes()
                for doc, a, b in zip(part.column(0).to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    packer.add(doc, raw[4 * a : 4 * b] + end)
                if len(packer.rows) > 20_000:
                    yield out()
        packer.finish()
        yield out()

    from pyspark.sql import functions as F

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, SCHEMA)
