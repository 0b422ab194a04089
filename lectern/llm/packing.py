"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n, since attention stays within a piece. Texts
are taken in windows of about WINDOW_TOKENS tokens as they stream through a task: full sequences are
cut off first, then the rests go in descending order to the sequence of the lowest cost that has room
left. The sequences of a window have as many places as its tokens: all of full capacity, but for the
rest, which is split into powers of two. So a piece that fits nowhere whole is cut, and none is padded.
There is no shuffle and no more state than a window, at any size of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lectern.llm.common import doc_texts, rows_of
from lectern.llm.tokens import encoder

LINEAR, QUADRATIC = 1.0, 1 / 2048
WINDOW_TOKENS = 1 << 20
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, tokens binary"
_NAMES = [x.split()[0] for x in PIECES.split(", ")]


def powers_of_two(n: int) -> list[int]:
    """The powers of two that add up to n, the largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def assign(lengths: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pieces (document, start, length, sequence, offset) of documents with these lengths, and the sequences' sizes.

    Each token is in exactly one piece, and every sequence is full. Empty documents have no piece.
    """
    pieces, sizes = [], []
    rests: list[tuple[int, int, int]] = []  # (length, document, start)
    for doc, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            pieces.append((doc, k * capacity, capacity, len(sizes), 0))
            sizes.append(capacity)
        if n % capacity:
            rests.append((n % capacity, doc, full * capacity))
    total = sum(n for n, _, _ in rests)
    room = np.array([capacity] * (total // capacity) + powers_of_two(total % capacity), np.int64)
    first, sized = len(sizes), room.copy()
    sizes += sized.tolist()
    cost = np.zeros(len(room))
    rests.sort(key=lambda x: (-x[0], x[1]))
    for n, doc, start in rests:
        while n:
            fits = room >= n
            # without room for the whole, the fullest gap takes a part
            to = int(np.where(fits, cost, np.inf).argmin()) if fits.any() else int(room.argmax())
            take = min(n, int(room[to]))
            pieces.append((doc, start, take, first + to, int(sized[to] - room[to])))
            room[to] -= take
            cost[to] += linear * take + quadratic * take * take
            n, start = n - take, start + take
    return pieces, sizes


def pack(docs: DataFrame, tokenizer: str, end_id: int | None = 2, capacity: int = 4096, window_tokens: int = WINDOW_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """One row a piece: where it lies in its document and in its sequence, with its ids.

    `tokens` has the piece's ids as little-endian unsigned 32-bit integers, `sequence_tokens` the size of
    its sequence: `capacity`, or a smaller power of two. Null texts are empty; with an `end_id` they
    have that alone, without one they have no piece. Rows that repeat a doc_id, or have none, are packed
    each for itself. An empty table gives no rows. Other columns are ignored.
    """
    if capacity < 1 or window_tokens < capacity:
        raise ValueError("a window holds a sequence at least")
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 36
        ids: list[bytes] = []
        names: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, held
            pieces, sizes = assign([len(x) // 4 for x in ids], capacity, linear, quadratic)
            doc, start, length, at, offset = (list(x) for x in zip(*pieces))
            out = [
                pa.array([names[d] for d in doc], pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([len(ids[d]) // 4 for d in doc], pa.int64()),
                pa.array([sequence + s for s in at], pa.int64()), pa.array(offset, pa.int64()), pa.array([sizes[s] for s in at], pa.int64()),
                pa.array([ids[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc, start, length)], pa.binary()),
            ]
            sequence += len(sizes)
            ids.clear()
            names.clear()
            held = 0
            return pa.RecordBatch.from_arrays(out, names=_NAMES)

        for batch in rows_of(batches):
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(enc.encode(text) + end)
                names.append(name)
                held += len(ids[-1]) // 4
                if held >= window_tokens:
                    yield flush()
        if held:
            yield flush()

    return doc_texts(docs).mapInArrow(run, PIECES)
