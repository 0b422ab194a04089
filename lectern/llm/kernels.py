"""Array kernels over the words of many texts at once: cutting, hashing, counting.

A word is a longest run of bytes other than space and 0x09-0x0D, as `[^\\x20\\x09-\\x0D]+` on the text.
Everything works on the UTF-8 bytes of one slice of a batch, so memory follows the slice alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[9, 10, 11, 12, 13]] = 32
_CASED = _LOWER.copy()
_LOWER[65:91] += 32
#: Groups of equal length below this are hashed one by one.
_FEW = 24


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string column without nulls, and the texts' offsets in them."""
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


class Words:
    """The words of texts: `buffer` holds each text's words, in turn, with one space between two.

    `at` and `size` are a word's place and bytes in the buffer, `count` the words of each text, and
    `first` the index of each text's first word.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = True):
        x = (_LOWER if lower else _CASED)[raw]
        black = x != 32
        starts = black.copy()
        starts[1:] &= ~black[:-1]
        edge = offsets[1:-1]
        edge = edge[edge < len(x)]
        starts[edge] = black[edge]  # a text's first letter begins a word
        stops = black.copy()
        stops[:-1] &= ~black[1:]
        last = edge[edge > 0] - 1
        stops[last] = black[last]
        begin, end = np.flatnonzero(starts), np.flatnonzero(stops)
        kept = black.copy()
        kept[1:] |= black[:-1]
        place = np.cumsum(kept) - 1
        self.buffer = x[kept]
        self.at = place[begin]
        self.size = end - begin + 1
        self.begin = begin
        self.first = np.searchsorted(begin, offsets[:-1])
        self.count = np.diff(np.append(self.first, len(begin)))

    def hashes(self, seed: int = 42) -> np.ndarray:
        return xxh64(self.buffer, self.at, self.size, seed)

    def shingles(self, n: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and bytes of the n-word shingles, and how many each text has; one if it has 1 to n-1 words."""
        many = np.where(self.count >= n, self.count - n + 1, np.minimum(self.count, 1))
        total = int(many.sum())
        begins = np.cumsum(many) - many
        index = np.arange(total) + np.repeat(self.first - begins, many)
        until = index + np.repeat(np.minimum(self.count, n) - 1, many)
        at = self.at[index]
        return at, self.at[until] + self.size[until] - at, many


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def _same_size(w8: np.ndarray, w4: np.ndarray, buffer: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """XXH64 of the spans of one size that begin at `at`."""
    seed_ = np.uint64(seed)
    pos, left = at, size
    with np.errstate(over="ignore"):
        if size >= 32:
            zero = np.zeros(len(at), np.uint64)
            acc = [zero + (seed_ + _P1 + _P2), zero + (seed_ + _P2), zero + seed_, zero + (seed_ - _P1)]
            while left >= 32:
                for i in range(4):
                    acc[i] = _round(acc[i], w8[pos + 8 * i])
                pos, left = pos + 32, left - 32
            h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                h = (h ^ _round(zero, a)) * _P1 + _P4
        else:
            h = np.full(len(at), seed_ + _P5, np.uint64)
        h += np.uint64(size)
        while left >= 8:
            h = _rotl(h ^ _round(np.uint64(0), w8[pos]), 27) * _P1 + _P4
            pos, left = pos + 8, left - 8
        if left >= 4:
            h = _rotl(h ^ (w4[pos].astype(np.uint64) * _P1), 23) * _P2 + _P3
            pos, left = pos + 4, left - 4
        for _ in range(left):
            h = _rotl(h ^ (buffer[pos].astype(np.uint64) * _P5), 11) * _P1
            pos = pos + 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h


def xxh64(buffer: np.ndarray, at: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of the spans of `buffer`: those of one size together."""
    out = np.empty(len(at), np.uint64)
    if not len(at):
        return out
    data = buffer.tobytes() + bytes(8)
    n = len(data) - 8
    w8 = np.ndarray((n,), "<u8", data, strides=(1,))
    w4 = np.ndarray((n,), "<u4", data, strides=(1,))
    order = np.argsort(size.astype(np.uint16) if size.max() < 65536 else size, kind="stable")
    sizes, begins = np.unique(size[order], return_index=True)
    for s, a, b in zip(sizes.tolist(), begins.tolist(), [*begins.tolist()[1:], len(order)]):
        which = order[a:b]
        if b - a < _FEW:
            out[which] = [xxhash.xxh64_intdigest(data[p : p + s], seed) for p in at[which].tolist()]
        else:
            out[which] = _same_size(w8, w4, buffer, at[which], s, seed)
    return out


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each run of `counts` values; 0 for empty runs."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


_LANES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of `counts` hashes, the bits set in over half of them; 0 for empty runs.

    Eight bits are counted at once in the bytes of a word, over blocks of at most 255 hashes.
    """
    ends = np.cumsum(counts)
    blocks = -(-counts // 255)
    many = int(blocks.sum())
    out = np.zeros(len(counts), np.uint64)
    if not many:
        return out
    first = np.cumsum(blocks) - blocks
    at = np.repeat(ends - counts, blocks) + 255 * (np.arange(many) - np.repeat(first, blocks))
    some = counts > 0
    half = counts[some, None]
    for k in range(8):
        part = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, at)
        each = part.view(np.uint8).reshape(-1, 8).astype(np.int64)
        per = np.add.reduceat(each, first[some], axis=0)
        for byte in range(8):
            out[some] |= (2 * per[:, byte] > half[:, 0]).astype(np.uint64) << np.uint64(8 * byte + k)
    return out
