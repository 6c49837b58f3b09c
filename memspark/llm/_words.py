"""Words and hashes of a whole batch of texts at once, on the bytes that Arrow holds: no string objects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random odd-or-even number for each byte, and the base of the positional weights (odd, so that it has an inverse).
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Texts are hashed in pieces of at most this many bytes (at word ends), so that weights stay a short table.
_PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of ``x`` spread over 64 bits; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    step = base
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step % 2**64
    return out[:n]


_UP, _DOWN = _powers(_BASE, _PIECE + 1), _powers(_INVERSE, _PIECE + 1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and the offsets of the texts in them. A null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of each text in turn, and the offsets of the texts in these.

    A word is a run of bytes other than space, \\t, \\n, \\v, \\f and \\r; with ``lower``, A-Z count as a-z.
    """
    raw, offsets = utf8(column)
    if len(raw) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    bounds = np.unique(offsets[1:-1])
    bounds = bounds[(bounds > 0) & (bounds < len(raw))]
    touching = bounds[inside[bounds] & inside[bounds - 1]]
    starts = np.concatenate([[0] if inside[0] else [], edge[inside[edge]], touching]).astype(np.int64)
    ends = np.concatenate([edge[~inside[edge]], touching, [len(raw)] if inside[-1] else []]).astype(np.int64)
    starts.sort()
    ends.sort()
    table = _BYTE[_LOWER] if lower else _BYTE
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _PIECE, "right")))
        a, b = starts[first], ends[last - 1]
        if b - a > _PIECE:  # one word longer than a piece
            h = np.uint64(0)
            for at in range(a, b, _PIECE):
                part = raw[at : min(b, at + _PIECE)]
                h = mix(np.array([h + np.sum(table[part] * _UP[: len(part)], dtype=np.uint64)], np.uint64))[0]
            out[first] = h
        else:
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[raw[a:b]] * _UP[: b - a], dtype=np.uint64)])
            out[first:last] = (total[ends[first:last] - a] - total[starts[first:last] - a]) * _DOWN[starts[first:last] - a]
        first = last
    return mix(out), np.searchsorted(starts, offsets).astype(np.int64)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of ``n`` words within each text, and the offsets of the texts in these.

    A text of fewer words, but one at least, has one: of all its words.
    """
    lengths = np.diff(offsets)
    counts = np.where(lengths >= n, lengths - n + 1, (lengths > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(counts)])
    if not len(words):
        return np.zeros(0, np.uint64), out_offsets
    k = len(words)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    at = np.repeat(offsets[:-1] - out_offsets[:-1], counts) + np.arange(out_offsets[-1])
    left = np.repeat(offsets[1:], counts) - at  # words from here to the text's end
    out = np.zeros(len(at), np.uint64)
    for j in range(n):
        w = padded[np.minimum(at + j, k)]
        out = np.where(j < left, mix(out * np.uint64(_BASE) + w + np.uint64(j + 1)), out)
    return out, out_offsets


def sets(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, sorted, and the offsets of the texts in these."""
    hashes = hashes.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[offsets[:-1][offsets[:-1] < len(hashes)]] = True
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[offsets]


def range_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum (modulo 2**64) of each range between offsets."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows that hold about ``limit`` bytes of text at most, or one row."""
    texts = batch.column(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, upto - at)
        at = upto
