"""Words of many texts at once, as numpy arrays over the bytes of an Arrow string array.

Texts are handled as UTF-8 bytes. White space is ASCII, so a byte of a longer character is
never taken for it. Words get 64-bit hashes, and short runs of words (a power series in them)
others from prefix sums; a second family (`seed=1`) makes them 128 bits where a match is final.
Long runs, whole texts, need a real digest where a match is final.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: For terms: every ASCII character but letters and digits separates.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])

#: Texts are worked through in pieces of about so many bytes; numpy needs some 60 times that.
PIECE_BYTES = 1 << 21

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Words of more bytes are hashed one by one.
LONG_WORD = 256
#: Masks of the first 0 to 8 bytes of a number.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = [mix(np.arange(1 + 256 * s, 257 + 256 * s, dtype=np.uint64) * np.uint64(_BASES[0])) for s in (0, 1)]


def _power(n: int, seed: int, inverse: bool) -> np.ndarray:
    got = _powers.get((seed, inverse))
    if got is None or len(got) < n:
        base = pow(_BASES[seed], -1 if inverse else 1, 1 << 64)
        steps = np.full(max(n, PIECE_BYTES // 2), base, np.uint64)
        steps[0] = 1
        got = _powers[seed, inverse] = np.multiply.accumulate(steps)
    return got[:n]


def prefix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Prefix sums of values times rising powers, one longer than `values`."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(len(values), seed, False), out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of every run [start, end) of what `sums` was made from; the length counts."""
    raw = (sums[end] - sums[start]) * _power(len(sums), seed, True)[start]
    return mix(raw + mix((end - start).astype(np.uint64)))


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets within them) of runs of rows; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    at = at.astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(at, at[first] + limit, "right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for every row the number of words before it (one longer)."""
    n = len(data)
    inside = ~separators[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    ends[:-1] &= ~inside[1:] | first[1:n]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of every word, eight bytes at a time, each mixed into what came before; long words by BLAKE2b.

    No sum of powers: those have words, not hard to write down, that collide under every odd base.
    """
    eight, size = _eights(data), end - start
    hashes = mix(size.astype(np.uint64) + np.uint64(_BASES[1 - seed]))
    live, at = np.flatnonzero((size > 0) & (size <= LONG_WORD)), 0
    while len(live):
        here = eight[start[live] + at] & _LOW[np.minimum(size[live] - at, 8)]
        hashes[live] = mix((hashes[live] ^ here) * np.uint64(_BASES[seed]))
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]], digest_size=8, salt=bytes([seed])).digest()
        hashes[i] = int.from_bytes(digest, "little")
    return hashes


def same_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether data[start:end] equals as many bytes of `other` from `begin` on, for every pair of places."""
    one, two, size = _eights(data), _eights(other), end - start
    same = begin + size <= len(other)
    live, at = np.flatnonzero(same & (size <= LONG_WORD)), 0
    while len(live):
        differ = (one[start[live] + at] ^ two[begin[live] + at]) & _LOW[np.clip(size[live] - at, 0, 8)]
        same[live] &= differ == 0
        at += 8
        live = live[(size[live] > at) & (differ == 0)]
    for i in np.flatnonzero(same & (size > LONG_WORD)).tolist():
        same[i] = np.array_equal(data[start[i] : end[i]], other[begin[i] : begin[i] + size[i]])
    return same


def row_of(rows: np.ndarray) -> np.ndarray:
    """For every word the row it is in, from the counts of `spans`."""
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (length[0] of them), start[1], ..."""
    total = int(length.sum())
    step = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    return np.repeat(start, length) + step


def slices(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """As `pieces`, but a longer row comes in several, cut before white space; True if the row goes on.

    A word that is longer than the limit stays whole.
    """
    for first, end, data, offsets in pieces(texts, limit):
        at = 0
        while len(data) - at > limit:
            window = np.flatnonzero(WHITE[data[at + 1 : at + limit]])
            if len(window):
                cut = at + 1 + int(window[-1])
            else:
                cut, step = at + limit, limit
                while cut < len(data) and not WHITE[data[cut : cut + step]].any():
                    cut += step
                if cut >= len(data):
                    break
                cut += int(np.argmax(WHITE[data[cut : cut + step]]))
            yield first, end, data[at:cut], np.array([0, cut - at]), True
            at = cut
        yield first, end, data[at:], offsets if at == 0 else np.array([0, len(data) - at]), False
