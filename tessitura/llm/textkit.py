"""Vectorised text kernels: numpy over the UTF-8 buffers of Arrow columns, with no per-word Python objects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Two polynomial hashes modulo the prime 2**31 - 1, each with a base of its own: 62 bits in all. Unlike a polynomial
#: modulo a power of two, no strings collide whatever the base is.
PRIME = (1 << 31) - 1
BASES = (1_597_463_007, 0x2545F491)
_P, _31 = np.uint64(PRIME), np.uint64(31)
#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE = 2 << 20

#: 0 for bytes outside words, else the byte with A-Z lower-cased: words are runs of 0-9, a-z and bytes over 0x7F.
WORD_BYTES = np.zeros(256, np.uint8)
for _b in range(256):
    _c = _b + 32 if 0x41 <= _b <= 0x5A else _b
    if 0x30 <= _c <= 0x39 or 0x61 <= _c <= 0x7A or _c >= 0x80:
        WORD_BYTES[_b] = _c


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (shifts and odd multipliers), in place."""
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME up to one multiple of it, in place."""
    high = x >> _31
    x &= _P
    x += high
    return x


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, in place."""
    _folded(_folded(x))
    x -= np.where(x >= _P, _P, np.uint64(0))
    return x


class Powers:
    """Powers of the bases and of their inverses modulo PRIME, (lane, power), grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones((2, 1), np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.up.shape[1] < n + 1:
            k = max(n + 1, SLICE + 1)
            self.up, self.down = (np.stack([_powers(b, k) for b in bases]) for bases in (BASES, [pow(b, -1, PRIME) for b in BASES]))
        return self.up, self.down


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:  # each pass doubles what is known
        more = min(k, n - k)
        out[k : k + more] = _reduced(out[:more] * np.uint64(pow(base, k, PRIME)))
        k += more
    return out


POWERS = Powers()


#: Bytes that are hashed at once, so that intermediate arrays stay in cache.
_STRIP = 1 << 14


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """(lane, n + 1) S with S[i] = sum of (data[j] + 1) * B**j for j < i, modulo PRIME."""
    up, _ = POWERS.to(len(data))
    out = np.zeros((2, len(data) + 1), np.uint64)
    for i in range(0, len(data), _STRIP):
        digits = data[i : i + _STRIP].astype(np.uint64)
        digits += np.uint64(1)
        for lane in range(2):
            to = out[lane, i + 1 : i + 1 + len(digits)]
            np.cumsum(_folded(digits * up[lane, i : i + len(digits)]), out=to)
            to += out[lane, i]
            _reduced(to)
    return out


def gram_hash(prefix: np.ndarray, gram: int) -> np.ndarray:
    """31-bit hashes, spread over 64 bits, of the gram bytes from every place on."""
    n = prefix.shape[1] - gram
    _, down = POWERS.to(n)
    out = np.empty(n, np.uint64)
    for i in range(0, n, _STRIP):
        j = min(n, i + _STRIP)
        x = prefix[0, i + gram : j + gram] + _P
        x -= prefix[0, i:j]
        x = _folded(x)
        x *= down[0, i:j]
        out[i:j] = mix(_reduced(x))
    return out


def _shifted(prefix: np.ndarray, lane: int, start: np.ndarray, end: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The sum over data[start:end] with its powers lowered by `by`, modulo PRIME."""
    x = prefix[lane][end] + _P
    x -= prefix[lane][start]
    x = _folded(x)
    x *= POWERS.down[lane][by]
    return _reduced(x)


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 62-bit hash of data[start:end] for each pair, spread over 64 bits, in constant time each."""
    POWERS.to(prefix.shape[1] - 1)
    out = np.empty(len(start), np.uint64)
    for i in range(0, len(out), _STRIP):
        a, b = start[i : i + _STRIP], end[i : i + _STRIP]
        out[i : i + _STRIP] = mix(_shifted(prefix, 0, a, b, a) << _31 | _shifted(prefix, 1, a, b, a))
    return out


def cut_hash(prefix: np.ndarray, start: np.ndarray, a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash that data[start:a] + data[b:end] has as a whole."""
    POWERS.to(prefix.shape[1] - 1)
    out = np.empty(len(start), np.uint64)
    for i in range(0, len(out), _STRIP):
        s, x, y, e = (v[i : i + _STRIP] for v in (start, a, b, end))
        lanes = [_reduced(_shifted(prefix, k, s, x, s) + _shifted(prefix, k, y, e, s + y - x)) for k in range(2)]
        out[i : i + _STRIP] = mix(lanes[0] << _31 | lanes[1])
    return out


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    base, end = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, end - base, base) if data is not None and end > base else np.zeros(0, np.uint8)
    return raw, offsets - base


def slices(raw: np.ndarray, offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with at most `most` bytes, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values that cross no row border."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    start = inside & (~before | border[:-1])
    end = inside & (~after | border[1:])
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, start, end) of each lower-cased word, and so in text order."""
    low = WORD_BYTES[raw]
    start, end = runs(low != 0, offsets)
    row = np.searchsorted(offsets, start, "right") - 1
    return row, span_hash(prefix_hash(low), start, end), start, end


_STEP = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], np.uint64)


def shingle_hash(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive entries of word (len(word) - k + 1 of them, none if there are fewer)."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += word[i : i + n] * _STEP[i]
    return mix(out)


def shingles(row: np.ndarray, word: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each k-word shingle; a row with fewer words, but not none, has one shingle of all its words."""
    full = shingle_hash(word, k)
    keep = row[: len(full)] == row[k - 1 :] if len(full) else np.zeros(0, bool)
    rows_out, hashes = row[: len(full)][keep], full[keep]
    count = np.bincount(row, minlength=rows)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.searchsorted(row, short)
        extra = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            there = count[short] > i
            extra[there] += word[first[there] + i] * _STEP[i]
        rows_out, hashes = np.concatenate([rows_out, short]), np.concatenate([hashes, mix(extra)])
    return rows_out, hashes
