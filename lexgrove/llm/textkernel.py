"""Word, line and window arithmetic over Arrow string buffers.

A *word* is a maximal run of bytes other than space and \\t..\\r, i.e. ``[^\\x20\\x09-\\x0D]+``.
All work is done on the UTF-8 bytes of a whole batch with numpy; a text is never cut.
Hashes of words and windows have 62 bits, mixed to 64: prefix sums of ``code * base**i`` modulo the prime 2**31 - 1, for
two bases and two halves of each code, give every segment's polynomial hash by one subtraction and a multiplication by
``base**-start``. A prime modulus matters: modulo a power of two, texts of a doubling pattern share one hash for every base.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BATCH_BYTES = 1 << 19
WINDOW_BLOCK = 60_000
BITS = U64(31)
PRIME = U64((1 << 31) - 1)


def splitmix(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(base**i, base**-i) modulo PRIME for i < n at least; kept, and grown where a longer text asks for it."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, int(PRIME))):
            a, k = np.ones(size, dtype=U64), 1
            while k < size:
                a[k : 2 * k] = a[:k] * U64(pow(b, k, int(PRIME))) % PRIME
                k *= 2
            out.append(a)
        _powers[base] = have = (out[0], out[1])
    return have


_kept: dict[int, np.ndarray] = {}


def scratch(k: int, n: int) -> np.ndarray:
    """Room for n numbers, the same again at the next call: fresh pages cost more than the sums that fill them."""
    if n > 1 << 21:
        return np.empty(n, dtype=U64)
    if k not in _kept or len(_kept[k]) < n:
        _kept[k] = np.empty(max(n, 1 << 20), dtype=U64)
    return _kept[k][:n]


def fold(x: np.ndarray) -> np.ndarray:
    """A smaller number that is x modulo PRIME."""
    high = x >> BITS
    x &= PRIME
    x += high
    return x


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column.fill_null("") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, offsets of rows in them)."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offs is not None else np.zeros(1, np.int64)
    d = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return d, o - o[0]


def slices(column: pa.Array, size: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text each; a longer row stands alone, whole."""
    _, o = raw(column)
    i, n = 0, len(column)
    while i < n:
        j = int(np.searchsorted(o, o[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def segment_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of codes[start:end] for each segment, independent of where it stands. codes: bytes or 64-bit hashes."""
    n = len(codes)
    out = np.zeros(len(starts), dtype=U64)
    for half in (0, 1):
        up, down = powers(n + 1, (base >> 31 * half) % int(PRIME - U64(3)) + 2)
        terms = scratch(0, n)
        if codes.dtype == np.uint8:
            np.multiply(codes, up[:n], out=terms)
        else:
            np.right_shift(codes, U64(31 * half), out=terms)
            terms &= PRIME
            terms *= up[:n]
        if codes.dtype != np.uint8 or n > 1 << 24:  # else no sum reaches 2**63
            high = np.right_shift(terms, BITS, out=scratch(1, n + 1)[:n])
            terms &= PRIME
            terms += high
        total = scratch(1, n + 1)
        total[0] = 0
        np.cumsum(terms, out=total[1:])
        h = fold(fold(total[ends] - total[starts]))
        h *= down[starts]
        h = fold(fold(h))
        h[h >= PRIME] -= PRIME
        out |= h << U64(31 * half)
    return mix(out + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))


class Words:
    """Words of the rows of a string array: byte spans, hashes and first word of each row."""

    def __init__(self, column: pa.Array, lower: bool = False, hashes: bool = True):
        self.data, self.offsets = raw(column)
        d, o = self.data, self.offsets
        n = len(d)
        self.space = SPACE[d]
        word = ~self.space
        begin, end = word.copy(), word.copy()
        if n:
            begin[1:] &= self.space[:-1]
            end[:-1] &= self.space[1:]
            edge = o[:-1][o[:-1] < o[1:]]
            begin[edge] = word[edge]
            last = o[1:][o[:-1] < o[1:]] - 1
            end[last] = word[last]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        #: first[i]:first[i + 1] are the words of row i.
        self.first = np.searchsorted(self.starts, o)
        self.counts = np.diff(self.first)
        if hashes:
            self.hashes = segment_hash(LOWER[d] if lower else d, self.starts, self.ends)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Number of set bytes in each row."""
        c = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(flags, out=c[1:])
        return np.diff(c[self.offsets])


def window_hash(hashes: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of every k neighbouring entries (len - k + 1 of them; none if there are fewer).

    Taken block by block, so that the tables of powers stay small however long the row or the chunk.
    """
    out = np.empty(max(0, len(hashes) - k + 1), dtype=U64)
    for i in range(0, len(out), WINDOW_BLOCK):
        at = np.arange(min(WINDOW_BLOCK, len(out) - i))
        out[i : i + len(at)] = segment_hash(hashes[i : i + len(at) + k - 1], at, at + k, base)
    return out


def whole_windows(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Flags of the windows of k words (by first word) that lie in one row."""
    ok = np.ones(max(0, n - k + 1), dtype=bool)
    if len(ok) and k > 1:
        cut = first[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        for back in range(1, k):
            at = cut - back
            ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok
