"""Vectorised text kernels over Arrow string columns: word hashes, shingle hashes.

Everything works on the UTF-8 bytes of a whole batch with numpy, in slices of
bounded size, so a very long text costs no more memory than many short ones.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
SLICE = 1 << 20
_MUL = U(0x9E3779B97F4A7C15)
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = (h ^ (h >> U(30))) * _M1
    h = (h ^ (h >> U(27))) * _M2
    return h ^ (h >> U(31))


#: A-Z to a-z, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Runs of more bytes than this are hashed by blake2b.
LONG_RUN = 512


def run_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of raw[start:end], one for each pair.

    Eight bytes at a time go through mix(), which no sum or power of a base undoes: runs of up to
    eight bytes and one length never collide, longer ones only by chance.
    """
    n = (end - start).astype(np.int64)
    lanes = np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix(n.astype(U) * _MUL + U(seed))
    live, at = np.flatnonzero((n > 0) & (n <= LONG_RUN)), 0
    while len(live):
        left = n[live] - at
        lane = lanes[start[live] + at]
        tail = left < 8
        lane[tail] &= (U(1) << (left[tail].astype(U) * U(8))) - U(1)
        h[live] = mix(h[live] * U(3) ^ lane)
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(n > LONG_RUN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return h


def class_table(kind: str) -> np.ndarray:
    """Which bytes belong to words: 'space' splits at ASCII white space; 'alnum' keeps ASCII letters, digits and all bytes of non-ASCII characters."""
    b = np.arange(256)
    if kind == "space":
        return ~((b == 32) | ((b >= 9) & (b <= 13)))
    return ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of an Arrow string column; null is empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def sliced(batches, text_index: int, limit: int = 1 << 21):
    """The batches in slices of about limit bytes of text (one row at least)."""
    for b in batches:
        if b.num_rows <= 1 or b.column(text_index).nbytes <= limit:
            if b.num_rows:
                yield b
            continue
        size = np.diff(utf8(b.column(text_index))[1])
        at, held = 0, 0
        for i, n in enumerate(size.tolist()):
            if held and held + n > limit:
                yield b.slice(at, i - at)
                at, held = i, 0
            held += n
        yield b.slice(at)
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: workers stay for the next task, and several share an executor's bound."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its own policy holds
        pass


def runs_of(member: np.ndarray, raw: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of the maximal runs, inside one text each, of least bytes or more that member (by byte) holds for."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z
    inside = member[raw]
    fresh = np.zeros(n + 1, bool)
    fresh[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | fresh[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | fresh[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    keep = e - s >= least
    return s[keep], e[keep]


class WordHasher:
    """Hashes of the words of texts, A-Z in lower case.  One per task."""

    def __init__(self, kind: str = "space"):
        self.table = class_table(kind)

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each word, offsets of each text's words, first byte and end byte of each word)."""
        n = len(raw)
        hashes, starts, ends = [], [], []
        fresh = np.zeros(n + 1, bool)
        fresh[off[:-1]] = True
        at = 0
        while at < n:
            end = min(n, at + SLICE)
            while end < n and self.table[raw[end]] and not fresh[end]:  # a word isn't cut
                step = min(n, end + 4096)
                stop = np.flatnonzero(~self.table[raw[end:step]] | fresh[end:step])
                end = end + int(stop[0]) if len(stop) else step
            part = raw[at:end]
            word = self.table[part]
            before = np.r_[False, word[:-1]] & ~fresh[at:end]
            s = np.flatnonzero(word & ~before)
            after = np.r_[word[1:], False] & np.r_[~fresh[at + 1 : end], False]
            e = np.flatnonzero(word & ~after) + 1
            hashes.append(run_hashes(LOWER[part], s, e))
            starts.append(s + at)
            ends.append(e + at)
            at = end
        if not hashes:
            z = np.zeros(0, np.int64)
            return np.zeros(0, U), np.zeros(len(off), np.int64), z, z
        s = np.concatenate(starts)
        return np.concatenate(hashes), np.searchsorted(s, off), s, np.concatenate(ends)


def shingle_hashes(words: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each text (the whole of a shorter one), and the offsets of each text's."""
    n = np.diff(off)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out_off = np.r_[0, np.cumsum(count)]
    out = np.empty(out_off[-1], U)
    if len(words) >= k:
        h = mix(words[: len(words) - k + 1] + U(k))
        for j in range(1, k):
            h = mix(h * U(3) + words[j : len(words) - k + 1 + j])
        owner = np.repeat(np.arange(len(n)), n)
        full = owner[: len(h)] == owner[k - 1 :]
        dest = np.repeat(n >= k, count)
        out[dest] = h[full]
    for m in range(1, k):
        rows = np.flatnonzero(n == m)
        if len(rows):
            h = mix(words[off[rows]] + U(m))
            for j in range(1, m):
                h = mix(h * U(3) + words[off[rows] + j])
            out[out_off[rows]] = h
    return out, out_off


def distinct_sets(hashes: np.ndarray, off: np.ndarray):
    """The sorted distinct hashes of each text."""
    for i in range(len(off) - 1):
        s = np.sort(hashes[off[i] : off[i + 1]])
        yield s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s


P61 = (1 << 61) - 1
_P = U(P61)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> U(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, for numbers below it."""
    a1, a0, b1, b0 = a >> U(31), a & U(0x7FFFFFFF), b >> U(31), b & U(0x7FFFFFFF)
    mid = a1 * b0 + a0 * b1
    return _reduced(_reduced((a1 * b1 << U(1)) + (mid >> U(30)) + ((mid & U(0x3FFFFFFF)) << U(31))) + a0 * b0)


class SpanHasher:
    """Hashes of any spans of a sequence of 64-bit numbers, by polynomials modulo the prime 2^61 - 1.

    Two different spans of n numbers have the same hash for at most n of the 2^61 bases, whatever
    the numbers; with the two bases taken here that is a digest of 122 bits.
    """

    BASES = (0x1234A6C5D3E7F91B, 0x0F1E2D3C4B5A6979)

    def __init__(self):
        self._powers(1 << 16)

    def _powers(self, n: int) -> None:
        self.tables = []
        for base in self.BASES:
            both = []
            for x in (base, pow(base, -1, P61)):
                p, step = np.ones(1, U), x
                while len(p) < n:  # the next as many powers are the present ones times x ** len
                    p = np.concatenate([p, times(p, np.full(len(p), step, U))])
                    step = step * step % P61
                both.append(p)
            self.tables.append(both)

    def __call__(self, numbers: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of numbers[a:z], one for each pair."""
        if len(numbers) >= len(self.tables[0][0]):
            self._powers(2 * len(numbers))
        out = []
        for power, inverse in self.tables:
            term = times(_reduced(numbers), power[: len(numbers)])
            low, high = (np.r_[U(0), np.cumsum(x)] for x in (term & U(0xFFFFFFFF), term >> U(32)))
            low, high = low[z] - low[a], _reduced(high[z] - high[a])
            total = _reduced(_reduced(high >> U(29)) + ((high & U(0x1FFFFFFF)) << U(32)) + _reduced(low))
            out.append(mix(times(total, inverse[a]) + (z - a).astype(U) * _MUL))
        return out[0], out[1]
