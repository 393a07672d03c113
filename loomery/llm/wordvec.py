"""Text columns as numpy arrays: words, code points and rolling 64-bit hashes of whole batches.

Texts stay in the flat buffer that Arrow hands over; nothing here loops over characters or words
in Python. Byte-level work runs in blocks of ``BLOCK`` bytes, so one very long text needs a few
bytes of memory a byte of text, not a few words of memory.

Hashes are 64-bit polynomials over random byte values, finished by a mixer. Two different words
share one with a probability near 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over 64 output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_P, _Q = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_PINV, _QINV = pow(_P, -1, 1 << 64), pow(_Q, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_pow_cache: dict[tuple[int, int], np.ndarray] = {}

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the largest n seen up to a block."""
    size = max(BLOCK + 1, 1 << (n - 1).bit_length()) if n else 1
    key = (base, size)
    if key not in _pow_cache:
        if size > BLOCK + 1:
            return _powers(base, n)
        _pow_cache[key] = _powers(base, size)
    return _pow_cache[key][:n]


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty. No copy where Arrow allows it."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32, count=texts.offset + len(texts) + 1)[texts.offset :] if len(texts) else np.zeros(1, np.int32)
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if len(texts) and buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``limit`` bytes together, at least one text each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a run of texts: byte spans, and how many each text has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = SPACE):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        solid = ~space[self.data]
        n = len(solid)
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], before[1:] = False, solid[:-1]
            after[-1], after[:-1] = False, solid[1:]
            cut = offsets[(offsets > 0) & (offsets < n)]
            before[cut], after[cut - 1] = False, False
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets[:-1])  # each text's first word
        self.first = np.append(self.first, len(self.starts))
        self.counts = np.diff(self.first)
        self.solid = solid

    def docs(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def texts(self, which: np.ndarray) -> list[bytes]:
        data = self.data.tobytes()
        return [data[a:b] for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist())]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each values[start:end]; spans ascend and do not overlap."""
    out = np.empty(len(starts), dtype=U64)
    i, n = 0, len(starts)
    inv_all = powers(_PINV, BLOCK)
    while i < n:
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        if int(ends[i]) - base > BLOCK:  # one span longer than a block: sum it up by blocks
            total, off = 0, 1
            for a in range(base, int(ends[i]), BLOCK):
                part = values[a : min(a + BLOCK, int(ends[i]))]
                total = (total + int((table[part] * powers(_P, len(part))).sum(dtype=U64)) * off) % (1 << 64)
                off = off * pow(_P, len(part), 1 << 64) % (1 << 64)
            out[i] = total
            i += 1
            continue
        part = table[values[base : int(ends[j - 1])]]
        part *= powers(_P, len(part))
        sums = np.empty(len(part) + 1, dtype=U64)
        sums[0] = 0
        np.cumsum(part, out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * inv_all[s]
        i = j
    return mix64(out ^ (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


def window_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every window of ``width`` consecutive words that stays in one text."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    starts = np.arange(n - width + 1)
    stop = np.repeat(first[1:], np.diff(first))  # where each word's text ends
    starts = starts[starts + width <= stop[: n - width + 1]]
    out = np.empty(len(starts), dtype=U64)
    inv = powers(_QINV, BLOCK)
    for a in range(0, len(starts), BLOCK // 2):
        s = starts[a : a + BLOCK // 2]
        base, top = int(s[0]), int(s[-1]) + width
        step = BLOCK - width
        b = 0
        while b < len(s):  # starts may leave gaps between texts
            base = int(s[b])
            e = int(np.searchsorted(s, base + step, "right"))
            top = int(s[e - 1]) + width
            part = words[base:top] * powers(_Q, top - base)
            sums = np.empty(len(part) + 1, dtype=U64)
            sums[0] = 0
            np.cumsum(part, out=sums[1:])
            rel = s[b:e] - base
            out[a + b : a + e] = (sums[rel + width] - sums[rel]) * inv[rel]
            b = e
    return starts, mix64(out)


# Code points -------------------------------------------------------------------------------

LETTER, NUMBER, OTHER, BLANK = 1, 2, 0, 3
#: The characters with the White_Space property. Fixed values.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: np.ndarray | None = None
_cp_random: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    global _classes
    if _classes is None:
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.zeros(0x110000, dtype=np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(m[0][0]), ord(m[0][-1])
                table[a : b + 1] = kind
        table[WHITE] = BLANK
        _classes = table
    return _classes


def cp_random() -> np.ndarray:
    global _cp_random
    if _cp_random is None:
        _cp_random = mix64(np.arange(1, 0x110001, dtype=U64) * U64(0xC2B2AE3D27D4EB4F))
    return _cp_random


def _contractions(cps: np.ndarray, kind: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
    """Moves token starts where 's 't 're 've 'm 'll 'd begins a token. stop: each position's text end."""
    at = np.flatnonzero((cps == 39) & start)
    if not len(at):
        return
    padded = np.append(cps, [0, 0])
    left = stop[at] - at
    one, two = padded[at + 1], padded[at + 2]
    short = np.isin(one, [115, 116, 109, 100]) & (left >= 2)
    long = (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)) & (left >= 3)
    for mask, size in ((short, 2), (long & ~short, 3)):
        a = at[mask]
        start[a + 1] = False
        inner = a[a + size < stop[a]] + size
        inner = inner[kind[inner] == LETTER]
        start[inner] = True


def pretokens(cps: np.ndarray, offsets: np.ndarray, lead_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Token spans of two public splitting patterns over code points.

    lead_space: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``, where
    every character is in a token. Otherwise the same contractions, ``\\p{L}+``, single ``\\p{N}`` and
    ``[^\\s\\p{L}\\p{N}]+``, where white space is in none.
    """
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[cps]
    start = np.empty(n, bool)
    start[0], start[1:] = True, kind[1:] != kind[:-1]
    edge = np.zeros(n, bool)
    edge[offsets[:-1][offsets[:-1] < n]] = True
    start |= edge
    stop = np.repeat(offsets[1:], np.diff(offsets))
    if lead_space:
        run = np.flatnonzero(start & (kind != BLANK) & ~edge)
        run = run[kind[run - 1] == BLANK]
        start[run - 1] = True
        start[run[cps[run - 1] == 32]] = False
        _contractions(cps, kind, start, stop)
        starts = np.flatnonzero(start)
        return starts, np.append(starts[1:], n)
    start |= kind == NUMBER
    _contractions(cps, kind, start, stop)
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    keep = kind[starts] != BLANK
    return starts[keep], ends[keep]


def ragged(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins values[offsets[w]:offsets[w+1]] for each w of which; with the length of each."""
    sizes = (offsets[1:] - offsets[:-1])[which]
    total = int(sizes.sum())
    begin = np.cumsum(sizes) - sizes
    index = np.repeat(offsets[:-1][which] - begin, sizes) + np.arange(total)
    return values[index], sizes
