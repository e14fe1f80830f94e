"""Words of Arrow string columns as 64-bit hashes, computed over whole batches without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
BLOCK = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole hash."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_LETTER = mix((np.arange(256, dtype=U) + U(1)) * U(_BASE))
_POWERS = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, grown on demand."""
    if len(_POWERS[0]) < n:
        m = max(n, BLOCK + 1)
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(m, U(b))
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0][:n], _POWERS[1][:n]


@dataclass(frozen=True)
class Alphabet:
    """Which bytes part words, and how the others are folded."""

    separator: np.ndarray
    fold: np.ndarray

    @staticmethod
    def of(separators: bytes, lower: bool) -> Alphabet:
        sep, fold = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
        sep[list(separators)] = True
        if lower:
            fold[65:91] += 32
        return Alphabet(sep, fold)


WHITE = bytes([*range(0x09, 0x0E), 0x20])
EXACT = Alphabet.of(WHITE, lower=False)
FOLDED = Alphabet.of(WHITE, lower=True)
# After folding A-Z, words are runs of 0-9, a-z and bytes of characters beyond ASCII.
ALNUM = Alphabet.of(bytes(b for b in range(128) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)), lower=True)


@dataclass
class Words:
    """Words of the texts lo..hi of a batch: hash, first byte, byte after the last, and word offsets by text."""

    lo: int
    hi: int
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    def of(self, i: int) -> slice:
        return slice(int(self.offsets[i - self.lo]), int(self.offsets[i - self.lo + 1]))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8) if n else np.zeros(1, np.int64)
    buf = col.buffers()[2] if n else None
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def split_words(data: np.ndarray, breaks: np.ndarray, alpha: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word in data; no word crosses a position in ``breaks``."""
    n, pos, parts = len(data), 0, []
    while pos < n:
        end = min(pos + BLOCK, n)
        if end < n:  # cut where a word ends, so that no word is split
            back = np.flatnonzero(alpha.separator[data[pos:end]])
            if len(back):
                end = pos + int(back[-1]) + 1
            else:
                while end < n and not alpha.separator[data[end]]:
                    end += 1
        d = data[pos:end]
        word = ~alpha.separator[d]
        before, after = np.empty_like(word), np.empty_like(word)
        before[0], before[1:], after[-1], after[:-1] = False, word[:-1], False, word[1:]
        cut = breaks[(breaks > pos) & (breaks < end)] - pos
        before[cut], after[cut - 1] = False, False
        s, e = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        up, down = _powers(len(d) + 1)
        total = np.zeros(len(d) + 1, U)
        np.cumsum(_LETTER[alpha.fold[d]] * up[:-1], out=total[1:])
        parts.append((mix((total[e] - total[s]) * down[s]), s + pos, e + pos))
        pos = end
    if not parts:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def batches_of_words(col: pa.Array, alpha: Alphabet, limit: int = BLOCK) -> Iterator[Words]:
    """Words of a batch's texts in slices of whole texts of about ``limit`` bytes each, so memory stays bounded."""
    data, off = text_bytes(col)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        part, o = data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        h, s, e = split_words(part, o, alpha)
        yield Words(lo, hi, h, s, e, np.searchsorted(s, o), part)
        lo = hi


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive hashes (positions that cross a text's end are the caller's to drop)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.zeros(n, U)
    for j in range(k):
        total += hashes[j:j + n] * U((2 * j + 1) * _BASE % (1 << 64))
        total ^= total >> U(29)
    return mix(total)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Like grams for long windows: one pass of running sums instead of k passes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = _powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[:-1], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n])
