"""Words and word shingles as 64-bit numbers, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_U = np.uint64


def _odd(n: int) -> list[np.uint64]:
    """n fixed odd multipliers."""
    return [_U(xxhash.xxh3_64_intdigest(f"multiplier {i}".encode()) | 1) for i in range(n)]


_SHIFT = _odd(128)
#: Multipliers of window_hashes(), for two independent hashes.
_WINDOW = (_SHIFT[64:96], _SHIFT[96:128])


def scramble(x: np.ndarray, turn: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no visible order; another one for each turn."""
    x = (x ^ (x >> _U(32))) * _SHIFT[2 * turn + 8]
    x = (x ^ (x >> _U(29))) * _SHIFT[2 * turn + 9]
    return x ^ (x >> _U(32))


#: Bytes hashed at once; longer texts are cut at white space, and only a longer word is taken whole.
PIECE = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A number per byte, 0 for white space; then with A-Z as a-z.
_CASED = np.array([xxhash.xxh3_64_intdigest(b"byte" + bytes([b])) for b in range(256)], np.uint64)
_CASED[_SPACE] = 0
_BYTES = _CASED.copy()
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
LONG_WORD = 32
_BASE = _U(0x9E3779B97F4A7C15 & ~7 | 5)  # 5 modulo 8: its powers repeat as late as any
_BACK = _U(pow(int(_BASE), -1, 1 << 64))
_powers = np.ones((2, 1), np.uint64)


def _powers_to(n: int) -> np.ndarray:
    """Powers 0 to n - 1 of the base and of its inverse."""
    global _powers
    if _powers.shape[1] < n:
        n = max(n, 1 << 16)
        steps = np.full((2, n), [[_BASE], [_BACK]], np.uint64)
        steps[:, 0] = 1
        _powers = np.multiply.accumulate(steps, axis=1)
    return _powers


def _hashes(raw: np.ndarray, fold: bool = True) -> np.ndarray:
    """One number per word of a text's bytes: a polynomial over its bytes, from running sums; of long words, an XXH3 hash."""
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = np.r_[[0] if inside[0] else [], edges, [len(raw)] if inside[-1] else []].astype(np.int64)
    starts, ends = edges[::2], edges[1::2]
    powers = _powers_to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_BYTES if fold else _CASED)[raw] * powers[0, : len(raw)], out=sums[1:])
    found = (sums[ends] - sums[starts]) * powers[1, starts]
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():  # there, polynomials modulo 2**64 have known collisions
        found[i] = xxhash.xxh3_64_intdigest((_LOWER[raw[starts[i] : ends[i]]] if fold else raw[starts[i] : ends[i]]).tobytes())
    return scramble(found, 9)


def word_hashes(text: str | None, fold: bool = True) -> np.ndarray:
    """One number per word: A-Z in lower case if fold, cut at the six ASCII white space characters."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) if text else np.zeros(0, np.uint8)
    if len(raw) <= PIECE:
        return _hashes(raw, fold) if len(raw) else np.zeros(0, np.uint64)
    found, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        if end < len(raw):
            gap = np.flatnonzero(_SPACE[raw[at:end]])
            if not len(gap):  # a word longer than a piece
                gap = np.flatnonzero(_SPACE[raw[end:]])
                end = end + int(gap[0]) if len(gap) else len(raw)
            else:
                end = at + int(gap[-1]) + 1
        found.append(_hashes(raw[at:end], fold))
        at = end
    return np.concatenate(found)


def shingle_hashes(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """One number per run of `width` words; fewer words are one shingle as a whole, none are none. May repeat."""
    n = len(words)
    if not n:
        return words
    if n < width:
        return scramble((words * np.array(_SHIFT[40 : 40 + n])).sum(keepdims=True, dtype=np.uint64) + _U(n), 1)
    total = words[: n - width + 1] * _SHIFT[0]
    for i in range(1, width):
        total = total + words[i : n - width + 1 + i] * _SHIFT[i]
    return scramble(total)


def window_hashes(words: np.ndarray, width: int, turn: int = 0) -> np.ndarray:
    """One number per run of `width` words, none for fewer words; independent ones for each turn, of two."""
    n = len(words) - width + 1
    if n <= 0:
        return words[:0]
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += words[i : n + i] * _WINDOW[turn][i % len(_WINDOW[turn])]
        if i % len(_WINDOW[turn]) == len(_WINDOW[turn]) - 1:
            total = scramble(total, 10)
    return scramble(total, 11 + turn)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles, sorted."""
    return np.unique(shingle_hashes(word_hashes(text), width))


def set_key(shingles: np.ndarray) -> int:
    """One number for a whole set."""
    total = scramble(shingles, 2).sum(dtype=np.uint64) + _U(len(shingles))
    return int(scramble(np.array([total]), 3)[0].astype(np.int64))
