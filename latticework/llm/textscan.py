"""Vectorised scanning of texts as arrays of code points: classes, spans and hashes of spans."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Code points of one chunk; work arrays take some 60 bytes for each, and should fit in a cache.
CHUNK = 1 << 17
_LAST = 0x323B0  # beyond it lie only tags, variation selectors and private use
# The code points with the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_STEP = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    out = np.zeros(0x110000, np.uint8)
    category = unicodedata.category
    head = np.array([ord(category(chr(c))[0]) for c in range(_LAST)], np.uint8)
    out[:_LAST][head == ord("L")] = LETTER
    out[:_LAST][head == ord("N")] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


@functools.cache
def folded() -> np.ndarray:
    """The lower-case code point of every code point that has a single one."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x1E944):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


@functools.cache
def _random() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(_STEP))


@functools.cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points; it depends on the content alone."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _powers(max(10, int(len(cp) + 1).bit_length()))
    prefix = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(_random()[cp] * up[: len(cp)], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(_STEP)))


def runs(flag: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true flags; a run ends where a text starts."""
    if not len(flag):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.empty(len(flag), bool)
    first[0] = flag[0]
    first[1:] = flag[1:] & ~flag[:-1]
    heads = firsts[firsts < len(flag)]
    first[heads] = flag[heads]
    last = np.empty(len(flag), bool)
    last[-1] = flag[-1]
    last[:-1] = flag[:-1] & (~flag[1:] | first[1:])
    return np.flatnonzero(first), np.flatnonzero(last) + 1


_CUT = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n\t\r])")


#: A piece of a text without white space is this many limits long at most, if it may be cut elsewhere.
_FAR = 8


def split_long(text: str, limit: int = CHUNK, else_at: re.Pattern | None = None, anywhere: bool = False) -> Iterator[str]:
    """Pieces of a long text, cut where white space follows something else: no word or token spans a cut.

    Where there is no such place for long, the text is cut at the next match of `else_at`, or, if `anywhere`, just there: a run
    without white space of a million characters is then more than one word, the same ones in every equal text.
    """
    at = 0
    while len(text) - at > limit:
        near = at + _FAR * limit
        m = _CUT.search(text, at + limit, near + 1)
        if m:
            end = m.start()
        elif anywhere:
            end = near
        else:
            m = else_at and else_at.search(text, at + limit)
            m = _CUT.search(text, near, m.start() if m else len(text)) or m
            if not m:
                break
            end = m.start()
        if end >= len(text):
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


class Chunk:
    """Some whole texts, or pieces of long ones, end to end: rows says to which text each piece belongs."""

    def __init__(self, rows: list[int], parts: list[str]):
        self.rows = np.array(rows, np.int64)
        self.text = "".join(parts)
        self.cp = codepoints(self.text)
        self.bounds = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=self.bounds[1:])

    def row_of(self, at: np.ndarray) -> np.ndarray:
        """The text that each position lies in."""
        return self.rows[np.searchsorted(self.bounds, at, side="right") - 1]


def chunks(texts: list[str | None], limit: int = CHUNK, else_at: re.Pattern | None = None) -> Iterator[Chunk]:
    """All texts, in order, in chunks of about `limit` code points, with pieces as `split_long` cuts them (anywhere, if need be, without `else_at`); null counts as empty."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        for part in split_long(text, limit, else_at, else_at is None):
            if size and size + len(part) > limit:
                yield Chunk(rows, parts)
                rows, parts, size = [], [], 0
            rows.append(row)
            parts.append(part)
            size += len(part)
    if parts:
        yield Chunk(rows, parts)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all ranges [start, start + length), one after the other."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    if not total:
        return out
    ends = np.cumsum(lengths)
    out[0] = starts[0]
    out[ends[:-1]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)
