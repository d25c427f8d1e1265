"""Words and word hashes of many texts at once, on UTF-8 bytes.

A word is a maximal run of bytes other than ASCII white space
(0x20, 0x09-0x0D); a word never crosses texts.
"""

from __future__ import annotations

import functools

import numpy as np

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
#: Bytes whose running sums are taken at once.
STEP = 1 << 16
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """MULTIPLIER ** 0..n-1 modulo 2^64."""
    global _powers
    if len(_powers) < n:
        made = np.full(max(n, 2 * len(_powers), 256), MULTIPLIER & (2**64 - 1), np.uint64)
        made[0] = 1
        _powers = np.multiply.accumulate(made)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all others."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    black = ~WHITE[data]
    before = np.empty(len(black), bool)
    before[0] = False
    before[1:] = black[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = False
    after = np.empty(len(black), bool)
    after[-1] = False
    after[:-1] = black[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(black & ~before)
    ends = np.flatnonzero(black & ~after) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, "right")


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random odd number for each byte; powers of MULTIPLIER and their inverses
    modulo 2^64, so that differences of running sums are hashes of spans."""
    numbers = np.random.default_rng(5).integers(0, 2**63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    inverse = np.full(STEP + 1, pow(MULTIPLIER, -1, 2**64), np.uint64)
    inverse[0] = 1
    return numbers, powers(STEP + 1)[: STEP + 1], np.multiply.accumulate(inverse)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; the spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    numbers, power, inverse = _tables()
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + STEP, "right")))
        if ends[i] - base > STEP:  # one long span, piece by piece
            value, scale = np.uint64(0), np.uint64(1)
            with np.errstate(over="ignore"):
                for a in range(base, int(ends[i]), STEP):
                    block = data[a : min(a + STEP, int(ends[i]))]
                    value += scale * (numbers[block] * power[: len(block)]).sum(dtype=np.uint64)
                    scale *= power[STEP]
            out[i], i = value, i + 1
            continue
        block = data[base : ends[j - 1]]
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(numbers[block] * power[: len(block)], out=sums[1:])
        at = starts[i:j] - base
        out[i:j] = (sums[ends[i:j] - base] - sums[at]) * inverse[at]
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


class Finder:
    """Places of distinct 64-bit keys. A table holds one key for each slot; those
    that find theirs taken are in the next table."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two keys are equal")
        self.tables: list[tuple[np.ndarray, int, int]] = []
        left, shift = np.arange(len(keys)), 0
        while len(left):
            size = max(1 << 14, 1 << int(len(left) * 4 - 1).bit_length())
            slots = np.full(size, -1, np.int32)
            at = ((keys[left] >> np.uint64(shift)) & np.uint64(size - 1)).astype(np.int64)
            slots[at[::-1]] = left[::-1]
            self.tables.append((slots, shift, size - 1))
            left = left[slots[at] != left]
            shift = shift + 7 if shift < 40 else 0
            if len(self.tables) > 40:
                raise ValueError("the tables don't settle")

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        out = np.full(len(key), -1, np.int64)
        rest = None
        for slots, shift, mask in self.tables:
            own = key if rest is None else key[rest]
            at = slots[((own >> np.uint64(shift)) & np.uint64(mask)).astype(np.int64)]
            hit = (at >= 0) & (self.keys[at] == own)
            if rest is None:
                out[hit] = at[hit]
                rest = np.flatnonzero((at >= 0) & ~hit)
            else:
                out[rest[hit]] = at[hit]
                rest = rest[(at >= 0) & ~hit]
            if not len(rest):
                break
        return out


def shingles(word: np.ndarray, text: np.ndarray, n_texts: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words inside a text, and its text; a text
    with fewer words (but one at least) has one shingle of all its words."""
    count = np.bincount(text, minlength=n_texts)
    total = len(word)
    out, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if total >= size:
        value = np.zeros(total - size + 1, np.uint64)
        for k in range(size):
            value = value * np.uint64(MULTIPLIER) + word[k : total - size + 1 + k]
        whole = text[: total - size + 1] == text[size - 1 :]
        out, own = mix(value[whole]), text[: total - size + 1][whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.cumsum(count) - count
        more = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            there = count[short] > k
            more[there] = more[there] * np.uint64(MULTIPLIER) + word[first[short[there]] + k]
        out, own = np.concatenate([out, mix(more + count[short].astype(np.uint64))]), np.concatenate([own, short])
        order = np.argsort(own, kind="stable")
        out, own = out[order], own[order]
    return out, own
