"""Words of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

_RNG = np.random.default_rng(20_240_601)
#: A random 64-bit value for each byte; a word's hash is the sum of its bytes' values times odd powers by place, then mixed.
BYTE = _RNG.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
POWER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Alphabet:
    """Which bytes stand inside words, and every byte with A-Z as a-z."""

    inside: np.ndarray
    lower: np.ndarray


def alphabet(kept: Sequence[int]) -> Alphabet:
    inside = np.zeros(256, bool)
    inside[list(kept)] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    return Alphabet(inside, lower)


#: Words of digits, letters and everything beyond ASCII.
ALNUM = alphabet([*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(0x80, 0x100)])
#: Words between white space (space, tab to carriage return); U+0000 is a character like others.
SPACED = alphabet([b for b in range(256) if b not in {0x20, *range(0x09, 0x0E)}])


@dataclass
class Words:
    hashes: np.ndarray  # of each word, all texts in a row
    bounds: np.ndarray  # of text i: hashes[bounds[i]:bounds[i + 1]]


#: Bytes worked on at a time: a long text's arrays are no larger than those of this many bytes.
SLICE = 8_000_000


def sizes_of(texts: Sequence[str | None], kept: Alphabet) -> np.ndarray:
    """The number of words of each text; none for None."""
    raws = [b"" if t is None else t.encode() for t in texts]
    inside = kept.inside[np.frombuffer(b"\n" + b"\n".join(raws) + b"\n", np.uint8)]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    return np.diff(np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)]))) if raws else np.zeros(0, np.int64)


def words_of(texts: Sequence[str | None], kept: Alphabet) -> Words:
    """The lower-cased words of each text; none for None. Texts of any length are hashed in slices; a word across two is their sum."""
    raws = [b"" if t is None else t.encode() for t in texts]
    lengths = np.fromiter((len(r) + 1 for r in raws), np.int64, len(raws))
    raw = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8) if raws else np.zeros(0, np.uint8)
    sums, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    before = (np.uint64(0), 0, 0)  # the sum, size and start of a word that the last slice began
    for left in range(0, len(raw), SLICE):
        inside, data = kept.inside[raw[left : left + SLICE]], kept.lower[raw[left : left + SLICE]]
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        begin, sizes = edges[::2], edges[1::2] - edges[::2]
        if not len(begin):
            found, begin = np.zeros(0, np.uint64), begin.astype(np.int64)
        else:
            at = np.flatnonzero(inside)
            first = np.cumsum(sizes) - sizes
            place = np.arange(len(at), dtype=np.int32) - np.repeat(first, sizes).astype(np.int32)
            powers = np.multiply.accumulate(np.full(int(sizes.max()), POWER, np.uint64))
            found, begin = np.add.reduceat(BYTE[data[at]] * powers[place], first), begin + left
        total, size, start = before
        if size and len(begin) and begin[0] == left:
            found[:1] = found[:1] * np.uint64(pow(int(POWER), size, 2**64)) + total
            sizes[0], begin[0] = sizes[0] + size, start
        elif size:
            found, begin, sizes = np.append(total, found), np.append(start, begin), np.append(size, sizes)
        before = (np.uint64(0), 0, 0)
        if len(inside) and inside[-1]:
            before, found, begin = (found[-1], int(sizes[-1]), int(begin[-1])), found[:-1], begin[:-1]
        sums.append(found)
        starts.append(begin)
    every = np.concatenate(starts)
    return Words(mix(np.concatenate(sums)), np.concatenate(([0], np.searchsorted(every, np.cumsum(lengths)))).astype(np.int64))
