"""Shingle sets and their parity sketches (numpy, one text at a time).

A sketch has a 64-bit word per block, the XOR of one word per shingle of the
block: 24 parity bits, of which each shingle flips one, and 40 bits of its hash.
Shingles in both of two sets cancel out in the difference, so the Hamming
distance of the parity bits is at most the size of the symmetric difference. The
other bits tell apart the blocks that few flips would not.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np

U = np.uint64
_GOLD, _M1, _M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)  # fixed values: splitmix64
_BASE = U(0xD1342543DE82EF95)
_WS = np.zeros(256, bool)
_WS[[32, *range(9, 14)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
PIECE = 1 << 20
_powers = np.ones(1, U)


def mix(x: np.ndarray) -> np.ndarray:
    x = x + _GOLD
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, at least."""
    global _powers
    if len(_powers) < n:
        size = max(64, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, _BASE, U)]))
    return _powers


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text, cut into pieces between words to bound memory."""
    out, at = [], 0
    while at < len(data):
        to = min(len(data), at + PIECE)
        while to < len(data) and not _WS[data[to]]:
            to += 1
        b = np.frombuffer(data, np.uint8, to - at, at)
        word = np.concatenate([[False], ~_WS[b], [False]])
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, lens = edges[::2], edges[1::2] - edges[::2]
        if len(starts):
            ends = np.cumsum(lens)
            place = np.arange(ends[-1]) - np.repeat(ends - lens, lens)
            x = (b[word[1:-1]].astype(U) + U(1)) * powers(int(lens.max()))[place]
            out.append(mix(np.add.reduceat(x, ends - lens) + lens.astype(U) * _GOLD))
        at = to
    return np.concatenate(out) if out else np.empty(0, U)


def shingles(text: str | None, width: int = 3) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of a text; the whole
    sequence is one shingle if it has fewer words; none without words."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not len(w):
        return w
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, k, U)
    for i in range(k):
        h = mix(h * _M1 + w[i:len(w) - k + 1 + i])
    return np.unique(h)


def node(hashes: np.ndarray) -> int:
    """The number of a set, the same for equal sets: 62 bits of a digest."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little") >> 2


class Bands:
    """Size bands for a Jaccard threshold of ``num / den``: a set of band k and
    the larger partner it may link to lie in the bands k and k + 1."""

    def __init__(self, num: int = 90, den: int = 100):
        self.num, self.den = num, den
        self.low = [1]

    def _reach(self, n: int, k: int) -> None:
        while self.low[-1] <= n or len(self.low) <= k + 1:
            self.low.append(self.low[-1] * self.den // self.num + 1)

    def band(self, n: int) -> int:
        self._reach(n, 0)
        return bisect_right(self.low, n) - 1

    def blocks(self, k: int) -> tuple[int, int]:
        """Blocks of the sketches that sets of band k share with their larger
        partners, and how many blocks more than the distance asks for."""
        self._reach(0, k)
        top = self.low[k + 1] - 1
        most = (top + top * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        if not most:
            return 0, 0  # only equal sets link
        spare = 3 + (most + 1) // 16
        return most + 1 + spare, spare


PARITY_BITS = 24
PARITY = U((1 << PARITY_BITS) - 1)


def sketch(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """The words of the sketch of sorted hashes; 0 for a block without shingles."""
    words = np.zeros(blocks, U)
    block = ((hashes >> U(32)) * U(blocks)) >> U(32)  # ascending, like the hashes
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    flips = U(1) << ((hashes & U(0xFFFFFF)) % U(PARITY_BITS))
    words[block[first].astype(np.int64)] = np.bitwise_xor.reduceat((mix(hashes) & ~PARITY) | flips, first)
    return words


def key_words(hashes: np.ndarray, bands: Bands, down: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The words, their blocks, the band, and how many words more than one a link
    shares at least, of the sketch for the own band or the one below (``down`` 1),
    without the empty words that may be left out."""
    band = bands.band(len(hashes)) - down
    blocks, spare = bands.blocks(band) if band >= 0 else (0, 0)
    if not blocks:
        return np.empty(0, U), np.empty(0, U), 0, 0
    words = sketch(hashes, blocks)
    at = np.flatnonzero(words)
    if blocks - len(at) > spare:
        at = np.arange(blocks)
    return words[at], at.astype(U), band, spare - (blocks - len(at))


def parity_bits(hashes: np.ndarray, bands: Bands, down: int) -> bytes:
    """The parity bits, 3 bytes per block, of the sketch for the own band or the one below."""
    band = bands.band(len(hashes)) - down
    blocks, _ = bands.blocks(band) if band >= 0 else (0, 0)
    words = sketch(hashes, blocks) & PARITY if blocks else np.empty(0, U)
    return words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PARITY_BITS // 8].tobytes()
