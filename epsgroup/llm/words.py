"""Words and word runs of many texts at once, as 64-bit hashes, for use inside tasks.

Words are runs of bytes other than space and \\t..\\r; A-Z count as a-z. A hash stands for its word: among a billion
different words two share one with a probability of 3 %, and then count as the same word.
"""

import numpy as np

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts, limit: int = SLICE_BYTES, table: bytes | None = LOWER):
    """(first, texts as bytes, lowered by default) for runs of rows of about `limit` bytes; a null text is empty."""
    first, size, out = 0, 0, []
    for row in range(len(texts)):
        scalar = texts[row]
        text = scalar.as_buffer().to_pybytes().translate(table) if scalar.is_valid else b""
        out.append(text)
        size += len(text)
        if size >= limit:
            yield first, out
            first, size, out = row + 1, 0, []
    if out:
        yield first, out


def hashed(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of a buffer that ends with a space."""
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    long = ends - starts
    of = np.concatenate([[0], np.cumsum(long)])
    place = np.arange(of[-1]) - np.repeat(of[:-1], long)
    powers = np.cumprod(np.full(max(1, int(long.max(initial=0))), _STEP))
    terms = (buf[~space].astype(np.uint64) + np.uint64(1)) * powers[place]
    sums = np.add.reduceat(terms, of[:-1]) if len(starts) else np.zeros(0, np.uint64)
    return mix(sums ^ (long.astype(np.uint64) << np.uint64(48))), starts


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    hashes, starts = hashed(np.frombuffer(b" ".join(texts) + b" ", np.uint8))
    upto = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    return hashes, np.diff(upto, prepend=0)


def runs(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all runs of n words, number of runs of each text). Runs do not cross texts.

    A text with 1 to n-1 words has one run, all of it; without words it has none.
    """
    first = np.cumsum(counts) - counts
    has = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    of = np.cumsum(has) - has
    start = np.arange(has.sum()) - np.repeat(of, has) + np.repeat(first, has)
    left = np.repeat(counts, has) - (start - np.repeat(first, has))
    total = np.zeros(len(start), np.uint64)
    factor = np.uint64(1)
    for k in range(n):
        at = start + k
        there = left > k
        total += np.where(there, hashes[np.minimum(at, max(0, len(hashes) - 1))] if len(hashes) else 0, 0).astype(np.uint64) * factor
        factor = np.uint64((int(factor) * int(_STEP)) % (1 << 64))
    return mix(total + np.minimum(left, n).astype(np.uint64)), has
