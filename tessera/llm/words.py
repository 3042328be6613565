"""Words of texts as hashes, made for all texts of an Arrow batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes that separate words: white space and ASCII punctuation.
SEPARATES = np.array([b <= 32 and (b == 32 or 9 <= b <= 13) or 33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127 for b in range(256)])
#: Longer words are hashed one by one.
LONG = 32
#: Bytes of texts that are taken apart at once; a longer text is taken by itself.
HELD_BYTES = 1 << 22
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, which differs with their order."""
    return mixed(a * FACTOR + b)


def stretches(inside: np.ndarray, edges: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, lengths)`` of the runs of bytes ``inside`` words; none goes on over one of ``edges``."""
    before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    if edges is not None:
        before[edges[edges < len(inside)]] = False
        after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1 - starts


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)


def hashed(octets: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each stretch of bytes; those of one length are gone through together, byte by byte."""
    order = np.argsort(-np.minimum(lengths, LONG + 1), kind="stable")
    ordered = lengths[order]
    at, h = starts[order], ordered.astype(np.uint64) ^ np.uint64(seed)
    longer = int(np.searchsorted(-ordered, -LONG, "left"))
    for j in range(min(LONG, int(ordered[0])) if len(ordered) else 0):
        upto = int(np.searchsorted(-ordered, -j, "left"))
        h[:upto] = (h[:upto] ^ octets[at[:upto] + j]) * FACTOR
        h[:upto] ^= h[:upto] >> np.uint64(29)
    for i in range(longer):
        h[i] = xxhash.xxh64_intdigest(octets[at[i] : at[i] + ordered[i]].tobytes(), seed)
    out = np.empty_like(h)
    out[order] = mixed(h)
    return out


def words_of_batch(texts: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, hashes, rows)`` of stretches of a batch: the hashes of all words in order, and the row, from the first, of each.

    Texts are lower-cased before; what ``SEPARATES`` parts the words. There are no nulls.
    """
    wide = texts.cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)
    out, low = [], 0
    while low < len(wide):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + HELD_BYTES, "right")) - 1)
        own = offsets[low : high + 1] - offsets[low]
        octets = data[offsets[low] : offsets[high]]
        inside = ~SEPARATES[octets]
        starts, lengths = stretches(inside, own)
        out.append((low, hashed(octets, starts, lengths), np.searchsorted(own, starts, "right") - 1))
        low = high
    return out


def words_of_text(text: str) -> np.ndarray:
    """The hashes of one lower-cased text's words."""
    return np.concatenate([np.zeros(0, np.uint64), *(h for _, h, _ in words_of_batch(pa.array([text])))])


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where n-grams start that lie within a row, and their hashes."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = len(hashes) - n + 1
    made = hashes[:last]
    for k in range(1, n):
        made = joined(made, hashes[k : last + k])
    at = np.flatnonzero(rows[:last] == rows[n - 1 :])
    return at, made[at]
