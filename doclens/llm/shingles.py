"""Word shingles of whole texts as 64-bit hashes, computed on arrays.

Words are maximal runs of bytes outside the six ASCII white-space bytes, after
A-Z were lower-cased.  A word's hash is a polynomial over its bytes modulo
2**64, read off running sums so that a whole batch of texts is hashed without a
loop over words; a shingle's hash mixes those of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Odd, so it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of one pass over a batch of texts: bounds the memory of a worker.
BATCH_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the number of words of each text."""
    joined = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = ~_SPACE[joined]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(joined) + 1)
    sums = np.empty(len(joined) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts])
    closes = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, closes)
    return words, np.diff(upto, prepend=0)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; a text with fewer words gives its whole sequence as one."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    if len(words) >= size:
        whole = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            whole = mix(whole * np.uint64(3) + words[k : len(words) - size + 1 + k])
    else:
        whole = words[:0]
    out = []
    for n, end in zip(counts.tolist(), ends.tolist()):
        if n >= size:
            out.append(np.unique(whole[end - n : end - size + 1]))
        elif n:
            one = np.uint64(n)
            for w in words[end - n : end]:
                one = mix(np.atleast_1d(one * np.uint64(3) + w))[0]
            out.append(np.atleast_1d(one))
        else:
            out.append(words[:0])
    return out


def in_batches(texts: Iterable[bytes], limit: int = BATCH_BYTES):
    """Consecutive runs of texts of about `limit` bytes; a longer text is a run of its own."""
    run, held = [], 0
    for t in texts:
        if run and held + len(t) > limit:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t)
    if run:
        yield run
