"""Byte contexts of order 0 to ORDER counted over a whole corpus, and the code lengths that follow from them.

A gram is a symbol and the ORDER symbols before it as one number: the nearest of those in the highest byte, the symbol
itself in the lowest. The contexts of all orders are thus prefixes of grams, and sorted grams form a trie. A part owns
whole contexts of LOCAL bytes with all that is longer; the shorter ones have at most 256**LOCAL grams, whatever the corpus.
No context is left out and every byte is a symbol of its own; the end of a text is END, which no UTF-8 text holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from wayfold.llm._hashing import mix

SYMBOLS = 256
ORDER = 6
LOCAL = 3
END = 0xFF
_BITS = 8 * (ORDER + 1)
_CODEC = pa.Codec("zstd", compression_level=1)


def grams(raw: bytes) -> np.ndarray:
    """Of each byte and the end. Bytes 0xFF, which only broken UTF-8 holds, count as 0xFE."""
    n = len(raw) + 1
    s = np.full(n + ORDER, END, np.uint64)
    s[ORDER:-1] = np.minimum(np.frombuffer(raw, np.uint8), 0xFE)
    x = s[ORDER:].copy()
    for k in range(1, ORDER + 1):
        x |= s[ORDER - k : ORDER - k + n] << np.uint64(8 * (ORDER - k + 1))
    return x


def of_order(x: np.ndarray, k: int) -> np.ndarray:
    """The context of order k and the symbol of each gram."""
    return x >> np.uint64(_BITS - 8 * k) << np.uint64(8) | x & np.uint64(0xFF)


def by_part(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted grams by part, then value, and the bounds of the parts in it (parts + 1)."""
    part = mix(x >> np.uint64(_BITS - 8 * LOCAL)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))


def squeezed(v: np.ndarray) -> bytes:
    """The bytes of numbers by plane, which sorts the like ones together, compressed."""
    return len(v).to_bytes(4, "little") + _CODEC.compress(v.view(np.uint8).reshape(-1, v.itemsize).T.tobytes(), asbytes=True)


def restored(blob: bytes, kind: type) -> np.ndarray:
    size, width = int.from_bytes(blob[:4], "little"), np.dtype(kind).itemsize
    flat = np.frombuffer(_CODEC.decompress(blob[4:], decompressed_size=width * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, size).T).view(kind).ravel()


def packed(x: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted numbers as steps, and their counts."""
    steps = squeezed(np.diff(x, prepend=np.uint64(0)))
    return len(steps).to_bytes(4, "little") + steps + squeezed(n.astype(np.uint32))


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    end = 4 + int.from_bytes(blob[:4], "little")
    return np.cumsum(restored(blob[4:end], np.uint64), dtype=np.uint64), restored(blob[end:], np.uint32)


def summed(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen, at = np.unique(x, return_inverse=True)
    return seen, np.bincount(at, n, len(seen)).astype(np.int64)


def _log(x: np.ndarray) -> np.ndarray:
    return np.log10(np.where(x > 0, x, 1))


class _Counts:
    """The grams of one order with their counts, and what is coded or escaped at each of its contexts."""

    def __init__(self, x: np.ndarray, n: np.ndarray):
        self.grams, self.weight = x, 2.0 * n - 1
        self.edge = np.flatnonzero(np.diff(x >> np.uint64(8), prepend=np.uint64(2**63)))
        self.contexts = x[self.edge] >> np.uint64(8)
        self.distinct = np.diff(np.append(self.edge, len(x)))
        self.total = np.add.reduceat(self.weight, self.edge) if len(x) else np.zeros(0)
        self.alone = _step(self.total, self.distinct, np.full(len(self.edge), SYMBOLS))
        self.after: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))  # by longer context, whose symbols are excluded

    def exclude(self, longer: _Counts) -> None:
        if not len(longer.grams):
            return
        shorter = longer.grams >> np.uint64(16) << np.uint64(8) | longer.grams & np.uint64(0xFF)
        gone = np.add.reduceat(self.weight[np.searchsorted(self.grams, shorter)], longer.edge)
        at = np.searchsorted(self.contexts, longer.contexts >> np.uint64(8))
        self.after = _step(self.total[at] - gone, self.distinct[at] - longer.distinct, SYMBOLS - longer.distinct)


def _step(total: np.ndarray, distinct: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of what counts are divided by, and of the escape's probability; no escape if no symbol is left for it."""
    escape = np.where(distinct < left, distinct, 0)
    bottom = _log(np.where(total > 0, total + escape, 1))
    return bottom, np.where((total > 0) & (escape > 0), _log(escape) - bottom, 0)


def _find(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each value, or -1."""
    if not len(sorted_):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return np.where(sorted_[at] == x, at, -1)


def code_lengths(asked: np.ndarray, x: np.ndarray, n: np.ndarray, short: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of the probability of each asked gram's symbol after its context.

    ``x`` and ``n``: the training texts' grams and counts in every context of LOCAL bytes that is asked for; ``short``:
    the grams of order LOCAL - 1 and counts of all training texts. Both are sorted and without zeros.
    """
    tables = [_Counts(*summed(of_order(x, k), n)) if k >= LOCAL else _Counts(*summed(short[0] >> np.uint64(8 * (LOCAL - k)) << np.uint64(8) | short[0] & np.uint64(0xFF), short[1])) for k in range(ORDER + 1)]
    for k in range(ORDER):
        tables[k].exclude(tables[k + 1])
    value, rest = np.zeros(len(asked)), np.arange(len(asked))
    escaped, longer = np.zeros(len(asked)), np.full(len(asked), -1)  # of the rest: escapes so far, and the place of its longer context
    for k in range(ORDER, -1, -1):
        t = tables[k]
        if not len(t.grams):
            continue
        key = of_order(asked[rest], k)
        gram, context = _find(t.grams, key), _find(t.contexts, key >> np.uint64(8))
        alone = longer < 0
        bottom, escape = (np.where(alone, a[np.maximum(context, 0)], b[np.maximum(longer, 0)] if len(b) else 0) for a, b in zip(t.alone, t.after, strict=True))
        hit = gram >= 0
        value[rest[hit]] = escaped[hit] + np.log10(t.weight[gram[hit]]) - bottom[hit]
        escaped = (escaped + np.where(context >= 0, escape, 0))[~hit]
        rest, longer = rest[~hit], context[~hit]
    used = int(tables[0].distinct.sum())
    value[rest] = escaped - np.log10(max(SYMBOLS - used, 1))
    return value
