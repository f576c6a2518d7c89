"""Hashed word shingles of whole texts, vectorised over batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import quiet_worker
from .tokens import word_list

_WHITE = bytes(range(9, 14))
#: Byte table: A-Z to a-z, and each of the white-space bytes to a space.
_TABLE = bytes(32 if c in _WHITE else c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Turns texts into sorted sets of 64-bit shingle hashes.

    Words are runs of other than space and \\t to \\r, with A-Z lower-cased. A
    text of fewer words than a shingle has its whole sequence as one shingle; a
    null text or one without words has none.
    """

    def __init__(self, words: int = 5) -> None:
        quiet_worker()
        self.words = words

    @staticmethod
    def _hashes(words: list[str]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def raw(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' shingle hashes, repeated ones included, in order, and where each text's begin (one more than texts)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        body = data.to_pybytes()[offsets[0] : offsets[-1]].translate(_TABLE) if data is not None else b""
        clean = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer((offsets - offsets[0]).astype(np.int64).tobytes()), pa.py_buffer(body)])
        parts = pc.split_pattern(clean, " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        flat = parts.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        distinct = word_list(flat.dictionary)
        codes = flat.indices.to_numpy()
        real = np.fromiter((w != "" for w in distinct), bool, len(distinct))[codes] if len(codes) else np.zeros(0, bool)
        h = self._hashes(distinct)[codes[real]] if len(codes) else np.zeros(0, np.uint64)
        counts = np.concatenate([[0], np.cumsum(real)])[bounds]  # words before each text
        k, n = self.words, np.diff(counts)
        made = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        begin = np.concatenate([[0], np.cumsum(made)])
        out = np.zeros(begin[-1], np.uint64)
        if len(h) >= k:
            rolling = np.zeros(len(h) - k + 1, np.uint64)
            for j in range(k):
                rolling = rolling * _STEP + h[j : len(h) - k + 1 + j]
            long = n >= k
            at = np.repeat(counts[:-1][long] - (np.cumsum(made[long]) - made[long]), made[long]) + np.arange(made[long].sum())
            where = np.repeat(begin[:-1][long] - (np.cumsum(made[long]) - made[long]), made[long]) + np.arange(made[long].sum())
            out[where] = rolling[at]
        for i in np.flatnonzero((n > 0) & (n < k)):
            x = np.uint64(n[i])
            for w in h[counts[i] : counts[i + 1]]:
                x = np.uint64((int(x) * int(_STEP) + int(w)) & (2**64 - 1))
            out[begin[i]] = ~x
        return mixed(out), begin

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's sorted distinct shingle hashes."""
        values, begin = self.raw(texts)
        return [np.unique(values[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
