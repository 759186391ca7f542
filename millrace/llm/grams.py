"""Word hashes and gram hashes of whole texts as numpy arrays, for the Python workers."""

from __future__ import annotations

import numpy as np
import xxhash

from millrace.llm.common import ship_by_value, worker_cache

_MAX_KNOWN = 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TURN, _MIX = np.uint64(29), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """64-bit hashes of words; a word is hashed once while the table holds it."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= _MAX_KNOWN:
            self.clear()
        self[word] = value
        return value


def word_hashes(words: list[bytes]) -> np.ndarray:
    cache = worker_cache()
    known = cache.get("word_hashes")
    if known is None:
        known = cache["word_hashes"] = WordHashes()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def other_hashes(h: np.ndarray) -> np.ndarray:
    """Word hashes mixed anew, one to one, so that runs of them have hashes independent of those of runs of `h`."""
    x = (h ^ (h >> np.uint64(31))) * _MIX
    return (x ^ (x >> np.uint64(27))) * _ODD


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two sequences one after the other, from their hashes; the order counts."""
    x = (a ^ (a >> _TURN)) * _ODD + (b ^ (b >> np.uint64(32))) * _MIX
    return x ^ (x >> _TURN)


def gram_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of `length` words, by doubling: a run of 2k is two runs of k, an odd rest overlaps."""
    if len(h) < length:
        return np.empty(0, np.uint64)
    done, g = 1, h
    while 2 * done <= length:
        g = joined(g[:-done], g[done:])
        done *= 2
    if done < length:
        shift = length - done
        g = joined(g[:-shift], g[shift:])
    return g


ship_by_value(__name__)
