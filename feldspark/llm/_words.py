"""Words of a text and hashes of runs of them."""

from __future__ import annotations

import numpy as np
import xxhash

#: Hashes of words that a worker keeps.
WORDS = 300_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()


def forget() -> None:
    _HASHES.clear()


ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """Words as UTF-8: A-Z in lower case, parted by ASCII white space."""
    return text.encode("utf-8").lower().split() if text else []


def codes(found: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))


def runs(code: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n words, by the words' codes; fewer words than n: none."""
    size = max(0, len(code) - n + 1)
    out = np.full(size, n, np.uint64)
    for k in range(n):
        out = mix(out * ODD + code[k : k + size])
    return out
