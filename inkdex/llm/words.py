"""Words of texts as 64-bit hashes, and hashes of their runs, for a whole batch at once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd

#: A Han character, or a run of other letters and digits.
WORD = re.compile("[一-鿿]|[^\\W_一-鿿]+")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose outputs look random (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    """The words of a text, caseless; none for a null or empty text."""
    return WORD.findall(text.casefold()) if text else []


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts in order, and the index of each word's text."""
    words = [words_of(t) for t in texts]
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    codes, values = pd.factorize(np.array([w for x in words for w in x], dtype=object))
    return (pd.util.hash_array(values, categorize=False).astype(np.uint64) if len(values) else np.zeros(0, np.uint64))[codes], owner


def runs(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the run of ``size`` words at each place, and whether it lies within one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return out, owner[:n] == owner[size - 1 :]


def blocks(texts: list[str | None], chars: int) -> Iterator[tuple[int, int]]:
    """Slices (begin, end) of the texts with about so many characters each, or one longer text: bounds a task's memory."""
    begin, total = 0, 0
    for k, t in enumerate(texts):
        total += len(t) if t else 0
        if total >= chars:
            yield begin, k + 1
            begin, total = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
