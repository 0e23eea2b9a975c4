"""Words, word hashes and small array helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

#: A words memo is emptied when it holds this many entries, so its memory is bounded; results do not depend on it.
MEMO_WORDS = 800_000
#: What empties the memos that this Python worker keeps from task to task.
KEPT: list[Callable[[], None]] = []

ODD = np.uint64(0x9E3779B97F4A7C15)


def kept(cached):
    """A cached function whose results outlive a task, until a task of another operator calls ``release_kept``."""
    KEPT.append(cached.cache_clear)
    return cached


def release_kept() -> None:
    """Spark hands an idle Python worker on to the next job, and with it the memory of what the last operator kept there."""
    for clear in KEPT:
        clear()


def ascii_words(text: str | None, table: bytes | None = None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` in UTF-8, their bytes replaced by ``table`` if there is one; ``bytes.split`` cuts at
    exactly those six bytes."""
    return text.encode("utf-8", "surrogatepass").translate(table).split() if text else []


class WordHashes(dict):
    """Word to 64-bit hash, computed once per distinct word while no more than ``most`` are held."""

    def __init__(self, most: int = MEMO_WORDS):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of every run of ``length`` consecutive words; empty where the text is shorter."""
    count = len(hashes) - length + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for i in range(length):
        total = total * ODD + hashes[i:i + count]
    return mixed(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values, by doubling."""
    low, have = values, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``start, start+1, ...`` for every pair, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


class Grown:
    """An array that is added to at its end, with room kept for more."""

    def __init__(self, kind):
        self.room, self.size = np.empty(1 << 12, kind), 0

    def add(self, values) -> None:
        end = self.size + len(values)
        if end > len(self.room):
            self.room = np.concatenate([self.room[:self.size], np.empty(max(end, self.size), self.room.dtype)])
        self.room[self.size:end] = values
        self.size = end

    def __getitem__(self, at):
        return self.room[at]
