"""Numpy helpers for word shingles, used inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
CACHE = 50_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * ODD[0]
    x = (x ^ (x >> np.uint64(29))) * ODD[1]
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hash of a word (bytes); emptied when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, as `WordHashes` has them for `split_words`, and where each text's end; a word is hashed once."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words = parts.flatten().dictionary_encode()
    values = np.fromiter(map(xxhash.xxh64_intdigest, words.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(words.dictionary))
    slots, ends = words.indices.to_numpy(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
    there = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)  # beside white space at an end
    if not there.all():
        there = there[slots]
        slots, ends = slots[there], np.append(0, np.cumsum(there))[ends]
    return values[slots], ends[1:].astype(np.int64)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` words, in order; of all words together where there are fewer."""
    if not len(hashes):
        return hashes
    width_here = min(width, len(hashes))
    n = len(hashes) - width_here + 1
    out = np.full(n, width_here, np.uint64)
    for k in range(width_here):
        out = mix(out * ODD[2] + hashes[k : k + n])
    return out


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    return np.unique(windows(hashes, width))
