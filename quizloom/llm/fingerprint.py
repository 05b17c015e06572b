"""SimHash fingerprints of whole texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
#: Reference fingerprints.
PIVOTS = 16


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The XXH64 of each run of `width` words, repeats included; a shorter text is one run, and one without words has none.

    A-Z are lowered, words are runs of anything but ASCII white space, and the words of a run are joined by one space.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1)
    starts = (ends[: -width + 1 or None] - lengths[: -width + 1 or None] - 1).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))


def simhash_of(hashes: np.ndarray) -> int:
    """The SimHash of 64-bit hashes, of few of them at a time: a bit is set if over half of them have it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash(text: str | None, width: int = 4) -> int:
    """The 64-bit SimHash of a text as an unsigned integer.

    A bit is set if over half of the hashes of the text's shingles, repeats included, have it. A text without words, or
    NULL, has fingerprint 0, and one of a single shingle that shingle's hash.
    """
    hashes = shingle_hashes(text, width)
    if len(hashes) <= 1:
        return int(hashes.sum())
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, width: int = 4) -> Column:
    """The SimHash as a signed long, computed in Arrow batches."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, width) for t in texts], np.uint64).view(np.int64))

    return of(text)


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def pivot_fingerprints(count: int = PIVOTS) -> list[int]:
    """Reference fingerprints: the XXH64 of 0, 1, 2, ..."""
    return [signed(xxhash.xxh64_intdigest(str(i), SEED)) for i in range(count)]
