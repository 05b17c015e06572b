"""Packing of token sequences into windows of several context sizes."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import UNUSUAL, blocks, missing_at, vocabulary_path

TIERS = (2048, 1024, 512, 256, 128, 64)
END_ID = 1
#: Tokens that are packed together before windows are closed, and tokens of a step group.
POOL_TOKENS, STEP_TOKENS = 2_000_000, 65_536
#: So many distinct words are remembered in each Python worker.
MEMORY_WORDS = 300_000

#: The fixed pattern by which byte-level vocabularies of this kind split text before merging.
PIECE = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+""")
#: The same on texts of plain characters.
PLAIN_PIECE = re.compile(r" ?[a-zA-ZÀ-ÖØ-öø-ɏ]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\t\n\r a-zA-ZÀ-ÖØ-öø-ɏ0-9]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")


def split(text: str) -> list[str]:
    return (PIECE if UNUSUAL.search(text) else PLAIN_PIECE).findall(text)


class WordCache(dict):
    """The bytes of the ids of each piece of text that merges leave apart; missing ones are asked of the tokenizer together."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, added)) + ")")

    def pieces(self, text: str) -> list[str]:
        if "<|" not in text:
            return split(text)
        return [x for k, part in enumerate(self.cut.split(text)) for x in ([part] if k % 2 else split(part))]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for first, stop in blocks(texts):
            if len(self) > MEMORY_WORDS:
                self.clear()
            pieces = [self.pieces(t) for t in texts[first:stop]]
            found = [list(map(self.get, own)) for own in pieces]
            gaps = [missing_at(ids) for ids in found]
            missing = list({own[i] for own, at in zip(pieces, gaps) for i in at})
            for x, e in zip(missing, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)):
                self[x] = array("I", e.ids).tobytes()
            for own, ids, at in zip(pieces, found, gaps):
                for i in at:
                    ids[i] = self[own[i]]
                yield np.frombuffer(b"".join(ids), "<u4")


@lru_cache(maxsize=2)
def word_cache(path: str) -> WordCache:
    """One for each Python worker."""
    return WordCache(path)


class Packer:
    """Packs documents in the order they come, a pool at a time.

    A document longer than the longest window first gives whole windows of its own. What is left is routed to the
    smallest tier that holds it. From the longest tier down, each document opens a window of its tier, and the gap is
    filled from shorter documents: the longest that fit, and in the end the head of the longest other one, whose tail
    goes to the tier that now holds it. All windows but those of the last few documents are full so; these wait for the
    next pool, and at the end of the partition they are cut at the tier sizes, and what is shorter than the last tier
    at powers of two, so that no window is padded. Windows are dealt to step groups by the least load.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = sorted(tiers, reverse=True)
        self.waiting: list[tuple[int, int, int]] = []  # length, document, start: of what no window holds yet
        self.windows: list[tuple[int, list[tuple[int, int, int]]]] = []  # tier, pieces (document, start, length)

    def add(self, document: int, length: int) -> None:
        longest, start = self.tiers[0], 0
        while length - start >= longest:
            self.windows.append((longest, [(document, start, longest)]))
            start += longest
        if start < length:
            self.waiting.append((length - start, document, start))

    def tier(self, length: int) -> int:
        return min(t for t in self.tiers if t >= length)

    def pack(self) -> None:
        """Closes all windows that can be filled; the others' documents wait on."""
        free, left = sorted(self.waiting), []
        while free:
            length, document, start = free.pop()
            size = self.tier(length)
            pieces, gap = [(document, start, length)], size - length
            while gap and free:
                k = bisect_right(free, (gap, float("inf"), 0)) - 1
                if k >= 0:
                    n, d, s = free.pop(k)
                    pieces.append((d, s, n))
                    gap -= n
                else:
                    n, d, s = free.pop()
                    pieces.append((d, s, gap))
                    insort(free, (n - gap, d, s + gap))
                    gap = 0
            if gap:
                left += [(n, d, s) for d, s, n in pieces]
            else:
                self.windows.append((size, pieces))
        self.waiting = left

    def flush(self) -> None:
        """Cuts what still waits at powers of two."""
        pieces = [(d, s, n) for n, d, s in sorted(self.waiting, reverse=True)]
        total = sum(n for _, _, n in pieces)
        for bit in range(self.tiers[0].bit_length() - 1, -1, -1):
            while total >= 1 << bit:
                window, room = [], 1 << bit
                while room:
                    d, s, n = pieces.pop(0)
                    window.append((d, s, min(n, room)))
                    if n > room:
                        pieces.insert(0, (d, s + room, n - room))
                    room -= min(n, room)
                self.windows.append((1 << bit, window))
                total -= 1 << bit
        self.waiting = []

    def step_groups(self) -> list[int]:
        """A group for each window, so that groups of about STEP_TOKENS have like loads and like mixes of tiers."""
        groups = max(1, round(sum(size for size, _ in self.windows) / STEP_TOKENS))
        load, of = [(0, g) for g in range(groups)], [0] * len(self.windows)
        for i in sorted(range(len(self.windows)), key=lambda i: -self.windows[i][0]):
            tokens, group = heappop(load)
            of[i] = group
            heappush(load, (tokens + self.windows[i][0], group))
        return of


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = "byte_bpe_50k.json", tiers: tuple[int, ...] = TIERS, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group
    and, if asked for, the ids.

    A document's ids are those of its text and an end id. Each id lies in exactly one piece; the pieces of a sequence
    stand one after the other from offset 0 and fill it, as `tiers` are powers of two. NULL and empty texts have the
    end id alone; repeated rows and rows with a NULL id are packed as they come; other columns are ignored; texts of any
    length are cut into windows; no rows give no rows. Packing goes on within each input partition, so that ids are never shuffled; sequence ids hold the partition's number.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, base, packer = word_cache(vocabulary_path(path)), TaskContext.get().partitionId() << 36, Packer(tiers)
        held: dict[int, tuple[object, np.ndarray]] = {}
        seen = sequences = groups = tokens = 0

        def close() -> pd.DataFrame:
            nonlocal sequences, groups
            of, rows = packer.step_groups(), []
            for (size, pieces), group in zip(packer.windows, of):
                offset = 0
                for d, start, n in pieces:
                    doc_id, ids = held[d]
                    part = ids[start : start + n]
                    rows.append((doc_id, start, n, zlib.crc32(part.tobytes()), len(ids), base + sequences, offset, size, base + groups + group, *([part.astype(np.int32)] if with_ids else [])))
                    offset += n
                sequences += 1
            groups += max(of, default=-1) + 1
            packer.windows = []
            waiting = {d for _, d, _ in packer.waiting}
            for d in [d for d in held if d not in waiting]:
                del held[d]
            frame = pd.DataFrame(rows, columns=names)
            frame["id"] = frame["id"].astype(id_kind)
            return frame

        id_kind = object
        for batch in batches:
            id_kind = "Int64" if pd.api.types.is_numeric_dtype(batch["id"]) else object
            ids_of = [None if pd.isna(x) else x for x in batch["id"].tolist()]
            for doc_id, ids in zip(ids_of, cache.encode(batch["text"].fillna("").tolist())):
                held[seen] = doc_id, np.append(ids, np.uint32(END_ID)).astype("<u4")
                packer.add(seen, len(ids) + 1)
                seen += 1
                tokens += len(ids) + 1
                if tokens >= POOL_TOKENS:
                    packer.pack()
                    yield close()
                    tokens = 0
        packer.pack()
        packer.flush()
        if packer.windows:
            yield close()

    kind = dict(docs.dtypes)[id_col]
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group", *(["ids"] if with_ids else [])]
    out = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, out)
