"""Byte-pair encoding and decoding with a pair occurrence index."""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many characters of text are encoded at a time, and so many distinct words are remembered, in each Python worker.
BLOCK_CHARS, MEMORY_WORDS = 500_000, 300_000


#: Texts without such characters are split by the patterns of the standard library, on plain classes; others by Unicode's.
UNUSUAL = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ɏ]")
PLAIN_WORD = re.compile(r"[a-zA-ZÀ-ÖØ-öø-ɏ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\t\n\r a-zA-ZÀ-ÖØ-öø-ɏ0-9]+")


def vocabulary_path(path: str) -> str:
    """A bare name means a file of the installed public tokenizers; resolved where it is read."""
    if os.path.dirname(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def blocks(texts: list[str], size: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts, of about `size` characters each, or a single longer text."""
    first = chars = 0
    for i, text in enumerate(texts):
        if i > first and chars + len(text) > size:
            yield first, i
            first, chars = i, 0
        chars += len(text)
    if first < len(texts):
        yield first, len(texts)


def missing_at(found: list) -> list[int]:
    """The places of None in a list."""
    out, at = [], -1
    try:
        while True:
            at = found.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free one from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PairIndex:
    """Merges the pairs of many words at once.

    All symbols of all words stand in one list, linked to their neighbours within the word. For each pair that has a
    rank the index holds all its positions. The active ranks are applied in ascending order, each at all its positions
    from left to right; a merge writes the new pairs of its neighbours to their lists. Positions that an earlier merge
    has used up are passed over when their turn comes.
    """

    def __init__(self, merges: list[tuple[int, int, int]]):
        self.merges = merges
        self.ranks = {a << 32 | b: rank for rank, (a, b, _) in reversed(list(enumerate(merges)))}
        self.keys = np.array(sorted(self.ranks), np.int64)
        self.rank_of_key = np.array([self.ranks[k] for k in self.keys.tolist()], np.int64)

    def occurrences(self, ids: np.ndarray, last: np.ndarray) -> dict[int, list[int]]:
        """The positions of each pair with a rank; last marks the last symbols of words."""
        keys = ids[:-1] << 32 | ids[1:]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        places = np.flatnonzero((self.keys[at] == keys) & ~last[:-1])
        ranks = self.rank_of_key[at[places]]
        order = np.argsort(ranks, kind="stable")
        active, first = np.unique(ranks[order], return_index=True)
        stops = np.append(first[1:], len(order)).tolist()
        places = places[order].tolist()
        return {r: places[a:b] for r, a, b in zip(active.tolist(), first.tolist(), stops)}

    def apply(self, symbols: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
        """The merged symbols of words that stand one after the other in symbols."""
        if not len(symbols):
            return [[] for _ in lengths]
        stops = np.cumsum(lengths)
        last = np.zeros(len(symbols), bool)
        last[stops[lengths > 0] - 1] = True
        positions = self.occurrences(symbols, last)
        after = np.where(last, -1, np.arange(1, len(symbols) + 1)).tolist()
        before = np.where(np.append(True, last[:-1]), -1, np.arange(-1, len(symbols) - 1)).tolist()
        ids, ranks, merges = symbols.tolist(), self.ranks.get, self.merges
        active = sorted(positions)
        while active:
            rank = heappop(active)
            left, right, merged = merges[rank]
            for i in sorted(positions.pop(rank)):
                j = after[i]
                if ids[i] != left or j < 0 or ids[j] != right:
                    continue
                ids[i], ids[j] = merged, -1
                h, k = before[i], after[j]
                after[i] = k
                if k >= 0:
                    before[k] = i
                    if (new := ranks(merged << 32 | ids[k])) is not None:
                        if new in positions:
                            positions[new].append(i)
                        else:
                            positions[new] = [i]
                            heappush(active, new)
                if h >= 0 and (new := ranks(ids[h] << 32 | merged)) is not None:
                    if new in positions:
                        positions[new].append(h)
                    else:
                        positions[new] = [h]
                        heappush(active, new)
        merged = np.array(ids)
        kept = merged >= 0
        counts = np.add.reduceat(kept, np.minimum(stops - lengths, len(kept) - 1)) * (lengths > 0)
        ends = np.cumsum(counts).tolist()
        flat = merged[kept].tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


class WordBpe:
    """The encoder and decoder of a vocabulary file with word ends, lower case and dropped white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.index = PairIndex([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        characters = byte_characters()
        self.inner = np.array([vocab[c] for c in characters], np.int64)
        self.last = np.array([vocab[c + self.end] for c in characters], np.int64)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(split)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.known: dict[str, tuple[bytes, str]] = {}
        self.fixed = {t: self.entry([i]) for t, i in self.special.items()}

    def entry(self, ids: list[int]) -> tuple[bytes, str]:
        return np.array(ids, "<u4").tobytes(), " ".join(self.tokens[i] for i in ids)

    def words(self, text: str) -> list[str]:
        """The normalised words of a text; the strings of special tokens are words of their own."""
        if "<|" not in text:
            return self.split(text)
        return [x for k, part in enumerate(self.cut.split(text)) for x in (["\n" + part] if k % 2 else self.split(part))]

    def split(self, text: str) -> list[str]:
        """NFC and lower case of each character by itself (no final form of sigma), then the words; white space drops out."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return (self.word if UNUSUAL.search(text) else PLAIN_WORD).findall(text)

    def learn(self, new: list[str]) -> None:
        """Encodes words not known yet, all through one index."""
        data = [b"" if w[0] == "\n" else w.encode("utf-8") for w in new]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        joined = np.frombuffer(b"".join(data), np.uint8)
        symbols = self.inner[joined]
        stops = np.cumsum(lengths)[lengths > 0]
        symbols[stops - 1] = self.last[joined[stops - 1]]
        for word, ids in zip(new, self.index.apply(symbols, lengths)):
            self.known[word] = self.entry(ids) if ids else self.fixed[word[1:]]

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids, as little-endian unsigned 32-bit integers, and what they decode to."""
        for first, stop in blocks(texts):
            if len(self.known) > MEMORY_WORDS:
                self.known.clear()
            split = [self.words(t) for t in texts[first:stop]]
            found = [list(map(self.known.get, words)) for words in split]
            gaps = [missing_at(own) for own in found]
            missing = list({words[i] for words, at in zip(split, gaps) for i in at})
            if missing:
                self.learn(missing)
            for words, own, at in zip(split, found, gaps):
                for i in at:
                    own[i] = self.known[words[i]]
                yield b"".join([ids for ids, _ in own]), " ".join([text for _, text in own])


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One for each Python worker."""
    return WordBpe(path)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = "word_bpe_49k.json", digests: bool = False) -> DataFrame:
    """(id, n_tokens, ids, decoded) of each row, or with digests SHA-256 of the ids' bytes and of the decoded text.

    Decoding joins the tokens by spaces, as the vocabulary has no decoder. NULL counts as the empty text, which has no
    ids and decodes to the empty text. Repeated rows and NULL ids stay as they are; other columns are ignored; texts of any
    length are encoded whole; no rows give no rows.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = word_bpe(vocabulary_path(path))
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            rows = []
            for ids, decoded in bpe.encode(texts):
                if digests:
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()))
                else:
                    rows.append((len(ids) // 4, np.frombuffer(ids, "<u4").astype(np.int32), decoded))
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pd.DataFrame({"id": batch["id"], "n_tokens": np.array(n, np.int64), "ids": list(ids), "decoded": list(decoded)})

    kinds = dict(docs.dtypes)
    out = f"id {kinds[id_col]}, n_tokens long, ids {'string' if digests else 'array<int>'}, decoded string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, out)
