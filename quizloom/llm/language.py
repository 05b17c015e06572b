"""Language identification by compression with a dictionary of each language."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Bytes of a language's dictionary, texts that it is made of at most, and the length beyond which others go first.
DICTIONARY_BYTES, DICTIONARY_TEXTS, LONG_TEXT = 262_144, 256, 8192
#: Chosen ids that are broadcast to meet their texts, at most; more are joined by shuffles.
BROADCAST_IDS = 100_000
#: Bytes of the dictionaries that are broadcast and tried at a time. All languages are learned; more of them take more turns.
BLOCK_BYTES = 16_777_216
LEVEL, PIECE_BYTES = 3, 8192
#: A prediction whose smallest size is not smaller than the next by this share of it is rejected.
NARROW = 0.01

NO_LETTERS = re.compile(r"[\W\d_]+")
SAID_AGAIN = re.compile(r"\b(\w+ )(?:\1)+")


def plain(text: str) -> str:
    """Lower-cased words apart by one space, a word that follows itself once."""
    return SAID_AGAIN.sub(r"\1", NO_LETTERS.sub(" ", text.lower()))


def dictionaries(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: Column) -> DataFrame:
    """(lang, dictionary) of every language: a bounded number of its texts, those of least hash among the not very long ones first.

    The ids are found without the texts, and each counts once, with its least text; texts are cut to the bytes wanted
    inside the tasks, and none reaches the driver.
    """
    known = docs.filter(rows & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    ids = known.groupBy("lang", "id").agg(F.min(F.length("text") > LONG_TEXT).alias("long"))
    order = Window.partitionBy("lang").orderBy("long", F.xxhash64("id"), "id")
    chosen = cut(ids.select("lang", "id", F.row_number().over(order).alias("place")).filter(F.col("place") <= DICTIONARY_TEXTS))
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen

    @F.pandas_udf("binary")
    def beginning(texts: pd.Series) -> pd.Series:
        return pd.Series([(plain(t).encode("utf-8", "surrogatepass") + b" ")[:DICTIONARY_BYTES] for t in texts], dtype=object)

    texts = known.join(chosen, ["lang", "id"]).groupBy("lang", "id", "place").agg(F.min("text").alias("text"))
    pieces = texts.select("lang", "place", beginning("text").alias("piece"))

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        data = b"".join(group.sort_values("place")["piece"])[:DICTIONARY_BYTES]
        return pd.DataFrame({"lang": group["lang"].iloc[:1], "dictionary": [data]})

    made = pieces.groupBy("lang").applyInPandas(joined, "lang string, dictionary binary")
    return cut(made.filter(F.length(F.trim(F.col("dictionary").cast("string"))) > 0))


def blocks(sizes: list[tuple[str, int]]) -> list[tuple[str, str]]:
    """The first and last language of each block of dictionaries."""
    out: list[tuple[str, str]] = []
    held = 0
    for lang, size in sizes:
        if out and held + size <= BLOCK_BYTES:
            out[-1], held = (out[-1][0], lang), held + size
        else:
            out.append((lang, lang))
            held = size
    return out


@lru_cache(maxsize=1)
def compressors(entries: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    made = []
    for lang, data in entries:
        content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=LEVEL)
        made.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False)))
    return made


def has_letters(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def least_sizes(text: str, made: list[tuple[str, zstandard.ZstdCompressor]]) -> list[tuple[int, str]]:
    """(bytes, language) of the two dictionaries that leave the whole text smallest, ties to the language first in order."""
    data = plain(text).encode("utf-8", "surrogatepass")
    pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
    return sorted((sum(len(c.compress(p)) for p in pieces), lang) for lang, c in made)[:2]


def identify(docs: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, score, rejected) of each row; dictionaries come from the rows where train_rows holds.

    The score grows from 0 to 1 with the margin between the two smallest sizes; narrow margins are rejected, which is a
    flag beside the language. A text that is NULL, empty or without letters has language `und`, score 0, and is
    rejected, as is every text where no row with a text and a language is there to learn from; ties go to the language
    first in order. Repeated rows and NULL ids stay, and a repeated id is learned from once; other columns are ignored;
    no rows give no rows. Where the languages fill several blocks, each text keeps its two smallest sizes from block to
    block, in tables.
    """
    spark, table = docs.sparkSession, dictionaries(docs, id_col, text_col, lang_col, train_rows)
    sizes = sorted((r["lang"], r["size"]) for r in table.select("lang", F.length("dictionary").alias("size")).collect())
    kind = "array<struct<size:long,lang:string>>"
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.array().cast(kind).alias("least"))
    for turn, (first, last) in enumerate(blocks(sizes)):
        block = table.filter(F.col("lang").between(first, last)).collect()
        shared = spark.sparkContext.broadcast(tuple(sorted((r["lang"], bytes(r["dictionary"])) for r in block)))
        found = (cut(found) if turn else found).withColumn("least", tried(shared, kind)("text", "least"))
    least = [F.get("least", F.lit(i)) for i in (0, 1)]
    margin = F.when(F.size("least") == 0, 0.0).when(F.size("least") == 1, 1.0).otherwise((least[1]["size"] - least[0]["size"]) / least[1]["size"])
    scored = found.select("id", F.coalesce(least[0]["lang"], F.lit("und")).alias("lang"), margin.alias("margin"))
    return scored.select("id", "lang", (1 - F.exp(-25 * F.col("margin"))).alias("score"), (F.col("margin") < NARROW).alias("rejected"))


def tried(shared, kind: str):
    """Merges the two smallest sizes so far with those of a block of dictionaries."""

    @F.pandas_udf(kind)
    def of(texts: pd.Series, before: pd.Series) -> pd.Series:
        made = compressors(shared.value)
        out = []
        for text, own in zip(texts, before):
            sizes = [(x["size"], x["lang"]) for x in own] + (least_sizes(text, made) if has_letters(text) else [])
            out.append([{"size": size, "lang": lang} for size, lang in sorted(sizes)[:2]])
        return pd.Series(out, dtype=object)

    return of
