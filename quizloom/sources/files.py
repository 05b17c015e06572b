"""Readers: text, DOCX, PDF characters, JSON trees, JSON lines, patterns, templates and the registry of models."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sinks.shared import kept

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files of text or markdown: (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def files(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """Files of one extension as bytes, found at any depth; the extension is matched without case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.filter(F.lower("path").endswith(f".{extension}")).select("path", "content")


def docx_runs(documents: DataFrame) -> DataFrame:
    """(path, paragraph_no, run_no, text, bold, superscript, font_pt, style, outline_level, list_level) of DOCX files.

    What a paragraph or a ratio is follows by grouping the rows; only the reading of the archive is Python.
    """
    names = ["path", "paragraph_no", "run_no", "text", "bold", "superscript", "font_pt", "style", "outline_level", "list_level"]

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    body = ElementTree.fromstring(archive.read("word/document.xml"))
                value = lambda e, tag: None if (x := e.find(tag)) is None else x.get(f"{WORD}val", "")
                for p, paragraph in enumerate(body.iter(f"{WORD}p")):
                    own = paragraph.find(f"{WORD}pPr")
                    own = paragraph if own is None else own
                    style, outline = value(own, f"{WORD}pStyle"), value(own, f"{WORD}outlineLvl")
                    level = None if (x := own.find(f"{WORD}numPr")) is None else value(x, f"{WORD}ilvl")
                    for r, one in enumerate(paragraph.iter(f"{WORD}r")):
                        text = "".join(t.text or "" for t in one.iter(f"{WORD}t"))
                        look = one.find(f"{WORD}rPr")
                        look = one if look is None else look
                        size = value(look, f"{WORD}sz")
                        bold = look.find(f"{WORD}b") is not None and value(look, f"{WORD}b") not in ("0", "false")
                        rows.append((path, p, r, text, bold, value(look, f"{WORD}vertAlign") == "superscript", float(size) / 2 if size else None, style, int(outline) if outline else None, int(level) if level else None))
            yield pd.DataFrame(rows, columns=names).astype({"outline_level": "Int32", "list_level": "Int32"})

    kinds = "path string, paragraph_no int, run_no int, text string, bold boolean, superscript boolean, font_pt double, style string, outline_level int, list_level int"
    return documents.select("path", "content").mapInPandas(run, kinds)


def docx_markdown(runs: DataFrame) -> DataFrame:
    """(doc_id, text): a line for each paragraph, headings by style or outline level, superscripts as notes."""
    noted = F.when(F.col("superscript") & F.col("text").rlike(r"^\s*\d+\s*$"), F.concat(F.lit(" (см.сноску "), F.trim("text"), F.lit(")"))).otherwise(F.col("text"))
    level = F.coalesce(F.regexp_extract("style", r"(?i)^heading\s*([1-6])$", 1).try_cast("int"), F.col("outline_level") + 1)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("run_no", noted.alias("t")))), lambda x: x["t"])
    lines = runs.groupBy("path", "paragraph_no").agg(F.array_join(in_order, "").alias("line"), F.max(level).alias("level"))
    line = F.when(F.col("level").between(1, 6) & (F.trim("line") != ""), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("line"))).otherwise(F.col("line"))
    all_lines = F.transform(F.array_sort(F.collect_list(F.struct("paragraph_no", line.alias("t")))), lambda x: x["t"])
    return lines.groupBy(F.col("path").alias("doc_id")).agg(F.array_join(all_lines, "\n\n").alias("text"))


def html_to_markdown(html: Column) -> Column:
    """Headings, paragraphs, list items and superscripts of HTML as markdown; other tags go."""
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head|nav|footer)\b.*?</\1\s*>", "")
    for level in range(1, 7):
        text = F.regexp_replace(text, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}\s*>", "\n\n" + "#" * level + " $1\n\n")
    text = F.regexp_replace(text, r"(?is)<sup\b[^>]*>\s*(\d+)\s*</sup\s*>", " (см.сноску $1)")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)<li\b[^>]*>", "\n- "), r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)</?(?:p|div|article|section|ul|ol|table|tr)\b[^>]*>", "\n\n"), r"<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def character_pages(characters: DataFrame) -> DataFrame:
    """Pages of PDF files (doc_id, page, chars, top, bottom, size), an array of each in the page's order n, from a row for each character."""
    columns = ("char", "top", "bottom", "size")
    ordered = F.array_sort(F.collect_list(F.struct("n", *columns))).alias("glyphs")
    pages = characters.groupBy("doc_id", "page").agg(ordered)
    return pages.select("doc_id", "page", *[F.col(f"glyphs.{c}").alias("chars" if c == "char" else c) for c in columns])


#: A page's doc_id, its page, its characters in order, and their tops, bottoms and sizes.
Page = tuple[object, object, Sequence[str], np.ndarray, np.ndarray, np.ndarray]


def page_arrays(batch: pa.RecordBatch) -> Iterator[Page]:
    """The pages of a batch (doc_id, page, chars, top, bottom, size) of arrays."""
    for doc_id, page, chars, *numbers in zip(*(batch.column(c) for c in ("doc_id", "page", "chars", "top", "bottom", "size"))):
        yield doc_id.as_py(), page.as_py(), [c or "" for c in chars.as_py()], *(np.array(x.as_py(), float) for x in numbers)


def page_superscripts(pages: DataFrame, read: Callable[[pa.RecordBatch], Iterator[Page]] = page_arrays, gap: float = 3.0, small: float = 0.85, raised: float = 1.5, context: int = 30) -> DataFrame:
    """Of pages of PDF files (doc_id, page and what `read` takes the characters from) the runs of digits set as superscripts: (doc_id,
    page, row_no, place, left, digits), left being up to three words before the run, of so many characters at most.

    Characters are in the page's order; a new row of type begins where the top moves by more than the gap. A digit is a superscript if it
    is smaller than its row's median size and stands higher than the row's median baseline. A page is what is held at a time; its
    characters are never rows of their own.
    """
    schema = StructType([pages.schema["doc_id"], pages.schema["page"]]).add("row_no", "long").add("place", "integer").add("before", "string").add("digits", "string")
    form = to_arrow_schema(schema)

    def found_in(chars: Sequence[str], top: np.ndarray, bottom: np.ndarray, size: np.ndarray) -> Iterator[tuple]:
        code = np.frombuffer(chars.encode("utf-32-le"), "<u4") if isinstance(chars, str) else np.fromiter((ord(c) if len(c) == 1 else 0 for c in chars), int, len(chars))
        digit = np.flatnonzero((code >= ord("0")) & (code <= ord("9")))
        starts = np.concatenate([[0], np.flatnonzero(np.abs(np.diff(top)) > gap) + 1])
        for row in np.unique(np.searchsorted(starts, digit, "right") - 1).tolist():
            a, b = int(starts[row]), int(starts[row + 1]) if row + 1 < len(starts) else len(top)
            sizes, bottoms = size[a:b][size[a:b] > 0], bottom[a:b][~np.isnan(bottom[a:b])]
            if not len(sizes) or not len(bottoms):
                continue
            own = digit[np.searchsorted(digit, a) : np.searchsorted(digit, b)]
            middle, line = len(sizes) // 2, len(bottoms) - 1 - len(bottoms) // 2
            median, base = np.partition(sizes, middle)[middle], np.partition(bottoms, line)[line]
            up = own[(size[own] < small * median) & (base - bottom[own] >= raised)]
            for run in np.split(up, np.flatnonzero(np.diff(up) > 1) + 1) if len(up) else ():
                first, last = int(run[0]), int(run[-1])
                yield row, first - a + 1, "".join(chars[max(a, first - context) : first])[-context:], "".join(chars[first : last + 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc_id, page, *found) for doc_id, page, *characters in read(batch) for found in found_in(*characters)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), form)], schema=form)

    found = pages.mapInArrow(run, schema)
    before = F.regexp_replace("before", r"(?U)\s+$", "")
    left = F.regexp_extract(before, r"(?U)(\S+(?:\s\S+){0,2})\s*$", 1)
    return found.select("doc_id", "page", "row_no", "place", left.alias("left"), "digits")


def superscript_runs(characters: DataFrame, **limits: float) -> DataFrame:
    """The superscripts of pages whose characters are rows (doc_id, page, n, char, top, bottom, size)."""
    return page_superscripts(character_pages(characters), **limits)


def footnote_words(runs: DataFrame) -> DataFrame:
    """(doc_id, notes): each document's own list of (left, digits), without repetition, in the order first seen."""
    order = F.struct("page", "row_no", "place")
    first = runs.filter("left <> ''").groupBy("doc_id", "left", "digits").agg(F.min(order).alias("seen"))
    return first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "left", "digits"))), lambda x: F.struct(x["left"].alias("left"), x["digits"].alias("digits"))).alias("notes"))


#: Levels of JSON trees that one round goes down.
ROUND = 16


def tree_nodes(trees: DataFrame, id_col: str = "path", json_col: str = "value") -> DataFrame:
    """Node rows (id, node_no, level, title, content) of JSON trees of any depth, by a loop that goes down so many levels in each
    round. A text that is no JSON has no rows; nodes are numbered from 0 from top to bottom.

    A step turns each row that holds a tree into the row of its top and rows that hold the trees below it, within the task. Only
    a round's result is written, so that a text is not written again for each level that stands above it.
    """
    rows = trees.select(F.col(id_col).alias("id"), F.array().cast("array<int>").alias("at"), F.try_parse_json(F.col(json_col)).alias("node")).filter("node IS NOT NULL")
    nothing = lambda kind: F.lit(None).cast(kind)
    made, held = {"level": "int", "title": "string", "content": "string"}, ("at", "node")
    text = lambda name: F.coalesce(F.try_variant_get("node", f"$.{name}", "string"), F.lit(""))
    top = F.struct("at", nothing("variant").alias("node"), F.try_variant_get("node", "$.level", "int").alias("level"), text("title").alias("title"), text("content").alias("content"))
    below = F.transform(
        F.coalesce(F.try_variant_get("node", "$.children", "array<variant>"), F.array().cast("array<variant>")),
        lambda child, i: F.struct(F.concat("at", F.array(i)).alias("at"), F.coalesce(child, F.parse_json(F.lit("null"))).alias("node"), *[nothing(kind).alias(name) for name, kind in made.items()]),
    )
    same = F.array(F.struct(*held, *made))
    parts = []
    while True:
        rows = rows.select("id", *held, *[nothing(kind).alias(name) for name, kind in made.items()])
        for _ in range(ROUND):
            rows = rows.select("id", F.explode(F.when(F.col("node").isNull(), same).otherwise(F.concat(F.array(top), below))).alias("n")).select("id", "n.*")
        rows = kept(rows)
        parts.append(rows.filter("node IS NULL").select("id", "at", *made))
        rows = rows.filter("node IS NOT NULL").select("id", *held)
        if rows.isEmpty():
            break
    order = Window.partitionBy("id").orderBy("at")
    return reduce(lambda a, b: a.unionByName(b), parts).select("id", (F.row_number().over(order) - 1).alias("node_no"), "level", "title", "content")


def json_chunks(spark: SparkSession, path: str) -> DataFrame:
    """JSON files, one tree each. If any holds chunks, (path, chunk_no, chunk) of those that do, the chunks as JSON; else the nodes of the
    trees, however deep: (path, node_no, level, title, content)."""
    found = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    ready = found.select("path", F.posexplode(F.try_variant_get(F.try_parse_json("value"), "$.chunks", "array<variant>")).alias("chunk_no", "chunk"))
    if not ready.isEmpty():
        return ready.select("path", "chunk_no", F.to_json("chunk").alias("chunk"))
    return tree_nodes(found).withColumnRenamed("id", "path")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with the file that each row is from."""
    return spark.read.schema(schema).json(path).withColumn("path", F.input_file_name())


def cleaning_patterns(spark: SparkSession, path: str) -> list[str]:
    """The patterns of a JSON file {"patterns": [...]}; none if there is no such file. They are few by nature."""
    try:
        rows = spark.read.schema("patterns array<string>").json(path, multiLine=True).collect()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return []
    return [p for r in rows for p in r["patterns"] or [] if re.compile(p)]


def templates(spark: SparkSession, path: str) -> DataFrame:
    """Prompt templates: (question_type, block, template) from files <question_type>/<block>.txt."""
    found = texts(spark, f"{path}/*/*.txt")
    parts = F.split("path", "/")
    return found.select(F.element_at(parts, -2).alias("question_type"), F.regexp_replace(F.element_at(parts, -1), r"\.txt$", "").alias("block"), F.col("text").alias("template"))


def filled(template: Column, source: Column, question: Column) -> Column:
    """A template with its two places filled."""
    return F.replace(F.replace(template, F.lit("{source}"), source), F.lit("{question}"), question)


def registry(spark: SparkSession, models: str) -> DataFrame:
    """Models from JSON text, a list of objects; a model without id or address is left out."""
    row = spark.createDataFrame([(models,)], "models string")
    kind = "array<struct<id string, name string, base_url string, model_name string, provider string>>"
    found = row.select(F.explode(F.from_json("models", kind)).alias("m")).select("m.*")
    return found.filter(F.col("id").isNotNull() & F.col("base_url").isNotNull()).withColumn("provider", F.coalesce("provider", F.lit("openai")))


def merged_registry(fixed: DataFrame, probed: DataFrame) -> DataFrame:
    """All models; in the list what was probed wins, in a look-up what is fixed."""
    a, b = fixed.withColumnRenamed("source", "a"), probed.withColumnRenamed("source", "b")
    return a.join(b, "model_id", "full_outer").select("model_id", F.coalesce("b", "a").alias("listed"), F.coalesce("a", "b").alias("looked_up"))
