"""Documents as outlines: lines, blocks, heading nodes, items and chunks, as rows in document order.

All steps are window, aggregation and join expressions over rows; `doc_id` is the key of every window, so that documents are the
units of work. One pass over the tree, which attaches items to headings, is a map over documents, each with its node rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import text as T
from . import tree

MIN_SIZE = 50
LEVELS = range(1, 7)

#: Fixed patterns of lines.
ATX = r"^(#{1,6})\s+(.+?)(?:\s+#+\s*)?$"
SETEXT = r"^(?:=+|-+)\s*$"
CHAPTER, ARTICLE = r"(?iu)^глава\s+\d+[.:]?\s*.+$", r"(?iu)^статья\s+\d+[.:]?\s*.+$"
SECTION, SUBSECTION = r"(?iu)^раздел\s+\d+[.:]?\s*.+$", r"(?iu)^подраздел\s+\d+[.:]?\s*.+$"
ROMAN_SECTION, SUBTITLE = r"(?i)^[IVXLCDM]+\.\s+.+$", r"^[А-ЯЁ][А-Яа-яё\s]{5,80}$"
MARKER_LINE, COMMENT_LINE = r"(?iu)^\s*гарант\s*:?\s*$", r"(?iu)^\s*см\.\s+комментарии\s+к\s+статье\s+\d+.*$"
ARTICLE_LINE = r"(?iu)^\s*[*_]{0,3}статья\s+\d+"
ITEM_STOP = r"^\d+[.)]"


def in_document(*order: str) -> Window:
    return Window.partitionBy("doc_id").orderBy(*order)


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, r"\r\n|\r|\n")).alias("line_no", "line"))


def without_marker_lines(lines: DataFrame, where: Column | None = None) -> DataFrame:
    """Drops marker lines, comment lines, and the blank lines after either; only where a condition holds, if one is given."""
    blank = T.strip(F.col("line")) == ""
    kind = F.when(F.col("line").rlike(MARKER_LINE) | F.col("line").rlike(COMMENT_LINE), "marker").when(~blank, "text")
    last = F.last(kind, ignorenulls=True).over(in_document("line_no"))
    marked = F.coalesce(F.col("__last") == "marker", F.lit(False))
    return lines.withColumn("__last", last).filter(~(marked if where is None else marked & where)).drop("__last")


def processor_marks(line: Column) -> dict[str, Column]:
    return {
        "marker": line.contains("ГАРАНТ"), "link": line.contains("garant.ru"), "structure": line.rlike(r"(?U)(?:Глава|Статья)\s+\d+"),
        "consultant": line.contains("consultant.ru") | line.contains("Консультант"), "sections": line.rlike(r"(?iu)(?:раздел|глава|статья)\s+\d+"),
        "gost": line.rlike(r"^ГОСТ\s+\d+"), "standard": line.contains("ГОСУДАРСТВЕННЫЙ СТАНДАРТ"), "numbered": line.rlike(r"^\d+\.\s+[А-ЯЁ\s]+$"),
    }


def first_processor(has: dict[str, Column]) -> Column:
    return (
        F.when(has["marker"] | (has["link"] & has["structure"]), "garant").when(has["consultant"] | has["sections"], "consultant")
        .when(has["gost"] | (has["standard"] & has["numbered"]), "gost").otherwise("universal")
    )


def processors(lines: DataFrame) -> DataFrame:
    """(doc_id, processor): the first kind of document, in fixed order, whose marks occur in the lines."""
    marks = lines.groupBy("doc_id").agg(*[F.bool_or(c).alias(name) for name, c in processor_marks(F.col("line")).items()])
    return marks.select("doc_id", first_processor({name: F.col(name) for name in processor_marks(F.col("line"))}).alias("processor"))


def with_processor(lines: DataFrame) -> DataFrame:
    """Lines with the processor of their document, by a window, so that the lines are not read twice."""
    whole = Window.partitionBy("doc_id")
    return lines.withColumn("processor", first_processor({name: F.bool_or(c).over(whole) for name, c in processor_marks(F.col("line")).items()}))


def garant_level(line: Column) -> Column:
    return F.when(line.rlike(CHAPTER), 1).when(line.rlike(ARTICLE), 2)


def gost_level(line: Column) -> Column:
    return (
        F.when(line.startswith("|"), None).when(line.rlike(r"^\d+\.\s+[А-ЯЁ\s]+$"), 1).when(line.rlike(r"^\d+\.\d+\.\d+\."), 3).when(line.rlike(r"^\d+\.\d+\."), 2)
        .when(line.rlike(r"^\d+\)\s+."), 4).when(line.rlike(r"^[а-яА-Я]\)\s+."), 5)
    )


def consultant_level(line: Column, following: Column) -> Column:
    """following is the next line, stripped; a subtitle needs one that is neither blank nor a heading itself."""
    heading = lambda x: x.rlike(ROMAN_SECTION) | x.rlike(SECTION) | x.rlike(SUBSECTION) | x.rlike(CHAPTER) | x.rlike(ARTICLE)
    subtitle = line.rlike(SUBTITLE) & ~line.rlike(T.NUMBERED) & F.coalesce((following != "") & ~heading(following), F.lit(False))
    return (
        F.when(line.startswith("|"), None).when(line.rlike(ROMAN_SECTION), 1).when(line.rlike(CHAPTER), 1).when(line.rlike(ARTICLE), 2).when(line.rlike(SECTION), 1)
        .when(line.rlike(SUBSECTION), 2).when(subtitle, 2)
    )


def with_headings(lines: DataFrame) -> DataFrame:
    """Lines in which those that a document's processor takes for headings begin with hashes.

    Upper-case lines right after a chapter's heading continue it; several numbered items on one line of a GOST document
    become lines of their own.
    """
    order = in_document("line_no")
    found = lines.withColumn("bare", T.strip_emphasis(F.col("line"))).withColumn("plain", T.strip(F.col("line")))
    found = found.withColumn("following", F.lead("bare").over(order))
    items = F.regexp_extract_all("plain", F.lit(r"(\d+\)\s+[^;]+(?:;|$))"), 1)
    many = (F.col("processor") == "gost") & F.col("plain").contains(";") & (F.size(items) > 1) & gost_level(F.col("plain")).isin(4).eqNullSafe(True)
    level = (
        F.when(F.col("processor") == "garant", garant_level(F.col("bare"))).when(F.col("processor") == "consultant", consultant_level(F.col("bare"), F.col("following")))
        .when(F.col("processor") == "gost", gost_level(F.col("plain")))
    )
    found = found.withColumn("level", level)
    shout = (F.col("processor") == "consultant") & (F.length("bare") < 100) & F.col("bare").rlike(r"\p{Lu}") & ~F.col("bare").rlike(r"\p{Ll}") & F.col("level").isNull()
    chapter = (F.col("processor") == "consultant") & F.col("bare").rlike(CHAPTER) & (F.col("level") == 1)
    found = found.withColumn("shout", shout).withColumn("chapter", F.coalesce(chapter, F.lit(False)))
    found = found.withColumn("run", F.sum((~F.coalesce("shout", F.lit(False))).cast("int")).over(order))
    in_run = Window.partitionBy("doc_id", "run").orderBy("line_no")
    found = found.withColumn("continues", F.col("shout") & F.first("chapter").over(in_run))
    more = F.collect_list(F.when(F.col("continues"), F.col("bare"))).over(Window.partitionBy("doc_id", "run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = found.withColumn("more", F.array_join(more, " "))
    text = F.when(F.col("chapter"), F.concat_ws(" ", "bare", "more")).when(F.col("processor") == "gost", F.col("plain")).otherwise(F.col("bare"))
    headed = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.rtrim(text))
    out = F.when(many, F.transform(items, lambda i: F.concat(F.lit("#### "), F.trim(i)))).when(F.col("level").isNotNull(), F.array(headed)).otherwise(F.array("line"))
    made = found.filter(~F.coalesce("continues", F.lit(False))).select("doc_id", "line_no", F.posexplode(out).alias("part", "line"))
    return made.select("doc_id", F.row_number().over(in_document("line_no", "part")).alias("line_no"), "line")


def blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, block_no, kind, level, text): headings of both kinds, and paragraphs that blank lines and headings part."""
    order = in_document("line_no")
    line = F.col("line")
    found = lines.withColumns({"atx": line.rlike(ATX), "rule": line.rlike(SETEXT), "blank": T.strip(line) == ""})
    found = found.withColumn("run", F.sum((~F.col("rule")).cast("int")).over(order))
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("line_no")))
    head = F.first(F.when(~F.col("rule"), ~F.col("atx") & ~F.col("blank")), ignorenulls=True).over(Window.partitionBy("doc_id", "run").orderBy("line_no"))
    # of a run of rules after a line that can be a title, the first underlines it, the second can be a title itself, and so on;
    # the first line of all can be one even if it is a rule
    found = found.withColumn("under", F.col("rule") & F.when(F.coalesce(head, F.lit(True)), F.col("place") % 2 == 0).otherwise((F.col("place") % 2 == 1) & (F.col("place") > 2)))
    found = found.withColumn("mark", F.lead(F.when(F.col("under"), line)).over(order)).filter("NOT under")
    level = F.when(F.col("atx"), F.length(F.regexp_extract("line", ATX, 1))).when(F.col("mark").startswith("="), 1).when(F.col("mark").isNotNull(), 2)
    title = F.when(F.col("atx"), T.strip(F.regexp_extract("line", ATX, 2))).otherwise(T.strip(line))
    found = found.withColumn("level", level).withColumn("text", F.when(level.isNotNull(), title).otherwise(line))
    heading = F.col("level").isNotNull()
    apart = heading | F.col("blank") | F.lag(heading | F.col("blank"), 1, True).over(order)
    found = found.withColumn("block_no", F.sum(apart.cast("int")).over(order)).filter(heading | ~F.col("blank"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    got = found.groupBy("doc_id", "block_no").agg(F.max("level").alias("level"), T.strip(F.array_join(parts, "\n")).alias("text"))
    return got.select("doc_id", "block_no", F.when(F.col("level").isNotNull(), "heading").otherwise("para").alias("kind"), "level", "text")


def nodes(found: DataFrame) -> DataFrame:
    """(doc_id, node_no, level, title, content): a node for each heading with its paragraphs, and node 0, the root, for those before."""
    order = in_document("block_no")
    heading = F.col("kind") == "heading"
    counted = found.withColumns({"own": F.sum(heading.cast("int")).over(order), "first": F.lag("block_no").over(order).isNull()})
    numbered = counted.withColumn("node_no", F.explode(F.when(F.col("first") & (F.col("own") > 0), F.array(F.lit(0), F.col("own"))).otherwise(F.array("own"))))
    here = F.col("node_no") == F.col("own")
    paragraphs = F.transform(F.array_sort(F.collect_list(F.when(here & ~heading, F.struct("block_no", "text")))), lambda x: x["text"])
    return numbered.groupBy("doc_id", "node_no").agg(
        F.coalesce(F.max(F.when(here, F.col("level"))), F.lit(0)).alias("level"), F.coalesce(F.max(F.when(here & heading, F.col("text"))), F.lit("")).alias("title"), F.array_join(paragraphs, "\n\n").alias("content"),
    )


def with_path(rows: DataFrame, order: str = "node_no") -> DataFrame:
    """Adds for each row the titles above it (`crumbs`, from level 1), whether it is a leaf, and its depth.

    The title open at a level is the last one of it that no later title of a lower level has closed. Levels are few and
    fixed, so that two windows, by document and in order, carry them all.
    """
    w = in_document(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    opened, columns = [], {}
    for k in LEVELS:
        columns[f"__at{k}"] = F.last(F.when(F.col("level") == k, F.struct(F.col(order).alias("at"), F.col("title").alias("title"), F.col("level").alias("level"))), ignorenulls=True).over(before)
    found = rows.withColumns(columns)
    for k in LEVELS:
        later = [F.coalesce(F.col(f"__at{j}.at"), F.lit(-1)) for j in LEVELS if j < k]
        alive = F.col(f"__at{k}").isNotNull() & (F.col("level") > k)
        for j in later:
            alive = alive & (F.col(f"__at{k}.at") > j)
        opened.append(F.when(alive, F.col(f"__at{k}")))
    crumbs = F.array_compact(F.array(*opened))
    leaf = F.coalesce(F.lead("level").over(w) <= F.col("level"), F.lit(True))
    return found.withColumns({"crumbs": F.transform(crumbs, lambda c: F.struct(c["level"].alias("level"), c["title"].alias("title"), c["at"].alias("position"))), "is_leaf": leaf, "depth": F.size(crumbs)}).drop(*columns)


def breadcrumbs(rows: DataFrame) -> Column:
    return F.array_join(F.transform(F.filter("crumbs", lambda c: c["title"] != ""), lambda c: c["title"]), " > ")


def item_texts(lines: Column, keep_preamble: bool = False) -> Column:
    """Of an array of lines the numbered items: a line that begins one and all lines up to the next number.

    Lines that only stop an item (`1.1. `), and what follows them, belong to none; nor does what stands before the first
    item, unless kept. A text without items is one item.
    """
    kept = F.array_join(F.filter(lines, lambda x: ~x.rlike(ARTICLE_LINE)), "\n")
    parts = F.split(kept, r"\n(?=\d+[.)])")
    is_item = lambda p: p.rlike(r"^\d+[.)][\s&&[^\n]]")
    wanted = (lambda p, i: is_item(p) | ((i == 0) & ~p.rlike(ITEM_STOP))) if keep_preamble else (lambda p, i: is_item(p))
    stripped = lambda texts: F.filter(F.transform(texts, T.strip), lambda p: p != "")
    whole = F.array(F.array_join(lines, "\n"))
    return stripped(F.when(F.exists(parts, is_item), F.filter(parts, wanted)).otherwise(whole))


def item_segments(lines: DataFrame, key: str = "doc_id", keep_preamble: bool = False) -> DataFrame:
    """(key, item_no, text) of the numbered items of each key's lines."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    found = lines.groupBy(key).agg(in_order.alias("lines")).select(key, F.posexplode(item_texts(F.col("lines"), keep_preamble)).alias("place", "text"))
    return found.select(key, (F.col("place") + 1).alias("item_no"), "text")


def combined(crumbs: Column, title: Column, item: Column) -> Column:
    """`breadcrumb > title`, a blank line, the item; what is empty is left out with its separator."""
    head = F.concat_ws(" > ", F.nullif(crumbs, F.lit("")), F.nullif(title, F.lit("")))
    return F.concat_ws("\n\n", F.nullif(head, F.lit("")), F.nullif(item, F.lit("")))


def chunks(rows: DataFrame, min_size: int = MIN_SIZE, document: str = "doc_id") -> DataFrame:
    """A chunk for each numbered item of each leaf; a leaf without content gives its title. Short chunks take no number."""
    leaves = with_path(rows).filter("is_leaf").withColumn("crumb_text", breadcrumbs(rows))
    items = F.when(F.col("content") != "", item_texts(F.split("content", "\n")))
    found = leaves.select("*", F.posexplode_outer(items).alias("item_no", "item"))
    found = found.withColumn("chunk_text", combined(F.col("crumb_text"), F.col("title"), F.coalesce("item", F.lit(""))))
    kept = found.filter(F.length(T.strip(F.col("chunk_text"))) >= min_size)
    number = F.row_number().over(in_document("node_no", F.coalesce("item_no", F.lit(0))))
    return kept.select("doc_id", number.alias("chunk_no"), "node_no", F.col("title"), "crumb_text", "crumbs", F.col("level"), "depth", "chunk_text", F.length("chunk_text").alias("text_length"))


def chunk_records(found: DataFrame, source: Column) -> DataFrame:
    """Chunks as nested records with a fragment id from the document's id and the number."""
    return found.select(
        F.format_string("%s_%d", F.col("doc_id").cast("string"), F.col("chunk_no")).alias("fragment_id"),
        F.struct(F.col("crumbs").alias("breadcrumb_path"), F.col("crumb_text").alias("breadcrumb_text"), F.col("level").alias("current_level"), "depth").alias("hierarchy_context"),
        F.struct("title", F.col("chunk_text").alias("combined_text"), F.lit(True).alias("is_leaf_node"), F.lit(False).alias("has_children"), "text_length", source.alias("source")).alias("fragment_data"),
    )


def legacy_chunks(rows: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """A chunk for each node with content that is a leaf or long enough, inner nodes included."""
    found = with_path(rows).withColumn("crumb_text", breadcrumbs(rows))
    found = found.withColumn("chunk_text", combined(F.col("crumb_text"), F.col("title"), F.col("content")))
    kept = found.filter((F.col("is_leaf") | (F.length("content") >= min_size)) & (T.strip(F.col("chunk_text")) != ""))
    return kept.select("doc_id", F.row_number().over(in_document("node_no")).alias("chunk_no"), "node_no", "is_leaf", "chunk_text")


def all_titles(rows: DataFrame, most: int = 50) -> DataFrame:
    """Per document its first titles in order, and the number of the others. Of titles before the cut no more are gathered."""
    place = F.row_number().over(in_document("node_no"))
    titled = rows.filter(T.strip(F.col("title")) != "").withColumn("place", place)
    shown = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.struct("place", "title")))), lambda x: x["title"])
    return titled.groupBy("doc_id").agg(F.array_join(shown, "\n").alias("titles"), F.greatest(F.count("*") - most, F.lit(0)).alias("others"))


# The pass that attaches items to headings, within one document. The other passes are steps over rows, in tree.py.


@dataclass
class Node:
    level: int
    title: str = ""
    content: str = ""
    children: list[Node] = field(default_factory=list)


HEAD, NUMBERED, SUB, MAIN = (re.compile(p.replace("(?iu)", "(?i)")) for p in (T.ARTICLE_HEADING, T.NUMBERED, T.SUB_ITEM, T.MAIN_ITEM))
#: Where an item `1) ` begins: a line, or after a semicolon or a full stop; and where letters do.
ITEM_START, LETTER_START = re.compile(r"(?:^|;\s*|\.\s+)(?=\d+\)\s)", re.M), re.compile(r"^(?=[а-яА-Я]\)\s)", re.M)
NUMBER_LED = re.compile(r"(?:\A|\n\n)\d+[.)]\s")
#: Items within a text that has none of these beginnings.
LOOSE_ITEM = re.compile(r"(\d+\))\s+([^;]+?)(?=;\s*\d+\)|;?\s*\Z)")


def cut_items(content: str, starts: re.Pattern[str]) -> tuple[str, list[Node]]:
    """What stands before the first item, and the items, each a title line with the lines after it."""
    at = [m.end() for m in starts.finditer(content)]
    found = []
    for a, b in zip(at, [*at[1:], len(content)]):
        first, _, rest = content[a:b].strip().removesuffix(";").strip().partition("\n")
        if NUMBERED.match(first) or SUB.match(first):
            found.append(Node(0, first.strip(), rest.strip()))
    return (content[: at[0]].strip() if at else content), found


def numbered_items(content: str) -> list[Node]:
    """The numbered items of a text: by their beginnings; else parted by semicolons; else the parts between blank lines that begin
    with a number."""
    _, found = cut_items(content, ITEM_START)
    if found or ITEM_START.search(content):
        return found
    if ";" in content:
        found = [Node(0, f"{m[1]} {m[2].strip()}") for m in LOOSE_ITEM.finditer(content) if m[2].strip()]
    if not found:
        parts = [p.strip().partition("\n") for p in content.split("\n\n")]
        found = [Node(0, first.strip(), rest.strip()) for first, _, rest in parts if NUMBERED.match(first.strip())]
    return found


def leading_number(title: str) -> int | None:
    found = re.match(r"(\d+)[.)]", title)
    return int(found[1]) if found else None


def releveled(node: Node, level: int) -> Node:
    node.level = level
    node.children = [releveled(c, level + 1) for c in node.children]
    return node


def gathered(head: Node, following: list[Node]) -> tuple[list[Node], int, str]:
    """(items, number of siblings used, content) of an article's heading and what follows it.

    Its own content may hold items. Numbered siblings of its level or the next are items, and those whose content begins with a
    number are the items of that; other text of its level goes into the content, deeper text is passed over and lost. Another article, a count that
    begins anew, a number of another level, or a higher level end it.
    """
    items, content, last = [], head.content, 0
    if NUMBER_LED.search(content.strip()):
        before, items = cut_items(content.strip(), ITEM_START)
        content = " ".join(before.split()) if items else content
    for used, n in enumerate(following):
        title, own = n.title.strip(), n.content.strip()
        if HEAD.match(title) and (n.level <= head.level or items):
            return items, used, content
        if NUMBERED.match(title):
            number = leading_number(title)
            if (last > 1 and (number == 1 or title.startswith("1."))) or not head.level <= n.level <= head.level + 1:
                return items, used, content
            last = last if number is None else number
            items.append(n)
            continue
        found = numbered_items(own) if NUMBERED.match(own.partition("\n")[0].strip()) else []
        if found:
            if last > 1 and found[0].title.startswith("1."):
                return items, used, content
            last = next((x for x in map(leading_number, [f.title for f in reversed(found)]) if x is not None), last)
            items += found
        elif n.level < head.level:
            return items, used, content
        elif n.level == head.level:
            content = "\n\n".join(x for x in (content, title or own) if x)
    return items, len(following), content


def attach_items(node: Node) -> None:
    """Headings of articles without children take the items that follow; sub-items go below their main item, letters below the
    item that holds them. Children of an item stay below it."""
    for child in node.children:
        attach_items(child)
    out, at = [], 0
    while at < len(node.children):
        head = node.children[at]
        out.append(head)
        at += 1
        if head.children or not HEAD.match(head.title.strip()):
            continue
        items, used, content = gathered(head, node.children[at:])
        if items or content:
            head.content, at = content, at + used
        main: Node | None = None
        for item in items:
            item.content, letters = cut_items(item.content, LETTER_START)
            item.children += letters
            if main is not None and SUB.match(item.title.strip()):
                main.children.append(item)
            else:
                main = item if MAIN.match(item.title.strip()) else None
                head.children.append(item)
        head.children = [releveled(c, head.level + 1) for c in head.children]
    node.children = out


#: Documents whose nodes a worker has as Python objects at a time.
DOCUMENTS = 64


def attached(rows: DataFrame) -> DataFrame:
    """The rows of a tree (see tree.py) with items attached to headings. A document is the unit of work; its nodes are numbered anew.

    A document's nodes are gathered into one row; a task goes through documents in Arrow batches.
    """
    schema = StructType([StructField("doc_id", rows.schema["doc_id"].dataType), *[StructField(n, ArrayType(IntegerType())) for n in ("node", "parent")], StructField("level", IntegerType()), StructField("title", StringType()), StructField("content", StringType())])
    form = to_arrow_schema(schema)

    def of_document(nodes: list[dict]) -> Iterator[tuple]:
        tops, known = [], {}
        for n in nodes:
            known[tuple(n["node"])] = node = Node(n["level"], n["title"], n["content"])
            above = None if n["parent"] is None else known.get(tuple(n["parent"]))
            (tops if above is None else above.children).append(node)
        number = itertools.count()

        def walk(n: Node, parent: list[int] | None) -> Iterator[tuple]:
            own = [next(number)]
            yield own, parent, n.level, n.title, n.content
            for c in n.children:
                yield from walk(c, own)

        for top in tops:
            attach_items(top)
            yield from walk(top, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS):
                some = batch.slice(at, DOCUMENTS)
                found = [list(of_document(nodes)) for nodes in some.column("nodes").to_pylist()]
                own = np.repeat(np.arange(len(found)), [len(x) for x in found])
                made = zip(*itertools.chain.from_iterable(found))
                yield pa.RecordBatch.from_arrays([some.column("doc_id").take(pa.array(own)).cast(form[0].type), *[pa.array(c, f.type) for c, f in zip(made, list(form)[1:])]], schema=form)

    whole = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node", "parent", F.col("level").cast("int").alias("level"), "title", "content"))).alias("nodes"))
    return whole.mapInArrow(run, schema)


def reshaped(rows: DataFrame) -> DataFrame:
    """Node rows of each document after all passes: paragraphs merged, articles split, items attached and split, empty nodes
    lifted, numbered anew in order."""
    merged = tree.split_articles(tree.merged_paragraphs(tree.tree(rows)))
    return tree.numbered(tree.lifted(tree.split_inline_items(attached(merged))))


def outline(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Node rows of markdown documents: the processor by their marks, headings, blocks, nodes, and the passes over the tree."""
    lines = without_marker_lines(with_processor(split_lines(docs, id_col, text_col)), F.col("processor") == "garant")
    return reshaped(nodes(blocks(with_headings(lines))))


def valid_nodes(rows: DataFrame) -> DataFrame:
    """The rows, or an error where a level or a text is missing."""
    bad = F.col("level").isNull() | F.col("title").isNull() | F.col("content").isNull()
    return rows.filter(F.when(bad, F.raise_error(F.lit("node without level, title or content"))).otherwise(F.lit(True)))


def font_levels(paragraphs: DataFrame) -> DataFrame:
    """Sizes of type, largest first, as levels 1 to 6 within a document; smaller ones have none."""
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("font_pt")))
    return paragraphs.withColumn("font_level", F.when(rank <= 6, rank))


def typography(runs: DataFrame) -> DataFrame:
    """Per paragraph from its runs (text, bold, font_pt): shares of bold and upper-case characters, the largest size."""
    n = F.sum(F.length("text"))
    letters = F.sum(F.length(F.regexp_replace("text", r"[^\p{L}]", "")))
    upper = F.sum(F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")))
    return runs.groupBy("doc_id", "paragraph_no").agg(
        F.round(F.coalesce(F.try_divide(F.sum(F.when(F.col("bold"), F.length("text")).otherwise(0)), n), F.lit(0.0)), 6).alias("bold_ratio"),
        F.round(F.coalesce(F.try_divide(upper, letters), F.lit(0.0)), 6).alias("upper_ratio"), F.max("font_pt").alias("font_pt"),
    )


#: What a paragraph of a word processor can be a heading by, with the confidence in each: its outline level, a heading's style,
#: its list level, the rank of its size of type, and being short and mostly bold or upper-case, which stands for level 3.
CONFIDENCE = {"outline": 1.0, "style": 0.95, "list": 0.8, "font": 0.7, "look": 0.55}
SHORT, MOSTLY, LOOK_LEVEL = 120, 0.6, 3


def typographic_headings(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, paragraph_no, text, outline_level, style_level, list_level, font_pt, bold_ratio, upper_ratio) with the
    heading level, 1 to 6, of the candidate of highest confidence; NULL for one without any."""
    found = list_bases(font_levels(paragraphs))
    bounded = lambda c: F.greatest(F.lit(1), F.least(F.lit(6), c)).cast("int")
    look = (F.length("text") <= SHORT) & ((F.col("bold_ratio") >= MOSTLY) | (F.col("upper_ratio") >= MOSTLY))
    levels = {
        "outline": F.col("outline_level"), "style": F.col("style_level"), "list": F.col("list_level") + F.col("list_base"),
        "font": F.when(F.col("font_pt").isNotNull(), F.col("font_level")), "look": F.when(look, F.lit(LOOK_LEVEL)),
    }
    candidates = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(CONFIDENCE[name]).alias("confidence"), bounded(c).alias("level"))) for name, c in levels.items()]))
    best = F.array_max(candidates)
    return found.withColumns({"level": best["level"], "confidence": best["confidence"]}).drop("font_level", "list_base")


def typographic_paragraphs(runs: DataFrame) -> DataFrame:
    """From runs of DOCX files (path as doc_id) the paragraphs with text: superscripts as notes, levels, and ratios."""
    noted = F.when(F.col("superscript"), F.concat(F.lit(" (см.сноску "), "text", F.lit(")"))).otherwise(F.col("text"))
    own = runs.filter("text <> ''").select(F.col("path").alias("doc_id"), "paragraph_no", "run_no", noted.alias("text"), "bold", "font_pt", "style", "outline_level", "list_level")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("run_no", "text"))), lambda x: x["text"])
    style = F.regexp_extract(F.max("style"), r"(?i)^heading\s*([1-9])$", 1).try_cast("int")
    told = own.groupBy("doc_id", "paragraph_no").agg(
        T.strip(F.array_join(in_order, "")).alias("text"), (F.max("outline_level") + 1).alias("outline_level"), style.alias("style_level"), F.max("list_level").alias("list_level"), F.max("font_pt").alias("font_pt"),
        (F.sum(F.when(F.col("bold"), F.length("text")).otherwise(0)) / F.sum(F.length("text"))).alias("bold_ratio"),
    )
    letters = F.regexp_replace("text", "[^A-Za-zА-Яа-яЁё]", "")
    upper = F.coalesce(F.try_divide(F.length(F.regexp_replace(letters, "[^A-ZА-ЯЁ]", "")), F.length(letters)), F.lit(0.0))
    return told.filter("text <> ''").withColumn("upper_ratio", upper)


def typographic_markdown(runs: DataFrame) -> DataFrame:
    """(doc_id, text) of DOCX files by what their paragraphs look like: headings with hashes, a blank line after each paragraph."""
    headed = typographic_headings(typographic_paragraphs(runs))
    line = F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text")).otherwise(F.col("text"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("paragraph_no", line.alias("line")))), lambda x: x["line"])
    return headed.groupBy("doc_id").agg(T.footnotes(F.array_join(in_order, "\n\n")).alias("text"))


def docx_processors(runs: DataFrame) -> DataFrame:
    """(doc_id, processor): whether DOCX files have styles of headings, other styles or outline levels, or neither."""
    heading, plain = F.col("style").rlike(r"(?i)^heading\s*\d+"), F.col("style").rlike(r"(?i)^normal")
    marks = runs.groupBy(F.col("path").alias("doc_id")).agg(F.bool_or(F.coalesce(heading, F.lit(False))).alias("styled"), F.bool_or(F.col("outline_level").isNotNull() | F.coalesce(~heading & ~plain, F.lit(False))).alias("custom"))
    return marks.select("doc_id", F.when(F.col("styled"), "heading_styles").when(F.col("custom"), "custom_styles").otherwise("universal").alias("processor"))


# Smaller steps over lines and items.


def number_resets(items: DataFrame, key: str = "doc_id", order: str = "item_no") -> DataFrame:
    """Flags items that begin to count anew: number 1 after a larger one (`number` is the item's)."""
    before = F.lag("number").over(Window.partitionBy(key).orderBy(order))
    return items.withColumn("reset", F.coalesce((F.col("number") == 1) & (before > 1), F.lit(False)))


def best_headings(candidates: DataFrame) -> DataFrame:
    """Of the levels proposed for a paragraph the one of highest confidence, of equal ones the smaller level."""
    best = F.max_by("level", F.struct("confidence", (-F.col("level")).alias("l")))
    return candidates.groupBy("doc_id", "paragraph_no").agg(best.alias("level"), F.max("confidence").alias("confidence"))


def list_bases(paragraphs: DataFrame) -> DataFrame:
    """What list levels are raised by within a document: 1 less the smallest one."""
    return paragraphs.withColumn("list_base", 1 - F.min("list_level").over(Window.partitionBy("doc_id")))


def inline_items(text: Column) -> Column:
    """The items `1) a; 2) b` on one line, two at least, else none."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+\)\s+[^;]+?)(?=\s*;\s*\d+\)|;?\s*$)"), 1)
    return F.when(F.size(found) > 1, F.transform(found, lambda s: T.strip(s))).otherwise(F.array().cast("array<string>"))


def letter_items(text: Column) -> Column:
    """Lines that begin `а) `, each with the lines after it up to the next."""
    parts = F.split(text, r"\n(?=[а-яА-Я]\)\s)")
    return F.filter(F.transform(parts, lambda s: T.strip(s)), lambda s: s.rlike(T.LETTER_ITEM))


def noted(text: Column, notes: Column) -> Column:
    """Footnote digits at the words they belong to, for each (left, digits) of a document's list in turn: `left` and digits, with no digit
    before or after, become `left (см.сноску digits)`."""
    quoted = lambda x: F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    plain = lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))

    def one(so_far: Column, note: Column) -> Column:
        pattern = F.concat(F.lit("(?<![0-9])"), quoted(note["left"]), note["digits"], F.lit("(?![0-9])"))
        return F.regexp_replace(so_far, pattern, F.concat(plain(note["left"]), F.lit(" (см.сноску "), note["digits"], F.lit(")")))

    return F.coalesce(F.aggregate(notes, text, one), text)


def first_text(*columns: Column) -> Column:
    """The first that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])
