"""The passes over outline trees as steps over node rows (doc_id, node, parent, level, title, content).

A node is an array of numbers, and nodes in the order of these arrays are the document from top to bottom: a node that a pass
adds below another has that one's numbers and further ones. The root's parent is NULL. All steps are windows, aggregations and
joins by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed patterns: a line with an article's number alone, items `1) a; 2) b` up to the next one or the end of a line.
ARTICLE_PARTS = r"(?iu)(?:\A|\n)(?=Статья\s+\d+\s*(?:\n|\z))"
ARTICLE_TITLE = r"(?iu)\A(Статья\s+\d+)\s*(?:\n|\z)"
INLINE_ITEM = r"\d+\)\s+[^;]*?(?=\s*;\s*\d+\)|;?\s*$)"
#: Levels that headings and what the passes add below them can have.
DEPTH = 12

COLUMNS = ("doc_id", "node", "parent", "level", "title", "content")


def in_order() -> Window:
    return Window.partitionBy("doc_id").orderBy("node")


def blank(text: Column) -> Column:
    return T.strip(text) == ""


def tree(rows: DataFrame) -> DataFrame:
    """Node rows (doc_id, node_no, level, title, content) in order, the root with level 0 among them, as a tree: the parent is the
    last node before with a smaller level. A row without one is a root itself."""
    before = Window.partitionBy("doc_id").orderBy("node_no").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.col("node_no")), ignorenulls=True).over(before) for k in range(DEPTH)]
    parent = F.greatest(*[F.when(F.col("level") > k, x) for k, x in enumerate(last)])
    return rows.select("doc_id", F.array("node_no").alias("node"), F.when(parent.isNotNull(), F.array(parent)).alias("parent"), "level", "title", "content")


def numbered(rows: DataFrame) -> DataFrame:
    """(doc_id, node_no, level, title, content) of a tree's rows, numbered in order from 0."""
    return rows.select("doc_id", (F.row_number().over(in_order()) - 1).alias("node_no"), "level", "title", "content")


def has_children() -> Column:
    """A node's first child stands right after it."""
    return F.coalesce(F.lead("parent").over(in_order()) == F.col("node"), F.lit(False))


def merged_paragraphs(rows: DataFrame) -> DataFrame:
    """Runs of two and more paragraphs of one level among siblings become one node.

    Its content is all titles and contents, joined by a space if the first ends with a comma or semicolon, else by a blank line; its
    title the first one of under 50 characters, or else the first of all if it is under 100 and no part of a sentence, which then
    is not repeated in the content.
    """
    paragraph = F.col("parent").isNotNull() & T.is_paragraph(F.col("title"), F.col("content"), F.col("inner"))
    among = Window.partitionBy("doc_id", "parent").orderBy("node")
    found = rows.withColumn("inner", has_children()).withColumn("paragraph", paragraph)
    goes_on = F.col("paragraph") & F.lag("paragraph", 1, False).over(among) & (F.lag("level").over(among) == F.col("level"))
    found = found.withColumn("goes_on", F.coalesce(goes_on, F.lit(False))).withColumn("run", F.sum((~F.col("goes_on")).cast("int")).over(among))
    runs = found.groupBy("doc_id", "parent", "run").agg(F.array_sort(F.collect_list(F.struct("node", "title", "content"))).alias("all"), F.min("level").alias("level"))
    some = lambda texts: F.filter(F.transform(texts, T.strip), lambda t: t != "")
    parts = some(F.flatten(F.transform("all", lambda x: F.array(x["title"], x["content"]))))
    runs = runs.withColumns({"parts": parts, "first": F.col("all")[0], "short": F.get(F.filter(some(F.transform("all", lambda x: x["title"])), lambda t: F.length(t) < 50), F.lit(0))})
    broken = lambda t: F.right(t, F.lit(1)).isin(",", ";")
    head = T.strip(F.col("first.title"))
    content = T.strip(F.when(broken(F.get("parts", F.lit(0))), F.array_join("parts", " ")).otherwise(F.array_join("parts", "\n\n")))
    named = F.col("short").isNull() & (F.length(head) < 100) & ~broken(head)
    less = F.when(named & F.startswith(content, head), T.strip(F.substr(content, F.length(head) + 1))).otherwise(content)
    one = F.size("all") == 1
    title = F.when(one, F.col("first.title")).otherwise(F.coalesce("short", F.when(named, head), F.lit("")))
    return runs.select("doc_id", F.col("first.node").alias("node"), "parent", "level", title.alias("title"), F.when(one, F.col("first.content")).otherwise(less).alias("content"))


def with_added(rows: DataFrame, title: Column, content: Column, added: Column) -> DataFrame:
    """The rows with another title and content, and below each the nodes of an array (place, level, title, content)."""
    own = F.struct("node", "parent", "level", title.alias("title"), content.alias("content"))
    below = F.transform(added, lambda a: F.struct(F.concat("node", a["place"]).alias("node"), F.col("node").alias("parent"), a["level"].alias("level"), a["title"].alias("title"), a["content"].alias("content")))
    return rows.select("doc_id", F.explode(F.concat(F.array(own), below)).alias("n")).select("doc_id", "n.*")


def split_articles(rows: DataFrame) -> DataFrame:
    """Lines of the root's content that name an article and nothing else begin nodes of level 2, its first children."""
    top = F.col("parent").isNull() & blank(F.col("title"))
    parts = F.split(T.strip(F.col("content")), ARTICLE_PARTS)
    article = lambda p: p.rlike(ARTICLE_TITLE)
    made = F.transform(F.filter(parts, article), lambda p, i: F.struct(F.array(i + 1).alias("place"), F.lit(2).alias("level"), F.regexp_extract(p, ARTICLE_TITLE, 1).alias("title"), T.strip(F.regexp_replace(p, ARTICLE_TITLE, "")).alias("content")))
    some = top & F.exists(parts, article)
    rest = T.strip(F.array_join(F.filter(parts, lambda p: ~article(p)), ""))
    nothing = F.array().cast("array<struct<place:array<int>,level:int,title:string,content:string>>")
    return with_added(rows, F.col("title"), F.when(some, rest).otherwise(F.col("content")), F.when(some, made).otherwise(nothing))


def split_inline_items(rows: DataFrame) -> DataFrame:
    """Two and more items `1) a; 2) b` on one line (two at most) of a content become its node's first children; a title that is an
    item itself is the first of them. The rest stays as content, its white space single spaces."""
    bare, head = T.strip(F.col("content")), T.strip(F.col("title"))
    own = T.is_sub_item(F.col("title")) & (bare != "")
    text = F.when(own, F.concat(head, F.when(bare.rlike(T.SUB_ITEM), "; ").otherwise(" "), bare)).otherwise(bare)
    found = rows.withColumn("text", text).withColumn("items", F.regexp_extract_all("text", F.lit(f"(?smd)({INLINE_ITEM})"), 1))
    span = F.regexp_extract("text", f"(?smd)({INLINE_ITEM}(?:.*{INLINE_ITEM})?)", 1)
    some = F.when(F.size("items") > 1, F.length(span) - F.length(F.replace(span, F.lit("\n"))) <= 1).otherwise(False)
    rest = F.regexp_replace("text", rf"(?smd){INLINE_ITEM}\s*;?\s*", "")
    left = T.strip(F.regexp_replace(F.when(own, F.regexp_replace(rest, r"\s*;\s*", " ")).otherwise(rest), r"(?U)\s+", " "))
    left = F.when(own & left.rlike(T.SUB_ITEM), "").otherwise(left)
    made = F.transform("items", lambda t, i: F.struct(F.array(F.lit(-1), i + 1).alias("place"), (F.col("level") + 1).cast("int").alias("level"), T.strip(t).alias("title"), F.lit("").alias("content")))
    nothing = F.array().cast("array<struct<place:array<int>,level:int,title:string,content:string>>")
    found = found.withColumn("some", some)
    return with_added(found, F.when(F.col("some") & own, "").otherwise(F.col("title")), F.when(F.col("some"), left).otherwise(F.col("content")), F.when(F.col("some"), made).otherwise(nothing))


def lifted(rows: DataFrame) -> DataFrame:
    """Nodes with children but neither title nor content go, and their children take their place, one level below the node that
    becomes the parent.

    The empty nodes of a document stand by its rows as a map from each to its parent, which every node climbs until it comes
    to one that stays; levels rise along a path, so that there are no more steps than levels. Documents without empty nodes
    have empty maps.
    """
    whole = Window.partitionBy("doc_id")
    found = rows.withColumn("inner", has_children())
    found = found.withColumn("empty", F.col("parent").isNotNull() & blank(F.col("title")) & blank(F.col("content")) & F.col("inner"))
    entries = lambda which, value: F.map_from_entries(F.collect_list(F.when(which, F.struct("node", value))).over(whole))
    found = found.withColumns({"some": F.bool_or("empty").over(whole), "most": F.max("level").over(whole)})
    found = found.withColumns({"up": entries(F.col("empty"), "parent"), "levels": entries(F.col("some") & F.col("inner") & ~F.col("empty"), "level")})
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size("up"), F.col("most"))))
    climbed = F.aggregate(steps, F.col("parent"), lambda at, _: F.coalesce(F.try_element_at("up", at), at))
    out = found.filter(~F.col("empty")).withColumn("to", F.when(F.col("some"), climbed).otherwise(F.col("parent")))
    level = F.when(F.col("to") != F.col("parent"), F.try_element_at("levels", F.col("to")) + 1).otherwise(F.col("level"))
    return out.select("doc_id", "node", F.col("to").alias("parent"), level.cast("int").alias("level"), "title", "content")
