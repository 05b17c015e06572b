"""Queries of texts, outlines and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import outline as O
from ..operators import stats as A
from ..sources import derived as S
from .registry import query

BARE = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"
CHUNKS = S.LINES + f", chunks AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS chunk_no, {BARE} AS chunk_text FROM lines WHERE length({BARE}) >= 50)"


def chunk_lines(spark, d):
    """Chunks of documents whose lines are leaves; short ones take no number."""
    rows = S.lines(spark, d).select("doc_id", F.col("line_no").alias("node_no"), F.lit(1).alias("level"), F.lit("").alias("title"), F.col("line").alias("content"))
    return O.chunks(rows)


@query("t12_chunk_lines", f"WITH {CHUNKS} SELECT doc_id, chunk_no, length(chunk_text) AS n, md5(chunk_text) AS digest FROM chunks")
def t12(spark, d):
    return chunk_lines(spark, d).select("doc_id", "chunk_no", F.length("chunk_text").alias("n"), F.md5("chunk_text").alias("digest"))


@query("a26_chunk_size_stats", f"""WITH {CHUNKS}, s AS (SELECT lang, length(chunk_text) AS n FROM chunks) SELECT lang, count(*) AS chunks, min(n) AS min_len, max(n) AS max_len, round(avg(n), 6) AS mean_len, CAST(median(n) AS DOUBLE) AS median_len,
    count(*) FILTER (n < 500) AS under_500, count(*) FILTER (n >= 500 AND n < 1000) AS under_1000, count(*) FILTER (n >= 1000 AND n < 2000) AS under_2000, count(*) FILTER (n >= 2000) AS from_2000 FROM s GROUP BY lang""")
def a26(spark, d):
    langs = S.table(spark, d, "documents").select("doc_id", "lang")
    return A.chunk_sizes(chunk_lines(spark, d).select("doc_id", "chunk_text").join(langs, "doc_id"), "lang")


@query("w03_enumerate_then_filter", f"WITH {S.LINES} SELECT doc_id, line_no + 1 AS chunk_index, length({BARE}) AS n FROM lines WHERE length({BARE}) >= 10")
def w03(spark, d):
    bare = T.strip(F.col("line"))
    return S.lines(spark, d).select("doc_id", (F.col("line_no") + 1).cast("long").alias("chunk_index"), F.length(bare).alias("n")).filter("n >= 10")


PATHS = f"""{S.OUTLINE_LINES}, marked AS (SELECT *, max(CASE WHEN level = 1 THEN line_no END) OVER w AS at1, max(CASE WHEN level = 2 THEN line_no END) OVER w AS at2,
        lead(coalesce(level, 3)) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_level FROM outline_lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    paths AS (SELECT m.doc_id, m.line_no, coalesce(m.level, 3) AS level, m.title, CASE WHEN coalesce(m.level, 3) > 1 THEN a.title END AS t1, CASE WHEN coalesce(m.level, 3) > 2 AND at2 > at1 THEN b.title END AS t2,
        coalesce(next_level <= coalesce(m.level, 3), TRUE) AS is_leaf FROM marked m LEFT JOIN outline_lines a ON a.doc_id = m.doc_id AND a.line_no = at1 LEFT JOIN outline_lines b ON b.doc_id = m.doc_id AND b.line_no = at2)"""


def node_rows(spark, d):
    return S.outline_lines(spark, d).select("doc_id", F.col("line_no").alias("node_no"), F.coalesce("level", F.lit(3)).alias("level"), "title", F.lit("").alias("content"))


@query("w04_breadcrumb", f"WITH {PATHS} SELECT doc_id, line_no AS node_no, concat_ws(' > ', nullif(t1, ''), nullif(t2, '')) AS crumbs, CAST(is_leaf AS INTEGER) AS is_leaf FROM paths")
def w04(spark, d):
    found = O.with_path(node_rows(spark, d))
    return found.select("doc_id", F.col("node_no").cast("long").alias("node_no"), O.breadcrumbs(found).alias("crumbs"), F.col("is_leaf").cast("int"))


CONTENT_PATHS = PATHS.replace("line AS title FROM lines)", "substr(line, 1, 10) AS title, substr(line, 11) AS content FROM lines)").replace("m.title,", "m.title, m.content,", 1)


@query("t13_chunk_nodes_legacy", f"""WITH {CONTENT_PATHS}, h AS (SELECT *, concat_ws(' > ', nullif(t1, ''), nullif(t2, ''), nullif(title, '')) AS head FROM paths),
    c AS (SELECT doc_id, line_no, concat_ws(chr(10) || chr(10), nullif(head, ''), nullif(content, '')) AS chunk_text FROM h WHERE is_leaf OR length(content) >= 50)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS chunk_no, md5(chunk_text) AS digest FROM c WHERE regexp_replace(chunk_text, '\\s', '', 'g') <> ''""")
def t13(spark, d):
    rows = node_rows(spark, d).withColumns({"content": F.expr("substring(title, 11)"), "title": F.substring("title", 1, 10)})
    return O.legacy_chunks(rows).select("doc_id", "chunk_no", F.md5("chunk_text").alias("digest"))


@query("w05_item_segments", f"""WITH {S.ITEM_LINES}, s AS (SELECT *, sum(CAST(regexp_matches(line, '^\\d+[.)]') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no) AS segment FROM item_lines),
    g AS (SELECT doc_id, segment, min(line_no) AS first, regexp_matches(arg_min(line, line_no), '^\\d+[.)]\\s') AS is_item, regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '^\\s+|\\s+$', '', 'g') AS text FROM s GROUP BY doc_id, segment),
    a AS (SELECT doc_id, 1 AS item_no, regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '^\\s+|\\s+$', '', 'g') AS text FROM item_lines WHERE doc_id NOT IN (SELECT doc_id FROM g WHERE is_item) GROUP BY doc_id)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS item_no, md5(text) AS digest FROM g WHERE is_item AND text <> '' UNION ALL SELECT doc_id, item_no, md5(text) FROM a WHERE text <> ''""")
def w05(spark, d):
    return O.item_segments(S.item_lines(spark, d)).select("doc_id", "item_no", F.md5("text").alias("digest"))


HEADS = ("Глава {}. Общие", "Статья {}", "Статья {}. О праве", "IV. Раздел", "Раздел {} Первый", "{}. ОБЩИЕ ПОЛОЖЕНИЯ", "{}.1. Текст", "{}.1.2. Текст", "{}) пункт", "а) подпункт")
HEAD_SQL = "CASE line_no % 13 " + " ".join(f"WHEN {i} THEN '{h.replace('{}', chr(39) + ' || line_no || ' + chr(39))}'" for i, h in enumerate(HEADS)) + " ELSE line END"


def headed_lines(spark, d):
    n = F.col("line_no").cast("string")
    line = F.col("line")
    for i, h in enumerate(HEADS):
        parts = h.split("{}")
        made = F.lit(parts[0]) if len(parts) == 1 else F.concat(F.lit(parts[0]), n, F.lit(parts[1]))
        line = F.when(F.col("line_no") % 13 == i, made).otherwise(line)
    return S.lines(spark, d).select("doc_id", "line_no", line.alias("line"))


@query("t08_line_classify", f"""WITH {S.LINES}, h AS (SELECT doc_id, line_no, {HEAD_SQL} AS line FROM lines)
    SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^(?i)глава\\s+\\d+[.:]?\\s*.+$') THEN 1 WHEN regexp_matches(line, '^(?i)статья\\s+\\d+[.:]?\\s*.+$') THEN 2 END AS garant,
    CASE WHEN starts_with(line, '|') THEN NULL WHEN regexp_matches(line, '^\\d+\\.\\s+[А-ЯЁ\\s]+$') THEN 1 WHEN regexp_matches(line, '^\\d+\\.\\d+\\.\\d+\\.') THEN 3 WHEN regexp_matches(line, '^\\d+\\.\\d+\\.') THEN 2
        WHEN regexp_matches(line, '^\\d+\\)\\s+.') THEN 4 WHEN regexp_matches(line, '^[а-яА-Я]\\)\\s+.') THEN 5 END AS gost FROM h""")
def t08(spark, d):
    line = F.col("line")
    return headed_lines(spark, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), O.garant_level(line).alias("garant"), O.gost_level(line).alias("gost"))


@query("t11_processors", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'garant' WHEN 1 THEN 'consultant' WHEN 2 THEN 'gost' ELSE 'universal' END AS processor FROM documents")
def t11(spark, d):
    mark = F.element_at(F.array(F.lit("ГАРАНТ:\nГлава 1"), F.lit("текст\nСтатья 5. О"), F.lit("ГОСТ 123\n1. ОБЩЕЕ"), F.lit("plain")), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = S.table(spark, d, "documents").select("doc_id", F.concat(mark, F.lit("\n"), "text").alias("text"))
    return O.processors(O.split_lines(docs))


@query("f01_md_emphasis", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Title ' || doc_id WHEN 1 THEN 'Title ' || doc_id WHEN 2 THEN 'Title ' || doc_id || ' rest' ELSE 'a*b ' || doc_id END AS title FROM documents")
def f01(spark, d):
    key = F.col("doc_id").cast("string")
    title = F.concat(F.lit("Title "), key)
    text = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" **"), title, F.lit("** "))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("___"), title, F.lit("___")))
    text = text.when(F.col("doc_id") % 4 == 2, F.concat(F.lit("*"), title, F.lit("* rest"))).otherwise(F.concat(F.lit("a*b "), key))
    return S.table(spark, d, "documents").select("doc_id", T.strip_emphasis(text).alias("title"))


@query("f02_superscript", "SELECT doc_id, 'Статья ' || doc_id || ' (см.сноску 12) x (см.сноску 0)' AS text FROM documents")
def f02(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.footnotes(F.concat(F.lit("Статья "), F.col("doc_id").cast("string"), F.lit("¹² x⁰"))).alias("text"))


@query("f04_titles", """SELECT doc_id, CAST(doc_id % 5 = 0 AS INTEGER) AS roman, CAST(doc_id % 5 IN (1, 2) AS INTEGER) AS heading, CAST(doc_id % 5 IN (1, 2) AS INTEGER) AS article, CAST(doc_id % 5 = 3 AS INTEGER) AS numbered,
    CAST(doc_id % 5 = 4 AS INTEGER) AS sub, CAST(doc_id % 5 = 0 OR (doc_id % 5 IN (3, 4) AND doc_id % 2 = 1) AS INTEGER) AS paragraph FROM documents""")
def f04(spark, d):
    key = F.col("doc_id")
    n = F.when(key % 5 == 0, "xiv").when(key % 5 == 1, "Глава 3 Общее").when(key % 5 == 2, "IV. Прочее").when(key % 5 == 3, "7. Пункт").otherwise("б) подпункт")
    title = F.when((key % 5).isin(3, 4) & (key % 2 == 1), F.concat(n, F.lit(","))).when((key % 5 == 4) & (key % 2 == 0), F.concat(F.lit("1) "), n)).otherwise(n)
    flag = lambda c: c.cast("int")
    paragraph = T.is_paragraph(title, F.lit("x"), F.lit(False))
    return S.table(spark, d, "documents").select(
        "doc_id", flag(T.is_roman(n)).alias("roman"), flag(T.is_real_heading(title)).alias("heading"), flag(T.is_article_heading(title)).alias("article"), flag(T.is_numbered(title) & ~T.is_sub_item(title)).alias("numbered"),
        flag(T.is_sub_item(title)).alias("sub"), flag(paragraph).alias("paragraph"),
    )


@query("f13_clean_patterns", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[%$&#*]{3}', '', 'g'), '!!', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents")
def f13(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.md5(T.clean(F.col("text"), ["[%$&#*]{3}", "!!"])).alias("digest"))


@query("f14_drop_marker_lines", f"""WITH {S.LINES}, m AS (SELECT doc_id, line_no, CASE line_no % 7 WHEN 1 THEN ' ГАРАНТ: ' WHEN 2 THEN '' WHEN 3 THEN 'См. комментарии к статье 5' WHEN 4 THEN ' ' ELSE line END AS line FROM lines)
    SELECT doc_id, line_no FROM m WHERE line_no % 7 NOT IN (1, 2, 3, 4) AND NOT (regexp_replace(line, '\\s', '', 'g') = '' AND line_no % 7 = 5)""")
def f14(spark, d):
    k = F.col("line_no") % 7
    line = F.when(k == 1, " ГАРАНТ: ").when(k == 2, "").when(k == 3, "См. комментарии к статье 5").when(k == 4, " ").otherwise(F.col("line"))
    return O.without_marker_lines(S.lines(spark, d).select("doc_id", "line_no", line.alias("line"))).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query("f18_language_rule", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'tg' WHEN 1 THEN 'be' WHEN 2 THEN 'tg' WHEN 3 THEN 'tg' ELSE 'ru' END AS language FROM documents")
def f18(spark, d):
    k = F.col("doc_id") % 5
    text = F.concat("text", F.when(k == 0, " Ҷ").when(k == 1, " ў").when(k == 2, " ДАВЛАТ").otherwise(""))
    return S.table(spark, d, "documents").select("doc_id", T.language(text, F.when(k == 3, "fa").otherwise("en")).alias("language"))


@query("a30_font_rank", "WITH r AS (SELECT p_brand AS doc_id, p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part) SELECT doc_id, p_partkey, CASE WHEN r <= 6 THEN CAST(r AS INTEGER) END AS font_level FROM r")
def a30(spark, d):
    return O.font_levels(S.table(spark, d, "part").select(F.col("p_brand").alias("doc_id"), "p_partkey", F.col("p_size").alias("font_pt"))).select("doc_id", "p_partkey", "font_level")


@query("a32_typography", r"""WITH r AS (SELECT doc_id, line_no // 3 AS paragraph_no, line, line_no % 2 = 0 AS bold, CAST(8 + line_no % 5 AS INTEGER) AS font_pt FROM lines)
    SELECT doc_id, paragraph_no, round(coalesce(sum(CASE WHEN bold THEN length(line) ELSE 0 END) / nullif(CAST(sum(length(line)) AS DOUBLE), 0), 0), 6) AS bold_ratio,
        round(coalesce(sum(length(regexp_replace(line, '[^\p{Lu}]', '', 'g'))) / nullif(CAST(sum(length(regexp_replace(line, '[^\p{L}]', '', 'g'))) AS DOUBLE), 0), 0), 6) AS upper_ratio, max(font_pt) AS font_pt FROM r GROUP BY 1, 2""".replace("WITH r", f"WITH {S.LINES}, r"))
def a32(spark, d):
    n = F.col("line_no")
    runs = S.lines(spark, d).select("doc_id", F.floor(n / 3).alias("paragraph_no"), F.col("line").alias("text"), (n % 2 == 0).alias("bold"), (8 + n % 5).alias("font_pt"))
    return O.typography(runs)


@query("a31_list_base", "SELECT c_custkey, CAST(1 - min(c_custkey % 9 + c_nationkey % 4) OVER (PARTITION BY c_nationkey) AS BIGINT) AS list_base FROM customer")
def a31(spark, d):
    rows = S.table(spark, d, "customer").select(F.col("c_nationkey").alias("doc_id"), "c_custkey", (F.col("c_custkey") % 9 + F.col("c_nationkey") % 4).alias("list_level"))
    return O.list_bases(rows).select("c_custkey", F.col("list_base").cast("long").alias("list_base"))


LETTERS = "regexp_replace(line, '[^A-Za-zА-Яа-яЁё]', '', 'g')"


@query("w08_typographic_headings", f"""WITH {S.LINES}, p AS (SELECT doc_id, line_no, line, CASE WHEN line_no % 11 = 0 THEN line_no % 3 + 1 END AS outline_level, CASE WHEN line_no % 7 = 0 THEN line_no % 9 + 1 END AS style_level,
        CASE WHEN line_no % 5 = 0 THEN line_no % 4 + doc_id % 3 END AS list_level, CASE WHEN line_no % 3 <> 1 THEN 8.0 + line_no % 9 END AS font_pt, (line_no % 10) / 10.0 AS bold_ratio,
        coalesce(length(regexp_replace({LETTERS}, '[^A-ZА-ЯЁ]', '', 'g')) / nullif(CAST(length({LETTERS}) AS DOUBLE), 0), 0) AS upper_ratio FROM lines),
    f AS (SELECT doc_id, font_pt, row_number() OVER (PARTITION BY doc_id ORDER BY font_pt DESC) AS font_level FROM (SELECT DISTINCT doc_id, font_pt FROM p WHERE font_pt IS NOT NULL)),
    b AS (SELECT doc_id, 1 - min(list_level) AS base FROM p GROUP BY doc_id)
    SELECT p.doc_id, p.line_no, CAST(least(6, greatest(1, CASE WHEN outline_level IS NOT NULL THEN outline_level WHEN style_level IS NOT NULL THEN style_level WHEN list_level IS NOT NULL THEN list_level + base
        WHEN font_level <= 6 THEN font_level WHEN length(line) <= 120 AND (bold_ratio >= 0.6 OR upper_ratio >= 0.6) THEN 3 END)) AS INTEGER) AS level FROM p JOIN b USING (doc_id) LEFT JOIN f ON f.doc_id = p.doc_id AND f.font_pt = p.font_pt
    WHERE outline_level IS NOT NULL OR style_level IS NOT NULL OR list_level IS NOT NULL OR font_level <= 6 OR (length(line) <= 120 AND (bold_ratio >= 0.6 OR upper_ratio >= 0.6))""")
def w08_typographic(spark, d):
    n, letters = F.col("line_no"), F.regexp_replace("line", "[^A-Za-zА-Яа-яЁё]", "")
    upper = F.coalesce(F.try_divide(F.length(F.regexp_replace(letters, "[^A-ZА-ЯЁ]", "")), F.length(letters)), F.lit(0.0))
    paragraphs = S.lines(spark, d).select(
        "doc_id", n.cast("long").alias("paragraph_no"), F.col("line").alias("text"), F.when(n % 11 == 0, n % 3 + 1).alias("outline_level"), F.when(n % 7 == 0, n % 9 + 1).alias("style_level"),
        F.when(n % 5 == 0, n % 4 + F.col("doc_id") % 3).alias("list_level"), F.when(n % 3 != 1, 8.0 + n % 9).alias("font_pt"), ((n % 10) / 10).alias("bold_ratio"), upper.alias("upper_ratio"),
    )
    return O.typographic_headings(paragraphs).filter("level IS NOT NULL").select("doc_id", F.col("paragraph_no").alias("line_no"), "level")


@query("t14_first_titles", f"""WITH {S.OUTLINE_LINES}, t AS (SELECT doc_id, title, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM outline_lines WHERE regexp_replace(title, '\\s', '', 'g') <> '')
    SELECT doc_id, md5(string_agg(title, chr(10) ORDER BY k) FILTER (k <= 50)) AS digest, greatest(max(n) - 50, 0) AS others FROM t GROUP BY doc_id""")
def t14(spark, d):
    return O.all_titles(node_rows(spark, d)).select("doc_id", F.md5("titles").alias("digest"), "others")


@query("t12_outline_chunks")
def t12_outline(spark, d):
    """The whole way from markdown to chunks: processor, headings, blocks, nodes, tree passes, items."""
    lines = headed_lines(spark, d)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return O.chunks(O.outline(lines.groupBy("doc_id").agg(text.alias("text")))).select("doc_id", "chunk_no", "title", "crumb_text", "chunk_text", "text_length")


@query("s01_html_to_text_outline")
def s01(spark, d):
    from ..sources.files import html_to_markdown

    pages = S.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), html_to_markdown(F.col("html")).alias("text"))
    return O.outline(pages)
