"""Queries of outline trees: parents, and the passes one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tree as R
from ..sources import derived as S
from .registry import query

#: SQL of white space at the ends, of titles that are no paragraphs, and of items.
BARE = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
TITLE, CONTENT = BARE.format("title"), BARE.format("content")
REAL = r"(?i)^(?:(?:раздел|глава|часть|статья|параграф)\s|конституция|преамбула|[ivxlcdm]+\.)"


def nodes(spark, d) -> DataFrame:
    return R.tree(S.outline_nodes(spark, d))


def told(rows: DataFrame) -> DataFrame:
    """A node's numbers as text, its parent's, and digests of its texts."""
    number = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ".")  # noqa: E731
    return rows.select("doc_id", number("node").alias("node"), number("parent").alias("parent"), "level", F.md5("title").alias("title"), F.md5("content").alias("content"))


@query("t02_parents", f"WITH {S.OUTLINE_NODES} SELECT n.doc_id, CAST(n.node_no AS VARCHAR) AS node, (SELECT CAST(max(p.node_no) AS VARCHAR) FROM outline_nodes p WHERE p.doc_id = n.doc_id AND p.node_no < n.node_no AND p.level < n.level) AS parent, n.level, md5(n.title) AS title, md5(n.content) AS content FROM outline_nodes n")
def t02(spark, d):
    return told(nodes(spark, d))


@query("t03_merged_paragraphs", rf"""WITH {S.OUTLINE_NODES}, flagged AS (
        SELECT t.*, {TITLE} AS head, t.level > 0 AND NOT EXISTS (SELECT 1 FROM tree c WHERE c.doc_id = t.doc_id AND c.parent_no = t.node_no)
            AND ({TITLE} = '' OR (NOT regexp_matches({TITLE}, '{REAL}') AND (length({TITLE}) > 150 OR right({TITLE}, 1) IN (',', ';') OR regexp_matches({TITLE}, '^\p{{Ll}}')))) AS paragraph FROM tree t),
    marked AS (SELECT *, CASE WHEN paragraph AND lag(paragraph) OVER w AND lag(level) OVER w = level THEN 0 ELSE 1 END AS begins FROM flagged WINDOW w AS (PARTITION BY doc_id, parent_no ORDER BY node_no)),
    runs AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id, parent_no ORDER BY node_no) AS run FROM marked),
    pieces AS (SELECT doc_id, parent_no, run, node_no, 0 AS side, head AS piece FROM runs UNION ALL SELECT doc_id, parent_no, run, node_no, 1, {CONTENT} FROM runs),
    joined AS (SELECT doc_id, parent_no, run, array_agg(piece ORDER BY node_no, side) FILTER (piece <> '') AS parts FROM pieces GROUP BY 1, 2, 3),
    groups AS (SELECT doc_id, parent_no, run, count(*) AS n, min(node_no) AS node_no, min(level) AS level, arg_min(title, node_no) AS title, arg_min(content, node_no) AS content, arg_min(head, node_no) AS head,
        arg_min(head, node_no) FILTER (head <> '' AND length(head) < 50) AS short FROM runs GROUP BY 1, 2, 3),
    whole AS (SELECT g.*, coalesce({BARE.format("CASE WHEN right(j.parts[1], 1) IN (',', ';') THEN array_to_string(j.parts, ' ') ELSE array_to_string(j.parts, chr(10) || chr(10)) END")}, '') AS all_text, short IS NULL AND length(head) < 100 AND right(head, 1) NOT IN (',', ';') AS named
        FROM groups g JOIN joined j ON j.doc_id = g.doc_id AND j.parent_no IS NOT DISTINCT FROM g.parent_no AND j.run = g.run)
    SELECT doc_id, CAST(node_no AS VARCHAR) AS node, CAST(parent_no AS VARCHAR) AS parent, level, md5(CASE WHEN n = 1 THEN title WHEN short IS NOT NULL THEN short WHEN named THEN head ELSE '' END) AS title,
        md5(CASE WHEN n = 1 THEN content WHEN named AND starts_with(all_text, head) THEN {BARE.format("substr(all_text, length(head) + 1)")} ELSE all_text END) AS content FROM whole""")
def t03(spark, d):
    return told(R.merged_paragraphs(nodes(spark, d)))


@query("t04_split_articles", rf"""WITH {S.OUTLINE_NODES}, line_rows AS (SELECT doc_id, unnest(string_split({CONTENT}, chr(10))) AS line, unnest(range(len(string_split({CONTENT}, chr(10))))) AS i FROM tree WHERE level = 0),
    marked AS (SELECT *, sum(CAST(regexp_matches(line, '(?i)^статья\s+\d+\s*$') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM line_rows),
    parts AS (SELECT doc_id, part, CASE WHEN part > 0 THEN regexp_replace(arg_min(line, i), '\s+$', '') ELSE '' END AS title, {BARE.format("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (part = 0 OR NOT regexp_matches(line, '(?i)^статья' || chr(92) || 's+' || chr(92) || 'd+' || chr(92) || 's*$')), '')")} AS content FROM marked GROUP BY 1, 2),
    split AS (SELECT DISTINCT doc_id FROM parts WHERE part > 0)
    SELECT t.doc_id, CAST(node_no AS VARCHAR) AS node, CAST(parent_no AS VARCHAR) AS parent, level, md5(t.title) AS title, md5(CASE WHEN t.level = 0 AND s.doc_id IS NOT NULL THEN coalesce(p.content, '') ELSE t.content END) AS content
    FROM tree t LEFT JOIN split s ON s.doc_id = t.doc_id LEFT JOIN parts p ON p.doc_id = t.doc_id AND t.level = 0 AND p.part = 0
    UNION ALL SELECT doc_id, '0.' || part, '0', 2, md5(title), md5(content) FROM parts WHERE part > 0""")
def t04(spark, d):
    return told(R.split_articles(nodes(spark, d)))


@query("t06_inline_items", rf"""WITH {S.OUTLINE_NODES}, texts AS (SELECT *, {CONTENT} AS bare, {TITLE} AS head, regexp_matches({TITLE}, '^(?:\d+|[а-яА-Я])\)\s') AND {CONTENT} <> '' AS own FROM tree),
    whole AS (SELECT *, CASE WHEN own THEN head || CASE WHEN regexp_matches(bare, '^(?:\d+|[а-яА-Я])\)\s') THEN '; ' ELSE ' ' END || bare ELSE bare END AS text FROM texts),
    -- pieces between semicolons: an item goes from a piece's first number to the end of its line, if a next item or the end of a line follows
    pieces AS (SELECT doc_id, node_no, unnest(string_split(text, ';')) AS piece, unnest(range(len(string_split(text, ';')))) AS k, len(string_split(text, ';')) AS n FROM whole),
    followed AS (SELECT *, lead(piece) OVER (PARTITION BY doc_id, node_no ORDER BY k) AS following, regexp_extract(piece, '\d+\)\s+(?s:.*)$') AS item FROM pieces),
    found AS (SELECT doc_id, node_no, k, regexp_replace(regexp_replace(item, '
(?s:.*)$', ''), '\s+$', '') AS item, length(piece) - length(item) AS at, strpos(item, chr(10)) > 0 AS broken FROM followed
        WHERE item <> '' AND (strpos(item, chr(10)) > 0 OR following IS NULL OR regexp_matches(following, '^\s*\d+\)') OR regexp_matches(following, '^[ 	
]*(
|$)'))),
    items AS (SELECT *, row_number() OVER (PARTITION BY doc_id, node_no ORDER BY k) AS i, count(*) OVER (PARTITION BY doc_id, node_no) AS many, min(k) OVER (PARTITION BY doc_id, node_no) AS first_k, max(k) OVER (PARTITION BY doc_id, node_no) AS last_k FROM found),
    lines_between AS (SELECT i.doc_id, i.node_no, sum(length(p.piece) - length(replace(p.piece, chr(10), ''))) AS breaks FROM (SELECT DISTINCT doc_id, node_no, first_k, last_k FROM items) i JOIN pieces p ON p.doc_id = i.doc_id AND p.node_no = i.node_no AND p.k >= i.first_k AND p.k < i.last_k GROUP BY 1, 2),
    taken AS (SELECT i.* FROM items i LEFT JOIN lines_between b ON b.doc_id = i.doc_id AND b.node_no = i.node_no WHERE many > 1 AND coalesce(b.breaks, 0) <= 1),
    rests AS (SELECT p.doc_id, p.node_no, string_agg(CASE WHEN t.k IS NULL THEN p.piece || CASE WHEN p.k < p.n - 1 THEN ';' ELSE '' END
        ELSE substr(p.piece, 1, t.at) || ltrim(substr(p.piece, t.at + 1 + length(t.item)), ' ' || chr(10)) || CASE WHEN t.broken AND p.k < p.n - 1 THEN ';' ELSE '' END END, '' ORDER BY p.k) AS rest
        FROM pieces p LEFT JOIN taken t ON t.doc_id = p.doc_id AND t.node_no = p.node_no AND t.k = p.k WHERE EXISTS (SELECT 1 FROM taken x WHERE x.doc_id = p.doc_id AND x.node_no = p.node_no) GROUP BY 1, 2)
    SELECT w.doc_id, CAST(w.node_no AS VARCHAR) AS node, CAST(parent_no AS VARCHAR) AS parent, level, md5(CASE WHEN r.doc_id IS NOT NULL AND own THEN '' ELSE title END) AS title,
        md5(CASE WHEN r.doc_id IS NULL THEN content ELSE {BARE.format("regexp_replace(CASE WHEN own THEN regexp_replace(r.rest, '" + chr(92) + "s*;" + chr(92) + "s*', ' ', 'g') ELSE r.rest END, '" + chr(92) + "s+', ' ', 'g')")} END) AS content
    FROM whole w LEFT JOIN rests r ON r.doc_id = w.doc_id AND r.node_no = w.node_no
    UNION ALL SELECT t.doc_id, t.node_no || '.-1.' || i, CAST(t.node_no AS VARCHAR), w.level + 1, md5(item), md5('') FROM taken t JOIN whole w ON w.doc_id = t.doc_id AND w.node_no = t.node_no""")
def t06(spark, d):
    return told(R.split_inline_items(nodes(spark, d)))


@query("t07_lift_empty", f"""WITH RECURSIVE {S.OUTLINE_NODES}, empties AS (SELECT doc_id, node_no, parent_no FROM tree t WHERE level > 0 AND {TITLE} = '' AND {CONTENT} = '' AND EXISTS (SELECT 1 FROM tree c WHERE c.doc_id = t.doc_id AND c.parent_no = t.node_no)),
    climb AS (SELECT doc_id, node_no, parent_no AS above, 0 AS steps FROM tree UNION ALL SELECT c.doc_id, c.node_no, e.parent_no, steps + 1 FROM climb c JOIN empties e ON e.doc_id = c.doc_id AND e.node_no = c.above),
    ended AS (SELECT doc_id, node_no, arg_max(above, steps) AS above, max(steps) AS steps FROM climb WHERE above IS NOT NULL GROUP BY 1, 2)
    SELECT t.doc_id, CAST(t.node_no AS VARCHAR) AS node, CAST(c.above AS VARCHAR) AS parent, CASE WHEN c.steps > 0 THEN p.level + 1 ELSE t.level END AS level, md5(t.title) AS title, md5(t.content) AS content
    FROM tree t LEFT JOIN ended c ON c.doc_id = t.doc_id AND c.node_no = t.node_no LEFT JOIN tree p ON p.doc_id = t.doc_id AND p.node_no = c.above WHERE NOT EXISTS (SELECT 1 FROM empties e WHERE e.doc_id = t.doc_id AND e.node_no = t.node_no)""")
def t07(spark, d):
    return told(R.lifted(nodes(spark, d)))
