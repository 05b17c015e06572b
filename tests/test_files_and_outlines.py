import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quizloom.functions import text as T
from quizloom.operators import assistant as A
from quizloom.operators import export as E
from quizloom.operators import outline as O
from quizloom.operators import questions as Q
from quizloom.operators import scorers as R
from quizloom.operators import tree as R2
from quizloom.operators import versions as V
from quizloom.sinks import files as sinks
from quizloom.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, want",
    [("Статья 92¹", "Статья 92 (см.сноску 1)"), ("Статья 92¹²", "Статья 92 (см.сноску 12)"), ("см. ст. 5³ настоящего Кодекса", "см. ст. 5 (см.сноску 3) настоящего Кодекса"), ("a⁰¹²³⁴⁵⁶⁷⁸⁹b", "a (см.сноску 0123456789)b"), ("none 12", "none 12")],
)
def test_footnotes(spark, raw, want):
    assert one(spark, T.footnotes(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [("**Статья 14.** Название", "Статья 14. Название"), (" __x__ ", "x"), ("***a***", "a"), ("a **b** c", "a **b** c"), ("*", "*"), ("", "")])
def test_emphasis(spark, raw, want):
    assert one(spark, T.strip_emphasis(F.lit(raw))) == want


CODE = """Преамбула кодекса.

Глава 3.
ПРЕСТУПЛЕНИЕ И НАКАЗАНИЕ

**Статья 14.** Понятие преступления

1. Преступлением признается виновно совершенное деяние.
2. Не является преступлением действие, формально содержащее признаки.

**Статья 15.** Категории преступлений

1. В зависимости от характера деяния подразделяются на категории.
1.1. Особое положение.
2. Преступлениями небольшой тяжести признаются деяния:
а) умышленные;
б) неосторожные.

Глава 4 Лица

**Статья 19.** Общие условия

Уголовной ответственности подлежит только вменяемое физическое лицо, достигшее возраста.
"""


def test_code_of_law(spark):
    docs = spark.createDataFrame([(1, CODE)], "doc_id long, text string")
    nodes = O.outline(docs).orderBy("node_no").collect()
    titles = [r["title"] for r in nodes]
    assert "Глава 3. ПРЕСТУПЛЕНИЕ И НАКАЗАНИЕ" in titles and not any("**" in t for t in titles)
    assert [t for t in titles if t.startswith("Статья")] == ["Статья 14. Понятие преступления", "Статья 15. Категории преступлений", "Статья 19. Общие условия"]
    chunks = O.chunks(O.outline(docs), 10).orderBy("chunk_no").collect()
    fifteen = [c for c in chunks if "Статья 15" in c["chunk_text"]]
    assert len(fifteen) >= 1 and all("Глава 3" in c["crumb_text"] for c in fifteen) and not any("Понятие" in c["chunk_text"] or "Общие условия" in c["chunk_text"] for c in fifteen)
    assert [c["chunk_no"] for c in chunks] == list(range(1, len(chunks) + 1))
    records = O.chunk_records(O.chunks(O.outline(docs), 10), F.lit("code"))
    assert {r["fragment_id"] for r in records.collect()} == {f"1_{c['chunk_no']}" for c in chunks}


def test_blocks(spark):
    text = "Title\n===\n\npara one\nline two\n# Head #\nSub\n---\n\n---\nlast"
    got = O.blocks(O.split_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))).orderBy("block_no").collect()
    assert [(r["kind"], r["level"], r["text"]) for r in got] == [("heading", 1, "Title"), ("para", None, "para one\nline two"), ("heading", 1, "Head"), ("heading", 2, "Sub"), ("para", None, "---\nlast")]


def tree_rows(spark, rows):
    """Rows (level, title, content) in order as the rows of a tree."""
    return R2.tree(spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc_id long, node_no int, level int, title string, content string"))


def listed(rows):
    return [(r["level"], r["title"], r["content"]) for r in rows.orderBy("node").collect()]


def test_articles_are_split_and_items_attached(spark):
    rows = tree_rows(spark, [(0, "", "before\nСтатья 7\nbody"), (1, "Статья 1", ""), (1, "1. first", "text"), (1, "1) sub", ""), (1, "2. second", ""), (1, "Статья 2", ""), (1, "1. other", "")])
    split = R2.split_articles(rows)
    assert listed(split)[:2] == [(0, "", "before"), (2, "Статья 7", "body")]
    assert listed(O.attached(split)) == [(0, "", "before"), (2, "Статья 7", "body"), (1, "Статья 1", ""), (2, "1. first", "text"), (3, "1) sub", ""), (2, "2. second", ""), (1, "Статья 2", ""), (2, "1. other", "")]


def test_paragraphs_are_merged(spark):
    rows = tree_rows(spark, [(0, "", ""), (2, "part one,", "a"), (2, "and part two", "b"), (2, "Глава 1", ""), (3, "X" * 60, ""), (3, "", "only"), (3, "lower " * 12, "")])
    assert listed(R2.merged_paragraphs(rows)) == [(0, "", ""), (2, "part one,", "part one, a and part two b"), (2, "Глава 1", ""), (3, "X" * 60, ""), (3, "", "only\n\n" + ("lower " * 12).strip())]


def test_inline_items_and_empty_nodes(spark):
    rows = tree_rows(spark, [(0, "", ""), (1, "H", "see: 1) one; 2) two; 3) three."), (1, "1) a", "2) b; 3) c;"), (1, "I", "1) x\n\n2) y\n\n3) z"), (1, "J", "1) x; 2) y\nrest  of it")])
    got = listed(R2.split_inline_items(rows))
    assert got[1:5] == [(1, "H", "see:"), (2, "1) one", ""), (2, "2) two", ""), (2, "3) three.", "")]
    assert got[5:9] == [(1, "", ""), (2, "1) a", ""), (2, "2) b", ""), (2, "3) c", "")] and got[9][2] == "1) x\n\n2) y\n\n3) z" and got[10] == (1, "J", "rest of it")
    chain = tree_rows(spark, [(0, "", ""), (1, "", " "), (2, "", ""), (3, "x", "y"), (4, "below", ""), (2, "z", ""), (1, "", ""), (1, "t", "")])
    kept = R2.lifted(chain)
    assert [(r["level"], r["title"], r["parent"]) for r in kept.orderBy("node").collect()] == [(0, "", None), (1, "x", [0]), (4, "below", [3]), (1, "z", [0]), (1, "", [0]), (1, "t", [0])]


def test_items_of_contents():
    items = lambda text: [(n.title, n.content) for n in O.numbered_items(text)]
    assert items("1) one; 2) two;\n3) three\nmore. 4) four") == [("1) one", ""), ("2) two", ""), ("3) three", "more."), ("4) four", "")]
    assert items("1. see 2) b;") == [("2) b", "")] and items("1. see 2) b; c") == [("1. see 2) b; c", "")]
    assert items("1. one\nmore\n\nplain\n\n2. two") == [("1. one", "more"), ("2. two", "")] and items("plain; text") == []


def gathered(spark, rows):
    return [(r["level"], r["title"], r["content"]) for r in O.attached(spark.createDataFrame([(1, [i], [0] if i else None, *r) for i, r in enumerate([(0, "", ""), *rows])], "doc_id long, node array<int>, parent array<int>, level int, title string, content string")).orderBy("node").collect()][1:]


def test_what_ends_a_list_of_items(spark):
    head = (2, "Статья 1", "")
    assert gathered(spark, [head, (2, "2. b", ""), (2, "1. anew", "")]) == [head, (3, "2. b", ""), (2, "1. anew", "")]
    assert gathered(spark, [head, (4, "1. deep", "")]) == [head, (4, "1. deep", "")]
    assert gathered(spark, [head, (3, "plain", ""), (2, "1. a", ""), (3, "lost", ""), (2, "note", ""), (1, "up", "")]) == [(2, "Статья 1", "note"), (3, "1. a", ""), (1, "up", "")]
    assert gathered(spark, [head, (3, "kept", "")]) == [head, (3, "kept", "")]
    assert gathered(spark, [head, (3, "", "1) x; 2) y"), (3, "Глава 2", ""), (2, "а. letter", "")]) == [head, (3, "1) x", ""), (3, "2) y", ""), (3, "Глава 2", ""), (2, "а. letter", "")]
    assert gathered(spark, [(2, "Глава 1", "intro\n\n1) a; 2) b"), (2, "3. c", "t\nа) l\nб) m"), (2, "1) s", "")]) == [(2, "Глава 1", "intro"), (3, "1) a", ""), (3, "2) b", ""), (3, "3. c", "t"), (4, "а) l", ""), (4, "б) m", ""), (4, "1) s", "")]


def docx(paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p>{p}</w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_docx(spark, tmp_path):
    head = '<w:pPr><w:pStyle w:val="Heading 2"/></w:pPr><w:r><w:rPr><w:b/><w:sz w:val="28"/></w:rPr><w:t>Статья 92</w:t></w:r><w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:t>1</w:t></w:r>'
    plain = '<w:r><w:t>Body </w:t></w:r><w:r><w:rPr><w:b w:val="0"/></w:rPr><w:t>text</w:t></w:r>'
    (tmp_path / "a.DOCX").write_bytes(docx([head, plain]))
    runs = files.docx_runs(files.files(spark, str(tmp_path), "docx"))
    assert files.docx_markdown(runs).first()["text"] == "## Статья 92 (см.сноску 1)\n\nBody text"
    got = O.typography(runs.withColumnRenamed("path", "doc_id")).orderBy("paragraph_no").collect()
    assert (got[0]["bold_ratio"], got[0]["font_pt"]) == (0.9, 14.0) and got[1]["bold_ratio"] == 0.0


def test_json_trees_lines_patterns_and_templates(spark, tmp_path):
    tree = {"level": 0, "title": "", "content": "", "children": [{"level": 1, "title": "A", "content": "x", "children": [{"level": 2, "title": "B", "content": "y", "children": []}]}, {"level": 1, "title": "C", "content": "z", "children": []}]}
    (tmp_path / "tree.json").write_text(json.dumps(tree))
    got = files.json_chunks(spark, f"{tmp_path}/tree.json").orderBy("node_no").collect()
    assert [(r["level"], r["title"]) for r in got] == [(0, ""), (1, "A"), (2, "B"), (1, "C")]
    (tmp_path / "chunks.json").write_text(json.dumps({"chunks": ["one", "two"]}))
    assert files.json_chunks(spark, f"{tmp_path}/chunks.json").count() == 2
    (tmp_path / "patterns.json").write_text(json.dumps({"patterns": ["a+", "b"]}))
    assert files.cleaning_patterns(spark, f"{tmp_path}/patterns.json") == ["a+", "b"] and files.cleaning_patterns(spark, f"{tmp_path}/none.json") == []
    (tmp_path / "prompts/open").mkdir(parents=True)
    (tmp_path / "prompts/open/c1.txt").write_text("Check {question}")
    assert [(r["question_type"], r["block"]) for r in files.templates(spark, f"{tmp_path}/prompts").collect()] == [("open", "c1")]
    rows = spark.createDataFrame([(1, 'say "x", ok', ["a"])], "id int, t string, l array<string>")
    sinks.write_json_lines(rows, f"{tmp_path}/lines")
    assert files.json_lines(spark, f"{tmp_path}/lines", "id int, t string").first()["t"] == 'say "x", ok'
    sinks.write_csv(rows, f"{tmp_path}/csv")
    back = spark.read.csv(f"{tmp_path}/csv", header=True, escape='"').first()
    assert back["t"] == 'say "x", ok' and back["l"] == '["a"]'
    assert [r["provider"] for r in files.registry(spark, '[{"id": "m", "base_url": "u"}, {"id": "n"}]').collect()] == ["openai"]


def test_replaced_partitions(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "dataset_id string, n int")
    sinks.append(rows, f"{tmp_path}/t", "dataset_id")
    sinks.replace_partitions(spark.createDataFrame([("a", 9)], "dataset_id string, n int"), f"{tmp_path}/t")
    assert sorted((r["dataset_id"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [("a", 9), ("b", 2)]


def test_outline_is_checked(spark, tmp_path):
    with pytest.raises(Exception, match="node without level"):
        sinks.write_outline(spark.createDataFrame([(1, None, "t", "c")], "doc_id int, level int, title string, content string"), f"{tmp_path}/o")


CHUNK = [(i, f"text {i}") for i in range(40)]


@pytest.mark.parametrize("mode, rejects, retries", [("generator_validator", False, False), ("generator_validator_gate", True, False), ("full", True, True)])
def test_modes_of_the_graph(spark, mode, rejects, retries):
    got = A.assistant(spark.createDataFrame(CHUNK, "doc_id long, text string"), ["open", "multi"], mode).collect()
    assert len(got) == 80
    assert any(r["outcome"] == "rejected" for r in got) == rejects
    assert any(r["retry_count"] for r in got) == retries


def test_failures_of_scorers_are_values(spark):
    def broken(batch):
        raise RuntimeError("no model")

    def slow(batch):
        raise R.TimeoutInScorer("late")

    rows = spark.createDataFrame(CHUNK, "doc_id long, text string")
    assert {r["error"] for r in R.scored(rows, broken).collect()} == {"no model"} and {r["error"] for r in R.scored(rows, slow).collect()} == {"timeout: late"}
    assert {r["detail"] for r in A.assistant(rows, ["open"], "generator_validator", generate=broken).collect()} == {"no model"}
    kept = R.rephrased(rows.withColumn("task", F.lit("as it was")), broken)
    assert {r["task"] for r in kept.collect()} == {"as it was"}


def test_shuffles_keep_the_right_options(spark):
    order, places = Q.shuffled(F.array(*map(F.lit, "abcd")), F.lit("1,3"), F.lit(5), 1)
    row = spark.range(1).select(order.alias("o"), places.alias("p")).first()
    assert sorted(row["o"]) == list("abcd") and {row["o"][int(p) - 1] for p in row["p"].split(",")} == {"a", "c"}
    order, places = Q.shuffled(F.array(*map(F.lit, "aab")), F.lit("1"), F.lit(5), 1)
    assert len(one(spark, places).split(",")) == 2


def test_orders_pages_and_export(spark):
    rows = spark.createDataFrame([("10", 1), ("9", 2), ("x", 3), (None, 4), ("9", 1)], "chunk_id string, question_id int")
    assert [(r[0], r[1]) for r in rows.orderBy(*E.export_order()).collect()] == [("9", 1), ("9", 2), ("10", 1), ("x", 3), (None, 4)]
    names = spark.createDataFrame([("a10",), ("a9",), ("",), (None,), ("B1",)], "n string")
    assert [r[0] for r in names.orderBy(*E.natural_order("n")).collect()][:3] == ["a9", "a10", "B1"]
    assert not [r[0] for r in names.orderBy(*E.natural_order("n", False)).collect()][0]
    assert [r[1] for r in E.page(rows, ["question_id", "chunk_id"], 99, 2).collect()] == [4]


def test_metadata_and_differences(spark):
    merged = V.merge_metadata(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("3")))
    assert one(spark, merged) == {"a": "3", "b": "2"}
    old = spark.createDataFrame([(1, "t", "o"), (2, "t", "o")], "question_id int, task string, options string")
    new = spark.createDataFrame([(1, "t2", "o"), (3, "t", "o")], "question_id int, task string, options string")
    assert {(r["question_id"], r["change"], r["fields"]) for r in V.diff(old, new).collect()} == {(1, "changed", "task"), (2, "removed", None), (3, "added", None)}


def test_typographic_headings_of_docx_runs(spark):
    rows = [
        ("a", 0, 0, "ОБЩИЕ ПОЛОЖЕНИЯ", False, False, 16.0, None, None, None),
        ("a", 1, 0, "Текст ", False, False, 12.0, None, None, None),
        ("a", 1, 1, "1", False, True, 8.0, None, None, None),
        ("a", 2, 0, "Пункт", False, False, None, "ListParagraph", None, 2),
        ("a", 3, 0, "Подпункт", False, False, None, "ListParagraph", None, 3),
        ("a", 4, 0, "Раздел", False, False, 12.0, "Heading 4", None, 2),
        ("a", 5, 0, "Часть", False, False, 12.0, "Heading4", 1, None),
        ("a", 6, 0, "Важно", True, False, None, None, None, None),
        ("a", 7, 0, "x" * 121, True, False, None, None, None, None),
        ("a", 8, 0, "  ", False, False, None, None, None, None),
        ("b", 0, 0, "просто текст", False, False, None, "Normal", None, None),
        ("c", 0, 0, "просто текст", False, False, None, "Custom", None, None),
    ]
    kinds = "path string, paragraph_no int, run_no int, text string, bold boolean, superscript boolean, font_pt double, style string, outline_level int, list_level int"
    runs = spark.createDataFrame(rows, kinds)
    levels = {r["paragraph_no"]: (r["level"], r["confidence"]) for r in O.typographic_headings(O.typographic_paragraphs(runs)).filter("doc_id = 'a'").collect()}
    # sizes 16 and 12 are ranks 1 and 2, the smallest list level stands for level 1
    assert levels == {0: (1, 0.7), 1: (2, 0.7), 2: (1, 0.8), 3: (2, 0.8), 4: (4, 0.95), 5: (2, 1.0), 6: (3, 0.55), 7: (None, None)}
    text = {r["doc_id"]: r["text"] for r in O.typographic_markdown(runs).collect()}
    assert text["a"].startswith("# ОБЩИЕ ПОЛОЖЕНИЯ\n\n## Текст  (см.сноску 1)\n\n# Пункт\n\n## Подпункт") and text["b"] == "просто текст"
    assert {r["doc_id"]: r["processor"] for r in O.docx_processors(runs).collect()} == {"a": "heading_styles", "b": "universal", "c": "custom_styles"}
