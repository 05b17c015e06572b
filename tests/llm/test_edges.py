"""NULLs, empty and very long texts, repeated rows, ties, empty tables and extra columns with clashing names."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quizloom.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, score string, label string, spans string, vector string, found int, rank int, held_out string"
LABELS = "doc_id long, quality int, toxic int, id string, label string"
PAGES = "page_id long, url string, html string, id string, text int, n_chars string"
VECTORS = "vec_id long, embedding array<float>, label int, id string, vector string, score string, cell string, rank string"
TURNS = "conv_id long, turn long, role string, text string, id string, fault string, dropped string, audit int"
LONG = "word " * 40_000 + "end"


def write(spark, path, docs, labels, pages, vectors, turns=()):
    pad = lambda rows, schema: [tuple(r) + (None,) * (schema.count(",") + 1 - len(r)) for r in rows]
    for name, rows, schema in (("documents", docs, DOCS), ("labels", labels, LABELS), ("pages", pages, PAGES), ("embeddings", vectors, VECTORS), ("conversations", turns, TURNS)):
        spark.createDataFrame(pad(rows, schema), schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    texts = [None, "", " \n\t ", "one", "Same words here again and again.", "Same words here again and again.", LONG, "!!! ### 123", "токен = abcdefgh1234 password: hunter22", "<|endoftext|> Ünïcödé ΑΣ 漢字 🙂", "a" * 50_000]
    docs = [(i, t, ("en", "fr", None)[i % 3], "s", 0 if t is None else len(t)) for i, t in enumerate(texts)]
    docs += [docs[4], docs[4], (None, "no id at all", None, None, None), (None, None, None, None, None)]
    labels = [(0, 1, 0), (3, 0, 1), (4, 1, 0), (4, 0, None), (None, 1, 1), (6, None, None), (99, 1, 0), (8, 0, 1)]
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<p>"), (None, "u", "<article><p>Text &amp; more</p></article>"), (4, "u", "<p>" + LONG), (4, "u", "<p>" + LONG), (5, "u", "<<<>>><a <b> & < text")]
    unit = [1.0] + [0.0] * 63
    vectors = [(0, unit), (100, unit), (200, [2.0] * 64), (200, [2.0] * 64), (1, unit), (2, None), (3, [float("nan")] * 64), (4, [float("inf")] + [0.0] * 63), (5, [0.0] * 64), (6, [None] + [1.0] * 63), (None, unit), (7, []), (8, [-1.0] * 64), (9, [1e30] * 64)]
    turns = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, None, None, None), (None, None, "", LONG), (2, 2**62, "assistant", "Ho"), (3, -5, "system", "\x0b")]
    return write(spark, tmp_path_factory.mktemp("odd"), docs, labels, pages, vectors, turns)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [], [])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_empty_pipeline(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def rows(spark, odd, name):
    return QUERIES[name](spark, odd).collect()


def test_near_duplicates(spark, odd):
    got = rows(spark, odd, "op1_near_duplicates")
    assert len(got) == 15
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    assert [r["component_id"] for r in got if r["doc_id"] in (4, 5)] == [4] * 4
    assert all(by[i, "0" * 16] == 0 for i in (0, 1, 2))
    assert by[None, "0" * 16] == 0


def test_secrets(spark, odd):
    got = {r["doc_id"]: r for r in rows(spark, odd, "op2_secrets")}
    assert got[0]["spans"] == "" and got[1]["spans"] == "" and got[8]["n_assign"] == 1 and got[10]["n_hex"] == 1
    assert got[10]["spans"] == "hex:0:50000"


def test_packing(spark, odd):
    got = rows(spark, odd, "op3_packing")
    assert sum(r["length"] for r in got if r["doc_id"] == 0) == 1
    assert sum(r["length"] for r in got if r["doc_id"] == 4) == 3 * next(r["doc_tokens"] for r in got if r["doc_id"] == 4)
    assert sum(r["length"] for r in got if r["doc_id"] is None) >= 2


def test_posting_lists(spark, odd):
    got = rows(spark, odd, "op4_posting_lists")
    assert {r["query_id"] for r in got} == {0, 100, 200}
    assert not {r["vec_id"] for r in got} & {2, 3, 4, 5, 6, 7, None}
    first = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0]
    assert first == [9, 200, 1, 100, 8]


def test_exact_top_k(spark, odd):
    got = sorted((r for r in rows(spark, odd, "op10_exact_top_k") if r["query_id"] == 0), key=lambda r: r["rank"])
    assert [r["vec_id"] for r in got] == [9, 200, 200, 1, 100] and got[1]["score"] == 512 * 256


@pytest.mark.parametrize("name", ["op5_quality", "op8_toxicity"])
def test_scores(spark, odd, name):
    got = rows(spark, odd, name)
    assert len(got) == 15 and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)


def test_main_text(spark, odd):
    got = rows(spark, odd, "op6_main_text")
    assert len(got) == 7 and {r["text"] for r in got if r["page_id"] in (1, 2, 3)} == {""}
    assert [r["text"] for r in got if r["page_id"] is None] == ["Text & more"]
    assert [r["n_chars"] for r in got if r["page_id"] == 4] == [len(LONG)] * 2


def test_bpe(spark, odd):
    got = {r["doc_id"]: r["n_tokens"] for r in rows(spark, odd, "op7_bpe")}
    assert got[0] == got[1] == got[2] == 0 and got[6] > 40_000


def test_language(spark, odd):
    got = rows(spark, odd, "op9_language")
    assert len(got) == 15 and {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2, 7)} == {"und"}
    assert {r["lang_pred"] for r in got} <= {"und", "en", "fr"}


def test_whitening(spark, odd):
    got = rows(spark, odd, "op11_whitening")
    assert sorted({(r["vec_id"] is None, r["vec_id"] or 0) for r in got}) == [(False, i) for i in (0, 1, 5, 8, 9, 100, 200)] + [(True, 0)]
    assert len(got) == 9 * 4 and {r["n"] for r in got} == {5}
    assert all(r["whitened"] is not None for r in got if r["component"] == 1)


def test_jaccard_join(spark, odd):
    got = rows(spark, odd, "op12_jaccard_join")
    assert len(got) == 15 and [r["component_id"] for r in got if r["doc_id"] in (4, 5)] == [4] * 4
    assert {r["component_id"] for r in got if r["n_shingles"] == 0} == {0, 1, 2, None}


def test_conversation_repair(spark, odd):
    got = {r["conv_id"]: r for r in rows(spark, odd, "op13_conversation_repair")}
    assert set(got) == {1, 2, 3, None} and got[3]["audit"] in ("", "D")


def test_stages(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns, name
        assert out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        assert out.count() <= docs.count()
    kept = corpus_pipeline.near_duplicates(spark, docs, odd)
    assert sorted(r["doc_id"] for r in kept.filter("doc_id IS NOT NULL").collect()) == [0, 3, 4, 6, 7, 8, 9, 10]
    assert kept.filter("doc_id IS NULL").count() == 2
    redacted = corpus_pipeline.secrets(spark, docs, odd).filter("doc_id = 8").first()
    assert "hunter22" not in redacted["text"] and redacted["n_chars"] == len(redacted["text"])
