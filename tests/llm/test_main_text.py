"""The ratios choose what is returned; names are one signal among them."""

import time

import numpy as np
import pytest

from quizloom.llm import main_text as M

BODY = "<p>The body of the text, long enough to be one.</p><p>And another paragraph of it, also long enough.</p>"
TEXT = "The body of the text, long enough to be one. And another paragraph of it, also long enough."
LONG = "Here is a sentence of the body, and it has its marks. " * 12


def test_without_the_ratios_most_outputs_change(spark, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    before = [M.main_text(p) for p in pages]
    monkeypatch.setattr(M, "selected", lambda texts, made, names: np.ones(len(made), bool))
    assert np.mean([M.main_text(p) != text for p, text in zip(pages, before)]) > 0.9


def test_without_any_name_the_ratios_find_the_article(spark, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    before = [M.main_text(p) for p in pages]
    monkeypatch.setattr(M, "signal", lambda *_: 1.0)
    assert np.mean([M.main_text(p) == text for p, text in zip(pages, before)]) > 0.5


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<div class="content with-sidebar"><article><h1>T</h1>{BODY}</article></div>', "T " + TEXT),
        (f'<div class="content has-sidebar" id="page"><div><h1>T</h1>{BODY}</div></div>', "T " + TEXT),
        (f'<div class="post comments-open"><h1>T</h1>{BODY}</div>', "T " + TEXT),
        (f'<div id="page" class="menu-open"><nav><a href="/">Home</a></nav><h1>T</h1>{BODY}</div>', "T " + TEXT),
        (f'<main><h1>T</h1>{BODY}<section id="related-work"><h2>Related work</h2><p>Others did this.</p></section></main>', f"T {TEXT} Related work Others did this."),
        (f"<html><head><title>x</title><meta name=a><nav><a href=/>Home</a></nav><h1>T</h1>{BODY}", "T " + TEXT),
        (f"<p>An <svg viewBox='0 0 1 1'/> icon.</p>{BODY}", "An icon. " + TEXT),
        (f"<article><h1>T</h1><div class=lead>The lead.</div><div class=body><p>{LONG}</p></div></article>", f"T The lead. {LONG.strip()}"),
        (f"<div id=post><h1>T</h1><div class=lead>The lead.</div><div class=body><p>{LONG}</p></div></div><footer>c</footer>", f"T The lead. {LONG.strip()}"),
        (f"<article><h1>T</h1><section><p>{LONG}</p></section><section><h2>End</h2><p>Short.</p></section></article>", f"T {LONG.strip()} End Short."),
        (f"<article><h1>T</h1><pre>{LONG}</pre><p>After.</p></article>", f"T {LONG.strip()} After."),
        (f"<form id=all><nav><a href=/>Home</a></nav><div id=c>{BODY}</div></form>", TEXT),
        (f'<article>{BODY}<div class="share-bar">Share it, now.</div><aside>See also, this.</aside><form><label>Name, please.</label></form></article>', TEXT),
        (f'<div id="main">{BODY}</div><div class="comments"><p>Nice one, really nice.</p><p>I agree, I do.</p></div>', TEXT),
        ("<nav><ul><li><a href=/>Home</a></li></ul></nav>", ""),
        (f'<article><h1>T</h1>{BODY}<section class="comments"><p>{LONG}</p><p>{LONG}</p></section></article>', "T " + TEXT),
        (f'<article><h1>T</h1>{BODY}<div class="x7"><a href="/buy">Buy this now, cheap, today only</a></div><ul><li><a href="/r">A reference.</a></li></ul></article>', f"T {TEXT} A reference."),
        (f'<div id=c><h1>T</h1>{BODY}<div class="reply">I, too.</div></div><div class="comment-list"><p>{LONG}</p></div>', "T " + TEXT),
        ("<svg><p>never closed, but read.</p>", "never closed, but read."),
    ],
)
def test_pages(page, text):
    assert M.main_text(page) == text


@pytest.mark.parametrize("page", ["<div>x" * 100_000, "<p><div>" + "<x>" * 50_000 + "<p></p>" * 50_000, "<div>" * 50_000 + "</section>" * 50_000, "<svg>x" * 50_000, "<a href='" * 50_000, "<table><tr><td>" * 30_000 + "x"])
def test_deep_and_endless_pages_take_linear_time(page):
    began = time.perf_counter()
    M.main_text(page)
    assert time.perf_counter() - began < 10


def test_ratios_by_a_plain_version():
    page = M.Page("<body><div class=a><p>One, two. Three</p><p>Four <a>five</a></p></div><ul><li><a>Six</a></li><li>Seven!</li></ul></body>")
    texts = [b.text() for b in page.blocks]
    assert texts == ["One, two. Three", "Four five", "Six", "Seven!"]
    paths, length, marks, links = M.ratios(texts, page.blocks)
    assert paths.tolist() == [0, 0, 1, 1]
    assert np.allclose(length, [(15 + 5 + 0.4) / 2] * 2 + [(0.3 + 6) / 2] * 2)
    assert np.allclose(marks, [2 / 2] * 2 + [1 / 2] * 2) and np.allclose(links, [4 / 24] * 2 + [3 / 9] * 2)

    def mean_around(values, i):
        near = [(np.exp(-0.5 * d * d), values[i + d]) for d in range(-3, 4) if 0 <= i + d < len(values)]
        return sum(w * v for w, v in near) / sum(w for w, _ in near)

    fused = [np.sqrt(length[i] * mean_around(length, i)) * (1 + np.sqrt(marks[i] * mean_around(marks, i))) for i in range(4)]
    value = [np.mean(fused[:2])] * 2 + [np.mean(fused[2:])] * 2
    assert M.selected(texts, page.blocks, np.ones(4)).tolist() == [v >= min(np.std(value), max(value) / 3) for v in value]
