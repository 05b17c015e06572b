"""The pipeline's near-duplicate stage against all pairs of texts."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quizloom.llm import jaccard_join as J
from quizloom.llm import near_duplicates as N
from quizloom.llm.fingerprint import shingle_hashes, simhash, simhash_of

SMALL = "/root/testdata/sf0.01"


def by_all_pairs(texts):
    """The ids that stay: the smallest of each component of 5-word Jaccard similarity 0.8 or more."""
    sets = {i: frozenset(shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    holders, root = {}, {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    def join(i, j):
        a, b = top(i), top(j)
        root[max(a, b)] = min(a, b)

    for i, own in sets.items():
        counts = {}
        for s in own or {None}:
            for j in holders.get(s, ()):
                counts[j] = counts.get(j, 0) + 1
            holders.setdefault(s, []).append(i)
        for j, n in counts.items():
            if not own or n >= 0.8 * (len(own) + len(sets[j]) - n):
                join(i, j)
    return {i for i in sets if top(i) == i}


def test_stage_by_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    kept = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).select("doc_id").collect()]
    assert len(kept) == len(set(kept)) and set(kept) == by_all_pairs(texts)


def test_copies_with_few_words_changed(spark):
    rng = np.random.default_rng(0)
    texts = {}
    for i in range(40):
        words = [f"w{k}" for k in rng.integers(0, 5000, 300)]
        for j in range(6):
            copy = list(words)
            for at in rng.integers(0, 300, 2 * j):
                copy[at] = f"x{rng.integers(0, 10**6)}"
            texts[len(texts)] = " ".join(copy)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    want = by_all_pairs(texts)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).select("doc_id").collect()} == want
    assert sum((simhash(texts[6 * i]) ^ simhash(texts[6 * i + 1])).bit_count() > 4 for i in range(40)) > 10


def test_near_fingerprints_are_candidates_of_the_stage(spark, monkeypatch):
    """Pairs that SimHashes put together are found by these alone, are checked exactly, and a crowd is dealt into chunks."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in rng.integers(0, 10**6, 2000)]
    near = [" ".join(words), " ".join([*words[:-1], "changed"]), " ".join([*words[:-60], *(f"x{k}" for k in range(60))])]
    assert len({simhash_of(J.shingles(t, 5)) for t in near}) > 1
    texts = [*near, " ".join(f"v{k}" for k in rng.integers(0, 10**6, 2000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cells, plain = [], N.near_cells
    monkeypatch.setattr(N, "near_cells", lambda classes: cells.append(plain(classes).collect()) or plain(classes))
    monkeypatch.setattr(J, "first_cells", lambda postings, first=J.first_cells: first(postings).limit(0))
    monkeypatch.setattr(J, "crossing_cells", lambda postings, labels, crossing=J.crossing_cells: crossing(postings, labels).limit(0))
    assert {r["doc_id"] for r in N.keep_one_of_each(docs).collect()} == {0, 3}
    assert len(cells) == 1 and len({r["cls"] for r in cells[0]}) == 3
    crowd = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("cls"), F.lit(3).alias("n"), (1 + F.col("id") % 2).alias("fp"))
    dealt = plain(crowd).groupBy("cell").count().collect()
    assert sum(r["count"] for r in dealt) == 5000 and len(dealt) == 3


def test_texts_that_simhashes_tie_are_all_compared(spark, monkeypatch):
    """Without the shingles' lists: copies in several chunks of a list, and two fingerprints near each other but not near a bucket's leader."""
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in rng.integers(0, 10**6, 2000)]
    texts = [" ".join([*words[:at], f"x{at}", *words[at + 1 :]]) for at in range(0, 200, 5)]
    texts.append(" ".join(f"v{k}" for k in rng.integers(0, 10**6, 2000)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(J, "CELL", 2)
    monkeypatch.setattr(J, "shared_postings", lambda classes, percent, shared=J.shared_postings: shared(classes, percent).limit(0))
    assert {r["doc_id"] for r in N.keep_one_of_each(docs).collect()} == {0, 40}
    base, near = 0x0123456789ABCDEF, 0b1111 << 33
    fps = sorted({base, *(base ^ 1 << i ^ 1 << j for i in (1, 2, 3) for j in (7, 8)), *(base ^ near ^ 0b111 << 45 ^ k for k in (0, 1, 2))})
    classes = spark.createDataFrame([(bytes([k]), 9, f) for k, f in enumerate(fps)], "cls binary, n long, fp long")
    token = {fps[r["cls"][0]]: r["token"] for r in N.near_cells(classes).collect()}
    for a in fps:
        for b in fps:
            assert (a ^ b).bit_count() > 4 or token[a] == token[b]


def test_rows_without_an_id_are_reduced_too(spark):
    one, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(None, one, "a"), (None, one, "b"), (None, one + " x", "c"), (2, one + " y", "d"), (3, one, "e"), (None, other, "f"), (None, other, "g"), (None, None, "h"), (None, " ", "i"), (7, "", "j"), (None, "alone", "k")]
    kept = N.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [2, 7]
    left = [r["text"] for r in kept if r["doc_id"] is None]
    assert len(left) == 4 and len({one, one + " x"} & set(left)) == 1 and other in left and "alone" in left
    assert sum(not (t or "").strip() for t in left) == 1


def test_stages_hand_few_texts_to_python(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(20)
        corpus_pipeline.packing(spark, docs, SMALL)
        assert spark.conf.get(name) == "500"
        spark.conf.set(name, "100")
        corpus_pipeline.packing(spark, docs, SMALL)
        assert spark.conf.get(name) == "100"
    finally:
        spark.conf.set(name, before)
