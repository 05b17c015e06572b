"""The classifiers' parts against plain versions, and what their fits read."""

import numpy as np
import zstandard
from pyspark.sql import functions as F

from quizloom.llm import language as L
from quizloom.llm import quality as Q
from quizloom.llm import toxicity as T


def test_languages_without_limit_and_in_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = {k: ["".join(rng.choice(letters, 7)) for _ in range(40)] for k in range(300)}
    rows = [(3 * n + 600 * k, " ".join(rng.choice(words[k], 60)), f"l{k:03}") for k in range(300) for n in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    monkeypatch.setattr(L, "BLOCK_BYTES", 60_000)
    found = {r["id"]: r["lang"] for r in L.identify(docs, F.col("doc_id") % 600 != 0).collect()}
    assert np.mean([found[i] == lang for i, _, lang in rows]) > 0.97
    monkeypatch.setattr(L, "BLOCK_BYTES", 2**24)
    assert {r["id"]: r["lang"] for r in L.identify(docs, F.col("doc_id") % 600 != 0).collect()} == found


def test_a_repeated_id_is_learned_from_once(spark):
    docs = spark.createDataFrame([(1, f"alpha beta {i}", "en") for i in range(1000)] + [(2, "un deux trois", "fr"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string")
    made = {r["lang"]: bytes(r["dictionary"]) for r in L.dictionaries(docs, "doc_id", "text", "lang", F.lit(True)).collect()}
    assert made == {"en": b"alpha beta  ", "fr": b"un deux trois "}


def test_languages_by_plain_compression(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1
    made = {r["lang"]: bytes(r["dictionary"]) for r in L.dictionaries(docs, "doc_id", "text", "lang", train).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in L.identify(docs, train).collect():
        data = L.plain(texts[r["id"]]).encode()
        sizes = []
        for lang, dictionary in made.items():
            total = 0
            for at in range(0, len(data), L.PIECE_BYTES):
                held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                total += len(zstandard.ZstdCompressor(level=L.LEVEL, dict_data=held, write_content_size=False, write_checksum=False).compress(data[at : at + L.PIECE_BYTES]))
            sizes.append((total, lang))
        assert r["lang"] == (min(sizes)[1] if any(map(str.isalpha, texts[r["id"]])) else "und")


def test_additive_model_by_plain_sums():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 4))
    y = (x[:, 0] * x[:, 1] + 0.2 * x[:, 2] + rng.normal(0, 0.1, 1500) > 0).astype(float)
    model = Q.fit_gam(x, y)
    assert set(model.pairs[0][:2]) == {0, 1}  # the pair that the labels follow gains most
    for row in x[:50]:
        total = model.base
        for j, value in enumerate(row):
            total += model.tables[j][sum(edge <= value for edge in model.edges[j])]
        for i, j, table in model.pairs:
            total += table[sum(e <= row[i] for e in model.pair_edges[i]), sum(e <= row[j] for e in model.pair_edges[j])]
        assert abs(model.logit(row[None])[0] - total) < 1e-9
    without = Q.Gam(model.base, model.edges, model.tables)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9 > ((without.score(x) > 0.5) == y).mean()


def test_trees_by_all_cuts():
    rng = np.random.default_rng(2)
    for _ in range(20):
        g, h = rng.normal(size=12), rng.uniform(0.1, 2, 12)
        value = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + Q.RIDGE)
        gains = {k: value(0, k) + value(k, 12) - value(0, 12) for k in range(1, 12)}
        gain, at = Q.best_cut(g, h)
        assert at == max(gains, key=gains.get) and abs(gain - gains[at]) < 1e-9
        table = Q.shallow_tree(g, h, 2)
        if gain <= 0:
            at = 0  # no cut: one leaf
        assert np.allclose(table[:at], g[:at].sum() / (h[:at].sum() + Q.RIDGE)) and np.allclose(table[at:], g[at:].sum() / (h[at:].sum() + Q.RIDGE))


def test_log_odds_by_plain_counts(spark):
    rng = np.random.default_rng(3)
    common, bad = [f"w{i}" for i in range(60)], ["vile", "viler", "vilest", "vileness", "grim"]
    texts = [(i, " ".join(rng.choice(common + (bad * 4 if i % 4 == 0 else []), 50)), int(i % 4 == 0), i % 2) for i in range(200)]
    counts = T.unit_counts(spark.createDataFrame(texts, "id long, text string, label int, fold int"))
    seen = {(w, before, label, fold) for _, t, label, fold in texts for before, w in zip(["", *t.split()], t.split())}
    for r in counts.collect():
        for name, keep in (("", (0, 1)), ("0", (0,)), ("1", (1,))):
            for letter, label in (("t", 1), ("c", 0)):
                assert r[letter + name] == len({s[:2] for s in seen if s[0] == r["word"] and s[2] == label and s[3] in keep})
    found = T.lexicon(counts)
    assert {"vile*", "grim"} <= {r["unit"] for r in found} and not {r["unit"] for r in found} & set(common)
    assert len(T.lexicon(counts, most=2)) == 2


def test_calibration_is_fitted_on_the_other_half(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = T.fit_toxicity(docs, labels, F.col("doc_id") % 3 != 0)
    assert model.slope > 0 and model.probability(-5.0) < 0.5 < model.probability(25.0)


def test_extreme_value_scale_solves_its_equation():
    for odds, frequency in ((2.0, 0.01), (4.0, 0.02), (1.5, 0.001)):
        s = T.extreme_value_scale(odds, frequency)
        assert s > 1e-6 and abs(frequency * np.exp(s * odds) + (1 - frequency) * np.exp(-s * T.DRIFT) - 1) < 1e-6


def test_filters_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a text of words", 0.25, 0.5), (1, "a text of words", 0.25, 0.5)], "doc_id long, text string, __quality_score double, __toxicity_score double")
    kept = T.keep_clean(Q.keep_good(docs, Q.Gam(1.0)), T.ToxicityModel(offset=-25.0))
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "a text of words", 0.25, 0.5)] * 2
