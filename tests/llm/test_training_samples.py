"""What the classifiers are fitted on: its make-up must not follow the density of matches or the number of labels."""

import hashlib

import numpy as np

from quizloom.llm import quality
from quizloom.llm.secrets import Tagger, find, train


def test_clean_chains_are_learnt_beside_many_secrets(spark):
    def digest(*key):
        return hashlib.sha256(repr(key).encode()).hexdigest()

    dense = [(i, " ; ".join(f"password={digest(i, k)[:12].upper()}" for k in range(45))) for i in range(160)]
    clean = [(1000 + i, " ; ".join(f"invoice number {digest('n', i, k)[:9].upper()} was paid" for k in range(4))) for i in range(200)]
    field = train(spark.createDataFrame(dense + clean, "doc_id long, text string"))
    tagger = Tagger(field)
    assert not any(find(text, tagger) for _, text in clean)


def test_scores_do_not_follow_the_number_of_labels(spark, monkeypatch):
    monkeypatch.setattr(quality, "FIT_ROWS", {0: 50, 1: 50})
    docs = spark.createDataFrame([(i, "The same words in all.") for i in range(1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(1000)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    assert abs(model.score(np.stack([quality.features("The same words in all.")]).astype(float))[0] - 0.9) < 0.01
