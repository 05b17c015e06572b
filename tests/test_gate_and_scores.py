import json

import pytest
from pyspark.sql import functions as F

from quizloom.functions import text as T
from quizloom.operators import gate as G
from quizloom.operators import scoring as P


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def blocks(kind, **changed):
    bits = {b: [1] * len(P.WEIGHTS[b]) for b in P.BLOCKS[kind]} | changed
    return {b: F.array(*map(F.lit, x)) for b, x in bits.items()}


@pytest.mark.parametrize(
    "kind, changed, total",
    [
        ("open", {}, 16.0), ("multi", {}, 20.5), ("one", {}, 20.5), ("open", {"c1_question": [1, 0, 1, 1, 1]}, 0.0),
        ("open", {"c2_outputs": [0] * 6, "c4_logic": [0] * 4, "c5_phrase": [0] * 2}, 0.0), ("multi", {"c3_outputs": [0, 1]}, 0.0), ("open", {"c4_logic": [0, 1, 1, 1]}, 15.0),
    ],
)
def test_weighted_total(spark, kind, changed, total):
    assert one(spark, P.weighted_total(blocks(kind, **changed), kind).alias("t"))["t"] == total


def test_score_lines(spark):
    text = F.lit("1 — good\n\n first: 0\nno score here\n10\n1")
    scores, words = P.parse_score_lines(text, 6)
    row = one(spark, scores.alias("s"), words.alias("w"))
    assert row["s"] == [1, 0, 0, 1, 0, 0] and row["w"][:2] == ["good", ""]
    scores, _ = P.parse_score_lines(F.lit("scores 1, 0 and 1 given."), 4)
    assert one(spark, scores.alias("s"))["s"] == [1, 0, 1, 0]


ANSWER = {"c1_chunk_informative": [1], "c1_reasoning": "ok", "c1_confidence": 0.9, "c2_chunk_reference_clarity": 1, "c2_reasoning": None, "c2_confidence": "high", "c3_chunk_multi_suitability": [0, 1]}


@pytest.mark.parametrize("raw", [json.dumps(ANSWER), f"```json\n{json.dumps(ANSWER)}\n```", repr(ANSWER).replace("None", "''"), "Here: " + json.dumps(ANSWER) + " done"])
def test_gate_answers(spark, raw):
    row = one(spark, G.parse_answer(F.lit(raw)).alias("g"))["g"]
    assert (row["c1_chunk_informative"], row["c2_chunk_reference_clarity"], row["c3_chunk_multi_suitability"]) == (1, 1, 0)
    assert row["c1_confidence"] == 0.9 and row["c2_confidence"] == 0.0 and row["c2_reasoning"] == ""


def test_gate_answer_that_does_not_parse(spark):
    assert one(spark, G.parse_answer(F.lit("no idea")).alias("g"))["g"] is None


@pytest.mark.parametrize(
    "scores, kind, reason",
    [((1, 1, 1), "multi", None), ((0, 1, 1), "open", "chunk_not_informative"), ((1, 0, 1), "one", "chunk_not_self_contained"), ((1, 1, 0), "multi", "chunk_not_suitable_for_multi"), ((1, 1, 0), "open", None), ((1, 1, 0), "one", None)],
)
def test_decisions(spark, scores, kind, reason):
    assert one(spark, G.rejection_reason(*map(F.lit, scores), F.lit(kind)).alias("r"))["r"] == reason


def test_modes(spark):
    for mode, gate, refine in (("generator_validator", False, False), ("generator_validator_gate", True, False), (" FULL ", True, True), (None, True, True)):
        a, b = G.modes(F.lit(mode).cast("string"))
        row = one(spark, a.alias("a"), b.alias("b"))
        assert (row["a"], row["b"]) == (gate, refine)
    with pytest.raises(Exception, match="unknown pipeline mode"):
        one(spark, G.modes(F.lit("other"))[0].alias("a"))


@pytest.mark.parametrize("text, pair", [("16.0/16.0", (16.0, 16.0)), ("N/A", (None, None)), ("N/A/N/A", (None, None)), ("14/", (None, None)), (None, (None, None))])
def test_pairs(spark, text, pair):
    a, b = P.score_pair(F.lit(text).cast("string"))
    assert tuple(one(spark, a.alias("a"), b.alias("b"))) == pair


@pytest.mark.parametrize(
    "raw, want",
    [
        ("{'a': \"it's\"}", {"a": "it's"}),
        (r"{'a': 'it\'s \"x\"', 'b': ('c', None, True,), }", {"a": 'it\'s "x"', "b": ["c", None, True]}),
        (r"{'a': '\x41\n\\', 'n': -1.5e3}", {"a": "A\n\\", "n": -1500.0}),
        ('{"a": "True, None"}', {"a": "True, None"}),
        ("{'a': {'b': [1, {'c': False}]}}", {"a": {"b": [1, {"c": False}]}}),
        ("{'a': 'open}", None),
        ("{'a': __import__}", None),
        ("words", None),
    ],
)
def test_python_literals(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "raw string").select(T.literal_python(F.col("raw")).alias("x")).first()["x"]
    assert (None if got is None else json.loads(got)) == want


def test_scores_without_lines(spark):
    scores, reasons = P.parse_score_lines(F.col("t"), 4)
    got = spark.createDataFrame([("c1 and 10, x0y",), ("1 — ok\nnone",), ("21",)], "t string").select(scores.alias("s"), reasons.alias("r")).collect()
    assert [r["s"] for r in got] == [[1, 0, 0, 0], [1, 0, 0, 0], [1, 0, 0, 0]] and got[1]["r"] == ["ok", "", "", ""]
