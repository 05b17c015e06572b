"""The field against enumeration, its screening against whole lines, and planted secrets that no fixed pattern sees."""

import tracemalloc
from itertools import product

import numpy as np
import pytest

from quizloom.llm import secrets as S

LETTERS = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
WORDS = "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def key(rng, n):
    return "".join(rng.choice(LETTERS, n))


def prose(rng, n):
    words = rng.choice(WORDS, n).tolist()
    for i in rng.integers(0, n, n // 8):
        words[i] = rng.choice([str(rng.integers(0, 3000)), f"{rng.integers(200, 999)}-555-{rng.integers(1000, 9999)}", f"v{rng.integers(1, 9)}.{rng.integers(0, 20)}.0", f"2024-0{rng.integers(1, 9)}-1{rng.integers(0, 9)}", "http://example.com/a/page2.html", f"user{rng.integers(1, 99)}@mail.example.com", "INVOICE", "PostgreSQL", f"{rng.integers(10**11, 10**12)}"])
    return " ".join(words)


def taught(rng, i):
    secret = [f'password = "{key(rng, rng.integers(12, 40))}"', f"api_key: {key(rng, 32)}", f"token={key(rng, 24)}", f"AKIA{''.join(rng.choice(LETTERS[:26], 16))}", "".join(rng.choice(list("0123456789abcdef"), 40))][i % 5]
    return f"{prose(rng, 25)} {secret} {prose(rng, 25)}\n{prose(rng, 30)}"


@pytest.fixture(scope="module")
def field(spark):
    """As the query trains it, on the table's documents."""
    return S.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def held_out_key(rng, i):
    """Shapes of keys that are not among those planted in training."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    own = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    return [key(rng, 28), f"glpat-{key(rng, 20)}", f"eyJ{key(rng, 30)}.{key(rng, 40)}.{key(rng, 43)}", own(letters + "234567", 32), f"npm_{key(rng, 36)}", f"hf_{key(rng, 34)}", f"{key(rng, 24)}/{key(rng, 20)}", f"sk_live_{key(rng, 24)}"][i % 8]


CARRIERS = ["Authorization: Bearer {}", "login with {} please", "AWS_SESSION {}", 'connect("{}")', "see {} below"]


def test_held_out_keys_are_found_whole(field):
    rng, tagger = np.random.default_rng(1), S.Tagger(field)
    whole = found = 0
    for i in range(400):
        secret = held_out_key(rng, i)
        text = f"{prose(rng, 20)} {CARRIERS[i % 5].format(secret)} {prose(rng, 20)}"
        at, spans = text.index(secret), tagger.spans(text)
        found += len(spans)
        whole += any(a <= at and at + len(secret) <= b for a, b in spans)
    assert whole >= 0.9 * 400 and whole >= 0.9 * found


@pytest.mark.parametrize("kind", ["uuid", "url", "version", "commit", "short commit", "number", "path"])
def test_what_looks_like_a_key_is_left_alone(field, kind):
    rng, tagger, wrong = np.random.default_rng(2), S.Tagger(field), 0
    for i in range(400):
        hexadecimal = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
        run = {
            "uuid": "-".join(map(hexadecimal, (8, 4, 4, 4, 12))), "url": f"https://site{rng.integers(99)}.example.com/c{rng.integers(1000, 99999)}/{key(rng, 3)}", "version": f"{rng.integers(30)}.{rng.integers(30)}.{rng.integers(99)}-rc.{rng.integers(9)}",
            "commit": hexadecimal(40), "short commit": hexadecimal(7), "number": str(rng.integers(10**11, 10**16)), "path": f"/var/lib/app{rng.integers(9)}/x86_64/lib{WORDS[i % 50]}.so.{rng.integers(9)}",
        }[kind]
        wrong += bool(tagger.spans(f"{prose(rng, 20)} {CARRIERS[i % 5].format(run)} {prose(rng, 20)}"))
    assert wrong <= 4


def test_clean_texts_are_left_alone(field):
    rng, tagger = np.random.default_rng(2), S.Tagger(field)
    assert sum(len(tagger.spans(prose(rng, 100))) for _ in range(300)) <= 3


def test_no_span_ends_within_a_run(field):
    rng, tagger = np.random.default_rng(6), S.Tagger(field)
    for i in range(200):
        text = f"{prose(rng, 10)} {CARRIERS[i % 5].format(held_out_key(rng, i))}, {prose(rng, 10)}"
        for a, b in tagger.spans(text):
            assert not (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum()) and b - a >= S.LEAST


def test_inside_and_moves_are_learnt(field):
    assert np.abs(field.weights[:, S.INSIDE]).sum() > 10
    assert field.moves[S.BEGIN, S.INSIDE] != 0 and field.moves[S.INSIDE, S.INSIDE] != 0
    rng, tagger = np.random.default_rng(3), S.Tagger(field)
    secret = key(rng, 40)
    assert any(b - a >= 32 for a, b in tagger.spans(f"they said {secret} then"))


def test_screening_changes_nothing(field):
    rng, tagger = np.random.default_rng(4), S.Tagger(field)
    for i in range(60):
        text = taught(rng, i)
        kept = tagger.spans(text)
        whole = tagger.stretches
        tagger.stretches = lambda emissions, lines: [(a, b) for a, b in zip(np.flatnonzero(lines), [*np.flatnonzero(lines)[1:], len(lines)])]
        assert tagger.spans(text) == kept
        tagger.stretches = whole


def test_emissions_are_sums_of_features(field):
    rng = np.random.default_rng(5)
    text, seen = f"{prose(rng, 8)} {key(rng, 40)} {prose(rng, 8)}"[:200], []
    tagger = S.Tagger(field)
    tagger.stretches = lambda emissions, lines: seen.append(emissions) or []
    tagger.spans(text)
    tokens = S.TOKEN.findall(text)
    assert "".join(tokens) == text
    types = np.array(list(map(S.type_of, tokens)), np.int64)
    features = S.window_features(tokens, S.numbers_of(types)[3].tolist(), S.file_code(text))
    assert np.allclose(seen[0], field.emissions(features), atol=1e-3)


def test_viterbi_and_marginals_by_enumeration():
    field, rng = S.Field(), np.random.default_rng(0)
    field.moves = rng.normal(size=(3, 3))
    moves = field.allowed()
    chains = [rng.normal(size=(n, 3)) for n in (4, 2, 3)]
    padded = np.zeros((3, 4, 3))
    for k, own in enumerate(chains):
        padded[k, : len(own)] = own
    marginals, pairs = field.expectations(padded, np.array([4, 2, 3]))
    wanted_pairs = np.zeros((3, 3))
    for k, own in enumerate(chains):
        n = len(own)
        ways = list(product(range(3), repeat=n))
        score = lambda t: own[range(n), t].sum() + sum(moves[a, b] for a, b in zip((0, *t), (*t, 0)))
        assert field.decode(own) == list(max(ways, key=score))
        weight = np.exp([score(t) for t in ways])
        want = np.array([[sum(w for t, w in zip(ways, weight) if t[i] == tag) for tag in range(3)] for i in range(n)]) / weight.sum()
        assert np.allclose(marginals[k, :n], want) and not marginals[k, n:].any()
        for t, w in zip(ways, weight / weight.sum()):
            for a, b in zip((0, *t), (*t, 0)):
                wanted_pairs[a, b] += w
    assert np.allclose(pairs, wanted_pairs)


def test_the_field_learns_from_its_neighbours():
    data = [([["w key", "bias"]], [1]), ([["w room", "bias"]], [0])] * 20
    field = S.Field()
    field.fit(data)
    assert field.decode(field.emissions([["w key", "bias"]])) == [1] and field.decode(field.emissions([["w room", "bias"]])) == [0]


def test_fitting_keeps_no_texts_of_features(monkeypatch):
    monkeypatch.setattr(S, "EPOCHS", 0)
    windows = (([[f"word {i % 7} {k} of a window" for k in range(18)] for i in range(48)], [0] * 48) for _ in range(300))
    tracemalloc.start()
    field = S.Field()
    field.fit(windows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(field.index) == 7 * 18 and peak < 6e6  # as texts they take over 15 MB
