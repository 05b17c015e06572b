"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rows, those of least hash, that the field is trained on; windows of each kind, at most; windows of one kind and text.
FIT_ROWS, FIT_WINDOWS, WINDOWS_OF_A_TEXT = 24_000, {"secret": 400, "planted": 1_400, "decoy": 2_600, "other": 600}, 4
#: Tokens of a window, and those before its secret. Least times that a feature stands in the windows to have weights.
WINDOW, LEAD, LEAST_COUNT = 48, 10, 3
EPOCHS, BATCH, RATE, RIDGE = 6, 256, 0.2, 1e-4
PLACEHOLDER = "[SECRET]"
#: What the field adds: runs of so many characters and more, with a digit or capitals within; of a line so many characters before
#: and after are looked at with a run.
LEAST, REACH = 12, 120
RUN, TELLING = re.compile(rf"[A-Za-z0-9+/_.\-]{{{LEAST},}}"), re.compile(r"[0-9]|[a-z][A-Z]|[A-Z]{2}")

#: The fixed patterns, in their order: the kind, the pattern, the group that is the secret, its least length.
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: The same runs of 24 and more, found without trying the shorter ones.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORD = re.compile(r"pass|secret|token|api", re.I)

#: Tokens, each with the white space before it: they end where the case, or the kind of character, changes. All text is tokens.
TOKEN = re.compile(r"\s*(?:[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[^\W0-9_A-Za-z]+|\S)|\s+\Z")
#: Symbols that keys have within; others end a run of tokens.
JOINS = frozenset("+/_.-")
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
#: Inside may not follow outside, nor begin a chain.
FORBIDDEN = -1e9
#: Types of tokens that a task remembers.
REMEMBERED = 200_000


def base_spans(text: str) -> list[tuple[int, str, int, int, int]]:
    """(start, kind, end, secret's start, secret's end) of the fixed patterns, leftmost and non-overlapping for each kind."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(PATTERNS):
        if kind == "assign" and not KEYWORD.search(text):
            continue
        for m in (LONG_HEX if kind == "hex" else pattern).finditer(text):
            if len(m[group]) >= least:
                found.append((m.start(), order, kind, m.end(), *m.span(group)))
    return [(a, kind, b, c, d) for a, _, kind, b, c, d in sorted(found)]


HEX = frozenset("0123456789abcdef")
HEX_OR_HYPHEN = HEX | {"-"}


def kind_of(word: str) -> str:
    if not word:
        return "end"
    if word[0].isdigit():
        return "0"
    if not word.isascii() or not word.isalpha():
        return "other" if word[0].isalpha() else word[0]
    return "a" if word.islower() else "A" if word.isupper() else "Aa"


def shape_of(token: str, word: str, lower: str, kind: str) -> tuple[str, str, int, int, bool]:
    """What is told of a token without the word itself: its kind, what stands before it, its size, vowels, and whether it is hexadecimal."""
    n = len(word)
    space = "glued" if n == len(token) else "line" if "\n" in token else "space"
    size = n if n < 8 else 8 if n < 12 else min(n.bit_length() + 5, 14)
    if n > 64:
        return kind, space, size, -1, False
    vowels = lower.count("a") + lower.count("e") + lower.count("i") + lower.count("o") + lower.count("u")
    return kind, space, size, vowels if n <= 8 else 8 * vowels // n, HEX.issuperset(lower)


def shape_features(kind: str, space: str, size: int, vowels: int, hexadecimal: bool) -> list[str]:
    return ["bias", f"{kind} {space}", f"{kind} {size}", f"{kind} {size} {space}", f"{kind} {size} {vowels}", f"hex {kind} {hexadecimal} {space}"]


def own_features(token: str) -> list[str]:
    """What a token's shape and letters tell."""
    word = token.lstrip()
    lower = word.lower()
    return [*shape_features(*shape_of(token, word, lower, kind_of(word))), f"word {lower[:16]}"]


def beside_kind(place: int, kind: str, glued: bool) -> str:
    return f"{place} kind {kind} {glued}"


def beside_features(token: str, place: int) -> list[str]:
    """What a token tells about one that is so many places away."""
    word = token.lstrip()
    return [f"{place} word {word[:16].lower()}", beside_kind(place, kind_of(word), len(word) == len(token))]


#: Places of neighbours, in tokens from the one that is tagged.
PLACES = (-3, -2, -1, 1)


def numbers_of(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens' numbers (length, white space before, line break in it, digit, breaks a run), a row each: starts and ends in the text, which begin a line, and the code
    of each one's run, by its length, number of tokens and digits, and the run's number."""
    ends = np.cumsum(table[:, 0])
    starts, lines = ends - table[:, 0] + table[:, 1], table[:, 2] > 0
    begins = (table[:, 1] > 0) | (table[:, 4] > 0)
    begins[1:] |= table[:-1, 4] > 0
    lines[0] = begins[0] = True
    run = np.cumsum(begins) - 1
    size, count = np.bincount(run, ends - starts), np.bincount(run)
    digits = np.bincount(run, (table[:, 3] == 1) * (ends - starts))
    code = np.minimum(np.log2(np.maximum(size, 1)).astype(int), 7) * 18 + np.minimum(np.log2(count).astype(int), 5) * 3 + np.where(digits == 0, 0, np.where(digits < size, 1, 2))
    return starts, ends, lines, code[run], run


def type_of(token: str) -> tuple[int, int, bool, bool, bool]:
    word = token.lstrip()
    lead = token[: len(token) - len(word)]
    return len(token), len(lead), "\n" in lead or "\r" in lead, word[:1].isdigit(), bool(word) and not word[0].isalnum() and word[0] not in JOINS


def file_code(text: str) -> int:
    """Features of the file: how long it is, and how many of its characters are digits."""
    n, digits = len(text) // 4, sum(map(text.count, "0123456789")) // 2
    return min(int(math.log2(n + 1)), 15) * 8 + min(int(math.log2(1 + 256 * digits / (n + 1))), 7)


def window_features(tokens: list[str], codes: list[int], file: int) -> list[list[str]]:
    padded = ["", "", "", *tokens, ""]
    return [
        own_features(t) + [f for p in PLACES for f in beside_features(padded[i + 3 + p], p)] + [f"run {c}", f"file {file}", f"file {file % 8} {kind_of(t.lstrip())}"]
        for i, (t, c) in enumerate(zip(tokens, codes))
    ]


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets of keys that are planted, beginnings that some have, and what may stand around any run that is planted.
ALPHABETS = (DIGITS + LOWER + UPPER,) * 3 + (DIGITS + LOWER + UPPER + "_-", DIGITS + LOWER + UPPER + "+/", DIGITS + LOWER, DIGITS + UPPER)
PREFIXES = ("", "", "", "sk_live_", "pk_test_", "ghp_", "xoxb-", "key-", "SG.", "tok.", "AIza", "rk_")
CARRIERS = ("{}", "{}", "{}", '"{}"', "'{}'", "({})", "use {}", "is {}", "with {}.", "see {},", "id={}", "X-Value: {}", "Bearer {}", "value = {}", 'set("{}")', "{};")


def drawn(rng: random.Random, alphabet: str, least: int, most: int) -> str:
    return "".join(rng.choices(alphabet, k=rng.randint(least, most)))


def planted_key(rng: random.Random) -> str:
    prefix = rng.choice(PREFIXES)
    alphabet = rng.choice(ALPHABETS)
    while True:
        body = drawn(rng, alphabet, 16 if prefix else 20, 56)
        if body[0] not in "_-+/" and body[-1] not in "_-+/" and any(c in DIGITS for c in body):
            return prefix + body


def decoy(rng: random.Random) -> str:
    """A run that is no secret though it looks a little like one: ids, links, hashes of commits, versions, numbers, paths, names."""
    hexadecimal, word = lambda n: drawn(rng, "0123456789abcdef", n, n), lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    uuid = "-".join(hexadecimal(n) for n in (8, 4, 4, 4, 12))
    site = f"{rng.choice(('http', 'https'))}://{rng.choice(('www.', '', 'cdn.', 'static.'))}{word()}.{rng.choice(('com', 'org', 'net', 'io', 'de'))}"
    part = rng.choice((word(), f"{word()}-{word()}", str(rng.randint(1, 10**6)), f"{rng.choice('abcdpx')}{rng.randint(100, 99999)}", drawn(rng, DIGITS + LOWER + UPPER, 3, 11), hexadecimal(rng.choice((8, 16, 32, 40))), uuid))
    camel = "".join(w.capitalize() for w in (word(), word(), word()))
    return rng.choice((
        *[uuid] * 5, uuid.upper(), uuid.upper(), "{" + uuid + "}", f"urn:uuid:{uuid}", hexadecimal(rng.choice((7, 8, 10, 12))), hexadecimal(40), hexadecimal(rng.choice((32, 64))), f"sha256:{hexadecimal(64)}",
        f"{site}/{part}", f"{site}/{part}/{drawn(rng, DIGITS + LOWER + UPPER, 3, 11)}", f"{site}/{word()}/{part}.html?id={rng.randint(1, 10**8)}&page={rng.randint(1, 99)}", f"{site}/{word()}/{word()}-{word()}-{word()}/{rng.randint(1, 10**7)}",
        f"v{rng.randint(0, 20)}.{rng.randint(0, 40)}.{rng.randint(0, 99)}", f"{rng.randint(1, 12)}.{rng.randint(0, 9)}.{rng.randint(0, 30000)}.{rng.randint(0, 9999)}", f"{word()}-{rng.randint(0, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 99)}-beta.{rng.randint(1, 9)}",
        str(rng.randint(10**9, 10**18)), f"+{rng.randint(1, 99)}-{rng.randint(100, 999)}-{rng.randint(1000000, 9999999)}", f"20{rng.randint(10, 29)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}Z",
        f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}", f"/usr/lib/{word()}{rng.randint(1, 9)}.{rng.randint(1, 20)}/{word()}/x86_64-linux-gnu/{word()}.so.{rng.randint(1, 9)}",
        camel, camel[0].lower() + camel[1:] + str(rng.randint(1, 99)), "_".join((word(), word(), word(), str(rng.randint(1, 999)))), "_".join((word(), word(), word())).upper(), f"{word()}.{word()}{rng.randint(1, 99)}@{word()}.example.com",
        f"INV-20{rng.randint(10, 29)}-{rng.randint(10000, 99999)}", f"978-{rng.randint(0, 9)}-{rng.randint(10, 99)}-{rng.randint(100000, 999999)}-{rng.randint(0, 9)}", f"{word()}{word()}{word()}{word()}{word()}", word().upper() * 2, ":".join(hexadecimal(2) for _ in range(6)),
    ))


def windows(text: str) -> list[tuple[str, list[str], list[int], int, list[int]]]:
    """Of a text, by hashes: its kind, tokens, codes of runs, the file's code, and tags of windows around secrets of the fixed patterns
    (`secret`), keys and decoys that are planted into the text (`planted`, `decoy`), and others, around digits and anywhere (`other`).

    In two of three windows with a secret what stands before it is hidden, words replaced by others of the text, and in half of
    these the secret's own beginning is, too, if it is one that a pattern looks for; so shape and neighbours must carry the tag.
    Runs of hexadecimal digits alone are left to their pattern and not tagged: nothing tells a commit from a key.
    """
    tokens = TOKEN.findall(text)
    if not tokens:
        return []
    types = np.array(list(map(type_of, tokens)), np.int64)
    starts, ends, _, codes, _ = numbers_of(types)
    digits = np.flatnonzero(types[:, 3])
    file = file_code(text)
    tags = np.zeros(len(tokens), int)
    spans: list[tuple[int, int]] = []
    for _, _, _, a, b in sorted((s for s in base_spans(text) if s[1] != "hex"), key=lambda s: s[3:5]):
        if spans and a < spans[-1][1]:
            spans[-1] = spans[-1][0], max(b, spans[-1][1])
        else:
            spans.append((a, b))
    firsts = []
    for a, b in spans:
        first, last = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(starts, b, side="left"))
        tags[first:last], firsts = INSIDE, [*firsts, first]
        tags[first] = BEGIN

    def rank(i: int) -> int:
        return xxhash.xxh64_intdigest(f"{i} {text[starts[i] : starts[i] + 64]}".encode("utf-8", "surrogatepass"))

    def window(first: int, size: int = WINDOW) -> slice:
        return slice(max(0, first), min(len(tokens), max(0, first) + size))

    out = []
    for first in sorted(firsts, key=rank)[:WINDOWS_OF_A_TEXT]:
        w, turn = window(first - LEAD), rank(first) % 6
        own = tokens[w]
        if turn >= 2:
            words = [t.lstrip() for t in tokens[:400] if t.strip().isalpha() and not KEYWORD.search(t)] or ["x"]
            for i in range(first - w.start):
                if own[i].strip().isalpha():
                    own[i] = own[i][: len(own[i]) - len(own[i].lstrip())] + words[(turn + 7 * i + first) % len(words)]
            if turn >= 4 and own[first - w.start].lstrip().startswith("AKIA"):
                at = first - w.start
                other = "".join(chr(65 + (rank(first) >> (5 * k)) % 26) for k in range(4))
                own[at] = own[at].replace("AKIA", other, 1)
        out.append(("secret", own, codes[w].tolist(), file, tags[w].tolist()))
    rng = random.Random(rank(0))
    free = [i for i in range(len(tokens)) if types[i, 1] and not tags[window(i - LEAD)].any()] if len(tokens) < 5000 else [i for i in rng.sample(range(len(tokens)), 400) if types[i, 1] and not tags[window(i - LEAD)].any()]
    for kind in ("planted", "decoy", "decoy", "planted", "decoy"):
        if not free:
            break
        i, run = rng.choice(free), planted_key(rng) if kind == "planted" else decoy(rng)
        carrier = rng.choice(CARRIERS)
        before, after = text[starts[max(0, i - LEAD)] : starts[i]], text[starts[i] : ends[min(len(tokens), i + LEAD) - 1]]
        made = f"{before}{carrier.format(run)} {after}"
        own = TOKEN.findall(made)
        starts_, ends_, _, codes_, _ = numbers_of(np.array(list(map(type_of, own)), np.int64))
        tagged = np.zeros(len(own), int)
        if kind == "planted":
            a = len(before) + carrier.index("{")
            first, last = int(np.searchsorted(ends_, a, side="right")), int(np.searchsorted(starts_, a + len(run), side="left"))
            tagged[first:last] = INSIDE
            tagged[first] = BEGIN
        out.append((kind, own, codes_.tolist(), file, tagged.tolist()))
    around = [int(i) for i in digits if not tags[window(int(i) - LEAD)].any()]
    some = sorted(around, key=rank)[: WINDOWS_OF_A_TEXT // 2]
    some += sorted((i for i in np.linspace(0, len(tokens) - 1, 8).astype(int).tolist() if not tags[window(i - LEAD)].any()), key=rank)[: WINDOWS_OF_A_TEXT // 2]
    out += [("other", tokens[w], codes[w].tolist(), file, tags[w].tolist()) for w in (window(i - LEAD) for i in dict.fromkeys(some))]
    return out


class Field:
    """A linear chain: weights of (feature, tag) and of moves between tags."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weights = np.zeros((1, 3))  # row 0 is for features that are not known
        self.moves = np.zeros((3, 3))

    def allowed(self) -> np.ndarray:
        moves = self.moves.copy()
        moves[OUTSIDE, INSIDE] = FORBIDDEN
        return moves

    def vector(self, features: list[str]) -> np.ndarray:
        return self.weights[[self.index.get(f, 0) for f in features]].sum(axis=0)

    def emissions(self, features: list[list[str]]) -> np.ndarray:
        return np.array([self.vector(own) for own in features])

    def decode(self, emissions: np.ndarray) -> list[int]:
        """The best sequence of tags, by Viterbi; before it stands a token outside."""
        moves, best, back = self.allowed(), emissions[0] + self.moves[OUTSIDE], []
        best[INSIDE] = FORBIDDEN
        for own in emissions[1:]:
            ways = best[:, None] + moves
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + own
        tags = [int((best + self.moves[:, OUTSIDE]).argmax())]
        for step in reversed(back):
            tags.append(int(step[tags[-1]]))
        return tags[::-1]

    def expectations(self, emissions: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of chains (chain, token, tag), padded to one length: probabilities of tags, and sums of those of moves, by the forward
        and backward recursions. A token outside stands before and after each chain."""
        moves, (n, width, _) = self.allowed(), emissions.shape
        start, end = self.moves[OUTSIDE].copy(), self.moves[:, OUTSIDE]
        start[INSIDE] = FORBIDDEN
        forward, backward = np.empty(emissions.shape), np.zeros(emissions.shape)
        forward[:, 0] = emissions[:, 0] + start
        for i in range(1, width):
            forward[:, i] = log_sum(forward[:, i - 1, :, None] + moves, 1) + emissions[:, i]
        backward[:, width - 1] = end
        for i in range(width - 2, -1, -1):
            onward = log_sum(moves[None] + (emissions[:, i + 1] + backward[:, i + 1])[:, None, :], 2)
            backward[:, i] = np.where((lengths - 1 == i)[:, None], end, onward)
        rows = np.arange(n)
        total = log_sum(forward[rows, lengths - 1] + end, 1)
        inside = np.arange(width)[None, :] < lengths[:, None]
        marginal = np.exp(np.minimum(forward + backward - total[:, None, None], 0)) * inside[:, :, None]
        pairs = np.zeros((3, 3))
        for i in range(1, width):
            each = forward[:, i - 1, :, None] + moves + (emissions[:, i] + backward[:, i])[:, None, :] - total[:, None, None]
            pairs += np.exp(np.minimum(each, 0))[inside[:, i]].sum(axis=0)
        pairs[OUTSIDE] += marginal[:, 0].sum(axis=0)
        pairs[:, OUTSIDE] += marginal[rows, lengths - 1].sum(axis=0)
        return marginal, pairs

    def fit(self, data: Iterable[tuple[list[list[str]], list[int]]], seed: int = 0) -> None:
        """Gradient steps on the likelihood, each weight with a rate of its own that falls with its gradients, and a ridge.

        Of the data, which is gone through once, features are kept as numbers: as texts they would be hundreds of MB of the driver's.
        """
        numbers: dict[str, int] = {}
        chains = [(np.fromiter((numbers.setdefault(f, len(numbers)) for own in features for f in own), np.int32), np.fromiter(map(len, features), np.int32), np.array(tags, np.int8)) for features, tags in data]
        counts = np.bincount(np.concatenate([flat for flat, _, _ in chains]), minlength=len(numbers))
        often = counts >= min(LEAST_COUNT, len(chains))
        known = np.where(often, np.cumsum(often), 0)
        self.index = {f: int(known[i]) for f, i in numbers.items() if often[i]}
        del numbers
        self.weights = np.zeros((len(self.index) + 1, 3))
        width, depth = max(len(tags) for _, _, tags in chains), max(int(each.max()) for _, each, _ in chains)
        ids, gold = np.zeros((len(chains), width, depth), np.int32), np.zeros((len(chains), width), np.int8)
        lengths = np.array([len(tags) for _, _, tags in chains])
        for k, (flat, each, tags) in enumerate(chains):
            gold[k, : len(tags)] = tags
            ids[k, : len(each)][np.arange(depth) < each[:, None]] = known[flat]
        seen, seen_moves = np.full(self.weights.shape, 1e-3), np.full((3, 3), 1e-3)
        order = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            for at in np.array_split(order.permutation(len(chains)), -(-len(chains) // BATCH)):
                own, n = ids[at], lengths[at]
                emissions = self.weights[own].sum(axis=2)
                marginal, pairs = self.expectations(emissions, n)
                inside = np.arange(width)[None, :] < n[:, None]
                wanted = np.eye(3)[gold[at]] * inside[:, :, None]
                moved = np.zeros((3, 3))
                for a, b, both in zip(gold[at][:, :-1].ravel(), gold[at][:, 1:].ravel(), inside[:, 1:].ravel()):
                    moved[a, b] += both
                moved[OUTSIDE] += np.bincount(gold[at][:, 0], minlength=3)
                moved[:, OUTSIDE] += np.bincount(gold[at][np.arange(len(at)), n - 1], minlength=3)
                rest = np.repeat((wanted - marginal).reshape(-1, 3), depth, axis=0)
                step = np.stack([np.bincount(own.ravel(), rest[:, c], len(self.weights)) for c in range(3)], axis=1) - RIDGE * len(at) * self.weights
                step[0] = 0
                seen += step**2
                self.weights += RATE * step / np.sqrt(seen)
                step = moved - pairs - RIDGE * len(at) * self.moves
                step[OUTSIDE, INSIDE] = 0
                seen_moves += step**2
                self.moves += RATE * step / np.sqrt(seen_moves)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


class Tagger(dict):
    """Decodes whole texts by a field. Types of tokens are numbered as they come, with what each adds to its own and its
    neighbours' emissions, so that those of a text are sums of rows of tables."""

    def __init__(self, field: Field):
        self.field, moves = field, field.allowed()
        self.runs = np.array([field.vector([f"run {c}"]) for c in range(144)])
        self.kinds = {k: i for i, k in enumerate(["", *sorted({f.partition(" ")[2].partition(" ")[2] for f in field.index if f.startswith("file ") and f.count(" ") == 2})])}
        self.by_kind = np.array([[field.vector([f"file {c} {k}"]) for c in range(8)] for k in self.kinds])
        # what entering a tag other than outside can gain at most against staying outside, and leaving it
        stay = moves[OUTSIDE, OUTSIDE]
        self.bonus = np.array([moves[:, BEGIN].max(), moves[[BEGIN, INSIDE], INSIDE].max()]) - stay
        self.bonus += max(0.0, moves[[BEGIN, INSIDE], OUTSIDE].max() - stay)
        # words that the field knows: what they add to their own emissions and, by place, to their neighbours'
        known = sorted({f.partition("word ")[2] for f in field.index if "word " in f})
        self.words = {w: i for i, w in enumerate(known, 1)}
        self.of_word = np.zeros((len(known) + 1, 1 + len(PLACES), 3), np.float32)
        for w, i in self.words.items():
            self.of_word[i] = [field.vector([f"word {w}"]), *(field.vector([f"{p} word {w}"]) for p in PLACES)]
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.shapes: dict[tuple, int] = {}
        self.by_shape, self.numbers, self.fresh = np.zeros((256, 1 + len(PLACES), 3), np.float32), np.zeros((4096, 8), np.int64), []
        self[""]  # stands before and after a text

    def __missing__(self, token: str) -> int:
        word = token.lstrip()
        lower, kind = word.lower(), kind_of(word)
        key = shape_of(token, word, lower, kind)
        shape = self.shapes.get(key)
        if shape is None:
            shape = self.shapes[key] = len(self.shapes)
            if shape == len(self.by_shape):
                self.by_shape = np.concatenate([self.by_shape, np.zeros_like(self.by_shape)])
            self.by_shape[shape] = [self.field.vector(shape_features(*key)), *(self.field.vector([beside_kind(p, kind, key[1] == "glued")]) for p in PLACES)]
        self[token] = number = len(self)
        self.fresh.append((*type_of(token), self.kinds.get(kind, 0), shape, self.words.get(lower[:16], 0)))
        return number

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Start and end of the runs that the field tags.

        A secret is a run (no white space, quotes or other separators) of LEAST characters and more, with a digit or capitals
        within; runs of hexadecimal digits and hyphens alone are left to their pattern, as nothing tells a UUID or a commit from a key. Only around such runs the text is decoded, with what stands before and after in the line; a run counts as a
        whole, if at least half of it is tagged.
        """
        if not self.field.index:
            return []
        if len(self) > REMEMBERED:
            self.forget()
        out, parts = [], []
        for m in RUN.finditer(text):
            if not TELLING.search(m[0]):
                continue
            a = max(text.rfind("\n", 0, m.start()) + 1, m.start() - REACH)
            b = text.find("\n", m.end(), m.end() + REACH)
            b = min(len(text), m.end() + REACH) if b < 0 else b
            if parts and a <= parts[-1][1]:
                parts[-1] = (parts[-1][0], max(b, parts[-1][1]))
            else:
                parts.append((a, b))
        file = file_code(text) if parts else 0
        for a, b in parts:
            out += [(a + x, a + y) for x, y in self.tagged(text[a:b], file)]
        return out

    def tagged(self, text: str, file: int) -> list[tuple[int, int]]:
        """The runs of a part of a text."""
        tokens = TOKEN.findall(text)
        n = len(tokens)
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, n)
        if self.fresh:
            while len(self) > len(self.numbers):
                self.numbers = np.concatenate([self.numbers, np.zeros_like(self.numbers)])
            self.numbers[len(self) - len(self.fresh) : len(self)] = self.fresh
            self.fresh = []
        numbers = self.numbers[at]
        starts, ends, lines, codes, run = numbers_of(numbers)
        emissions = self.runs[codes] + self.by_kind[numbers[:, 5], file % 8] + self.field.vector([f"file {file}"])
        before, after = -min(PLACES), max(PLACES)
        edge = np.repeat(self.numbers[:1, 6:8], before + after, axis=0)
        shape, word = np.concatenate([edge[:before], numbers[:, 6:8], edge[before:]]).T
        for k, p in enumerate((0, *PLACES)):
            own = slice(before + p, before + p + n)
            emissions += self.by_shape[shape[own], k] + self.of_word[word[own], k]
        hit = np.zeros(n, bool)
        for first, last in self.stretches(emissions, lines):
            hit[first:last] = np.array(self.field.decode(emissions[first:last])) != OUTSIDE
        if not hit.any():
            return []
        size = ends - starts
        found = []
        for r in np.flatnonzero(2 * np.bincount(run, hit * size) >= np.maximum(np.bincount(run, size), 1)):
            first, last = (int(x) for x in np.searchsorted(run, [r, r + 1]))
            whole = text[starts[first] : ends[last - 1]]
            a, b = len(whole) - len(whole.lstrip("".join(JOINS))), len(whole.rstrip("".join(JOINS)))
            if b - a >= LEAST and TELLING.search(whole[a:b]) and not HEX_OR_HYPHEN.issuperset(whole[a:b].lower()):
                found.append((int(starts[first]) + a, int(starts[first]) + b))
        return found

    def stretches(self, emissions: np.ndarray, lines: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of tokens, in one line each, outside of which no tag but outside can stand in the best sequence: those tokens
        for which some run of neighbours around them has a positive sum of what tokens could gain at most by other tags."""
        gain = (emissions[:, 1:] - emissions[:, :1] + self.bonus).max(axis=1)
        if gain.max() <= 0:
            return []
        place = np.arange(len(gain)) + np.cumsum(lines)  # a wall stands before each line
        walled = np.zeros(place[-1] + 1)
        walled[place] = gain
        walls = place[lines] - 1
        walled[walls] = -1.0 - np.maximum(gain, 0).sum()
        sums = np.concatenate([[0.0], np.cumsum(walled)])
        positive = np.zeros(len(walled) + 2, bool)
        positive[1:-1] = np.maximum.accumulate(sums[:0:-1])[::-1] > np.minimum.accumulate(sums[:-1])
        edges = np.flatnonzero(positive[1:] != positive[:-1])
        back = np.full(len(walled) + 1, len(gain))
        back[place] = np.arange(len(gain))
        back[walls] = back[walls + 1]
        return [(int(back[a]), int(back[b - 1]) + 1) for a, b in zip(edges[::2], edges[1::2])]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Trains on the rows of least hash: windows around what the fixed patterns find, around keys and decoys planted into the texts,
    and others, each kind within its own limit.

    Tokens of the windows are brought to the driver, a bounded number, and no texts. Without texts the field marks nothing.
    """
    chosen = docs.select(F.col(id_col).alias("id")).filter(F.col("id").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("text")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [w for t in batch["text"] for w in windows(t or "")]
            yield pd.DataFrame(rows, columns=["kind", "tokens", "codes", "file", "tags"])

    got = cut(texts.mapInPandas(run, "kind string, tokens array<string>, codes array<int>, file int, tags array<int>").distinct())

    def chosen_windows() -> Iterator[tuple[list[list[str]], list[int]]]:
        for kind, limit in FIT_WINDOWS.items():
            for r in got.filter(F.col("kind") == kind).orderBy(F.xxhash64("tokens"), "tokens", "codes", "tags", "file").limit(limit).collect():
                yield window_features(r["tokens"], r["codes"], r["file"]), r["tags"]

    field = Field()
    if not got.isEmpty():
        field.fit(chosen_windows())
    return field


def find(text: str | None, tagger: Tagger) -> list[tuple[int, str, int, int, int]]:
    """All spans of a text by start, then kind in order: the fixed patterns', and those of the field that touch none of them (kind `crf`)."""
    text = text or ""
    spans = base_spans(text)
    taken = [(s[0], s[2]) for s in spans]
    spans += [(a, "crf", b, a, b) for a, b in tagger.spans(text) if not any(a < y and x < b for x, y in taken)]
    kinds = [p[0] for p in PATTERNS] + ["crf"]
    return sorted(spans, key=lambda s: (s[0], kinds.index(s[1])))


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of each row: start, end (code points, end exclusive), kind, and the secret's own start and end.

    NULL counts as the empty text and has no spans; repeated rows and NULL ids stay; other columns are ignored; no rows give
    no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = "array<struct<start:int,end:int,kind:string,secret_start:int,secret_end:int>>"

    @F.pandas_udf(kind)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = Tagger(shared.value)
        for texts in batches:
            yield pd.Series([[{"start": a, "end": b, "kind": k, "secret_start": c, "secret_end": d} for a, k, b, c, d in find(t, tagger)] for t in texts], dtype=object)

    return docs.select(F.col(id_col).alias("id"), spans(F.col(text_col)).alias("spans"))


def redact(text: str, tagger: Tagger) -> str:
    """The text with each secret, but not what tells that it is one, written as a placeholder."""
    out, at = [], 0
    for _, _, _, a, b in sorted(find(text, tagger), key=lambda s: s[3:5]):
        if b > at:
            out += [text[at : max(a, at)], PLACEHOLDER if a >= at else ""]
            at = b
    return "".join(out) + text[at:]


def redacted(text: Column, field: Field, spark) -> Column:
    """Texts without their secrets; NULL stays NULL. Equal texts, as in repeated rows, stay equal; no other column is looked at."""
    shared = spark.sparkContext.broadcast(field)

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = Tagger(shared.value)
        for texts in batches:
            yield pd.Series([t if t is None else redact(t, tagger) for t in texts], dtype=object)

    return of(text)
