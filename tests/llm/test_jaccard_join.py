"""The n-gram Jaccard join against all pairs, with lists split into cells, hot groups and odd texts."""

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from quizloom.llm import jaccard_join as J
from quizloom.llm.queries import op12_jaccard_join

SCHEMA = "doc_id long, text string, id string, n long, cls string, label string"


def plain_set(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def plain(rows, percent=90):
    """[(id, n, least id reached)] by all pairs of distinct sets, each row alone where its set is empty."""
    sets = sorted({plain_set(t) for _, t in rows} - {frozenset()}, key=sorted)
    root = {s: s for s in sets}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for a, b in combinations(sets, 2):
        if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
            root[find(a)] = find(b)
    least = {}
    for i, t in rows:
        if i is not None and plain_set(t):
            s = find(plain_set(t))
            least[s] = min(least.get(s, i), i)
    out = [(i, len(plain_set(t)), least.get(find(plain_set(t))) if plain_set(t) else i) for i, t in rows]
    return sorted(out, key=str)


def got(frame):
    return sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in frame.collect()), key=str)


def made(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", 7, "y", "z") for r in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words, 60))
    out = []

    def add(text):
        out.append((len(out), text))

    for base in range(12):
        own = list(rng.choice(words, rng.integers(3, 130)))
        for copy in range(12):
            near = list(own)
            for _ in range(rng.integers(0, 4)):
                near[rng.integers(len(near))] = words[rng.integers(400)]
            add(" ".join(near) + f" tail{copy}" * (copy % 5 == 0))
    for k in range(60):
        add(passage + " " + " ".join(rng.choice(words, rng.integers(0, 40))))
    for n in (1, 2, 3, 8, 9, 10, 11, 12, 13, 20, 21, 22):  # subsets one shingle apart
        add(" ".join(f"s{i}" for i in range(n)))
        add(" ".join(f"s{i}" for i in range(n)).upper())
    many = " ".join(rng.choice(words, 1300))
    out += [(None, out[3][1]), (None, None), (None, "lonely words of no id"), (900, None), (901, ""), (902, " \n\t"), (903, "x"), (903, "x"), (5, out[7][1]), (904, "a b c d e f g h i j k l"), (905, "long " * 30_000 + "end")]
    return out


def test_against_all_pairs(spark, rows):
    assert got(J.similarity_join(made(spark, rows))) == plain(rows)


def test_long_lists_in_chunks(spark, rows, monkeypatch):
    monkeypatch.setattr(J, "CELL", 4)
    monkeypatch.setattr(J, "DENSE", 1)
    monkeypatch.setattr(J, "FEW", 3)
    monkeypatch.setattr(J, "COUNTERS", 1 << 10)
    assert got(J.similarity_join(made(spark, rows))) == plain(rows)


@pytest.mark.parametrize("percent", [80, 95])
def test_other_similarities(spark, rows, percent):
    assert got(J.similarity_join(made(spark, rows[:170]), percent=percent)) == plain(rows[:170], percent)


def test_no_rows_and_no_shared_shingle(spark):
    assert got(J.similarity_join(made(spark, []))) == []
    alone = [(i, " ".join(f"{i}-{k}" for k in range(30))) for i in range(5)]
    assert got(J.similarity_join(made(spark, alone))) == plain(alone)


def test_divide_skip_finds_all():
    rng = np.random.default_rng(6)
    for trial in range(60):
        base = rng.choice(300, 40, replace=False)
        sets = []
        for _ in range(30):
            own = base.copy()
            at = rng.choice(40, rng.integers(0, 12), replace=False)
            own[at] = rng.integers(300, 2000, len(at))
            sets.append(np.unique(own).astype(np.uint64))
        sets.sort(key=len)
        lists, member = J.Lists(sets), 29
        wanted = np.sort(rng.choice(29, 15, replace=False))
        for least in (1, 5, 30, len(sets[member])):
            want = [(int(o), len(np.intersect1d(sets[member], sets[o]))) for o in wanted]
            assert J.occurring(lists, member, wanted, least) == [x for x in want if x[1] >= least]


def test_merge_skip_skips():
    class Counted(list):
        reads = 0

        def __getitem__(self, i):
            Counted.reads += 1
            return list.__getitem__(self, i)

    lists = [Counted(range(k, 5000, 7)) for k in range(6)] + [Counted([2500, 4999])]
    assert J.merge_skip(lists, 2) == sorted((v, sum(v in x for x in map(set, lists))) for v in {2500, 4999} if sum(v in set(x) for x in lists) >= 2)
    dense = Counted.reads
    Counted.reads = 0
    assert J.merge_skip(lists, 6) == [] and Counted.reads < dense


def test_cell_writes_a_tree_of_links():
    rng = np.random.default_rng(8)
    base = np.arange(200, dtype=np.uint64) << np.uint64(33)
    sets = sorted([np.unique(np.concatenate([np.delete(base, rng.choice(200, 5)), rng.integers(1, 2**63, 3, dtype=np.uint64)])) for _ in range(150)], key=len)
    parity = J.Fields([J.field(s) for s in sets])
    links = J.cell_links(sets, parity, np.arange(150), 90)
    assert len(links) == 149
    for a in range(150):
        for b in range(a):
            common = len(np.intersect1d(sets[a], sets[b]))
            assert parity.apart(np.array([a]), np.array([b]))[0] <= len(sets[a]) + len(sets[b]) - 2 * common


def test_marks_of_shared_shingles(spark):
    values = [5, -7, 2**62, 5 + 1024, -1]
    marks = J.bitmap_of(spark.createDataFrame([(v,) for v in values], "token long").repartition(3), 1024)
    assert {i for i in range(1024) if marks[i // 8] >> (i % 8) & 1} == {v % 2**64 % 1024 for v in values}


def test_wide_parities_fold():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(1, 2**63, n, dtype=np.uint64)) for n in (50, 900, 1100, 3000, 9000, 2900)]
    sets += [np.concatenate([s[: len(s) * 9 // 10], rng.integers(1, 2**63, 5, dtype=np.uint64)]) for s in sets]
    found = J.Fields([J.field(s) for s in sets])
    for a in range(12):
        for b in range(12):
            differ = len(sets[a]) + len(sets[b]) - 2 * len(np.intersect1d(sets[a], sets[b]))
            bits = min(J.wide_bits(len(x)) for x in (sets[a], sets[b]))
            own = [np.frombuffer(J.parities(x, bits), np.uint8) for x in (sets[a], sets[b])]
            assert found.apart(np.array([a]), np.array([b]))[0] == np.bitwise_count(own[0] ^ own[1]).sum() <= differ


def test_query_on_given_rows(spark):
    found = op12_jaccard_join(spark, "/root/testdata/sf0.001").collect()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == plain(rows)


def test_sets_that_link_share_the_group_of_the_smaller():
    for percent in (88, 90, 95):
        for a in [*range(9, 400), 5000, 99_999]:
            for b in {a, (a + a * 100 // percent) // 2, a * 100 // percent}:  # as large as may link with a, at most
                prefixes = pa.array([[7, 8], [8]], pa.list_(pa.int64()))
                own, pos, key, home = J.keyed(prefixes, np.array([a, b]), percent)
                mine = set(key[(own == 0) & (pos == 1) & home])
                assert len(mine) == 1 and mine <= set(key[own == 1])


def test_sizes_keep_texts_that_cannot_link_out_of_a_list(spark):
    prefix = [[int(v)] for v in [5] * 40 + [6] * 2]
    sizes = [9 * 2 ** (k % 20) for k in range(40)] + [100, 108]
    classes = spark.createDataFrame([(bytes([k]), n, p) for k, (n, p) in enumerate(zip(sizes, prefix))], "cls binary, n long, prefix array<long>")
    found = J.shared_postings(classes, 90).collect()
    assert {r["members"] for r in found} == {2} and len(found) == 42  # 40 of one shingle, two of each size
