"""Candidates by distances to pivots, dense clusters without all pairs, and rows that share an id."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizloom.llm import near_duplicates as N


def frame(spark, keys):
    return spark.createDataFrame([(N.signed(int(k)),) for k in keys], "fp long").repartition(4)


@pytest.mark.parametrize("blocks", [6, 7, 8])
def test_links_by_all_pairs(spark, blocks):
    rng = np.random.default_rng(blocks)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    keys = sorted({int(b) ^ sum(1 << int(i) for i in rng.choice(64, n, replace=False)) for b in base for n in (0, 1, 2, 3, 4, 5, 6)})
    got = {frozenset(r) for r in N.links(frame(spark, keys), blocks=blocks).collect()}
    assert got == {frozenset((N.signed(a), N.signed(b))) for i, a in enumerate(keys) for b in keys[:i] if (a ^ b).bit_count() <= 4}


def test_more_fingerprints_have_longer_keys():
    assert [N.blocks_for(n, 4) for n in (10, 250_000, 4_000_000, 10**9)] == [6, 6, 7, 8]


def test_the_pivots_discard_most_pairs(spark):
    rng = np.random.default_rng(2)
    rows = frame(spark, rng.integers(0, 2**63, 300, dtype=np.uint64)).select("fp", *[c.alias(f"pivots{i}") for i, c in enumerate(N.pivot_table(F.col("fp")))])
    pairs = rows.select(*[F.col(c).alias(f"x{c}") for c in rows.columns]).crossJoin(rows.select(*[F.col(c).alias(f"y{c}") for c in rows.columns])).filter("xfp < yfp")
    assert pairs.filter(N.within_pivot_bound("x", "y", 4)).count() < 0.01 * pairs.count()


def test_a_dense_cluster_writes_few_links(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base, keys = int(rng.integers(0, 2**63)), set()
    while len(keys) < 5000:
        keys.add(base ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(1, 5), replace=False)))
    apart = {int(x) for x in rng.integers(0, 2**63, 500, dtype=np.uint64)}
    written, plain = [], N.components
    monkeypatch.setattr(N, "components", lambda edges: written.append(edges.count()) or plain(edges))
    got = N.clusters(frame(spark, keys | apart)).collect()
    assert len({r["label"] for r in got}) == 1 and {r["node"] for r in got} == {N.signed(k) for k in keys}
    assert sum(written) < 15 * 5000


def test_components_are_those_of_all_links(spark):
    rng = np.random.default_rng(4)
    keys = set()
    for _ in range(30):
        at = int(rng.integers(0, 2**63))
        for _ in range(40):  # a chain, each within 4 bits of the one before
            at ^= sum(1 << int(i) for i in rng.choice(64, rng.integers(1, 5), replace=False))
            keys.add(at)
    keys = sorted(keys)
    root = {k: k for k in keys}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 4:
                root[top(a)] = top(b)
    want = {}
    for k in keys:
        want.setdefault(top(k), set()).add(N.signed(k))
    got = {}
    for r in N.clusters(frame(spark, keys)).collect():
        got.setdefault(r["label"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_one_row_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, text, "a"), (1, text, "a"), (2, text + " x", "b"), (1, other, "c"), (3, other, "d"), (None, text, "e"), (1, text + " y", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id string")
    got = N.keep_one_of_each(docs)
    assert got.columns == docs.columns
    kept = sorted((r["doc_id"] or 0, r["text"], r["kept_id"]) for r in got.collect())
    assert len(kept) == 3 and (0, text, "e") in kept and (1, other, "c") in kept and kept[1][0] == 1
