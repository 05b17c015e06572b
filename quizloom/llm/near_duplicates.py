"""Near-duplicate groups: by SimHash with pivot distance tables, and by the similarity of shingle sets behind the same tables."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components, grouped, merged
from .fingerprint import PIVOTS, fingerprint, pivot_fingerprints, signed
from .jaccard_join import chunk_of, chunks, linked

RADIUS = 4
#: Keys of candidates have so many bits beyond the binary logarithm of the number of fingerprints, about.
SPARE_BITS = 2
#: Of similar texts: the words of a shingle and the least Jaccard similarity of the sets of shingles, in percent.
WIDTH, PERCENT = 5, 80


def block_masks(blocks: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def blocks_for(n: int, radius: int) -> int:
    """The least number of blocks so that those in which fingerprints within the radius agree tell n of them apart."""
    blocks = radius + 2
    while 64 * (blocks - radius) // blocks < n.bit_length() + SPARE_BITS and blocks < radius + 5:
        blocks += 1
    return blocks


def pivot_table(fp: Column, mask: int = -1, bits: int = 8) -> list[Column]:
    """The Hamming distances to all pivots in the bits of the mask, packed into longs."""
    pivots, each = pivot_fingerprints(), 64 // bits
    packed = []
    for first in range(0, len(pivots), each):
        parts = [F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(p)).bitwiseAND(F.lit(signed(mask & (1 << 64) - 1)))).cast("long"), bits * i) for i, p in enumerate(pivots[first : first + each])]
        packed.append(reduce(lambda a, b: a.bitwiseOR(b), parts))
    return packed


def pivots_of(fp: str, side: str = "") -> list[Column]:
    return [c.alias(f"{side}pivots{i}") for i, c in enumerate(pivot_table(F.col(fp)))]


def within_pivot_bound(a: str, b: str, radius: int, count: int = PIVOTS) -> Column:
    """By the triangle inequality, fingerprints within the radius differ by no more than it in any coordinate."""

    def distance(side: str, i: int) -> Column:
        return F.shiftrightunsigned(F.col(f"{side}pivots{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(255))

    return reduce(lambda x, y: x & y, [F.abs(distance(a, i) - distance(b, i)) <= radius for i in range(count)])


def first_agreeing(x: Column, y: Column, blocks: int, agree: int) -> Column:
    """The set, as bits, of the first `agree` blocks in which x and y are equal."""
    differ = x.bitwiseXOR(y)
    rest = reduce(lambda a, b: a.bitwiseOR(b), [F.when(differ.bitwiseAND(F.lit(signed(m))) == 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, m in enumerate(block_masks(blocks))])
    chosen = []
    for _ in range(agree):
        lowest = rest.bitwiseAND(-rest)
        chosen.append(lowest)
        rest = rest.bitwiseXOR(lowest)
    return reduce(lambda a, b: a.bitwiseOR(b), chosen)


def candidates(fingerprints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(fp, pivots0, pivots1, choice, key): each fingerprint under every choice of blocks, keyed by its distances to the pivots there.

    Of the blocks of bits, at least blocks - radius are equal in two fingerprints within the radius, and so are their
    distances to all pivots in these blocks. The distances in a block are packed into a long, four bits each.
    """
    if blocks - radius < 1 or -(-64 // blocks) > 15:
        raise ValueError(f"{blocks} blocks do not serve a radius of {radius}")
    agree = blocks - radius
    tables = fingerprints.select("fp", *[pivot_table(F.col("fp"), m, 4)[0].alias(f"block{i}") for i, m in enumerate(block_masks(blocks))])
    keys = [F.struct(F.lit(sum(1 << i for i in c)).alias("choice"), F.xxhash64(F.lit(sum(1 << i for i in c)), *[f"block{i}" for i in c]).alias("key")) for c in combinations(range(blocks), agree)]
    return tables.select("fp", *pivots_of("fp"), F.explode(F.array(*keys)).alias("k")).select("fp", "pivots0", "pivots1", "k.choice", "k.key")


def near(x: str, y: str, radius: int) -> Column:
    """The pivots' bound, which discards most pairs, and the distance itself."""
    return within_pivot_bound(x, y, radius) & (F.bit_count(F.col(f"{x}fp").bitwiseXOR(F.col(f"{y}fp"))) <= radius)


def links(fingerprints: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """All pairs (a, b), a < b, of the distinct longs in column `fp` that differ in at most `radius` bits.

    Fingerprints meet whose distances to the pivots agree in enough blocks; a pair is compared under its first common
    choice only. There the pivot table discards it or lets it pass to the exact comparison. Of dense clusters this gives
    all pairs; clusters finds components without.
    """
    blocks = blocks or blocks_for(fingerprints.count(), radius)
    keyed = candidates(fingerprints, radius, blocks)
    a, b = keyed.alias("a"), keyed.alias("b")
    meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.choice") == F.col("b.choice")) & (F.col("a.fp") < F.col("b.fp"))
    once = first_agreeing(F.col("a.fp"), F.col("b.fp"), blocks, blocks - radius) == F.col("a.choice")
    return a.join(b, meet & near("a.", "b.", radius) & once).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def clusters(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, label) of the distinct longs in column `fp` that have a link; the label is the same for all of a component.

    Links are not all written. Fingerprints that meet share a bucket; each is compared with the bucket's leader, and what is
    linked is contracted. Then those of a bucket that are not in its leader's component are compared with the members in
    other components, and what is linked is written once for each two components. So each two of a bucket are in one
    component or compared, and no more rows are written than fingerprints stand in buckets. Keys and fingerprints alone are shuffled
    for the buckets, the distances to the pivots are made again from them.
    """
    keyed = candidates(fingerprints, radius, blocks_for(fingerprints.count(), radius)).select("key", "fp")
    by_hash = F.col("fp").bitwiseXOR(F.col("key"))  # another order in each bucket
    buckets = keyed.groupBy("key").agg(F.min(by_hash).bitwiseXOR(F.col("key")).alias("leader"), F.count("*").alias("n")).filter("n > 1")
    members = cut(keyed.join(buckets, "key"))
    met = members.filter("fp <> leader").select("fp", "leader").distinct()
    star = met.select("fp", F.col("leader").alias("leader_fp"), *pivots_of("fp"), *pivots_of("leader", "leader_")).filter(near("", "leader_", radius))
    labels = components(star.select(F.least("fp", "leader_fp").alias("a"), F.greatest("fp", "leader_fp").alias("b")).distinct())
    of = labels.select(F.col("node").alias("fp"), F.col("label").alias("own"))
    of_leader = labels.select(F.col("node").alias("leader"), F.col("label").alias("leading"))
    named = members.filter("n > 2").join(of, "fp", "left").join(of_leader, "leader", "left")
    named = named.select("key", "fp", F.coalesce("own", "fp").alias("own"), F.coalesce("leading", "leader").alias("leading"))
    rest = cut(named.join(named.filter("own <> leading").select("key").distinct(), "key", "left_semi")).select("*", *pivots_of("fp"))
    x, y = rest.filter("own <> leading").alias("x"), rest.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.own") != F.col("y.own")) & ((F.col("y.own") == F.col("y.leading")) | (F.col("x.fp") < F.col("y.fp")))
    tied = x.join(y, apart & near("x.", "y.", radius)).select(F.least("x.own", "y.own").alias("a"), F.greatest("x.own", "y.own").alias("b")).distinct()
    return merged(labels, tied)


def near_cells(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(cell, token, cls, n, pos) of sets (cls, n, fp) whose SimHashes are equal or tied together by links within the radius: these are one list, known by
    its token. Long lists are dealt into chunks, which are the cells. Every place is the first, which rules out no pair."""
    equal = classes.groupBy("fp").agg(F.count("*").alias("times")).filter("times > 1").select("fp", F.col("fp").alias("label"))
    tied = clusters(classes.select("fp").distinct(), radius).withColumnRenamed("node", "fp")
    listed = cut(classes.join(tied.union(equal.join(tied, "fp", "left_anti")), "fp").select(F.xxhash64("label", F.lit("near")).alias("token"), "cls", "n"))
    sizes = listed.groupBy("token").agg(chunks(F.count("*"), F.sum("n")).alias("chunks"))
    return listed.join(sizes, "token").select(F.xxhash64("token", chunk_of(F.col("chunks"))).alias("cell"), "token", "cls", "n", F.lit(0).alias("pos"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row (id, fp, component_id) for each row of docs.

    Copies share a fingerprint and are brought down to one row each before any pair is formed. NULL and empty texts
    and texts of white space have fingerprint 0, which links like any other. Rows with a NULL id take part and may
    connect others; a component without any id has a NULL component_id. Repeated rows each stay. Other columns are
    ignored, whatever their names; no rows give no rows.
    """
    rows = cut(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp")))
    distinct = cut(rows.groupBy("fp").agg(F.min("id").alias("least_id")))
    labels = clusters(distinct.select("fp"), radius)
    return grouped(rows, distinct, labels, "fp").select("id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Of each group of similar texts the row of smallest id; of several rows with that id in one group the one of least MD5 of
    its text, of rows equal in both any one. So an id that is repeated with texts of several groups may stay in each. Rows
    without an id, which no order sets against the others, may tie a group together, and one of them stays besides, that of least MD5.
    All columns are kept, whatever their names; no rows give no rows.

    Texts are similar by their sets of shingles, texts without words are one group. Sets whose SimHashes the tables of distances to
    pivots tie together are lists, of which each two end up in one group or are compared, exactly. At a similarity of 0.8 SimHashes differ by
    five to ten bits as a rule, where blocks of 64 bits find no candidates; so what the SimHashes miss is sought through the rarest shingles. There
    the fingerprints are wider ones, parities, whose distance is never more than that of the sets: tables of their distances to the pivots discard
    pairs by the largest difference of coordinates, what survives is compared as a whole, and then the sets are, exactly.
    """

    def free(name: str) -> str:
        while name in docs.columns:
            name += "_"
        return name

    own_id, own_digest, other_digest = free("kept_id"), free("kept_digest"), free("kept_other")
    found = linked(docs, id_col, text_col, width, percent, pivots=PIVOTS, near=lambda classes: near_cells(classes)).filter(F.col("id").isNull() | (F.col("id") == F.col("component_id")))
    least = found.groupBy("group", F.col("id").isNull()).agg(F.min(F.struct("id", "digest")).alias("kept"))
    kept = least.select(F.col("kept.id").alias(own_id), F.col("kept.digest").alias(other_digest)).distinct()
    digested = docs.withColumn(own_digest, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    named = digested.join(kept, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(own_digest) == F.col(other_digest)), "left_semi")
    return named.dropDuplicates([id_col, own_digest]).drop(own_digest)
