"""Links of texts by the Jaccard similarity of their shingle sets: T-occurrence search over inverted lists, with DivideSkip."""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import cut, small_batches, written
from .components import components, grouped, merged
from .fingerprint import SEED, simhash_of

WIDTH, PERCENT = 3, 90
#: Counters of shingles, which fix the order of all shingles, the rare ones first; the rows in which they are summed up.
COUNTERS, SLICES = 1 << 20, 64
#: Bits of a set's parities; of larger sets there is a wider field besides, of two to four bits for each shingle.
BITS = 1024
#: A cell with so many times more promising pairs than members is searched as it is; in others each pair is, in one cell only.
DENSE = 8
#: Classes whose texts, and rows of cells whose wide fields, are fetched by a broadcast of their ids, 60 bytes each; more are fetched by a shuffle of the
#: texts or fields.
FEW = 200_000
#: Bits by which shingles of several prefixes are known before they are shuffled: 8 MB.
MARKS = 1 << 26
#: Members of a cell, and shingles of them, about: what one task holds at a time.
CELL, CELL_SHINGLES = 2048, 1 << 22
#: Sizes of sets are dealt into groups, each from SPAN times the beginning of the one before, where sets that link are at least so similar in
#: percent; below, a set would stand in two groups and more as a rule.
SPAN, GROUPED = 1.25, 88
#: DivideSkip's weight of a probe of a long list against a step of the merge of the short ones.
PROBE = 0.0085


#: Rows that a task takes from Spark at a time, each with a text or a set.
BATCH = 500
#: Hashes of words that a task keeps, and what the places in a shingle multiply them by.
WORDS = 1 << 16
PLACES = np.random.default_rng(SEED).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Hashes(dict):
    """The XXH64 of each word that is asked for, as long as there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


HASHES = Hashes()


def shingles(text: str | None, width: int) -> np.ndarray:
    """The text's set of shingles, sorted: 64 bits for each run of `width` words, mixed from the words' hashes; a shorter text is one
    run, one without words has none. A-Z are lowered, words are runs of anything but ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    runs, used = max(1, len(words) - width + 1), min(width, len(words))
    mixed = np.full(runs, used, np.uint64)
    for k in range(used):
        mixed += each[k : k + runs] * PLACES[k % len(PLACES)] ^ np.uint64(k)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    mixed.sort()
    return mixed[np.append(True, mixed[1:] != mixed[:-1])]


def needed(sizes: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least intersection of two sets that link, by the sum of their sizes."""
    return -(-percent * sizes // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """Two sets that link share one of the first so many shingles of each, in any one order of all shingles."""
    return n - -(-percent * n // 100) + 1


def counts_of(texts: DataFrame, width: int, counters: int = COUNTERS) -> np.ndarray:
    """How often shingles of each remainder modulo the counters occur in all texts: each partition sums up its own, slices of the
    sums are added on the way. Of a fixed size however many rows there are."""
    each = counters // SLICES

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some, held = np.zeros(counters, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                some.append(shingles(text, width))
                held += len(some[-1])
                if held >= counters:
                    total += np.bincount((np.concatenate(some) % np.uint64(counters)).astype(np.int64), minlength=counters)
                    some, held = [], 0
        if some:
            total += np.bincount((np.concatenate(some) % np.uint64(counters)).astype(np.int64), minlength=counters)
        if total.any():
            parts = [np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in total.reshape(SLICES, each)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(x, np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in total.values()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    sums = texts.mapInArrow(local, schema).repartition("slice").mapInArrow(added, schema).collect()
    out = np.zeros((SLICES, each), np.uint32)
    for row in sums:
        out[row["slice"]] = np.frombuffer(row["counts"], np.uint32)
    return out.ravel()


def parities(shingles: np.ndarray, bits: int = BITS) -> bytes:
    """For each remainder modulo the bits whether an odd number of shingles has it: two sets differ in as many bits at most as in
    shingles. The halves of a field, one upon the other, are the field of half as many bits."""
    odd = np.bincount((shingles >> np.uint64(32)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_bits(n: int) -> int:
    return max(BITS, 1 << (2 * n - 1).bit_length())


def field(shingles: np.ndarray) -> bytes:
    return parities(shingles, wide_bits(len(shingles)))


def folded(given: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of fields, by doublings of BITS: the numbers of those that have so many bits or more, and these, folded."""
    level = np.array([(len(x) * 64 // BITS).bit_length() - 1 for x in given], int)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(int(level.max(initial=-1)), -1, -1):
        at = np.flatnonzero(level == k)
        bits = np.stack([given[i] for i in at]) if len(at) else np.zeros((0, BITS << k >> 6), np.uint64)
        if out:
            more, wider = out[-1]
            at, bits = np.concatenate([at, more]), np.concatenate([bits, wider[:, : BITS << k >> 6] ^ wider[:, BITS << k >> 6 :]])
        out.append((at, bits))
    return out[::-1]


class Fields:
    """Parities of some sets, compared by the wider field that both of a pair have."""

    def __init__(self, given: list[bytes]) -> None:
        arrays = [np.frombuffer(x, np.uint64) for x in given]
        self.level = np.array([(len(x) * 64 // BITS).bit_length() - 1 for x in arrays], int)
        self.place, self.bits = [], []
        for at, bits in folded(arrays):
            place = np.full(len(given), -1)
            place[at] = np.arange(len(at))
            self.place.append(place)
            self.bits.append(bits)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The bits in which the sets a and b differ, no more than their shingles."""
        both, out = np.minimum(self.level[a], self.level[b]), np.zeros(len(a), np.int64)
        for k, (place, bits) in enumerate(zip(self.place, self.bits)):
            at = np.flatnonzero(both == k)
            for some in np.array_split(at, len(at) * bits.shape[1] // (1 << 20) + 1) if len(at) else ():
                out[some] = np.bitwise_count(bits[place[a[some]]] ^ bits[place[b[some]]]).sum(axis=1, dtype=np.int64)
        return out


def sets_of(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, simhashes: bool = False) -> DataFrame:
    """(id, digest, n, cls, parity, wide, prefix) of each row: the size of its set, 128 bits that tell the set from others, its parities
    and its rarest shingles; without the last three where equal sets alone can link. With simhashes, the set's SimHash as fp besides."""
    text = F.col(text_col)
    counts = docs.sparkSession.sparkContext.broadcast(counts_of(docs.select(text), width))
    plain = docs.select(F.col(id_col).alias("id"), digest(text).alias("digest"), text.alias("text"))
    schema = StructType([plain.schema["id"], plain.schema["digest"]]).add("n", "long").add("cls", "binary").add("parity", "binary").add("wide", "binary").add("prefix", ArrayType(LongType()))
    schema = schema.add("fp", "long") if simhashes else schema
    form = to_arrow_schema(schema)

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls, parity, wide, prefix, fp = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                x = shingles(text, width)
                n.append(len(x))
                cls.append(xxhash.xxh3_128_digest(x.tobytes(), SEED))
                first = prefix_length(len(x), percent)
                alone = len(x) * 100 < percent * (len(x) + 1)  # not even one shingle more may be there
                if not alone:
                    count = counts.value[(x % np.uint64(len(counts.value))).astype(np.int64)]
                    rare = np.argpartition(count, first)[: first + 1] if first + 1 < len(x) else np.arange(len(x))
                    rare = np.flatnonzero(count <= count[rare].max())
                    prefix.append(x[rare[np.lexsort((x[rare], count[rare]))][:first]].view(np.int64))
                parity.append(None if alone else parities(x))
                wide.append(field(x) if not alone and wide_bits(len(x)) > BITS else None)
                if alone:
                    prefix.append(None)
                if simhashes:
                    fp.append(simhash_of(x))
            columns = [batch.column("id"), batch.column("digest"), n, cls, parity, wide, prefix, *([np.array(fp, np.uint64).view(np.int64)] if simhashes else ())]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, form)], schema=form)

    return plain.mapInArrow(shingled, schema)


def digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def bitmap_of(tokens: DataFrame, bits: int = MARKS) -> np.ndarray:
    """One bit for each remainder of the tokens modulo the bits; partitions mark their own, slices of which are put together on the way.
    Of a fixed size however many tokens there are; a partition's slices, of which few bits are set, are written compressed."""
    each = bits // SLICES // 8

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) % np.uint64(bits)
            np.bitwise_or.at(marks, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        some = [k for k in range(SLICES) if marks[k * each : (k + 1) * each].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([zlib.compress(marks[k * each : (k + 1) * each].tobytes(), 1) for k in some], pa.binary())], ["slice", "marks"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole[k] = whole.get(k, 0) | np.frombuffer(zlib.decompress(x), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(whole, pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in whole.values()], pa.binary())], ["slice", "marks"])

    schema = "slice int, marks binary"
    out = np.zeros((SLICES, each), np.uint8)
    for row in tokens.mapInArrow(local, schema).repartition("slice").mapInArrow(joined, schema).collect():
        out[row["slice"]] = np.frombuffer(zlib.decompress(row["marks"]), np.uint8)
    return out.ravel()


def group_edges(most: int = 1 << 40) -> np.ndarray:
    edges = [1]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, int(edges[-1] * SPAN)))
    return np.array(edges)


EDGES = group_edges()


def keyed(prefix: pa.ListArray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of prefixes of sets of so many shingles, a row for each token and group of sizes: the number of the set, the token's place, the key of both, whether
    the group is the set's own. A set stands in the groups of all smaller ones that it can link with, so that two that link share the own group
    of the smaller one."""
    tokens, lengths = prefix.flatten().to_numpy(zero_copy_only=False), prefix.value_lengths().to_numpy(zero_copy_only=False)
    own = np.repeat(np.arange(len(n)), lengths)
    pos = np.arange(len(own)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    if percent < GROUPED:
        return own, pos, tokens, np.ones(len(own), bool)
    first, last = (np.searchsorted(EDGES, x, "right") for x in (-(-percent * n // 100), n))
    times = (last - first + 1)[own]
    row = np.repeat(np.arange(len(own)), times)
    group = first[own[row]] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    key = (tokens[row].view(np.uint64) ^ group.astype(np.uint64) * PLACES[0]) * PLACES[1]
    key ^= key >> np.uint64(32)
    return own[row], pos[row], key.view(np.int64), group == last[own[row]]


def shared_postings(classes: DataFrame, percent: int) -> DataFrame:
    """(token, cls, n, pos, members, weight): the inverted lists of the prefixes by groups of sizes, as far as at least two classes stand in them, one
    in its own group; lists of two, which most are, only if sizes and places let these two link.

    Most keys of a prefix stand in one class alone. Those that do not are found by counts, and a map of bits of them cuts the
    prefixes down before they are shuffled; where bits are shared by chance, the counts of the lists tell. Without groups, classes of
    all sizes that share a shingle by chance would fill the lists, ever more of them to a class the more texts there are.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(keyed(batch.column("prefix"), batch.column("n").to_numpy(), percent)[2])], ["token"])

    counted = classes.select("n", "prefix").mapInArrow(keys, "token long").groupBy("token").agg(F.count("*").alias("times"))
    known = classes.sparkSession.sparkContext.broadcast(bitmap_of(counted.filter("times > 1").select("token")))

    def cut_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = known.value
        for batch in batches:
            own, pos, tokens, home = keyed(batch.column("prefix"), batch.column("n").to_numpy(), percent)
            at = tokens.view(np.uint64) % np.uint64(len(marks) * 8)
            kept = np.flatnonzero(marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
            own = pa.array(own[kept])
            yield pa.RecordBatch.from_arrays([batch.column("cls").take(own), batch.column("n").take(own), pa.array(pos[kept].astype(np.int32)), pa.array(tokens[kept]), pa.array(home[kept])], ["cls", "n", "pos", "token", "home"])

    postings = cut(classes.select("cls", "n", "prefix").mapInArrow(cut_down, "cls binary, n long, pos int, token long, home boolean"))
    lists = postings.groupBy("token").agg(F.count("*").alias("members"), F.sum("n").alias("weight"), F.max("n").alias("most"), F.min(F.col("n") - F.col("pos")).alias("rest"), F.max("home").alias("home"))
    able = (100 * (F.col("weight") - F.col("most")) >= percent * F.col("most")) & ((100 + percent) * F.col("rest") >= percent * F.col("weight"))
    lists = lists.filter(F.col("home") & ((F.col("members") > 2) | ((F.col("members") == 2) & able)))
    return postings.drop("home").join(lists.select("token", "members", "weight"), "token")


def chunks(members: Column, weight: Column) -> Column:
    return F.greatest(F.ceil(members / CELL), F.ceil(weight / CELL_SHINGLES)).cast("int")


def chunk_of(chunks: Column) -> Column:
    return F.pmod(F.xxhash64("cls", F.lit(SEED)), chunks).cast("int")


def first_cells(postings: DataFrame) -> DataFrame:
    """(cell, cls, pos): each class in its rarest shared list and in its longest one, long lists in chunks that stand alone."""
    best = postings.groupBy("cls").agg(F.min(F.struct("pos", "token", "members", "weight")).alias("rare"), F.max(F.struct("members", "token", "pos", "weight")).alias("long"))
    each = F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"{k}.{c}") for c in ("token", "pos", "members", "weight")]) for k in ("rare", "long")])))
    chosen = best.select("cls", each.alias("l")).select("cls", "l.*")
    return chosen.select(F.xxhash64("token", chunk_of(chunks(F.col("members"), F.col("weight")))).alias("cell"), "cls", "pos")


def crossing_cells(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """(cell, cls, pos, label) so that each two classes of a list that are not in one component meet in a cell.

    Most of a long list is in the component of its leader as a rule. The others are dealt into chunks, each of which meets each
    chunk of them and each of the leader's component; that component's own members never meet for their own sake.
    """
    named = postings.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    lead = F.min(F.struct(F.xxhash64("cls", "token").alias("hash"), "label"))["label"].alias("lead")
    mixed = named.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most"), lead).filter("least <> most").select("token", "lead")
    named = cut(named.join(mixed, "token").withColumn("apart", F.col("label") != F.col("lead")))
    sums = [f(F.col("apart") == side) for f, side in ((F.count_if, True), (F.count_if, False))]
    weights = [F.sum(F.when(F.col("apart") == side, F.col("n")).otherwise(0)) for side in (True, False)]
    sizes = named.groupBy("token").agg(chunks(sums[0], weights[0]).alias("xs"), chunks(sums[1], weights[1]).alias("ys"), (chunks(sums[0] + sums[1], weights[0] + weights[1]) == 1).alias("one"))
    rows = named.join(sizes, "token")
    x, y = chunk_of(F.col("xs")), chunk_of(F.col("ys"))

    def pair(kind: str, i: Column, j: Column) -> Column:
        return F.xxhash64("token", F.lit(kind), i, j)

    others = F.transform(F.sequence(F.lit(0), F.col("xs") - 1), lambda k: pair("apart", F.least(k, x), F.greatest(k, x)))
    led = F.transform(F.sequence(F.lit(0), F.col("ys") - 1), lambda k: pair("led", x, k))
    mine = F.transform(F.sequence(F.lit(0), F.col("xs") - 1), lambda k: pair("led", k, y))
    cells = F.when(F.col("one"), F.array(pair("one", F.lit(0), F.lit(0)))).when(F.col("apart"), F.concat(others, led)).otherwise(mine)
    return rows.select(F.explode(cells).alias("cell"), "cls", "pos", "label")


def by_cell(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("cell").sortWithinPartitions("cell", *order)


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole cells from batches that are sorted by cell."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column("cell").to_numpy()
        last = int(np.searchsorted(cells, cells[-1]))
        if last:
            yield pa.Table.from_batches([*kept, batch.slice(0, last)])
            kept = []
        elif kept and kept[-1].column("cell")[0].as_py() != cells[0]:
            yield pa.Table.from_batches(kept)
            kept = []
        kept.append(batch.slice(last))
    if kept:
        yield pa.Table.from_batches(kept)


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values as equal numbers."""
    return np.unique(np.array(column.to_pylist(), object).astype("S16"), return_inverse=True)[1]


def likely(table: pa.Table, percent: int, fixed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (cell, n, pos, label, field), sorted by cell and size, of one cell and two labels that are not ruled out: by sizes, by
    places in the lists, by the distances of the fields to fixed ones, by the fields. None of these rules out a pair that links
    at its first common shingle."""
    cell, n, pos = (table.column(c).to_numpy() for c in ("cell", "n", "pos"))
    given = table.column("field").to_pylist()
    parity, label = Fields(given), numbers(table.column("label"))
    to_fixed = None
    if len(fixed):
        narrow = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, BITS // 64), axis=0) for x in given])
        to_fixed = np.stack([np.bitwise_count(narrow ^ p).sum(axis=1, dtype=np.int16) for p in fixed], axis=1)
    rows, step = np.arange(len(cell)), 0
    while len(rows):
        step += 1
        rows = rows[rows + step < len(cell)]
        rows = rows[(cell[rows] == cell[rows + step]) & (100 * n[rows] >= percent * n[rows + step])]
        a, b = rows, rows + step
        sizes = n[a] + n[b]
        least = needed(sizes, percent)
        able = (label[a] != label[b]) & (pos[a] <= n[a] - least) & (pos[b] <= n[b] - least)
        a, b, most = a[able], b[able], (sizes - 2 * least)[able]
        if to_fixed is not None and len(a):
            able = np.abs(to_fixed[a] - to_fixed[b]).max(axis=1) <= most
            a, b, most = a[able], b[able], most[able]
        near = parity.apart(a, b) <= most
        if near.any():
            yield a[near], b[near]


def promising(cells: DataFrame, classes: DataFrame, percent: int, pivots: int = 0) -> DataFrame:
    """(cell, cls), no row twice, from (cell, cls, pos, label): cells in which the classes are to be searched, so that all pairs that are
    not ruled out meet.

    Narrow fields come first; the wide ones are fetched for what they leave. A pair that many cells hold is searched in one, the
    least, but where a cell holds many pairs for its members they are all searched there.
    """
    fixed = np.random.default_rng(SEED).integers(0, 2**64, (pivots, BITS // 64), dtype=np.uint64)
    form = to_arrow_schema(StructType([cells.schema[c] for c in ("cell", "cls", "pos", "label")]))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches):
            good = np.zeros(table.num_rows, bool)
            for a, b in likely(table, percent, fixed):
                good[a] = good[b] = True
            if good.any():
                yield from table.filter(pa.array(good)).select(form.names).cast(form).combine_chunks().to_batches()

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches):
            found = list(likely(table, percent, fixed))
            if not found:
                continue
            a, b = (np.concatenate([p[side] for p in found]) for side in (0, 1))
            cell, cls = table.column("cell").to_numpy(), np.array(table.column("cls").to_pylist(), object)
            own, first, members = np.unique(cell, return_index=True, return_counts=True)
            dense = (np.bincount(np.searchsorted(own, cell[a]), minlength=len(own)) > DENSE * members)[np.searchsorted(own, cell)]
            whole = np.unique(np.concatenate([a[dense[a]], b[dense[a]]]))
            swap = cls[a] > cls[b]
            a, b = np.where(swap, b, a)[~dense[a]], np.where(swap, a, b)[~dense[a]]
            columns = [np.concatenate([cls[a], cls[whole]]), np.concatenate([cls[b], np.full(len(whole), None, object)]), np.concatenate([cell[a], cell[whole]])]
            yield pa.RecordBatch.from_arrays([pa.array(c.tolist(), t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64()))], ["a", "b", "cell"])

    narrow = cells.join(classes.select("cls", "n", F.col("parity").alias("field")), "cls")
    first = written(by_cell(narrow, "n").mapInArrow(sift, StructType([cells.schema[c] for c in form.names])))
    left = F.broadcast(first) if first.count() <= FEW else first
    wide = left.join(classes.select("cls", "n", F.coalesce("wide", "parity").alias("field")), "cls")
    pairs = by_cell(wide, "n").mapInArrow(pair, "a binary, b binary, cell long")
    chosen = pairs.groupBy("a", "b", F.when(F.col("b").isNull(), F.col("cell")).alias("own")).agg(F.min("cell").alias("cell"))
    return chosen.select("cell", F.explode(F.array_compact(F.array("a", "b"))).alias("cls")).distinct()


class Lists:
    """The inverted lists of a cell's sets, members numbered by rising size, all lists in one sorted array of keys."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.members = len(sets)
        tokens, own = np.unique(np.concatenate(sets), return_inverse=True)
        self.tokens = np.split(own.astype(np.int64), np.cumsum([len(s) for s in sets])[:-1])
        self.keys = np.sort(own.astype(np.int64) * self.members + np.repeat(np.arange(self.members), [len(s) for s in sets]))

    def of(self, member: int, wanted: np.ndarray) -> list[np.ndarray]:
        """For each shingle of the member the wanted members (sorted) that have it."""
        base = self.tokens[member] * self.members
        start, stop = np.searchsorted(self.keys, base + wanted[0]), np.searchsorted(self.keys, base + wanted[-1], "right")
        if len(wanted) * 8 < (stop - start).mean():
            return [wanted[self.holds(self.tokens[member][i], wanted)] for i in range(len(base))]
        flag = np.zeros(self.members, bool)
        flag[wanted] = True
        found = [self.keys[a:b] - c for a, b, c in zip(start.tolist(), stop.tolist(), base.tolist())]
        return [x[flag[x]] for x in found]

    def holds(self, token: int | np.ndarray, member: int | np.ndarray) -> np.ndarray:
        key = token * self.members + member
        return self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key


def merge_skip(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """(value, number of lists) of the values in at least so many of the sorted lists: a heap of the lists' heads; where a head is in
    too few, so many heads that the rest could not make it leave together, and jump to the next head."""
    heap = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    found = []
    while len(heap) >= least:
        value, gone = heap[0][0], []
        while heap and heap[0][0] == value:
            gone.append(heapq.heappop(heap))
        if len(gone) >= least:
            found.append((value, len(gone)))
            target = value + 1
        else:
            while heap and len(gone) < least - 1:
                gone.append(heapq.heappop(heap))
            target = heap[0][0] if heap else None
        if target is None:
            break
        for _, i, at in gone:
            at = bisect_left(lists[i], target, at)
            if at < len(lists[i]):
                heapq.heappush(heap, (lists[i][at], i, at))
    return found


def occurring(lists: Lists, member: int, wanted: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(other, intersection) of the wanted members with at least `least` shingles of this one's, by DivideSkip: the longest lists are
    set apart, the short ones merged for so many occurrences fewer, and what that finds probed in the long ones."""
    own = lists.of(member, wanted)
    order = sorted(range(len(own)), key=lambda i: len(own[i]))
    longest = len(own[order[-1]])
    apart = min(least - 1, int(least / (PROBE * np.log2(max(2, longest)) + 1)))
    short, long = order[: len(order) - apart], lists.tokens[member][order[len(order) - apart :]]
    found = []
    for other, times in merge_skip([own[i].tolist() for i in short], least - apart):
        times += int(lists.holds(long, other).sum()) if apart else 0
        if times >= least:
            found.append((other, times))
    return found


def cell_links(sets: list[np.ndarray], parity: Fields, labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of numbers (of sets of rising size) that link and tie components together, as few as tie all that links in the cell.

    A member searches smaller ones of other components, first the nearest by parities of each component, then twice as many.
    """
    lists, n, comp, out = Lists(sets), np.array([len(s) for s in sets]), labels.copy(), []
    for member in range(1, len(sets)):
        low = int(np.searchsorted(n, -(-percent * n[member] // 100)))
        others = np.arange(low, member)
        others = others[comp[others] != comp[member]]
        if not len(others):
            continue
        apart = parity.apart(others, np.full(len(others), member))
        sizes = n[others] + n[member]
        near = apart <= sizes - 2 * needed(sizes, percent)
        others, apart = others[near], apart[near]
        room = 1
        while len(others):
            order = np.lexsort((apart, comp[others]))
            group = comp[others[order]]
            place = np.arange(len(order)) - np.searchsorted(group, group)
            tested = np.zeros(len(others), bool)
            tested[order[place < room]] = True
            for other, common in occurring(lists, member, others[tested], int(needed(n[member] + n[low], percent))):
                if common >= needed(n[member] + n[other], percent) and comp[other] != comp[member]:
                    out.append((other, member))
                    comp[comp == comp[other]] = comp[member]
            left = ~tested & (comp[others] != comp[member])
            others, apart, room = others[left], apart[left], 2 * room
    return out


def found_links(survivors: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of classes that link and tie components together, from (cell, cls), (node, label) and (cls, shingles)."""
    named = survivors.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    full = by_cell(named.join(sets, "cls").select("cell", "cls", F.length("shingles").alias("n"), "label", "shingles"), "n", "cls")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches):
            ends = np.flatnonzero(np.diff(table.column("cell").to_numpy())) + 1
            for a, b in zip([0, *ends.tolist()], [*ends.tolist(), table.num_rows]):
                rows = table.slice(a, b - a)
                cls = rows.column("cls").to_pylist()
                sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
                if found := cell_links(sets, Fields([field(x) for x in sets]), numbers(rows.column("label")), percent):
                    yield pa.RecordBatch.from_arrays([pa.array([cls[p[k]] for p in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    return full.mapInArrow(searched, "a binary, b binary").distinct()


def shingles_of(docs: DataFrame, wanted: DataFrame, classes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(cls, shingles) of the wanted classes, made again from one text of each."""
    one = written(classes.join(wanted.select("cls").distinct(), "cls", "left_semi").select("cls", F.col("one.id").alias("one_id"), F.col("one.digest").alias("one_digest")))
    if one.count() <= FEW:
        one = F.broadcast(one)
    texts = docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))
    found = texts.join(one, F.col("id").eqNullSafe(F.col("one_id")) & (F.col("digest") == F.col("one_digest"))).select("cls", "text").dropDuplicates(["cls"])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text, width).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(sets, pa.binary())], ["cls", "shingles"])

    return found.mapInArrow(shingled, "cls binary, shingles binary")


def linked(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, pivots: int = 0, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row (id, digest, n, cls, component_id, group) for each row of docs: the group is the same for all that links tie together,
    which the least id alone would not tell where ids are repeated. Rows without shingles are one group here.

    near, if given, makes (cell, token, cls, n, pos) from (cls, n, fp), the SimHashes of classes: more lists, whose cells are searched in the first
    round and which, as the others, are gone through in the second, so that each two classes of one end up tied or compared.
    """
    with small_batches(docs.sparkSession, BATCH):
        rows = written(sets_of(docs, id_col, text_col, width, percent, near is not None))
        first = [F.first(c).alias(c) for c in ("n", "parity", "wide", "prefix", *(["fp"] if near else ()))]
        distinct = cut(rows.groupBy("cls").agg(F.min("id").alias("least_id"), F.min(F.struct("id", "digest")).alias("one"), *first))
        classes = distinct.filter("prefix IS NOT NULL")
        postings = cut(shared_postings(classes, percent))

        def links(cells: DataFrame, labels: DataFrame) -> DataFrame:
            survivors = written(promising(cells, classes, percent, pivots))
            return cut(found_links(survivors, labels, shingles_of(docs, survivors, classes, id_col, text_col, width), percent))

        cells, lists = first_cells(postings), [postings]
        if near:
            lists.append(cut(near(classes.select("cls", "n", "fp"))))
            cells = cells.unionByName(lists[1].select("cell", "cls", "pos"))
        labels = components(links(cells.withColumn("label", F.col("cls")), classes.select(F.col("cls").alias("node"), F.col("cls").alias("label")).limit(0)))
        ties = links(reduce(DataFrame.unionByName, [crossing_cells(x, labels) for x in lists]), labels)
        of = labels.withColumnRenamed("label", "own")
        named = ties.join(of.withColumnRenamed("node", "a").withColumnRenamed("own", "c"), "a", "left").join(of.withColumnRenamed("node", "b").withColumnRenamed("own", "d"), "b", "left")
        named = named.select(F.coalesce("c", "a").alias("a"), F.coalesce("d", "b").alias("b"))
        labels = merged(labels, named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return grouped(rows.select("id", "digest", "n", "cls"), distinct.select("cls", "least_id"), labels, "cls")


def similarity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row (id, n_shingles, component_id) for each row of docs; two link when 100 * intersection >= percent * union of their sets of
    shingles, and component_id is the least id that links reach, the row's own included.

    Shingles are told apart by 64 bits of hash. Equal sets are one class. Classes meet in the inverted lists of the rarest tenth of
    their shingles; every such list with two classes or more is a cell, or several where it is long. First each class is searched
    in two cells, and what links becomes components; then all cells that hold more than one component are. A cell is sifted by sizes,
    places and parities, sets are fetched for what remains and searched by DivideSkip.
    NULL and empty texts and texts of white space have no shingles and link with nothing; nor do rows without an id lose their place:
    they may tie others together, and a component without any id has a NULL component_id. Repeated rows each stay, texts of any
    length count whole, other columns are ignored, no rows give no rows.
    """
    found = linked(docs, id_col, text_col, width, percent)
    return found.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
