"""Repair of conversation structure: the cheapest edits, sought by A* on the lattice of edits, after a damage by rule."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: ASCII white space, all else is said.
BLANK = " \t\n\x0b\x0c\r"
#: Costs of the edits; a truncated row that stays is charged besides.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The roles that the grammar (s?(ua)+)? lets follow: by state, which is the initial of the last role ("" at the start).
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}
#: Rows and characters of a conversation that are held at a time.
BLOCK_ROWS, BLOCK_CHARS = 2048, 4_000_000
#: Fault of a row, the first that holds.
WHOLE, EMPTY, REPEATED, CUT = range(4)


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, dropped), NULLs of role and text read as one space.

    By crc32 of `conv_id:turn` (NULL again one space) modulo 20 a row is dropped (0, it stays here as a mark of its
    conversation), emptied (1), loses its sentence ends (2), is repeated (3) or becomes the user's (4).
    """

    def said(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat_ws(":", said(id_col), said(turn_col))), F.lit(20))
    text = F.when(kind <= 1, "").when(kind == 2, F.regexp_replace(said(text_col), "[.!?]", "")).otherwise(said(text_col))
    each = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    role = F.when(kind == 4, "user").otherwise(said(role_col))
    return rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), (kind == 0).alias("dropped"), each.alias("copy")).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds `fault`. What was said before is told by a window over equal rows of a conversation, never over all of it."""
    seen = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    told = F.rtrim(F.col("text"), F.lit(BLANK))
    fault = F.when(told == "", EMPTY).when(seen, REPEATED).when(~F.substring(told, -1, 1).isin(".", "!", "?"), CUT).otherwise(WHOLE)
    return rows.withColumn("fault", fault)


def moves(state: str, role: str, fault: int) -> list[tuple[int, str, str]]:
    """(cost, edit, next state) for a row with this role."""
    found = [(DELETE, "D", state)]
    if fault in (WHOLE, CUT):
        charge = TRUNCATED if fault == CUT else 0
        if role and role[0] in FOLLOWS[state]:
            found.append((charge, "K", role[0]))
        found.append((REROLE + charge, "R", FOLLOWS[state][-1]))
    return found


def least(rows: list[tuple[str, int]], entries: list[tuple[int, int, str, str]], last: bool) -> dict[str, tuple[int, int, str]]:
    """state -> (cost, entry, audit) of the cheapest edits of the rows (role, fault), of equal ones the ASCII-least, by A*.

    Entries are (cost so far, rank, tail of the audit, state). The queue is keyed by cost plus what the rows that are left
    charge at least (deletions of blank and repeated rows, truncated ones), then by audit. That estimate never drops by
    more than an edit costs, so that a node is settled when it first leaves the queue. With `last`, only the cheapest end of a
    whole conversation is sought, else all ends.
    """
    charge = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        charge[i] = charge[i + 1] + (0, DELETE, DELETE, TRUNCATED)[rows[i][1]]
    queue = [(cost + charge[0], rank, tail, 0, state, cost, k) for k, (cost, rank, tail, state) in enumerate(entries)]
    heapq.heapify(queue)
    settled, ends = set(), {}
    while queue:
        _, rank, audit, i, state, cost, entry = heapq.heappop(queue)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        if i == len(rows):
            if not last or state in ("", "a"):
                ends[state] = (cost, entry, audit)
                if last or len(ends) == len(FOLLOWS):
                    break
        else:
            for price, edit, after in moves(state, *rows[i]):
                if (i + 1, after) not in settled:
                    heapq.heappush(queue, (cost + price + charge[i + 1], rank, audit + edit, i + 1, after, cost + price, entry))
        if (i, FOLLOWS[state][-1]) not in settled:
            heapq.heappush(queue, (cost + INSERT + charge[i], rank, f"{audit}I", i, FOLLOWS[state][-1], cost + INSERT, entry))
    return ends


def applied(rows: list[tuple[str, str]], edits: str, state: str) -> Iterator[tuple[str, str]]:
    """The (role, text) that edits make of rows (role, text)."""
    at = 0
    for edit in edits:
        after = FOLLOWS[state][-1]
        if edit == "I":
            yield NAMES[after], ""
            state = after
            continue
        role, text = rows[at]
        at += 1
        if edit == "K":
            yield role, text
            state = role[0]
        elif edit == "R":
            yield NAMES[after], text
            state = after


class Way:
    """A cheapest way to a state after the rows so far: its cost and audit, and what it makes of the rows."""

    def __init__(self, state: str = "", cost: int = 0, audit: str = "", before: Way | None = None, texts: bool = False) -> None:
        self.state, self.cost, self.audit = state, cost, audit
        self.hash = before.hash.copy() if before else hashlib.sha256()
        self.some = before.some if before else False
        self.turns = [*before.turns] if before and texts else []

    def say(self, turns: Iterator[tuple[str, str]], texts: bool) -> Way:
        for role, text in turns:
            self.hash.update(f"{chr(10) * self.some}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.some = True
            if texts:
                self.turns.append({"role": role, "text": text})
        return self


def onward(ways: list[Way], rows: list[tuple[str, str, int]], last: bool, texts: bool = False) -> list[Way]:
    """The cheapest ways after some more rows (role, text, fault); with `last` the cheapest whole repair alone.

    Audits so far are compared once. They are ranks afterwards; of one that begins with another only the rest stays.
    """
    ways = sorted(ways, key=lambda w: w.audit)
    entries, rank = [], 0
    for k, way in enumerate(ways):
        if k == 0 or not way.audit.startswith(first):
            first, rank = way.audit, k
        entries.append((way.cost, rank, way.audit[len(first) :], way.state))
    found = []
    for state, (cost, entry, audit) in least([(role, fault) for role, _, fault in rows], entries, last).items():
        own = audit[len(entries[entry][2]) :]
        way = Way(state, cost, ways[entry].audit + own, ways[entry], texts)
        found.append(way.say(applied([(role, text) for role, text, _ in rows], own, ways[entry].state), texts))
    return found


class Conversation:
    """One conversation while its rows go by in order; of a long one a block at a time is held, and up to four ways."""

    def __init__(self, conv_id: object, texts: bool) -> None:
        self.conv_id, self.texts = conv_id, texts
        self.ways, self.rows, self.chars = [Way()], [], 0
        self.turns: list[int] = []  # the least and the largest
        self.distinct, self.role, self.counts = 0, None, [0, 0, 0, 0]
        self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None:
            self.distinct += not self.turns or turn != self.turns[1]
            self.turns = [self.turns[0] if self.turns else turn, turn]
        self.illegal += self.role is not None and self.role + role[:1] not in ("su", "ua", "au")
        self.role = role[:1]
        self.counts[fault] += 1
        if len(self.rows) >= BLOCK_ROWS or self.chars + len(text) > BLOCK_CHARS:
            self.ways, self.rows, self.chars = onward(self.ways, self.rows, False, self.texts), [], 0
        self.rows.append((role, text, fault))
        self.chars += len(text)

    def report(self) -> dict:
        [way] = onward(self.ways, self.rows, True, self.texts)
        gaps = self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        found = {"conv_id": self.conv_id, "gaps": gaps, "blank": self.counts[EMPTY], "duplicate": self.counts[REPEATED], "truncated": self.counts[CUT], "illegal": self.illegal}
        found |= {"cost": way.cost, "audit": way.audit, "repaired_sha256": way.hash.hexdigest()}
        return found | ({"repaired": way.turns} if self.texts else {})


def repair(rows: DataFrame, texts: bool = False) -> DataFrame:
    """One row for each conv_id of rows (conv_id, turn, role, text, and dropped where there is such a column): its faults, the
    cheapest edits that give roles (s?(ua)+)?, and the SHA-256 of what they make; with `texts` that itself, as `repaired`.

    Rows stand in the order of turn, NULLs first, then role and text. A NULL conv_id is a conversation too. NULL roles and
    texts are read as one space. Repeated rows are duplicates. Roles are told by their first letter. A conversation with
    dropped rows only has zeros, an empty audit and the hash of nothing; no rows give no rows. Other columns are ignored.
    Conversations stream through their tasks sorted: any length takes a block of rows, whose texts may be as long as one
    row's, and the audits so far (with `texts` also the conversation, which is a cell of the result).
    """
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), dropped.alias("dropped"))
    ordered = with_faults(plain).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == REPEATED)
    counts = [StructField(name, LongType()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    schema = StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *counts, StructField("audit", StringType()), StructField("repaired_sha256", StringType())])
    if texts:
        schema.add("repaired", ArrayType(StructType([StructField("role", StringType()), StructField("text", StringType())])))
    form = to_arrow_schema(schema)

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for conv_id, turn, role, text, gone, fault in zip(*[batch.column(name).to_pylist() for name in ("conv_id", "turn", "role", "text", "dropped", "fault")]):
                if now is None or now.conv_id != conv_id:
                    done += [now.report()] if now else []
                    now = Conversation(conv_id, texts)
                if not gone:
                    now.add(turn, role, text, fault)
                if len(done) >= 1000:
                    yield pa.RecordBatch.from_pylist(done, form)
                    done = []
        yield pa.RecordBatch.from_pylist(done + ([now.report()] if now else []), form)

    return ordered.mapInArrow(repaired, schema)
