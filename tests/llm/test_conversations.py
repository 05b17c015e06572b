"""Repairs against all edit sequences, in blocks, on NULLs and ties, and against the SQL of the same."""

import hashlib
import zlib
from itertools import product

import duckdb
import numpy as np
import pytest

from quizloom.llm import conversations as C
from quizloom.llm.queries import ORACLE_SQL, op13_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, id string, fault int, dropped_ string, audit string"


def all_repairs(rows):
    """(cost, audit, turns) of the cheapest edits by plain dynamic programming over rows and states, all ties compared."""
    ways = {"": (0, "", ())}

    def inserted(ways):
        out = dict(ways)
        for _ in range(3):
            for state, (cost, audit, turns) in list(out.items()):
                after = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
                way = (cost + 2, audit + "I", (*turns, ({"u": "user", "a": "assistant"}[after], "")))
                out[after] = min(out.get(after, way), way)
        return out

    for role, text, fault in rows:
        onward = {}
        for state, (cost, audit, turns) in inserted(ways).items():
            options = [(state, 3, "D", ())]
            if fault in (0, 3):
                late = int(fault == 3)
                if role[:1] in {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}[state]:
                    options.append((role[:1], late, "K", ((role, text),)))
                after = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
                options.append((after, 2 + late, "R", (({"u": "user", "a": "assistant"}[after], text),)))
            for after, price, edit, said in options:
                way = (cost + price, audit + edit, (*turns, *said))
                onward[after] = min(onward.get(after, way), way)
        ways = onward
    ways = inserted(ways)
    return min(ways[s] for s in ("", "a") if s in ways)


def plain(rows):
    """The contract's columns of one conversation by its rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faulty, counts = set(), [], [0] * 4
    for _, role, text in rows:
        told = text.rstrip(" \t\n\x0b\x0c\r")
        fault = 1 if not told else 2 if (role, text) in seen else 0 if told[-1] in ".!?" else 3
        seen.add((role, text))
        counts[fault] += 1
        faulty.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, said = all_repairs(faulty)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, counts[1], counts[2], counts[3], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text, kept = role if role is not None else " ", text if text is not None else " ", out.setdefault(conv, [])
        if kind == 1:
            text = ""
        elif kind == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        elif kind == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def got(frame):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[n] for n in names) for r in frame.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "su"]
    texts = ["Yes.", "no", "Why?", "", " \t", None, "Stop!  \n", "a b", "x."]
    out = [(None, 0, "user", "Alone."), (None, None, "assistant", "No id."), (1000, None, "user", "Two."), (1000, None, "user", "Two."), (1001, 5, None, None)]
    for conv in range(300):
        out += [(conv, None if rng.random() < 0.05 else int(t), roles[rng.integers(len(roles))], texts[rng.integers(len(texts))]) for t in rng.integers(0, 12, rng.integers(1, 9))]
    return out + [(2000 + k, t, role, "Fine.") for k, said in enumerate(("u", "a", "s", "uu", "ss", "aa")) for t, role in enumerate({"u": "user", "a": "assistant", "s": "system"}[c] for c in said)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("conversations"))
    spark.createDataFrame([(*r, "x", 9, "y", "z") for r in rows], SCHEMA).repartition(5).write.parquet(f"{path}/conversations.parquet")
    return path


def test_contract_on_odd_conversations(spark, rows, folder):
    assert got(op13_conversation_repair(spark, folder)) == {conv: plain(kept) for conv, kept in damaged(rows).items()}


def test_sql(spark, rows, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet/*.parquet')")
    found = con.execute(ORACLE_SQL["op13_conversation_repair"]).fetchall()
    assert {r[0]: r[1:] for r in found} == {conv: plain(kept) for conv, kept in damaged(rows).items()}


@pytest.mark.parametrize("block", [1, 2, 5])
def test_blocks_of_long_conversations(spark, rows, folder, monkeypatch, block):
    rng = np.random.default_rng(block)
    for n in (0, 1, 7, 60, 200):
        said = [(("user", "assistant", "system", "x")[rng.choice(4, p=(0.5, 0.3, 0.1, 0.1))], f"t{i}", int(rng.choice(4, p=(0.6, 0.1, 0.1, 0.2)))) for i in range(n)]
        ways = [C.Way()]
        for at in range(0, n, block):
            ways = C.onward(ways, said[at : at + block], False, True)
        [way] = C.onward(ways, [], True, True)
        assert (way.cost, way.audit, tuple((t["role"], t["text"]) for t in way.turns)) == all_repairs(said)


def test_all_edit_sequences():
    """Every sequence of edits of short conversations, not by states."""
    for said in product(("user", "assistant", "system"), repeat=3):
        rows = [(role, f"{i}", 3 * (i == 1)) for i, role in enumerate(said)]
        found = []
        for edits in {e for n in range(3, 7) for e in product("DIKR", repeat=n) if sum(x != "I" for x in e) == 3}:
            state, cost, at, fits = "", 0, 0, True
            for edit in edits:
                role = rows[at][0][0] if edit != "I" else ""
                cost += {"I": 2, "D": 3, "K": 0, "R": 2}[edit] + (edit in "KR" and rows[at][2] == 3)
                if edit == "K":
                    fits &= role in C.FOLLOWS[state]
                    state = role if fits else state
                elif edit in "IR":
                    state = C.FOLLOWS[state][-1]
                at += edit != "I"
            if fits and state in ("", "a"):
                found.append((cost, "".join(edits)))
        [way] = C.onward([C.Way()], rows, True)
        assert (way.cost, way.audit) == min(found)


def test_estimate_saves_work(monkeypatch):
    """Of a long conversation without faults only its own way and what lies within its cost are opened."""
    seen = []
    real = C.moves
    monkeypatch.setattr(C, "moves", lambda *a: seen.append(1) or real(*a))
    C.least([("user" if i % 2 == 0 else "assistant", 2 * (i % 4 == 3)) for i in range(400)], [(0, 0, "", "")], True)
    assert len(seen) < 4 * 400


def test_texts_and_dropped_only(spark):
    frame = spark.createDataFrame([(1, 0, "user", "Hi.", False), (1, 1, "user", "Ho.", False), (2, 0, "user", "Gone.", True)], "conv_id int, turn int, role string, text string, dropped boolean")
    found = {r["conv_id"]: r for r in C.repair(frame, texts=True).collect()}
    assert [tuple(t) for t in found[1]["repaired"]] == [("user", "Hi."), ("assistant", "Ho.")] and found[1]["audit"] == "KR"
    assert found[2]["audit"] == "" and found[2]["cost"] == 0 and found[2]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
