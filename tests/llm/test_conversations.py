"""Repair of conversations against all edit strings, and the way by chunks against the one that holds a conversation."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from parzelle.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, g string, present int"
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}


def cheapest(turns):
    """All edit strings that cost no more than the best so far; turns: role initial, fault (blank, duplicate, truncated or none)."""
    best = (10**9, None)

    def go(i, roles, cost, letters):
        nonlocal best
        if cost > best[0] or not re.fullmatch("(s?(ua)*u?)?", roles):
            return
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, letters))
        if len(roles) < 2 * len(turns) + 2:
            for new in "ua":
                go(i, roles + new, cost + 5, letters + "I")
        if i < len(turns):
            role, fault = turns[i]
            go(i + 1, roles, cost + 2, letters + "D")
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                go(i + 1, roles + role[:1] if role else roles + "?", cost + more, letters + "K")
                for new in "ua":
                    go(i + 1, roles + new, cost + more + 1, letters + "R")

    go(0, "", 0, "")
    return best


def told(rows):
    """The faults of rows (role, text) in order."""
    seen, faults = set(), []
    for role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return faults


def replayed(rows, letters):
    """The repaired text's digest: roles of new turns follow from the grammar."""
    out, i, last = [], 0, ""
    for x in letters:
        new = "assistant" if last == "u" else "user"
        if x == "I":
            out.append((new, ""))
        else:
            role, text = rows[i]
            i += 1
            if x == "D":
                continue
            out.append((role if x == "K" else new, text))
        last = out[-1][0][:1]
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def plain(table):
    """conv_id to the contract's columns, from rows (conv_id, turn, role, text)."""
    found = {}
    for conv in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in table:
            if c != conv:
                continue
            fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if fate:
                text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
                rows += [(turn is not None, turn or 0, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
        rows.sort()
        turns = [r[1] for r in rows if r[0]]
        kept = [r[2:] for r in rows]
        faults = told(kept)
        cost, letters = cheapest([(r[0], f) for r, f in zip(kept, faults, strict=True)])
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(kept, kept[1:], strict=False)]
        found[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost, letters, replayed(kept, letters),
        )
    return found


@pytest.fixture(scope="module")
def table():
    rnd = random.Random(5)
    rows = []
    for conv in range(120):
        turn = rnd.randrange(5)
        for _ in range(rnd.randrange(1, 7)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"])
            text = rnd.choice(["Yes.", "No!", "cut off", "Is it? \n", "\t \x0b", None, "", "Größe 🙂.", f"word {turn}."])
            rows.append((conv, rnd.choice([turn, turn, None]), role, text))
            turn += rnd.choice([0, 1, 1, 1, 3])
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (500, None, None, None), (501, 0, "user", "x " * 50_000 + ".")]
    rows += [(502, t, "user" if t % 2 == 0 else "assistant", "Same.") for t in range(6)]
    return rows


def rows_of(df):
    return {r["conv_id"]: tuple(r[n] for n in conversations.NAMES) for r in df.collect()}


@pytest.mark.parametrize("limits", [{}, {"most_rows": 0, "chunk": 2}, {"most_rows": 3, "chunk": 3}])
def test_repair_equals_all_edit_strings(spark, table, limits):
    df = spark.createDataFrame([(*r, "clash", 1) for r in table], SCHEMA).repartition(3)
    found = conversations.repair(conversations.damaged(df), present=F.col("present"), **limits)
    assert found.columns == ["conv_id", *conversations.NAMES]
    got = rows_of(found)
    assert got == plain(table)
    assert found.count() == len(got)


def test_query_equals_all_rows(spark):
    sf = "/root/testdata/sf0.001"
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op12_conversation_repair(spark, sf)) == plain(table)


def test_long_conversation_by_chunks_equals_whole(spark):
    rnd = random.Random(9)
    turns = [(rnd.choice(["user", "assistant", "system", "x"]), rnd.choice(["A.", "B", f"c {i}.", f"d {i}", ""])) for i in range(3000)]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)] + [(2, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    whole = rows_of(conversations.repair(df))
    assert whole == rows_of(conversations.repair(df, most_rows=100, chunk=64)) == rows_of(conversations.repair(df, most_bytes=50, chunk=7))
    assert len(whole[1][6]) >= 3000


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(conversations.damaged(none), present=F.col("present")).collect() == []
