"""Repair of the turn structure of conversations by the cheapest edits.

The roles of a sound conversation are an optional system turn, then pairs of a user's and an assistant's. The grammar has
four states: nothing yet, after system, after user, after assistant; it may end in the first and the last. For every turn
and state the cost to go is found from the end backwards; then a walk forwards takes, of the edits that keep that cost,
the one whose letter comes first in ASCII (D, I, K, R), which gives the first of all cheapest edit strings.

Conversations of few rows and bytes are sorted and repaired group by group. Longer ones are cut into chunks of turns,
so that one that holds a third of all rows is handled by many tasks: costs of a chunk from each state to each are a
matrix, and matrices of chunks are composed (least sums) from the last to the first, which gives each chunk the costs at
its end; a walk through a chunk from each of the four states tells where it ends, so that chunks are linked from the
first to the last. Only the digest of the repaired text has to see a conversation's turns one after the other, since
SHA-256 can't be composed: they stream through a task that holds one batch and the edit string.

Cases. A null role or text is one space, so the text is blank; rows of a null conversation are one conversation; null
turns come first and count for no gap. Rows of one turn are ordered by role, then text, so equal rows stay together and
all but the first are duplicates. Roles other than system, user and assistant (by their first letter) can't be kept in
place. A conversation without rows that are present has zeros, no edits and the digest of the empty text. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from parzelle.llm import common
from parzelle.llm.common import durable
from parzelle.operators.ranks import places

#: A conversation of more is cut into chunks.
MOST_ROWS, MOST_BYTES = 20_000, 16_000_000
#: Turns of a chunk.
CHUNK = 50_000
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NEVER = 1 << 60
#: By state: where a turn of each role leads, what role a new one must have, and where that leads.
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
NONE = (None, None, None, None)
NEW_ROLE = ("user", "user", "assistant", "user")
NEW = (2, 2, 3, 2)
#: Costs to go at the end: nothing, or turns to be inserted.
END = (0, 2 * INSERT, INSERT, 0)
OK, BLANK, DUPLICATE, CUT = range(4)
OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NAMES = [part.split()[0] for part in OUT.split(", ")]

#: The first letter of a turn's role, and its fault.
Turn = tuple[str, int]
Costs = tuple[int, int, int, int]


def before(turn: Turn, after: Costs) -> Costs:
    """Costs to go before a turn, of those after it."""
    initial, fault = turn
    costs = [DELETE + c for c in after]
    if fault in (OK, CUT):
        more = TRUNCATED if fault == CUT else 0
        kept = KEPT.get(initial, NONE)
        for s in range(4):
            costs[s] = min(costs[s], more + REROLE + after[NEW[s]], more + KEEP + after[kept[s]] if kept[s] is not None else NEVER)
    costs[2] = min(costs[2], INSERT + costs[3])
    costs[3] = min(costs[3], INSERT + costs[2])
    return min(costs[0], INSERT + costs[2]), min(costs[1], INSERT + costs[2]), costs[2], costs[3]


def costs_to_go(turns: list[Turn], end: Costs) -> list[Costs]:
    """Before each turn, and at the end."""
    found = [end]
    for turn in reversed(turns):
        found.append(before(turn, found[-1]))
    return found[::-1]


def walk(turns: list[Turn], costs: list[Costs], state: int) -> tuple[list[str], int]:
    """For each turn the letters of what is inserted before it and of its own edit; the state at the end."""
    edits = []
    for i, (initial, fault) in enumerate(turns):
        letters = ""
        now, then = costs[i], costs[i + 1]
        more = TRUNCATED if fault == CUT else 0
        while now[state] != DELETE + then[state] and now[state] == INSERT + now[NEW[state]]:
            letters += "I"
            state = NEW[state]
        if now[state] == DELETE + then[state]:
            letters += "D"
        elif (to := KEPT.get(initial, NONE)[state]) is not None and now[state] == more + KEEP + then[to]:
            letters += "K"
            state = to
        else:
            letters += "R"
            state = NEW[state]
        edits.append(letters)
    return edits, state


class Tally:
    """What comes out for one conversation, turn by turn."""

    def __init__(self):
        self.counts = [0, 0, 0, 0]
        self.turns = self.illegal = self.cost = self.state = self.lines = 0
        self.low = self.high = self.initial = None
        self.audit: list[str] = []
        self.digest = hashlib.sha256()

    def line(self, role: str, text: str) -> None:
        self.digest.update((f"\n{role}:{text}" if self.lines else f"{role}:{text}").encode())
        self.lines += 1

    def insert(self) -> None:
        self.line(NEW_ROLE[self.state], "")
        self.state = NEW[self.state]
        self.cost += INSERT

    def add(self, turn: int | None, role: str, text: str, fault: int, letters: str) -> None:
        """The next turn, in order."""
        self.counts[fault] += 1
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        self.audit.append(letters)
        for _ in letters[:-1]:
            self.insert()
        if letters[-1] == "D":
            self.cost += DELETE
            return
        self.cost += (TRUNCATED if fault == CUT else 0) + (KEEP if letters[-1] == "K" else REROLE)
        if letters[-1] == "K":
            self.state = KEPT[role[:1]][self.state]
            self.line(role, text)
        else:
            self.line(NEW_ROLE[self.state], text)
            self.state = NEW[self.state]

    def row(self) -> list:
        while END[self.state]:
            self.audit.append("I")
            self.insert()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return [gaps, *self.counts[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()]


def fault(text: str) -> int:
    """But for duplicates."""
    shown = text.rstrip(SPACE)
    return BLANK if not shown else OK if shown[-1] in ".!?" else CUT


def one(turns: list, roles: list[str], texts: list[str]) -> list:
    """The row of a conversation that is held."""
    seen: set[tuple[str, str]] = set()
    found: list[Turn] = []
    for role, text in zip(roles, texts, strict=True):
        kind = fault(text)
        found.append((role[:1], DUPLICATE if kind != BLANK and (role, text) in seen else kind))
        seen.add((role, text))
    edits, _ = walk(found, costs_to_go(found, END), 0)
    tally = Tally()
    for turn, role, text, (_, kind), letters in zip(turns, roles, texts, found, edits, strict=True):
        tally.add(turn, role, text, kind, letters)
    return tally.row()


def batches_of(rows: Iterator[list]) -> Iterator[pa.RecordBatch]:
    """Rows of g and the columns of OUT, some hundreds at a time."""
    types = [pa.string(), *common.arrow_types(OUT)]
    held: list[list] = []
    for row in rows:
        held.append(row)
        if len(held) >= common.BATCH_ROWS or len(row[NAMES.index("audit") + 1]) > common.BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=["g", *NAMES])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=["g", *NAMES])


def short(rows: DataFrame) -> DataFrame:
    """Conversations that can be held: all rows of one in a task, one conversation at a time."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for group in common.groups(batches, ["g"]):
            there = group.filter(group["present"])
            yield [group["g"][0].as_py(), *one(there["turn"].to_pylist(), there["role"].to_pylist(), there["text"].to_pylist())]

    return rows.repartition("g").sortWithinPartitions("g", "turn", "role", "text").mapInArrow(lambda batches: batches_of(found(batches)), f"g string, {OUT}")


def matrix(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each state at a chunk's end the costs from each state at its start."""
    pdf = pdf.sort_values("place")
    turns = list(zip(pdf["initial"], pdf["fault"], strict=True))
    rows = []
    for to in range(4):
        costs = tuple(0 if s == to else NEVER for s in range(4))
        for turn in reversed(turns):
            costs = before(turn, costs)
        rows.append([min(c, NEVER) for c in costs])
    return pd.DataFrame([[pdf["g"].iat[0], pdf["chunk"].iat[0], *rows]], columns=["g", "chunk", "m0", "m1", "m2", "m3"])


def ends(pdf: pd.DataFrame) -> pd.DataFrame:
    """The costs to go at the end of each chunk of a conversation."""
    pdf = pdf.sort_values("chunk", ascending=False)
    found, costs = [], END
    for g, chunk, *m in pdf[["g", "chunk", "m0", "m1", "m2", "m3"]].itertuples(index=False):
        found.append([g, chunk, list(costs)])
        costs = tuple(min(m[to][s] + costs[to] for to in range(4)) for s in range(4))
    return pd.DataFrame(found, columns=["g", "chunk", "costs"])


def walks(pdf: pd.DataFrame) -> pd.DataFrame:
    """The edits of each turn of a chunk, and the state after the chunk, for each state before it."""
    pdf = pdf.sort_values("place")
    turns = list(zip(pdf["initial"], pdf["fault"], strict=True))
    costs = costs_to_go(turns, tuple(int(c) for c in pdf["costs"].iat[0]))
    ways = [walk(turns, costs, s) if costs[0][s] < NEVER else ([""] * len(turns), 0) for s in range(4)]
    return pd.DataFrame({"g": pdf["g"], "chunk": pdf["chunk"], "place": pdf["place"], "fault": pdf["fault"], "edits": list(zip(*[w[0] for w in ways], strict=True)), "exits": [[w[1] for w in ways]] * len(pdf)})


def starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state before each chunk of a conversation."""
    pdf = pdf.sort_values("chunk")
    found, state = [], 0
    for g, chunk, exits in pdf[["g", "chunk", "exits"]].itertuples(index=False):
        found.append([g, chunk, state])
        state = int(exits[state])
    return pd.DataFrame(found, columns=["g", "chunk", "state"])


def long(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Conversations of any length, by chunks."""
    placed = places(rows.where("present").select("g", "turn", "role", "text"), "g", "turn", "role", "text")
    shown = F.rtrim("text", F.lit(SPACE))
    kind = F.when(shown == "", BLANK).when(F.substring(shown, -1, 1).isin(".", "!", "?"), OK).otherwise(CUT)
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    skinny = placed.select("g", "place", F.expr(f"place div {chunk}").alias("chunk"), F.substring("role", 1, 1).alias("initial"), kind.alias("kind"), same.alias("same"))
    # a duplicate is a row that isn't the first of its role and text; firsts and rows meet by place, which is unique
    firsts = skinny.groupBy("g", "same").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    faults = durable(skinny.join(firsts, "place", "left").select("g", "place", "chunk", "initial", F.when((F.col("kind") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("kind")).alias("fault")))
    costs = "array<long>"
    matrices = faults.groupBy("g", "chunk").applyInPandas(matrix, f"g string, chunk long, m0 {costs}, m1 {costs}, m2 {costs}, m3 {costs}")
    at_end = matrices.groupBy("g").applyInPandas(ends, f"g string, chunk long, costs {costs}")
    ways = durable(faults.join(at_end, ["g", "chunk"]).groupBy("g", "chunk").applyInPandas(walks, "g string, chunk long, place long, fault int, edits array<string>, exits array<int>"))
    at_start = ways.groupBy("g", "chunk").agg(F.first("exits").alias("exits")).groupBy("g").applyInPandas(starts, "g string, chunk long, state int")
    edits = ways.join(at_start, ["g", "chunk"]).select("place", "fault", F.get("edits", F.col("state")).alias("letters"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        g, tally = None, Tally()
        for part in batches:
            for name, *turn in zip(*[part.column(c).to_pylist() for c in ("g", "turn", "role", "text", "fault", "letters")], strict=True):
                if g is not None and name != g:
                    yield [g, *tally.row()]
                    tally = Tally()
                g = name
                tally.add(*turn)
        if g is not None:
            yield [g, *tally.row()]

    lines = placed.join(edits, "place").repartition("g").sortWithinPartitions("g", "place")
    repaired = lines.mapInArrow(lambda batches: batches_of(found(batches)), f"g string, {OUT}")
    nothing = rows.groupBy("g").agg(F.max("present").alias("some")).where("NOT some").select("g", *[F.lit(v).cast(t).alias(n) for n, v, t in zip(NAMES, Tally().row(), [p.split()[1] for p in OUT.split(", ")], strict=True)])
    return repaired.unionByName(nothing)


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, chunk: int = CHUNK) -> DataFrame:
    """A row for each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows that are not present only name their conversation."""
    c = F.col(f"`{conv}`")
    g = F.when(c.isNull(), "-").otherwise(F.concat(F.lit("="), c.cast("string")))
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    rows = df.select(g.alias("g"), F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")).alias("text"), there.alias("present"))
    n, size = F.count(F.lit(1)), F.sum(F.octet_length("text"))
    large = durable(rows.groupBy("g").agg(n.alias("n"), size.alias("size")).where((F.col("n") > most_rows) | (F.col("size") > most_bytes)).select("g", "n"))
    if large.isEmpty():
        found = short(rows)
    else:
        # a large conversation's rows go to no one task: those of over a thousandth of all large ones' rows, a thousand at most, are sent to all
        total = large.agg(F.sum("n")).first()[0]
        hot = F.broadcast(large.where(F.col("n") * 1000 > total).select("g", F.lit(True).alias("hot")))
        told = rows.join(hot, "g", "left")
        rest = told.where("hot IS NULL").join(large.where(F.col("n") * 1000 <= total).select("g", F.lit(True).alias("big")), "g", "left")
        found = short(rest.where("big IS NULL")).unionByName(long(told.where("hot").drop("hot").unionByName(rest.where("big").drop("hot", "big")), chunk))
    name = F.when(F.col("g") != "-", F.substring("g", 2, 1 << 30)).cast(df.schema[conv].dataType)
    return found.select(name.alias(conv), *NAMES)


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with faults by crc32 of conversation and turn: 0 of 20 are not present, 1 are emptied, 2 lose their ends of
    sentences, 3 come twice, 4 become the user's. Columns conv, turn, role, text, present."""
    c, t = F.col(f"`{conv}`"), F.col(f"`{turn}`")
    known = lambda x: F.coalesce(x.cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(known(c), F.lit(":"), known(t)).cast("binary")) % 20
    words = known(F.col(f"`{text}`"))
    words = F.when(fate == 1, "").when(fate == 2, F.translate(words, ".!?", "")).otherwise(words)
    who = F.when(fate == 4, "user").otherwise(known(F.col(f"`{role}`")))
    times = F.explode(F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1).cast("int"))).alias("again")
    return df.select(c.alias(conv), t.alias(turn), who.alias(role), words.alias(text), (fate != 0).alias("present"), times).drop("again")
