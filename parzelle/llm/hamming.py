"""All pairs of 64-bit fingerprints within a Hamming radius, and the classes they form.

Candidates. The bits are dealt into radius + extra blocks; two fingerprints within the radius agree in at least `extra`
of them, so they meet in the table of one choice of `extra` blocks (permuted block tables). Fingerprints must be
distinct: copies are folded before. A table's rows are shuffled by their agreeing bits and streamed group by group.

Within a group, pivot tables: the Hamming distances of every member to reference fingerprints are computed once. By the
triangle inequality a pair whose distances to any pivot differ by more than the radius is no link; the first pivot sorts
the members, so only a window of them is looked at, the next ones discard by the maximum coordinate difference, and the
survivors are verified bit by bit. Measured on sf0.1 (9,296 distinct fingerprints): of random pairs the first pivot
keeps 58 %, eight 1.5 %, all 32 0.01 %; of the 507 pairs that meet in block tables 63 are left for verification, 38 link.
Unrelated fingerprints lie 32 +/- 4 bits from any pivot, so the first pivot alone can't deal them out to tasks, which is
what the block tables are for. Links of a group come out as a forest that spans its classes: no more rows than members.

Hot groups. A group of more than `hot` members is not held: its rows pass through in numbered chunks, and a second
shuffle brings each two chunks together in a tile of their own. So a task holds 2 * hot fingerprints and a batch at most, and no
pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parzelle.llm import common

#: Reference fingerprints.
PIVOTS = 32
#: Groups up to here are handled together, pair by pair at equal offsets.
SMALL = 8
HOT = 20_000
#: Members of a bucket of a block table, on average, that are thought few.
FEW = 16


def references(n: int = PIVOTS) -> np.ndarray:
    """Fixed pseudo-random fingerprints (splitmix64 of 1, 2, ...)."""
    with np.errstate(over="ignore"):
        x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def table_masks(radius: int, extra: int) -> list[int]:
    """Signed 64-bit masks, one for each choice of blocks."""
    n = radius + extra
    if n > 64:
        raise ValueError("radius and extra blocks must not exceed 64")
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(blocks, extra)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def extra_blocks(rows: int, radius: int) -> int:
    """As many blocks that must agree as keep unrelated fingerprints of so many rows apart: two, and more for billions of rows."""
    extra = 2
    while extra < 6 and rows / 2.0 ** (64 * extra / (radius + extra)) > FEW:
        extra += 1
    return extra


def distances(prints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[:, None] ^ pivots[None, :]).astype(np.int8)


def forest(prints: np.ndarray, radius: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the classes of distinct fingerprints: exact, by search from class to class."""
    table = distances(prints, pivots)
    order = np.argsort(table[:, 0], kind="stable")
    prints, table = prints[order], table[order]
    rest = np.arange(len(prints))
    froms, tos = [], []
    while len(rest):
        queue = [int(rest[0])]
        rest = rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = table[rest, 0]
            a, b = np.searchsorted(near, [table[x, 0] - radius, table[x, 0] + radius + 1])
            some = rest[a:b]
            some = some[(np.abs(table[some, 1:8] - table[x, 1:8]) <= radius).all(axis=1)]
            some = some[(np.abs(table[some, 8:] - table[x, 8:]) <= radius).all(axis=1)]
            some = some[np.bitwise_count(prints[some] ^ prints[x]) <= radius]
            if len(some):
                froms.append(np.full(len(some), prints[x]))
                tos.append(prints[some])
                queue += some.tolist()
                gone = np.zeros(b - a, dtype=bool)
                gone[np.searchsorted(rest[a:b], some)] = True
                rest = np.concatenate([rest[:a], rest[a:b][~gone], rest[b:]])
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(froms), np.concatenate(tos)) if froms else (empty, empty)


def group_links(starts: np.ndarray, prints: np.ndarray, radius: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within each group; groups lie one after the other, beginning at starts."""
    sizes = np.diff(np.append(starts, len(prints)))
    froms, tos = [], []
    for a, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        x, y = forest(prints[a : a + n], radius, pivots)
        froms.append(x)
        tos.append(y)
    small = (sizes > 1) & (sizes <= SMALL)
    if small.any():
        group = np.repeat(np.arange(small.sum()), sizes[small])
        members = prints[np.repeat(starts[small] - (np.cumsum(sizes[small]) - sizes[small]), sizes[small]) + np.arange(sizes[small].sum())]
        table = distances(members, pivots)
        for offset in range(1, SMALL):
            i = np.flatnonzero(group[offset:] == group[:-offset]) if offset < len(group) else np.zeros(0, int)
            i = i[np.abs(table[i + offset] - table[i]).max(axis=1, initial=0) <= radius]
            i = i[np.bitwise_count(members[i] ^ members[i + offset]) <= radius]
            froms.append(members[i])
            tos.append(members[i + offset])
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(froms), np.concatenate(tos)) if froms else (empty, empty)


def _batch(names: list[str], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if n in ("t", "chunk") else pa.int64()) for n, x in zip(names, cols, strict=True)], names=names)


OUT = "t int, chunk int, key long, a long, b long"
NAMES = ["t", "chunk", "key", "a", "b"]


def links(prints: DataFrame, radius: int, extra: int = 2, hot: int = HOT) -> DataFrame:
    """a, b (long): links that connect all classes of the distinct fingerprints in column fp (long, no nulls)."""
    masks = table_masks(radius, extra)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = references()
        held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        passing: tuple[int, int] | None = None
        passed = 0

        def through(t, key, fp):
            nonlocal passed
            chunk = (passed + np.arange(len(fp))) // hot
            passed += len(fp)
            return _batch(NAMES, np.full(len(fp), t, np.int32), chunk.astype(np.int32), np.full(len(fp), key), fp, fp)

        def whole(t, key, fp):
            if len(fp):
                starts = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])))
                a, b = group_links(starts, fp.view(np.uint64), radius, pivots)
                if len(a):
                    n = len(a)
                    yield _batch(NAMES, np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64), a.view(np.int64), b.view(np.int64))

        for batch in batches:
            cols = [np.concatenate([old, batch.column(n).to_numpy(zero_copy_only=False)]) for old, n in zip(held, ("t", "key", "fp"), strict=True)]
            t, key, fp = cols
            if passing is not None:
                n = int(np.argmax(np.append((t != passing[0]) | (key != passing[1]), True)))
                if n:
                    yield through(*passing, fp[:n])
                t, key, fp = t[n:], key[n:], fp[n:]
                if not len(fp):
                    held = [x[:0] for x in cols]
                    continue
                passing, passed = None, 0
            if not len(fp):
                continue
            at = len(fp) - int(np.argmax(np.append(((t != t[-1]) | (key != key[-1]))[::-1], True)))
            if len(fp) - at > hot:
                yield through(t[-1], key[-1], fp[at:])
                passing = int(t[-1]), int(key[-1])
                held = [t[:0], key[:0], fp[:0]]
            else:
                held = [t[at:], key[at:], fp[at:]]
            yield from whole(t[:at], key[:at], fp[:at])
        yield from whole(*held)

    keys = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    found = common.durable(keys.repartition("t", "key").sortWithinPartitions("t", "key", "fp").mapInArrow(stream, OUT))
    out = found.where("t < 0").select("a", "b")
    rest = found.where("t >= 0").select("t", "key", "chunk", F.col("a").alias("fp"))
    if rest.isEmpty():
        return out
    return out.unionByName(tiles(rest, radius))


def tiles(rest: DataFrame, radius: int) -> DataFrame:
    """Links between the members of hot groups: each two chunks of a group meet in a tile."""
    chunks = rest.groupBy("t", "key").agg((F.max("chunk") + 1).alias("n"))
    other = F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(1))))
    dealt = rest.join(chunks, ["t", "key"]).select("t", "key", "fp", "chunk", other.alias("other")).where("chunk <> other")
    dealt = dealt.select("t", "key", "fp", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = references()
        at, held = None, []

        def flush():
            a, b = forest(np.concatenate(held).view(np.uint64), radius, pivots)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            ids = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("t", "key", "i", "j")])
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(fp)], strict=True):
                if lo == hi:
                    continue
                tile = tuple(ids[lo])
                if at is not None and tile != at:
                    yield from flush()
                    held = []
                at = tile
                held.append(fp[lo:hi])
        if held:
            yield from flush()

    return dealt.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges a, b: root is the smallest node it is connected with.

    Alternating large-star and small-star steps, each a few joins and aggregates, until nothing changes. Neighbours of
    a node are met by joins, which can be split when a node has very many; no list of neighbours is ever made.
    """
    now = common.durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        n, total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not n or (n, total) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = n, total
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = common.durable(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
