"""Links within groups that are too large for a task, without all pairs of a group.

The members of a group lie in a metric space (a Kind says in which), and near ones are to be linked, so that the linked
components are those of all near pairs.

1. Each member meets a few references, drawn from the group by hash: its distances to them are kept, near ones link.
   Members are streamed in chunks of their group, each of which gets the references, so this grows with the members only.
2. The components of all links so far are labels. Most members of a group of near-copies now have its main label. The
   others are apart: while they are too many for a task, and for ROUNDS rounds at most, references are drawn from them.
3. Two members of one label are linked already. Of two with different labels one at least is apart. So the members apart
   are dealt into parts, and all members of the group are streamed past each part. By the triangle inequality, distances
   to any reference that differ by more than a near pair's largest distance rule a pair out: members that no member
   apart can be near to aren't sent, and pairs are compared only if all references allow it.

A group with very many members apart from each other still costs their number times the group's, less what the references
rule out; no link is lost either way. A task holds references or one part, and streams the rest.

Cases. An empty table gives the known links. A member that is its group's only one links nowhere. Repeated members meet
like others, at distance zero; a member never links to itself. Ties among equal hashes go by node. Null groups and nodes
aren't expected; payloads are what the Kind takes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parzelle.llm import common, hamming

#: References of a group and round, and rounds.
REFERENCES, ROUNDS = 8, 3


class Kind:
    """What members are. payload: the columns that parse() reads, the first of them of variable length; slack: the largest
    distance of a near pair, or more."""

    payload: tuple[str, ...]
    slack: float

    def parse(self, part: pa.RecordBatch) -> list:
        raise NotImplementedError

    def stack(self, held: list):
        """Members in the form that compare() takes."""
        raise NotImplementedError

    def compare(self, held, at: np.ndarray, one) -> tuple[np.ndarray, np.ndarray]:
        """Distances of the held members at these places to one member, and whether they are near."""
        raise NotImplementedError


def links(members: DataFrame, payloads: DataFrame, kind: Kind, cap: int, known: DataFrame) -> DataFrame:
    """a, b: the known links and those that connect the near members of each group. members: g, node, weight (a node may be
    in several groups); payloads: node and the kind's columns; cap: the weight that a task holds."""
    sizes = common.durable(members.groupBy("g").agg(F.ceil(F.sum("weight") / cap).cast("int").alias("chunks")))
    placed = common.durable(members.join(sizes, "g").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")))
    named = placed.select("g", "chunk", "node", "weight").withColumns({"label": F.col("node"), "apart": F.lit(True), "far": F.lit(None).cast("array<double>")})
    for nth in range(ROUNDS):
        met = common.durable(_met(named, references(named, nth), sizes, payloads, kind))
        near = met.select(F.col("node").alias("a"), F.explode("near").alias("b"))
        known = common.durable(known.unionByName(near))
        labels = hamming.components(known).withColumnRenamed("root", "component")
        new = met.drop("near").withColumnRenamed("far", "later")
        named = named.drop("label", "apart").join(new, ["g", "chunk", "node"]).join(labels, "node", "left")
        named = named.select("g", "chunk", "node", "weight", F.coalesce("component", "node").alias("label"), F.coalesce(F.concat("far", "later"), "later").alias("far"))
        named = common.durable(_apart(named, sizes))
        left = named.where("apart").groupBy("g").agg(F.sum("weight").alias("n"))
        most = left.agg(F.max("n")).first()[0]
        if not most:
            return known
        named = named.join(_spread(left.select("g"), sizes), ["g", "chunk"], "left_semi")
        if most <= cap:
            break
    return known.unionByName(_borders(named, sizes, payloads, kind, cap))


def references(named: DataFrame, nth: int) -> DataFrame:
    """g, node: of each group a few of the members apart; one for each of so many values of a hash."""
    drawn = named.where("apart").withColumn("h", F.xxhash64("node", F.lit(nth)))
    least = drawn.groupBy("g", F.pmod("h", F.lit(REFERENCES)).alias("k")).agg(F.min(F.struct("h", "node")).alias("m"))
    return common.durable(least.select("g", "m.node"))


def _spread(table: DataFrame, sizes: DataFrame) -> DataFrame:
    """A copy of the group's rows for each of its chunks."""
    return table.join(sizes, "g").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")


def _apart(named: DataFrame, sizes: DataFrame) -> DataFrame:
    """Marks members whose label isn't the group's most frequent one (of several the smallest)."""
    counts = named.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("g").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("main"))
    return named.join(_spread(main, sizes), ["g", "chunk"]).withColumn("apart", F.col("label") != F.col("main")).drop("main")


def _runs(batches: Iterator[pa.RecordBatch], kind: Kind, tile: list[str]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """Tile, whether its rows are held, rows; rows come by tile, held ones first."""
    for batch in batches:
        for part in common.slices([batch], kind.payload[0]):
            cols = [part.column(c).to_numpy(zero_copy_only=False) for c in (*tile, "held")]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), part.num_rows], strict=True):
                if b > a:
                    yield tuple(int(c[a]) for c in cols[:-1]), cols[-1][a] == 0, part.slice(a, b - a)


def _met(named: DataFrame, drawn: DataFrame, sizes: DataFrame, payloads: DataFrame, kind: Kind) -> DataFrame:
    """g, chunk, node, far (distances to the group's references, by node), near (those that are near)."""
    tile = ["g", "chunk"]
    held = _spread(drawn.join(payloads, "node"), sizes).withColumn("held", F.lit(0))
    rows = named.select("g", "chunk", "node").join(payloads, "node").withColumn("held", F.lit(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, items, stacked = None, [], [], None
        for where, first, part in _runs(batches, kind, tile):
            if where != at:
                at, nodes, items, stacked = where, [], [], None
            if first:
                nodes += part.column("node").to_pylist()
                items += kind.parse(part)
                continue
            stacked = stacked or kind.stack(items)
            ids, every, fars, nears = part.column("node").to_pylist(), np.arange(len(nodes)), [], []
            for node, one in zip(ids, kind.parse(part), strict=True):
                far, near = kind.compare(stacked, every, one)
                fars.append(far.astype(float))
                nears.append([nodes[i] for i in np.flatnonzero(near).tolist() if nodes[i] != node])
            yield pa.RecordBatch.from_arrays(
                [part.column("g"), part.column("chunk"), part.column("node"), pa.array(fars, pa.list_(pa.float64())), pa.array(nears, pa.list_(pa.int64()))],
                names=[*tile, "node", "far", "near"],
            )

    dealt = held.select(*tile, "held", "node", *kind.payload).unionByName(rows.select(*tile, "held", "node", *kind.payload))
    return dealt.repartition(*tile).sortWithinPartitions(*tile, "held", "node").mapInArrow(run, "g long, chunk int, node long, far array<double>, near array<long>")


def _borders(named: DataFrame, sizes: DataFrame, payloads: DataFrame, kind: Kind, cap: int) -> DataFrame:
    """a, b: links of members apart with members of other labels."""
    slack = kind.slack
    apart = named.where("apart")
    least = [f(F.get("far", F.lit(k))).alias(f"{n}{k}") for k in range(REFERENCES * ROUNDS) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    bounds = common.durable(apart.groupBy("g").agg(F.ceil(F.sum("weight") / cap).cast("int").alias("parts"), *least))
    fits = F.lit(True)
    for k in range(REFERENCES * ROUNDS):
        fits &= F.coalesce(F.get("far", F.lit(k)).between(F.col(f"lo{k}") - slack, F.col(f"hi{k}") + slack), F.lit(True))
    kept = named.join(_spread(bounds, sizes), ["g", "chunk"]).where(F.col("apart") | fits)
    kept = kept.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("g", "chunk", "part", "node", "label", "far", F.lit(1).alias("held"))
    dealt = apart.drop("chunk").join(bounds.select("g", "parts"), "g").withColumn("part", F.pmod(F.xxhash64("node", F.lit(-1)), F.col("parts")).cast("int"))
    dealt = _spread(dealt, sizes).select("g", "chunk", "part", "node", "label", "far", F.lit(0).alias("held"))
    tile = ["g", "chunk", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, labels, fars, items, stacked = None, [], [], [], [], None
        for where, first, part in _runs(batches, kind, tile):
            if where != at:
                at, nodes, labels, fars, items, stacked = where, [], [], [], [], None
            own = part.column("node").to_pylist(), part.column("label").to_pylist(), part.column("far").to_pylist()
            if first:
                for have, more in zip((nodes, labels, fars, items), (*own, kind.parse(part)), strict=True):
                    have += more
                continue
            if not nodes:
                continue
            if stacked is None:
                stacked, of_label, of_far = kind.stack(items), np.array(labels), np.array(fars)
            a, b = [], []
            for node, label, far, one in zip(*own, kind.parse(part), strict=True):
                some = np.flatnonzero((of_label != label) & (np.abs(of_far - np.array(far)) <= slack).all(axis=1))
                if len(some):
                    near = some[kind.compare(stacked, some, one)[1]]
                    a += [node] * len(near)
                    b += [nodes[i] for i in near.tolist()]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = dealt.unionByName(kept).join(payloads, "node").select(*tile, "held", "node", "label", "far", *kind.payload)
    return rows.repartition(*tile).sortWithinPartitions(*tile, "held", "node").mapInArrow(run, "a long, b long")
