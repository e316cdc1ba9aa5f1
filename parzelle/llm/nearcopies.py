"""SimHash near-dedup by similarity: classes of texts whose shingle sets have a Jaccard similarity of 0.8 or more.

That similarity moves about ten bits of a 64-bit fingerprint, too many for block tables. So this form has fingerprints
of 1024 bits over the distinct shingles; the differing bits and the two set sizes give an estimate of the similarity (its
error is about 0.02 for long texts). It works in three steps, copies folded first:

1. Candidates share the smallest values of some hash functions (minwise bands; a pair of similarity 0.8 is missed with a
   chance under 0.0001). Only members of bands with two or more sets carry their fingerprint into the shuffle by band.
2. Within a band, pivot tables: Hamming distances to references chosen from the band itself; pairs whose distances to any
   pivot differ by more than the largest radius are discarded, the survivors estimated. Pairs that may be similar (an
   estimate up to MARGIN below) link, as a forest; their components are loose classes.
3. Within a loose class the shingle sets are compared exactly; chains of pairs that are similar enough are the classes.

Links come out as forests, no more rows than members. Bands and loose classes that are too large for a task are taken up
by llm/crowds.py: all members meet a few references first, and only members that this leaves apart meet the others.

Links run between sets, which have numbers of their own, so an id with several texts never ties their classes together.

Cases. Null, empty and blank texts have no shingle and are one class; fewer words than a shingle are one shingle. Very
long texts are hashed in parts. Rows of one id with different texts have the class of their own text each, also if it
names more than one. A null id names a class only if no member has an id. An empty table gives no rows. Only the id and
text columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from parzelle.llm import common, crowds, hamming
from parzelle.llm.neardup import SEED, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
#: 64-bit parts of a fingerprint; bands, and hash functions in each.
PARTS, BANDS, PER_BAND = 16, 24, 5
BITS = 64 * PARTS
PIVOTS = 16
HOT = 20_000
#: Groups up to here are handled together, pair by pair at equal offsets.
SMALL = 6
#: What an estimate may lie below the similarity; for sets of few shingles, whose votes are often tied, more.
MARGIN, FEW, FEW_MARGIN = 0.15, 32, 0.4
#: Shingles of a chunk, on average, when sets are compared.
CHUNK = 2_000_000
#: Shingles that are hashed at once.
AT_ONCE = 4096


def _constants(n: int, first: int) -> np.ndarray:
    return hamming.references(first + n)[first:] | np.uint64(1)


MIX, MINS = _constants(PARTS, 0), _constants(BANDS * PER_BAND, PARTS)
SIDE = np.unpackbits(hamming.references(PARTS).view(np.uint8)).astype(bool)


def mixed(hashes: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """A row of further hashes for each hash."""
    with np.errstate(over="ignore"):
        x = (hashes[:, None] ^ odd[None, :]) * odd[None, :]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint (PARTS words) and the band keys of a set of distinct hashes."""
    votes = np.zeros(BITS, dtype=np.int64)
    least = np.full(BANDS * PER_BAND, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), AT_ONCE):
        part = hashes[at : at + AT_ONCE]
        bits = np.unpackbits(mixed(part, MIX).view(np.uint8), axis=1)
        for lo in range(0, len(bits), 255):
            votes += bits[lo : lo + 255].sum(axis=0, dtype=np.uint8)
        with np.errstate(over="ignore"):
            np.minimum(least, ((part[:, None] ^ MINS[None, :]) * MINS[None, :]).min(axis=0), out=least)
    # ties, frequent among few shingles, go by fixed bits instead of to one side
    prints = np.packbits(np.where(2 * votes == len(hashes), SIDE, 2 * votes > len(hashes))).view(np.uint64)
    keys = np.zeros(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, PER_BAND).T:
        keys = mixed(keys ^ column, MIX[:1])[:, 0]
    return prints, keys.view(np.int64)


def describe(text: bytes, words: int, seed: int) -> tuple[bytes, int, list[int], bytes]:
    """Digest and size of the shingle set, band keys, fingerprint."""
    hashes = np.unique(np.array(shingle_hashes(text, words, seed), dtype=np.uint64))
    digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    if not len(hashes):
        return digest, 0, [], b""
    prints, keys = sketch(hashes)
    return digest, len(hashes), keys.tolist(), prints.tobytes()


def alike(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the estimated Jaccard similarity of rows of fingerprints allows for the similarity."""
    differ = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    shared = np.cos(differ * (math.pi / BITS)) * np.sqrt(nx * ny)
    least = np.maximum(similarity - np.where(np.minimum(nx, ny) <= FEW, FEW_MARGIN, MARGIN), 0.01)
    return shared * (1 + least) >= least * (nx + ny)


def radius(least: float) -> int:
    """Bits in which fingerprints of this estimate differ at most; sets of unequal size must be nearer."""
    return int(BITS * math.acos(min(1.0, 2 * least / (1 + least))) / math.pi) + 1


def forest(prints: np.ndarray, sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of links that span the classes, found from class to class."""
    reach = radius(max(similarity - (FEW_MARGIN if (sizes <= FEW).any() else MARGIN), 0.01))
    pivots = prints[np.linspace(0, len(prints) - 1, PIVOTS).astype(int)]
    table = np.stack([np.bitwise_count(prints ^ p).sum(axis=1, dtype=np.int16) for p in pivots], axis=1)
    order = np.argsort(table[:, 0], kind="stable")
    prints, sizes, table = prints[order], sizes[order].astype(float), table[order]
    rest = np.arange(len(prints))
    froms, tos = [], []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            a, b = np.searchsorted(table[rest, 0], [table[x, 0] - reach, table[x, 0] + reach + 1])
            at = np.arange(a, b)
            at = at[(np.abs(table[rest[at], 1:] - table[x, 1:]) <= reach).all(axis=1)]
            at = at[alike(prints[rest[at]], prints[x], sizes[rest[at]], sizes[x], similarity)]
            if len(at):
                some = rest[at]
                froms.append(np.full(len(some), x))
                tos.append(some)
                queue += some.tolist()
                rest = np.delete(rest, at)
    none = np.zeros(0, np.int64)
    return (order[np.concatenate(froms)], order[np.concatenate(tos)]) if froms else (none, none)


def group_links(starts: np.ndarray, prints: np.ndarray, sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of links within groups, which lie one after the other, beginning at starts."""
    counts = np.diff(np.append(starts, len(prints)))
    froms, tos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, n in zip(starts[counts > SMALL], counts[counts > SMALL], strict=True):
        x, y = forest(prints[a : a + n], sizes[a : a + n], similarity)
        froms.append(x + a)
        tos.append(y + a)
    group = np.repeat(np.where(counts <= SMALL, np.arange(len(counts)), -1), counts)
    for offset in range(1, min(SMALL, len(group))):
        i = np.flatnonzero((group[offset:] == group[:-offset]) & (group[offset:] >= 0))
        i = i[alike(prints[i], prints[i + offset], sizes[i].astype(float), sizes[i + offset].astype(float), similarity)]
        froms.append(i)
        tos.append(i + offset)
    return np.concatenate(froms), np.concatenate(tos)


def row_key(doc, text) -> Column:
    """Of an id and a text, 16 bytes; null is like an empty text, and a null id like no other."""
    parts = F.concat(F.when(doc.isNull(), "-").otherwise(F.concat(F.lit("+"), doc.cast("string"))), F.lit("\n"), F.coalesce(text.cast("string"), F.lit("")))
    return F.unhex(F.md5(parts.cast("binary")))


def described(df: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id, which (the key of id and text), digest, n, keys, print."""

    def make():
        def run(texts: pa.Array) -> dict:
            found = [describe(t, words, SEED) for t in common.as_bytes(texts)]
            return dict(zip(("digest", "n", "keys", "print"), map(list, zip(*found, strict=True)), strict=True))

        return run

    text = F.col(f"`{text_col}`").cast("string")
    doc = F.col(f"`{id_col}`")
    picked = df.select(doc.alias("id"), row_key(doc, text).alias("which"), text.alias("text"))
    return common.map_texts(picked, "id", "text", make, "digest binary, n long, keys array<long>, print binary", keep=("which",))


class Prints(crowds.Kind):
    """Fingerprints with the sizes of their sets; far apart by bits, near by the estimate."""

    payload = ("print", "n")

    def __init__(self, similarity: float):
        self.similarity = similarity
        self.slack = radius(max(similarity - FEW_MARGIN, 0.01))

    def parse(self, part: pa.RecordBatch):
        prints = np.frombuffer(b"".join(part.column("print").to_pylist()), dtype=np.uint64).reshape(-1, PARTS)
        return list(zip(prints, part.column("n").to_numpy().astype(float), strict=True))

    def stack(self, held):
        return np.stack([p for p, _ in held]), np.array([n for _, n in held])

    def compare(self, held, at, one):
        prints, sizes = held[0][at], held[1][at]
        return np.bitwise_count(prints ^ one[0]).sum(axis=1, dtype=np.int64), alike(prints, one[0], sizes, one[1], self.similarity)


class Sets(crowds.Kind):
    """Texts as sets of shingles; far apart by the Jaccard distance, which is a metric."""

    payload = ("text",)

    def __init__(self, words: int, similarity: float):
        self.words, self.similarity = words, similarity
        self.slack = 1 - similarity + 1e-9

    def parse(self, part: pa.RecordBatch):
        return [np.unique(np.array(shingle_hashes(t, self.words, SEED), dtype=np.uint64)) for t in common.as_bytes(part.column("text"))]

    def stack(self, held):
        return held, np.array([len(x) for x in held], dtype=float)

    def compare(self, held, at, one):
        both = np.array([shared(held[0][i], one) for i in at.tolist()], dtype=float)
        alike = both / (held[1][at] + len(one) - both)
        return 1 - alike, alike >= self.similarity


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values have in common."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))


def loose_links(sets: DataFrame, similarity: float, hot: int) -> DataFrame:
    """a, b: links that connect the distinct sets whose estimate suffices; sets has node, n, keys, print."""
    keyed = sets.select("node", F.posexplode("keys").alias("t", "key"))
    bands = common.durable(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    prints = sets.select("node", "n", "print")
    links = band_links(keyed.join(bands.where(F.col("members") <= hot), ["t", "key"]).join(prints, "node"), similarity)
    crowded = bands.where(F.col("members") > hot)
    if crowded.isEmpty():
        return links
    members = keyed.join(crowded, ["t", "key"]).select(F.xxhash64("t", "key").alias("g"), "node", F.lit(1).alias("weight"))
    return crowds.links(members, prints, Prints(similarity), hot, common.durable(links))


def band_links(members: DataFrame, similarity: float) -> DataFrame:
    """a, b: links within bands (t, key) that fit a task."""
    band = ["t", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def found(part: pa.Table, starts: np.ndarray):
            prints = np.frombuffer(b"".join(part["print"].to_pylist()), dtype=np.uint64).reshape(-1, PARTS)
            a, b = group_links(starts, prints, part["n"].to_numpy(), similarity)
            if len(a):
                ids = part["node"].combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], names=["a", "b"])

        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, new]) if held is not None else new
            cols = [held[c].to_numpy() for c in band]
            starts = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in cols], axis=0)))
            if len(starts) > 1:
                yield from found(held.slice(0, int(starts[-1])), starts[:-1])
                held = held.slice(int(starts[-1]))
        if held is not None and len(held):
            yield from found(held, np.zeros(1, np.int64))

    return members.repartition(*band).sortWithinPartitions(*band, "node").mapInArrow(run, "a long, b long")


def exact_forest(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Positions of links that span the classes of sets (sorted, distinct) by their Jaccard similarity."""
    froms, tos = [], []
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    alive, members, bounds, part = np.ones(len(sets), dtype=bool), np.arange(len(sets)), ends - sizes, codes
    marks = np.zeros(len(names), dtype=np.uint8)
    for start in range(len(sets)):
        queue = [start] if alive[start] else []
        alive[start] = False
        while queue:
            if 2 * alive[members].sum() < len(members):
                members = members[alive[members]]
                part = np.concatenate([codes[ends[m] - sizes[m] : ends[m]] for m in members]) if len(members) else codes[:0]
                bounds = np.cumsum(sizes[members]) - sizes[members]
            x = queue.pop()
            if not len(members):
                continue
            own = codes[ends[x] - sizes[x] : ends[x]]
            marks[own] = 1
            both = np.add.reduceat(marks[part], bounds, dtype=np.int64)
            marks[own] = 0
            some = members[alive[members] & (both / (sizes[x] + sizes[members] - both) >= similarity)].tolist()
            alive[some] = False
            froms += [x] * len(some)
            tos += some
            queue += some
    return froms, tos


def exact_links(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """a, b: links that connect the texts of a group that are similar; texts has root (the group), node, text; of a node's copies one counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, sets = None, [], []

        def flush():
            a, b = exact_forest(sets, similarity)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[x] for x in a], pa.int64()), pa.array([nodes[x] for x in b], pa.int64())], names=["a", "b"])

        for batch in batches:
            for part in common.slices([batch], "text"):
                rows = zip(part.column("root").to_pylist(), part.column("node").to_pylist(), common.as_bytes(part.column("text")), strict=True)
                for group, node, text in rows:
                    if group != at:
                        if len(sets) > 1:
                            yield from flush()
                        at, nodes, sets = group, [], []
                    if nodes and nodes[-1] == node:
                        continue
                    hashes = np.unique(np.array(shingle_hashes(text, words, SEED), dtype=np.uint64))
                    if len(hashes):
                        nodes.append(node)
                        sets.append(hashes)
        if len(sets) > 1:
            yield from flush()

    return texts.repartition("root").sortWithinPartitions("root", "node").mapInArrow(run, "a long, b long")


def _classes(df: DataFrame, words: int, similarity: float, hot: int, chunk: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The described rows; and for each set its digest and its class's head: the smallest id and, of that id's texts in the class, one's key."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0, and 1 at most")
    every = common.durable(described(df, words, id_col, text_col))
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "which"))
    one = every.groupBy("digest").agg(first.alias("first"), F.min_by(F.struct("n", "keys", "print"), "digest").alias("set"), F.count(F.lit(1)).alias("copies"))
    sets = common.durable(one.select(F.monotonically_increasing_id().alias("node"), "digest", "first", "copies", "set.*"))
    loose = hamming.components(loose_links(sets.where("n > 0"), similarity, hot))
    loose = common.durable(loose.join(sets.select("node", "first.which", "n"), "node"))
    text = F.col(f"`{text_col}`").cast("string")
    # a row may be repeated very often: of its copies one from each task goes through the shuffle, and one stays
    once = Window.partitionBy("which").orderBy("which")
    texts = df.select(row_key(F.col(f"`{id_col}`"), text).alias("which"), text.alias("text")).withColumn("nth", F.row_number().over(once)).where("nth = 1").drop("nth")
    held = common.durable(loose.groupBy("root").agg(F.sum("n").alias("held")))
    members = texts.join(loose, "which").select("root", "node", F.col("n").alias("weight"), "text")
    crowded = held.where(F.col("held") > chunk).select("root")
    if crowded.isEmpty():
        links = exact_links(members, words, similarity)
    else:
        members = common.durable(members)
        links = common.durable(exact_links(members.join(crowded, "root", "left_anti"), words, similarity))
        many = loose.join(crowded, "root").select(F.col("root").alias("g"), "node", F.col("n").alias("weight"))
        links = crowds.links(many, members.select("node", "text"), Sets(words, similarity), chunk, links)
    member = hamming.components(links)
    named = sets.select("node", "digest", "first", "copies").join(member, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = named.groupBy("root").agg(F.min("first").alias("head"))
    return every, named.join(heads, "root").select("root", "digest", "copies", "head")


def near_copies(df: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, hot: int = HOT, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, component_id (the smallest id reachable)."""
    every, named = _classes(df, words, similarity, hot, chunk, id_col, text_col)
    return common.join_unique(every.select("id", "digest"), named.drop("root"), "digest", "copies").select(F.col("id").alias(id_col), F.col("head.id").alias("component_id"))


def heads(df: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, hot: int = HOT, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, which: of each class the row to keep, by its id and row_key(): the smallest id; null if no member has one."""
    _, named = _classes(df, words, similarity, hot, chunk, id_col, text_col)
    return named.select("root", "head.id", "head.which").distinct().select(F.col("id").alias(id_col), "which")
