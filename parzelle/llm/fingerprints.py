"""SimHash document fingerprints: weighted term hashes vote on signed bits; permuted block tables find neighbours.

Terms are pairs of neighbouring words (ASCII white space apart, A-Z lower-cased), the first word paired with a start
mark; a term weighs the letters it has, sixteen at most, and counts as often as it occurs. Each of the fingerprint's
256 bits is the sign of the weighted sum of the terms' hash bits. Likeness of two fingerprints is the cosine of the
angle that their differing bits stand for, at least 0.

Permuted block tables find all fingerprints within a Hamming radius: bits are dealt into radius + extra blocks; for each
choice of `extra` blocks a table has the fingerprints with these blocks in front, and two within the radius agree in the
front of some table. first_near() gives each fingerprint the smallest id within the radius that way; neighbours() lists
the pairs themselves. Tables hold numbers; only members of fronts that several share carry their fingerprint along. A
front that very many share is dealt into chunks, each two of which meet in a tile of their own, so no task holds more
than 2 * HOT of them and no pair is lost. Of each chunk's members those that have found the smallest id are looked at no
further, so copies of one text cost few comparisons.

Cases. Null, empty and blank texts have fingerprint zero and are wholly like each other. Very long texts are hashed in
parts. Repeated rows and equal texts have equal fingerprints. Ids are whole numbers; others, as text, must spell some.
The next document is that of the next larger id (null: smallest), ties by text; after the last comes the first; a single
document is its own next. A null id is nobody's first_near unless no id is within the radius. An empty table gives no
rows. Only the id and text columns are read, so others can have any names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from parzelle.llm import common

BITS = 256
LANES = BITS // 64
HEAVIEST = 16
#: Terms whose bits are counted at once; words whose hash a worker keeps.
AT_ONCE, WORDS = 16_384, 400_000
LOWEST = -(1 << 63)
#: Bits in which near fingerprints differ at most; members of a front that a chunk has.
RADIUS, HOT = 7, 20_000


class Hasher:
    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def word(self, x: bytes) -> int:
        if (h := self.known.get(x)) is None:
            if len(self.known) >= WORDS:
                self.known.clear()
            h = self.known[x] = xxhash.xxh64_intdigest(x, 1)
        return h

    def votes(self, text: bytes) -> np.ndarray:
        """Signed sums of the bits."""
        words = text.lower().split()
        total = np.zeros(BITS)
        if not words:
            return total
        own = np.fromiter(map(self.word, words), np.uint64, len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        weight = np.minimum(sizes + np.append(0, sizes[:-1]), HEAVIEST).astype(np.float32)
        with np.errstate(over="ignore"):
            terms = own * np.uint64(0x9E3779B97F4A7C15) + np.append(np.uint64(0x1234567), own[:-1])
            for at in range(0, len(terms), AT_ONCE):
                x = terms[at : at + AT_ONCE, None] + np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(31)
                bits = np.unpackbits(x.view(np.uint8), axis=1)
                w = weight[at : at + AT_ONCE]
                total += 2 * (w @ bits.astype(np.float32)) - w.sum()
        return total

    def fingerprint(self, text: bytes) -> bytes:
        return np.packbits(self.votes(text) > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    apart = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return max(0.0, math.cos(math.pi * apart / (8 * len(a))))


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (binary)."""

    def make():
        hasher = Hasher()
        return lambda texts: {"fingerprint": [hasher.fingerprint(x) for x in common.as_bytes(texts)]}

    return common.map_texts(df, id_col, text_col, make, "fingerprint binary")


def _fronts(radius: int, extra: int, bits: int) -> list[np.ndarray]:
    """For each table a mask of 64-bit words."""
    n = radius + extra
    edges = [bits * i // n for i in range(n + 1)]
    blocks = [sum(1 << k for k in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [np.frombuffer(sum(c).to_bytes(bits // 8), np.uint64) for c in combinations(blocks, extra)]


def _words(column, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, bits // 64)


def tiled(prints: DataFrame, radius: int, extra: int, bits: int, hot: int) -> DataFrame:
    """Distinct fingerprints (node, fp, first) once for each tile (t, key, i, j) in which some other may be near."""
    masks = _fronts(radius, extra, bits)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, words = batch.column("node"), _words(batch.column("fp"), bits)
            for t, mask in enumerate(masks):
                with np.errstate(over="ignore"):
                    key = ((words & mask) * np.arange(3, 3 + 2 * len(mask), 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(axis=1, dtype=np.uint64)
                    key ^= key >> np.uint64(29)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, np.int32)), pa.array(key.view(np.int64)), node], names=["t", "key", "node"])

    keyed = prints.select("node", "fp").mapInArrow(keys, "t int, key long, node long")
    shared = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    dealt = common.pair_chunks(keyed.join(shared, ["t", "key"]), F.ceil(F.col("members") / hot), "node").drop("members")
    return dealt.join(prints, "node").repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "first", "node")


TILE = ["t", "key", "i", "j"]


def first_near(prints: DataFrame, radius: int = RADIUS, extra: int = 1, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """fp, n, first_near for a table of id and fp: how many rows have the fingerprint, and the smallest id within the radius."""
    folded = prints.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    folded = common.durable(folded.select(F.monotonically_increasing_id().alias("node"), "fp", "first", "n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.groups(batches, TILE):
            # a null id comes last: it may find others, but nobody finds it
            first = pc.fill_null(group["first"], 0).to_numpy()
            known = len(first) - group["first"].null_count
            order = np.concatenate([np.arange(len(first) - known, len(first)), np.arange(len(first) - known)])
            words, nodes = _words(group["fp"], bits)[order], group["node"].to_numpy()[order]
            ids = first[order]
            rest = np.arange(1, len(order))
            for x in range(known):
                rest = rest[np.searchsorted(rest, x, side="right") :]
                if not len(rest):
                    break
                hit = np.bitwise_count(words[rest] ^ words[x]).sum(axis=1, dtype=np.int64) <= radius
                if hit.any():
                    some = rest[hit]
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(np.full(len(some), ids[x]))], names=["node", "near"])
                    rest = rest[~hit]

    found = tiled(folded.select("node", "fp", "first"), radius, extra, bits, hot).mapInArrow(run, "node long, near long")
    best = found.groupBy("node").agg(F.min("near").alias("near"))
    return folded.join(best, "node", "left").select("fp", "n", F.least("first", "near").alias("first_near"))


def neighbours(prints: DataFrame, radius: int, extra: int = 1, bits: int = BITS, col: str = "fingerprint", hot: int = HOT) -> DataFrame:
    """a, b, apart: all pairs of distinct fingerprints (binary, a < b) that differ in at most radius bits.

    Pairs are as many as there are; for one row a document see first_near().
    """
    distinct = prints.where(F.col(col).isNotNull()).select(F.col(col).alias("fp")).distinct()
    numbered = common.durable(distinct.select(F.monotonically_increasing_id().alias("node"), "fp", F.lit(0).cast("long").alias("first")))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.groups(batches, TILE):
            words, prints_ = _words(group["fp"], bits), group["fp"].to_pylist()
            for x in range(len(words) - 1):
                apart = np.bitwise_count(words[x + 1 :] ^ words[x]).sum(axis=1, dtype=np.int64)
                some = np.flatnonzero(apart <= radius)
                if len(some):
                    each = [sorted((prints_[x], prints_[x + 1 + k])) for k in some]
                    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in each], pa.binary()), pa.array([p[1] for p in each], pa.binary()), pa.array(apart[some], pa.int32())], names=["a", "b", "apart"])

    return tiled(numbered, radius, extra, bits, hot).mapInArrow(pairs, "a binary, b binary, apart int").distinct()


#: Text of a bucket of neighbouring ids, on average at most, as a task sorts it.
BUCKET_BYTES = 256_000_000


def next_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bucket, head, id, key, text: documents in buckets of neighbouring ids, in order, each followed by the head of the next bucket (head = 1)."""
    doc = F.col(f"`{id_col}`")
    picked = df.select(doc.cast("long").alias("id"), F.coalesce(doc.cast("long"), F.lit(LOWEST)).alias("key"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    size = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    low, cuts = picked.agg(F.min("key"), F.percentile_approx("key", shares, 10 * parts)).first()
    # every cut is some document's key, so each bucket begins with its cut
    heads = np.unique(np.array([LOWEST if low is None else low, *(cuts or [])], dtype=np.int64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            bucket = np.searchsorted(heads, key, side="right") - 1
            first = np.flatnonzero(heads[bucket] == key)
            rows = np.append(np.arange(len(key)), first)
            to = np.append(bucket, (bucket[first] - 1) % len(heads))
            head = np.append(np.zeros(len(key), np.int32), np.ones(len(first), np.int32))
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(head, pa.int32()), *taken.columns], names=["bucket", "head", *batch.schema.names])

    dealt = picked.mapInArrow(deal, "bucket int, head int, id long, key long, text string")
    return dealt.repartitionById(len(heads), "bucket").sortWithinPartitions("bucket", "head", "key", "text")


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compared(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fp, edited_fp (binary), near_edited, near_next."""
    names = ["id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        before: tuple | None = None
        over: int | None = None
        for part in common.slices(batches, "text"):
            out: list[list] = [[] for _ in names]
            for bucket, head, doc, text in zip(*(part.column(c).to_pylist() for c in ("bucket", "head", "id", "text")), strict=True):
                if head and over == bucket:
                    continue  # further rows with the next bucket's first id
                print_ = hasher.fingerprint(text.encode())
                if before is not None and before[0] == bucket:
                    _, was, old, old_print = before
                    new = edited(old, text)
                    new_print = hasher.fingerprint(new.encode())
                    for column, x in zip(out, (was, len(old), hashlib.sha256(new.encode()).digest(), old_print, new_print, likeness(old_print, new_print), likeness(old_print, print_)), strict=True):
                        column.append(x)
                over = bucket if head else None
                before = None if head else (bucket, doc, text, print_)
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=names)

    return next_documents(df, id_col, text_col).mapInArrow(run, "id long, n_chars long, edited_sha256 binary, fp binary, edited_fp binary, near_edited double, near_next double")


def compare(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, extra: int = 1, hot: int = HOT) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, first_near: the smallest id of a document whose fingerprint is within the radius, itself included."""
    rows = common.durable(compared(df, id_col, text_col))
    out = common.join_unique(rows, first_near(rows.select("id", "fp"), radius, extra, hot=hot), "fp", "n")
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select(F.col("id").alias(id_col), "n_chars", text("edited_sha256"), F.lower(F.hex("fp")).alias("fingerprint"), F.lower(F.hex("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next", "first_near")
