"""SimHash near-duplicates: fingerprints of word shingles, links by pivot distance tables, classes.

Words are stretches without ASCII white space, A-Z lower-cased; a shingle is `words` neighbouring ones, space-joined
(fewer words: all of them). A bit of the fingerprint is set if it is set in over half of the shingles' XXH64 hashes.
Documents link if their fingerprints differ in few bits, and form classes by chains of links.

Only ids and fingerprints are shuffled. Copies are folded to one fingerprint before pairs are sought.

Cases. Null, empty and blank texts have fingerprint zero, which links like any other. Very long texts are hashed in
parts. Repeated rows are one class. A null id never names a class unless all its members' ids are null. An empty table gives no rows. Only the id and text
columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from parzelle.llm import common, hamming

WORDS, RADIUS, SEED = 4, 4, 42
#: Hashes whose bits are counted at once.
AT_ONCE = 65_536


def shingle_hashes(text: bytes, words: int, seed: int) -> list[int]:
    parts = text.lower().split()  # bytes: A-Z alone, and the white space of the definition
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(parts), seed)] if parts else []
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=False)]


def simhash(hashes: list[int]) -> int:
    """Signed."""
    if not hashes:
        return 0
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        part = np.array(hashes[at : at + AT_ONCE], dtype=">u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes)).view(">i8")[0])


def fingerprints(df: DataFrame, words: int = WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (long)."""

    def make():
        def run(texts: pa.Array) -> dict:
            return {"fp": [simhash(shingle_hashes(t, words, seed)) for t in common.as_bytes(texts)]}

        return run

    return common.map_texts(df, id_col, text_col, make, "fp long")


def classes(prints: DataFrame, radius: int = RADIUS, extra: int | None = None, hot: int = hamming.HOT, id_col: str = "doc_id") -> DataFrame:
    """id, fp, component_id (the smallest id reachable) for a table of id and fp."""
    folded = common.durable(prints.groupBy("fp").agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("n")))
    extra = extra or hamming.extra_blocks(folded.count(), radius)
    member = hamming.components(hamming.links(folded.select("fp"), radius, extra, hot))
    known = folded.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = known.join(heads, "root").select("fp", "n", "component_id")
    return common.join_unique(prints, named, "fp", "n").select(F.col(id_col), "fp", "component_id")


def near_duplicates(df: DataFrame, words: int = WORDS, radius: int = RADIUS, extra: int | None = None, hot: int = hamming.HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp, component_id."""
    return classes(common.durable(fingerprints(df, words, SEED, id_col, text_col)), radius, extra, hot, id_col)


def hexadecimal(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
