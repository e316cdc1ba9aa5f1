"""Range-partitioning into shards of nearly equal bytes, by sampled splitters.

Records are ordered by a key of 64 bits: the upper ones hash the group (equal texts lie together), then come some of the
id and of the row's number, so that a group of any size can be split, even one of copies of a single row. A size-weighted sample of keys, bounded in number, gives quantile
boundaries of many ranges; one pass counts each range's rows and bytes, and overfull ranges are subdivided. A range's
records are then ordered within it; with the bytes of the ranges before, each record knows where it starts in the whole
order, and the shard follows from the middle of the record. So shards differ by about one record, whatever the sample.

Only id, key, size and check sum are shuffled, no texts; a task holds one range at a time. The law is `bytes`, so a group
of equal texts that lies on the border of two shards is cut there: 2 of 583 groups on sf0.01.

Cases. Null texts are empty, of size 8. Repeated rows are records of their own, with keys of their own. Null ids are an id like any other. An
empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from parzelle.llm import common

#: Records in the sample, on average; ranges for each shard; a range above so many times the mean is subdivided.
SAMPLE, RANGES, OVERFULL = 16_384, 32, 4.0
#: Low bits of the key: from the id, and below them from the row's number, by which even copies of one row are told apart.
ID_BITS, COPY_BITS = 14, 12


def shard_key(group: Column, record: Column, copy: Column) -> Column:
    low, least = (1 << ID_BITS + COPY_BITS) - 1, (1 << COPY_BITS) - 1
    number = F.xxhash64(record).bitwiseAND(F.lit(low & ~least)).bitwiseOR(F.xxhash64(copy).bitwiseAND(F.lit(least)))
    return F.xxhash64(group).bitwiseAND(F.lit(~low)).bitwiseOR(number)


def split(keyed: DataFrame, shards: int) -> DataFrame:
    """keyed has id, size, key and others; adds shard and slot."""
    total, rows = keyed.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not rows:
        return keyed.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # a record is drawn with a chance in proportion to its size, decided by a hash: the same in each attempt
    chance = F.pmod(F.xxhash64(F.lit(7), "key", "id"), F.lit(1 << 40)) / float(1 << 40)
    drawn = sorted(r[0] for r in keyed.where(chance < F.col("size") * (SAMPLE / max(total, 1))).select("key").collect())
    cuts = np.unique(np.array(drawn, dtype=np.int64)[np.linspace(0, len(drawn) - 1, shards * RANGES).astype(int)]) if drawn else np.zeros(0, np.int64)
    limit = OVERFULL * total / (shards * RANGES)
    for _ in range(4):
        counted = _in_ranges(keyed, cuts).groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        over = [r for r in counted if r["bytes"] > limit and r["high"] > r["low"]]
        if not over:
            break
        new = [int(r["low"]) + (int(r["high"]) - int(r["low"]) + 1) * k // n for r in over for n in [int(r["bytes"] / limit * 2) + 2] for k in range(1, n)]
        cuts = np.unique(np.concatenate([cuts, np.array(new, dtype=np.int64)]))
    else:
        counted = _in_ranges(keyed, cuts).groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    counted.sort(key=lambda r: r["part"])
    before_bytes, before_rows, at = {}, {}, [0, 0]
    for r in counted:
        before_bytes[r["part"]], before_rows[r["part"]] = at
        at = [at[0] + r["bytes"], at[1] + r["rows"]]
    offsets = keyed.sparkSession.createDataFrame([(p, before_bytes[p], before_rows[p]) for p in before_bytes], "part int, bytes_before long, rows_before long")
    order = Window.partitionBy("part").orderBy("key", "id")
    within = _in_ranges(keyed, cuts).withColumns({"b": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), "r": F.row_number().over(order)})
    placed = within.join(F.broadcast(offsets), "part")
    start = F.coalesce(F.col("b"), F.lit(0)) + F.col("bytes_before")
    shard = F.least(F.lit(shards - 1), F.floor((start * 2 + F.col("size")) * float(shards) / (2.0 * total))).cast("int")
    placed = common.durable(placed.select(*keyed.columns, shard.alias("shard"), (F.col("r") + F.col("rows_before") - 1).alias("place")))
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("place").alias("first")).collect()}
    starts = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    return placed.select(*keyed.columns, "shard", (F.col("place") - starts[F.col("shard")]).alias("slot"))


def _in_ranges(keyed: DataFrame, cuts: np.ndarray) -> DataFrame:
    """Adds part, the number of cuts up to the key, found in two steps: among every n-th cut, then among the n that follow it."""
    if not len(cuts):
        return keyed.withColumn("part", F.lit(0))
    n = math.isqrt(len(cuts) - 1) + 1
    groups = [cuts[i : i + n].tolist() for i in range(0, len(cuts), n)]
    # constants as text, which Spark folds into literals
    heads = F.split(F.lit(",".join(str(g[0]) for g in groups)), ",").cast("array<bigint>")
    rest = F.from_json(F.lit(str(groups)), "array<array<bigint>>")
    upto = lambda values: F.size(F.filter(values, lambda cut: cut <= F.col("key")))
    with_group = keyed.withColumn("_g", upto(heads))
    part = F.when(F.col("_g") == 0, 0).otherwise((F.col("_g") - 1) * n + upto(F.get(rest, F.col("_g") - 1)))
    return with_group.withColumn("part", part.cast("int")).drop("_g")


def shard(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    doc = F.col(f"`{id_col}`")
    keyed = df.select(doc.alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), shard_key(text, doc.cast("string"), F.monotonically_increasing_id()).alias("key"))
    # the checkpoint fixes the rows' numbers, which each reading of the table may deal otherwise
    out = split(common.durable(keyed), shards)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
