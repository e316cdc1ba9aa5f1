"""What the operators of this subpackage share: reading tables, streaming Arrow batches, durable cuts of lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from parzelle.operators.lineage import durable  # noqa: F401  (the operators here take it from this module)

#: Rows that one call of a batch function sees at most; texts of a call are in memory together.
BATCH_ROWS = 256
#: Bytes of text after which a call gets no further rows.
BATCH_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_unique(rows: DataFrame, named: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join with a table that has each key once, and in column n how many rows have it. Keys of over a thousandth
    of all rows, a thousand at most, are sent to all tasks, so that their rows aren't dealt by the key."""
    total = named.agg(F.sum(n)).first()[0] or 0
    hot = named.where(F.col(n) * 1000 > total)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(named.where(F.col(n) * 1000 <= total), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def as_bytes(texts: pa.Array) -> list[bytes]:
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def as_texts(texts: pa.Array) -> list[str]:
    return [x or "" for x in texts.to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that few rows and, but for single long ones, few bytes of the column are handled at once."""
    for batch in batches:
        col = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > BATCH_BYTES or i - start >= BATCH_ROWS):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def map_texts(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable], schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One output row for each input row: its id, columns to keep, then those that the batch function returns.

    make() runs once in each task and returns f(texts: pa.Array) -> dict of column name to values.
    """
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        types = None
        for part in slices(batches, "text"):
            found = f(part.column("text"))
            types = types or arrow_types(schema)
            cols = [part.column("id"), *(part.column(c) for c in keep), *(pa.array(found[n], type=t) for n, t in zip(names, types, strict=True))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", *keep, *names])

    picked = df.select(F.col(f"`{id_col}`").alias("id"), *keep, F.col(f"`{text_col}`").cast("string").alias("text"))
    first = ", ".join(f"{c} {picked.schema[c].dataType.simpleString()}" for c in ("id", *keep))
    return picked.mapInArrow(run, f"{first}, {schema}").withColumnRenamed("id", id_col)


def arrow_types(schema: str) -> list[pa.DataType]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return [kinds[part.split()[1]] for part in schema.split(",")]


def pair_chunks(members: DataFrame, chunks, by: str) -> DataFrame:
    """Each member with the tiles (i, j) of its group that it belongs to: one if the group is a single chunk."""
    dealt = members.withColumns({"chunks": chunks, "chunk": F.pmod(F.xxhash64(by), chunks)})
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(F.col("chunks") - 1, F.lit(1))))).where("chunk <> other")
    return dealt.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).drop("chunks", "chunk", "other")


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each group, together; rows come sorted by the keys. One group is held, and a batch."""
    held: pa.Table | None = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, new]) if held is not None else new
        cols = [held[c].to_numpy() for c in keys]
        starts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1).tolist()]
        for a, b in zip(starts, starts[1:], strict=False):
            yield held.slice(a, b - a)
        held = held.slice(starts[-1])
    if held is not None and len(held):
        yield held
