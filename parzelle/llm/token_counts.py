"""Exact histogram of encoded lengths, with suffix sums over it.

Each text is encoded once and its length alone goes into a partial count, so the shuffle holds a row for each distinct
length of a task. Suffix sums run in two levels: within ranges of lengths, and over the ranges' totals, so that no task
has to see all lengths. From the row of length n one reads, for the context limit n: documents at or beyond it, their
tokens, and the tokens that are left when all are truncated to n. Between two listed lengths m < n the documents beyond
don't change, so the truncated total at any limit c, m <= c <= n, is that of m plus (c - m) times docs_ge of n.

Cases. Null and empty texts have length 0. Very long texts are encoded whole. Repeated rows and ties count each. An empty
table gives no rows. Only the id and text columns are read, so others can have any names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from parzelle.llm import bpe, common

#: Lengths in a range of the first level.
RANGE = 1024


def lengths(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens."""

    def make():
        encode = bpe.library(path, pattern).encode_ordinary

        def run(texts: pa.Array) -> dict:
            return {"n_tokens": [len(encode(t)) for t in common.as_texts(texts)]}

        return run

    return common.map_texts(df, id_col, text_col, make, "n_tokens long")


def histogram(counted: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """For each length: docs, docs_ge and tokens_ge at or beyond it, truncated_total at that limit, share_le of documents at most as long (the quantile that the length answers)."""
    by = counted.groupBy(F.col(length_col).alias("n_tokens")).agg(F.count(F.lit(1)).alias("docs")).withColumn("part", F.floor(F.col("n_tokens") / RANGE).cast("long"))
    by = common.durable(by)  # read twice below; without this the texts would be encoded twice
    ranges = by.groupBy("part").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t"))
    after = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(1))
    ranges = ranges.select("part", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"), F.sum("d").over(all_rows).alias("d_all"), F.sum("t").over(all_rows).alias("t_all"))
    within = Window.partitionBy("part").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs_ge = F.sum("docs").over(within) + F.col("d_after")
    tokens_ge = F.sum(F.col("docs") * F.col("n_tokens")).over(within) + F.col("t_after")
    return (
        by.join(ranges, "part")
        .withColumns({"docs_ge": docs_ge, "tokens_ge": tokens_ge})
        .select("n_tokens", "docs", "docs_ge", "tokens_ge", (F.col("t_all") - F.col("tokens_ge") + F.col("docs_ge") * F.col("n_tokens")).alias("truncated_total"), ((F.col("d_all") - F.col("docs_ge") + F.col("docs")) / F.col("d_all")).alias("share_le"))
    )
