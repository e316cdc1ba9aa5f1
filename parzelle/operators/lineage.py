"""Durable cuts of lineage, for plans that are read more than once or grow in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Only a local master may do without: it gets a temporary folder, which all its tasks can see."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in that folder."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """As durable(), but a table in that folder. For rounds of joins: a checkpoint keeps the size
    that was estimated for its plan, in which each join multiplies its sides, so a few rounds on the estimate has so many
    digits that planning takes longer than the work; and it computes the last step twice. The table is written plainly, so
    that the size of its files, by which Spark chooses joins, is that of its rows."""
    path = f"{_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> tuple[DataFrame, int]:
    """The table() of these rows, and its number of rows."""
    found = table(df)
    return found, found.count()
