"""Reading and writing tables: files by kind, text lists, JSON lookups, numbered chunks, kept results."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from parzelle.operators.relational import chunks
from parzelle.sources import files, layers


#: Character sets that Spark reads by itself.
CHARSETS = {"US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16BE", "UTF-16LE", "UTF-16", "UTF-32"}


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str | None = None, encoding: str = "UTF-8", sheet: str | None = None) -> DataFrame:
    """By ending: parquet, orc, json, txt, xlsx, shp, gpkg, tif, csv; sheet is a sheet's or layer's name. Without a schema all csv columns are strings; without a separator the header tells: the first of ; and , that it has. Other character sets, such as ISO-8859-15, are allowed in this session when one is asked for."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "xls":
        raise ValueError(f"convert .{kind} files to Parquet or CSV first")
    if kind == "gpkg":
        return layers.read_geopackage(spark, path, sheet)
    if kind in ("tif", "tiff"):
        return layers.read_raster(spark, path)
    if kind == "xlsx":
        return files.read_sheet(spark, path, sheet)
    if kind == "shp":
        return files.read_shapes(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "orc":
        return spark.read.orc(path)
    if kind == "json":
        return spark.read.json(path, schema=schema, multiLine=True)
    if kind == "txt":
        return spark.read.text(path)
    encoding = encoding.upper().replace("ISO ", "ISO-")
    if encoding not in CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    if sep is None:
        head = spark.read.option("encoding", encoding).text(path).limit(1).collect()
        sep = ";" if head and ";" in head[0][0] else ","
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", False)
    return (reader.schema(schema) if schema else reader).csv(path)


def text_lists(spark: SparkSession, pattern: str) -> DataFrame:
    """value, file: the lines of all files that a pattern fits."""
    return spark.read.text(pattern).select("value", F.input_file_name().alias("file"))


def kept(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is made and written if there is none at the path yet, and read from there. What an interrupted run left behind, without the mark of success, is made anew."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null, in all floating columns."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def write_csv(df: DataFrame, path: str, sep: str = ";", encoding: str = "UTF-8", null: str = "", digits: int | None = None, append: bool = False) -> None:
    """digits: how many places after the point floating numbers are written with."""
    encoding = encoding.upper().replace("ISO ", "ISO-")
    if encoding not in CHARSETS:
        df.sparkSession.conf.set("spark.sql.legacy.javaCharsets", "true")
    if digits is not None:
        df = df.withColumns({c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", c)) for c, t in df.dtypes if t in ("double", "float")})
    df.write.mode("append" if append else "overwrite").option("header", True).option("sep", sep).option("encoding", encoding).option("nullValue", null).csv(path)


def write_sheets(frames: dict[str, DataFrame], path: str) -> None:
    """A folder with a CSV table for each sheet, of any size. files.write_sheets() makes a single .xlsx file of small ones."""
    for name, df in frames.items():
        write_csv(df, f"{path.rstrip('/')}/{name}")


def append_lines(df: DataFrame, column: str, path: str) -> None:
    """Lines are added to a text folder."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("append").text(path)


def lookup(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a JSON object of strings or nested values (as JSON text)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def write_lookup(df: DataFrame, key: str, value: str, path: str) -> None:
    """A JSON object to a line for each key."""
    df.select(F.to_json(F.create_map(F.col(key).cast("string"), F.col(value))).alias("value")).write.mode("overwrite").text(path)


def write_dictionary(df: DataFrame, key: str, value: str, path: str) -> None:
    """A single JSON object, keys in order. It is one file, so one task writes it, entry by entry; of a key's rows the first counts."""
    entry = F.to_json(F.create_map(F.col(key).cast("string"), F.col(value)), {"ignoreNullFields": "false"})
    entries = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), entry.alias("value")).coalesce(1).sortWithinPartitions("key", "value")

    def lines(batches):
        before, last = "{", None
        for batch in batches:
            out = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != last:
                    out.append(before + text[1:-1])
                    before, last = ",", k
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["}"], pa.string())], names=["value"])

    out = df.sparkSession.createDataFrame([("{}",)], "value string") if entries.isEmpty() else entries.mapInArrow(lines, "value string")
    out.write.mode("overwrite").text(path)


def write_nested(df: DataFrame, outer: str, inner: str, value: str, path: str) -> None:
    """A single JSON object of objects, outer and inner keys in order. One file, so one task writes it, entry by entry; of rows of equal keys the first counts."""
    o, i = F.col(outer).cast("string").alias("o"), F.col(inner).cast("string").alias("i")
    entry = F.to_json(F.create_map(i, F.col(value)), {"ignoreNullFields": "false"}).alias("value")
    key = F.to_json(F.create_map(o, F.lit(0))).alias("key")
    entries = df.where(F.col(outer).isNotNull() & F.col(inner).isNotNull()).select(o, i, key, entry).coalesce(1).sortWithinPartitions("o", "i", "value")

    def lines(batches):
        last = None, None
        for batch in batches:
            out = []
            for o, i, key, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if o != last[0]:
                    out.append(("{" if last[0] is None else "},") + key[1:-2] + "{")
                if (o, i) != last:
                    out.append(("" if o != last[0] else ",") + text[1:-1])
                last = o, i
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["}}"], pa.string())], names=["value"])

    out = df.sparkSession.createDataFrame([("{}",)], "value string") if entries.isEmpty() else entries.mapInArrow(lines, "value string")
    out.write.mode("overwrite").text(path)


def nested_lookup(spark: SparkSession, path: str) -> DataFrame:
    """outer, inner, value of a JSON object of objects."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("outer", "m"))
    return whole.select("outer", F.explode("m").alias("inner", "value"))


def word_list(spark: SparkSession, path: str, extra: list[str] = (), longer_than: int = 2) -> DataFrame:
    words = spark.read.text(path).select(F.trim("value").alias("word")).where(F.length("word") > longer_than)
    return words.union(spark.createDataFrame([(w,) for w in extra], "word string")).distinct() if extra else words.distinct()


def write_chunks(df: DataFrame, column: str, path: str, size: int = 1000) -> None:
    """Distinct values, sorted, in numbered folders of a fixed number of lines."""
    chunks(df, column, size).select(F.col(column).cast("string").alias("value"), "chunk").repartition("chunk").sortWithinPartitions("chunk", "value").write.mode("overwrite").partitionBy("chunk").text(path)
