"""CSV files with an unknown encoding."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.text import INTEGER, NUMERIC
from tablescope.plans.columns import col, per_column

# Texts that stand for a missing value.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]
TRUE_FALSE = ["True", "False", "TRUE", "FALSE", "true", "false"]


@dataclass
class LoadedCsv:
    """The table, the size of its files, and one row for each file: ``file_path, file_size, is_utf8, encoding``."""

    df: DataFrame
    size_mb: float
    files: DataFrame

    @property
    def latin1_files(self) -> list[str]:
        rows = self.files.filter("encoding = 'ISO-8859-1' AND NOT is_utf8").select("file_path").collect()
        return sorted(r["file_path"] for r in rows)


def file_encodings(spark: SparkSession, path: str) -> DataFrame:
    """``file_path, file_size, is_utf8, header, header_text`` per file: the header as its bytes and decoded.

    The text source hands over the bytes of each line as they are, so their validity can be tested directly. The
    read splits large files; the test combines on the map side to one row per file. The header is the first line of
    the split at the start of the file.
    """
    lines = spark.read.text(path)
    at_start = F.col("_metadata.file_block_start") == 0
    files = lines.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(
        F.max("_metadata.file_size").alias("file_size"),
        F.bool_and(F.is_valid_utf8("value")).alias("is_utf8"),
        F.first(F.when(at_start, F.col("value")), ignorenulls=True).alias("header"),
    )
    text = F.when(F.col("is_utf8"), F.col("header")).otherwise(F.decode(F.col("header").cast("binary"), "ISO-8859-1"))
    return files.select("file_path", "file_size", "is_utf8", "header", text.alias("header_text"))


def _header_names(line: str) -> list[str]:
    """Column names of a header line: unnamed columns and repeated names get their number, as the CSV reader gives them."""
    names = next(csv.reader([line]), [])
    seen = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if seen.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def _lines(spark: SparkSession, path: str, files: DataFrame, headers: list[str]) -> DataFrame:
    """All rows of the files as text columns, from one read of the lines.

    Each line meets the encoding and the header of its file, is decoded and parsed, and its fields go to the columns that the
    header names. The plan has a branch for each different header and none for files. Header lines are told by their text,
    so a file that repeats its header as data gets the repeated lines back from their number.
    """
    number = F.element_at(F.create_map(*[x for i, h in enumerate(headers) for x in (F.lit(h), F.lit(i))]), F.col("header_text"))
    known = files.filter(F.col("header_text").isNotNull()).select(
        "file_path", "is_utf8", "header", "header_text", number.alias("header_no")
    )
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_path"))
    # A look of its own, with one small row for each file that has a header; most files have their header once.
    repeated = text.join(known, "file_path").filter(F.col("value") == F.col("header"))
    repeated = repeated.groupBy("file_path").agg(F.count("*").alias("n"), F.first("header_text").alias("line"), F.first("header_no").alias("header_no"))
    repeated = repeated.filter("n > 1").persist(StorageLevel.MEMORY_AND_DISK)
    plain = F.when(F.col("is_utf8"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    rows = text.join(known, "file_path").select(plain.alias("line"), "header_text", "header_no")
    rows = rows.filter((F.col("line") != F.col("header_text")) & (F.trim("line") != "")).select("line", "header_no")
    again = repeated.select("line", "header_no", F.explode(F.sequence(F.lit(2).cast("long"), "n"))).select("line", "header_no")
    names = [_header_names(h) for h in headers]
    width = max(map(len, names))
    schema = ", ".join(f"c{i} string" for i in range(width))
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    parsed = rows.unionByName(again).select("header_no", F.from_csv("line", schema, options).alias("f"))
    columns = list(dict.fromkeys(n for found in names for n in found))
    chosen = []
    for name in columns:
        value = F.lit(None).cast("string")
        for i, found in enumerate(names):
            if name in found:
                value = F.when(F.col("header_no") == i, F.col(f"f.c{found.index(name)}")).otherwise(value)
        chosen.append(value.alias(name))
    return parsed.select(*chosen)


def _reader(spark: SparkSession, encoding: str, multi_line: bool):
    return spark.read.options(
        header=True, encoding=encoding, quote='"', escape='"', mode="PERMISSIVE", multiLine=multi_line
    )


def _with_types(df: DataFrame) -> DataFrame:
    """Texts for missing values become NULL, then each column gets the narrowest type that holds all its values:
    whole number, number, true/false, else text. Dates stay text. One aggregate looks at all columns."""
    df = df.select(*[F.when(~col(c).isin(MISSING_TEXTS), col(c)).alias(c) for c in df.columns])

    def measures(name: str) -> dict[str, Column]:
        value = col(name)
        whole = value.rlike(INTEGER) & F.trim(value).try_cast("bigint").isNotNull()
        return {
            "n": F.count(value),
            "whole": F.count_if(whole),
            "number": F.count_if(value.rlike(NUMERIC)),
            "logical": F.count_if(value.isin(TRUE_FALSE)),
        }

    types = {}
    for r in per_column(df, df.columns, measures, "n bigint, whole bigint, number bigint, logical bigint").collect():
        if r["whole"] == r["n"] and r["n"]:
            types[r["column"]] = "bigint"
        elif r["number"] == r["n"]:
            types[r["column"]] = "double"
        elif r["logical"] == r["n"]:
            types[r["column"]] = "boolean"
    return df.select(
        *[F.trim(col(c)).try_cast(types[c]).alias(c) if c in types else col(c) for c in df.columns]
    )


def load_csv(
    spark: SparkSession, path: str, encoding: str | None = None, infer_types: bool = True, multi_line: bool = False
) -> LoadedCsv:
    """Read CSV files with a header line; the encoding is found per file: UTF-8 if its bytes allow, else Latin-1.

    Any other encoding that the CSV reader knows can be named; one that has to be tried after Latin-1 would never be
    reached, since Latin-1 accepts every byte. ``multi_line`` allows line breaks inside quotes, at the price
    of files that are no longer split. The size is that of all files, in MB.

    Files may have their columns in different orders, or lack some: the columns meet by name. With the encoding left open, all
    lines are read as one table, and each is decoded and parsed by what is known of its file; no path reaches the driver and the
    plan grows with the different headers only. With ``multi_line`` or a named encoding, files of one encoding and header line are
    read together, and their paths are listed when there is more than one group.
    """
    found = file_encodings(spark, path)
    files = found.withColumn("encoding", F.lit(encoding)) if encoding else found.withColumn(
        "encoding", F.when(F.col("is_utf8"), "UTF-8").otherwise("ISO-8859-1")
    )
    files = files.persist(StorageLevel.MEMORY_AND_DISK)
    groups = files.groupBy("encoding", "header").agg(F.sum("file_size").alias("size"), F.first("header_text").alias("text")).collect()
    size = sum(g["size"] for g in groups)
    headers = sorted({g["text"] for g in groups if g["text"]})
    if not encoding and not multi_line and headers:
        df = _lines(spark, path, files, headers)
    else:
        df = _grouped(spark, path, files, len(groups), multi_line)
    return LoadedCsv(_with_types(df) if infer_types else df, round(size / (1024 * 1024), 2), files)


def _grouped(spark: SparkSession, path: str, files: DataFrame, groups: int, multi_line: bool) -> DataFrame:
    """The rows of the files from one CSV reader for each encoding and header line."""
    if groups <= 1:
        row = files.select("encoding").first()
        return _reader(spark, row["encoding"] if row else "UTF-8", multi_line).csv(path)
    listed = files.groupBy("encoding", "header").agg(F.sort_array(F.collect_list("file_path")).alias("paths"))
    parts = []
    for g in sorted(listed.collect(), key=lambda g: (g["encoding"] != "UTF-8", g["paths"])):
        if g["header"] is not None:  # an empty file has no columns
            parts.append(_reader(spark, g["encoding"], multi_line).csv(g["paths"]))
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part, allowMissingColumns=True)
    return df
