"""Document sources: routing by extension, text with an encoding cascade, tables in text, duplicate skip, folder batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Readers by extension (fixed values). Those outside this module need optional libraries.
ROUTES = {"pdf": "pdf", "xlsx": "xlsx", "xls": "xls", "docx": "docx", "doc": "doc", "msg": "msg", "png": "image", "jpg": "image", "jpeg": "image", "md": "text", "txt": "text", "csv": "text", "tsv": "text", "rtf": "text"}
ENCODINGS = ("utf-8", "utf-8-sig", "latin-1", "cp1252")


def files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Files with path, content, size, extension, route and SHA-256."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return routed(rows)


def routed(rows: DataFrame) -> DataFrame:
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    routes = F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv])
    return rows.withColumns({"filename": F.regexp_extract("path", r"([^/]+)$", 1), "extension": extension}).withColumns({"route": F.try_element_at(routes, F.col("extension")), "file_hash": F.sha2("content", 256)})


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes as text by the first encoding that fits; a byte-order mark goes."""
    def one(data: bytes) -> str:
        for name in ENCODINGS:
            try:
                return bytes(data).decode(name).removeprefix("﻿")
            except UnicodeDecodeError:
                continue
        return ""

    return content.map(one)


def text_pages(rows: DataFrame) -> DataFrame:
    """Text files as documents of one page."""
    return rows.filter("route = 'text'").select("path", "filename", "file_hash", F.lit(1).alias("page_number"), decoded("content").alias("text"))


def without_known(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content isn't stored yet; of equal files the one of least path."""
    w = Window.partitionBy("file_hash").orderBy("path")
    return rows.join(known.select("file_hash").distinct(), "file_hash", "left_anti").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def tables_in_text(pages: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Runs of two or more lines with three or more cells and a digit, as tables of cells (cells part at tabs or two blanks)."""
    lines = pages.select(*key, F.posexplode(F.split(text, "\n")).alias("at", "line")).withColumn("cells", F.filter(F.split(F.trim("line"), r"\t+|\s{2,}|\s*\|\s*"), lambda c: c != ""))
    is_row: Column = (F.size("cells") >= 3) & F.col("line").rlike(r"\d")
    w = Window.partitionBy(*key).orderBy("at")
    rows = lines.withColumn("_row", is_row).withColumn("island", F.col("at") - F.sum(F.col("_row").cast("int")).over(w)).filter("_row")
    tables = rows.groupBy(*key, "island").agg(F.array_sort(F.collect_list(F.struct("at", "cells"))).alias("r")).filter(F.size("r") >= 2)
    return tables.select(*key, F.col("r")[0]["at"].alias("first_line"), F.transform("r", lambda x: x["cells"]).alias("rows"))
