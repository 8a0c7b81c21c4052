"""Readers and writers of the formats that texts, logs and tables come in."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 25 << 20
#: Encodings in the order in which they are tried.
ENCODINGS = ["utf-8-sig", "gb18030", "big5"]


def decode(raw: bytes) -> str:
    """Text of bytes by the first encoding that fits, else with replacement characters."""
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            pass
    return raw.decode("utf-8", "replace")


def docx_text(raw: bytes) -> str:
    """Paragraphs of a DOCX file, one a line."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))


def manuals(spark: SparkSession, path: str) -> DataFrame:
    """``product`` (the file's name) and ``text`` of .md, .txt and .docx files up to 25 MB."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [docx_text(raw) if path.lower().endswith(".docx") else decode(raw) for path, raw in zip(b["path"], b["content"])]
            yield pd.DataFrame({"product": b["product"], "text": texts})

    files = spark.read.format("binaryFile").load(path).filter(F.col("length") <= MOST_BYTES)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    return files.filter(F.lower("path").rlike(r"\.(md|txt|docx)$")).select("path", "content", name.alias("product")).mapInPandas(run, "product string, text string")


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array in one file, or of JSON lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def keyed_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """``key`` and ``value`` of a JSON object; texts that say that they are errors are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))
    return rows.filter(~F.startswith("value", F.lit("__ERROR__"))) if value == "string" else rows


def captions(spark: SparkSession, path: str) -> DataFrame:
    """Image captions from an object keyed ``product|image_id``: rows with an id and some text."""
    rows = keyed_json(spark, path, "struct<product:string,image_id:string,short_caption:string,content:string,reason:string,category:string,section_fit:string>").select("value.*")
    text = F.array_join(F.filter(F.array("short_caption", "content", "reason"), lambda x: F.coalesce(x, F.lit("")) != ""), " ")
    return rows.withColumn("caption", text).filter("coalesce(image_id, '') <> '' AND caption <> ''")


def csv_table(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """A CSV file with a header and quoted line breaks, in any encoding that Python knows."""
    if encoding.lower() in ("utf-8", "utf8", "utf-8-sig"):
        return spark.read.csv(path, header=True, multiLine=True, escape='"')

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["content"]:
                rows = pd.read_csv(io.BytesIO(raw), encoding=encoding, dtype=str, keep_default_na=False)
                yield pd.DataFrame({"row": rows.to_dict("records")})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row map<string,string>")


def sse_done(body: Column) -> Column:
    """JSON of the ``done`` event of a server-sent-events body."""
    done = F.filter(F.split(F.regexp_replace(body, "\r\n", "\n"), "\n\n"), lambda e: e.rlike(r"(?m)^event:\s*done\s*$"))
    return F.regexp_replace(F.regexp_extract(F.element_at(F.concat(done, F.array(F.lit(""))), 1), r"(?s)data:\s*(.*)", 1), r"\ndata:\s*", "")


def append_log(rows: DataFrame, path: str, day: Column) -> None:
    """Append rows as JSON lines, in folders by day."""
    rows.withColumn("day", day).write.mode("append").partitionBy("day").json(path)


def not_yet_done(todo: DataFrame, spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rows whose key isn't in a log of JSON lines; lines that aren't JSON are ignored."""
    done = spark.read.schema(f"{key} {todo.schema[key].dataType.simpleString()}").option("mode", "PERMISSIVE").json(path)
    return todo.join(done.filter(F.col(key).isNotNull()), key, "left_anti")


def publish(tables: dict[str, DataFrame], root: str, version: int) -> None:
    """Write a version of all tables, then the row that makes it the current one."""
    spark = next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{root}/v{version}/{name}")
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{root}/current")


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the version that was made current last."""
    version = spark.read.parquet(f"{root}/current").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/v{version}/{name}")
