"""Publication of tables in versions, with a digest of every file, and what is still to be indexed.

A version's tables are written first, then its manifest, with length and SHA-256 of each file;
then the files are read again and held against it. Only a version without a fault becomes
the current one, by one more row in the history, which Spark commits as a whole. So whoever reads
sees the old version or the new one, and a job that dies between leaves the old one and a version
that the next attempt overwrites. ``restore`` holds an older version against its manifest and
makes it the current one by one more row; nothing is copied and nothing deleted.

The history has ``seq``, ``action`` (``publish``, ``restore``, ``built``), ``version`` and ``product``. A product is pending from when
it was published or restored until an index was built. One writer publishes at a time: the history's rows
are numbered by who adds them.

Nulls and ties: a null product is one that is pending as null. Tables without rows are published like
others. Publishing nothing is an error.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import SECTIONS, sections, shared_dir

HISTORY = "seq bigint, action string, version bigint, product string"
#: Rows of a file, so that one fits a task that hashes it.
FILE_ROWS = 1_000_000


class Refused(Exception):
    """A version that isn't as its manifest says."""


def history(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(HISTORY).parquet(f"{root}/history")
    except AnalysisException:
        return spark.createDataFrame([], HISTORY)


def _latest(spark: SparkSession, root: str) -> tuple[int, int | None, int]:
    """The last number of the history, the current version, and the largest."""
    r = history(spark, root).agg(F.max("seq").alias("seq"), F.max_by("version", F.when(F.col("action") != "built", F.col("seq"))).alias("now"), F.max("version").alias("most")).first()
    return r.seq or 0, r.now, r.most or 0


def _note(spark: SparkSession, root: str, action: str, version: int | None, products: list) -> None:
    seq = _latest(spark, root)[0] + 1
    spark.createDataFrame([(seq, action, version, p) for p in products], HISTORY).coalesce(1).write.mode("append").parquet(f"{root}/history")


def _files(spark: SparkSession, root: str, version: int) -> DataFrame:
    """Table, file, length and SHA-256 of all files of a version."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(f"{root}/v{version}/tables")
    path = F.split("path", "/")
    return files.select(F.element_at(path, -2).alias("name"), F.element_at(path, -1).alias("file"), F.length("content").cast("long").alias("length"), F.sha2("content", 256).alias("sha256"))


def _manifest(spark: SparkSession, root: str, version: int) -> DataFrame:
    """``_files`` as one file's rows; the files are hashed before, each by a task of its own partition."""
    return _files(spark, root, version).repartition(1)


def stage(tables: dict[str, DataFrame], root: str, version: int) -> None:
    """Write a version's tables, then its manifest. Nobody reads them yet."""
    if not tables:
        raise ValueError("nothing to publish")
    spark = next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        rows.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{root}/v{version}/tables/{name}")
    _manifest(spark, root, version).write.mode("overwrite").parquet(f"{root}/v{version}/manifest")


def faults(spark: SparkSession, root: str, version: int) -> DataFrame:
    """Files (name, file, fault) of a version that are ``missing``, ``changed`` or ``added`` since its manifest was written."""
    said = spark.read.parquet(f"{root}/v{version}/manifest").select("name", "file", F.struct("length", "sha256").alias("said"))
    there = _files(spark, root, version).select("name", "file", F.struct("length", "sha256").alias("there"))
    fault = F.when(F.col("there").isNull(), "missing").when(F.col("said").isNull(), "added").when(F.col("said") != F.col("there"), "changed")
    return said.join(there, ["name", "file"], "full").select("name", "file", fault.alias("fault")).filter("fault IS NOT NULL")


def digests(spark: SparkSession, root: str, version: int) -> DataFrame:
    """One SHA-256 for each table of a version, of its files' digests in order."""
    rows = spark.read.parquet(f"{root}/v{version}/manifest")
    return rows.groupBy("name").agg(F.count("*").alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256).alias("sha256"))


def _point(spark: SparkSession, root: str, action: str, version: int, products: list) -> None:
    found = faults(spark, root, version).limit(20).collect()
    if found:
        raise Refused(f"version {version}: " + ", ".join(f"{r.name}/{r.file} {r.fault}" for r in found))
    _note(spark, root, action, version, products)


def publish(tables: dict[str, DataFrame], root: str, products: list) -> int:
    """A new version of all ``tables``, of which ``products`` are new or changed; gives its number."""
    if not products:
        raise ValueError("nothing to publish")
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.active()
    version = _latest(spark, root)[2] + 1
    stage(tables, root, version)
    _point(spark, root, "publish", version, products)
    return version


def restore(spark: SparkSession, root: str, version: int) -> None:
    """Make an older version the current one, if its files are what they were; the products published since are pending again."""
    known = history(spark, root)
    if not known.filter((F.col("action") == "publish") & (F.col("version") == version)).limit(1).count():
        raise Refused(f"version {version} was never published")
    seq = known.filter((F.col("action") == "publish") & (F.col("version") == version)).agg(F.min("seq")).first()[0]
    after = [r.product for r in known.filter((F.col("action") == "publish") & (F.col("seq") > seq)).select("product").distinct().orderBy("product").collect()]
    own = [r.product for r in known.filter((F.col("action") == "publish") & (F.col("seq") == seq)).select("product").distinct().orderBy("product").collect()]
    _point(spark, root, "restore", version, after or own)


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the current version."""
    version = _latest(spark, root)[1]
    if version is None:
        raise Refused("nothing was published")
    return spark.read.parquet(f"{root}/v{version}/tables/{name}")


def pending(spark: SparkSession, root: str) -> DataFrame:
    """Products that came or changed since an index was built."""
    rows = history(spark, root)
    built = rows.filter("action = 'built'").agg(F.coalesce(F.max("seq"), F.lit(0).cast("long")).alias("built"))
    return rows.join(F.broadcast(built)).filter("action <> 'built' AND seq > built").select("product").distinct()


def mark_built(spark: SparkSession, root: str) -> None:
    """An index of the current version was built: nothing is pending."""
    _note(spark, root, "built", _latest(spark, root)[1], [None])


def _published(s, d) -> DataFrame:
    """Sections through three versions, of which the second is restored after an index was built and a third came."""
    root, rows = f"{shared_dir(s)}/publication-{uuid.uuid4().hex}", sections(s, d).select("doc_id", "section_id", "product", "text")
    publish({"sections": rows.filter("product <> 'src3'"), "products": rows.filter("product <> 'src3'").select("product").distinct()}, root, ["src0"])
    publish({"sections": rows, "products": rows.select("product").distinct()}, root, ["src3"])
    mark_built(s, root)
    publish({"sections": rows.filter("doc_id % 2 = 0"), "products": rows.select("product").distinct()}, root, ["src1", "src2"])
    restore(s, root, 2)
    counts = current(s, root, "sections").groupBy("product").agg(F.count("*").alias("sections"), F.sum(F.length("text")).alias("chars"))
    waiting = pending(s, root).withColumn("pending", F.lit(True))
    return counts.join(waiting, "product", "left").select("product", "sections", "chars", F.coalesce("pending", F.lit(False)).alias("pending"))


QUERIES = {
    "published_sections": (
        _published,
        f"WITH {SECTIONS} SELECT product, count(*) AS sections, CAST(sum(char_len) AS BIGINT) AS chars, product IN ('src1', 'src2') AS pending FROM sections GROUP BY product",
    ),
}
