"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: Bytes of text that the vectorised helpers take at a time; bounds their memory.
SLICE_BYTES = 2 << 20
#: Keys of more than one row in so many are hot.
HOT_SHARE = 1000


def work_dir(spark: SparkSession) -> str:
    """A folder of this application's own in ``spark.checkpoint.dir``, which driver and executors share.

    Where the session names none, a local folder is made in local mode (as in tests), and
    anywhere else it is an error.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/docloom-{context.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it again.

    Cuts the lineage: losing an executor never repeats what made the table, and numbers that
    were given to its rows stay theirs. ``discard`` deletes it, ``clear`` all of them.
    """
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, t.staged_at)


def clear(spark: SparkSession) -> None:
    """Delete all staged tables of this application; call it when results have been written."""
    _delete(spark, work_dir(spark))


def with_facts(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row for each key and in ``weight`` how many of the ``total`` rows have it.

    Keys of more than a thousandth of the rows are hot: there are a thousand at most, so
    they are broadcast and their rows stay where they are. The others are shuffled, by the
    same plan at every size.
    """
    hot = F.broadcast(facts.filter(F.col(weight) * HOT_SHARE > total))
    rest = rows.join(hot.select(key), key, "left_anti").join(facts.filter(F.col(weight) * HOT_SHARE <= total).hint("merge"), key)
    return rows.join(hot, key).unionByName(rest)


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows``, a staged table, with ``pos``, from 0 in each ``group`` by ``order`` (nulls first), and ``n``, the rows of the group.

    Sorted by ranges, so a group of any size is spread over tasks; what the tasks have of each
    group is summed up, a row for each task that has any. Of equal rows any may come first.
    ``group`` has no nulls. The table it stages is ``numbered_at`` of the result.
    """
    tie, keys = F.col("tie"), [F.col(group).asc(), *(F.col(c).asc_nulls_first() for c in order)]
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys, tie).sortWithinPartitions(*keys, tie).drop("tie")
    placed = staged(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), name)
    so_far = Window.partitionBy(group).orderBy("part")
    parts = placed.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("m"))
    parts = parts.select(group, "part", (F.sum("m").over(so_far) - F.col("m") - F.col("first")).alias("shift"), F.sum("m").over(Window.partitionBy(group)).alias("n"))
    out = placed.join(parts.hint("merge"), [group, "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")
    out.numbered_at = placed
    return out


def crc(number: str) -> str:
    """DuckDB's SQL for the unsigned crc32 of a number's decimal digits."""
    bits = "[CAST(1 AS BIGINT), 2, 3, 4, 5, 6, 7, 8]"
    return (
        f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), "
        f"lambda c, b: list_reduce(list_prepend(xor(c, b), {bits}), lambda v, u: xor(v >> 1, (v & 1) * 3988292384))))"
    )


def named(column: str) -> Column:
    """The column of just this name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def beside(rows: DataFrame, column: str, results: dict[str, DataType], run: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]]) -> DataFrame:
    """``rows`` with ``results``, which ``run`` gives for the batches' column ``judged``, together with the batch.

    All other columns go through the worker in one struct by place, so they may have any names; those
    that have a result's name are replaced.
    """
    others = [c for c in rows.columns if c != column]
    at = {c: i for i, c in enumerate(others)}
    carried = F.struct(F.lit(0).alias("c"), *(named(c).alias(f"c{i}") for i, c in enumerate(others))).alias("carried")
    packed_rows = rows.select(carried, named(column).alias("judged"))
    schema = StructType(list(packed_rows.schema.fields))
    for i, kind in enumerate(results.values()):
        schema = schema.add(f"r{i}", kind)
    names = schema.names

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in run(batches):
            yield pa.RecordBatch.from_arrays([part.column("carried"), part.column("judged"), *found], names=names)

    kept = [(F.col("judged") if c == column else F.col(f"carried.c{at[c]}")).alias(c) for c in rows.columns if c not in results]
    return packed_rows.mapInArrow(go, schema).select(*kept, *(F.col(f"r{i}").alias(r) for i, r in enumerate(results)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, one after the other, and the n + 1 offsets. Null: empty."""
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    buffers = col.buffers()
    off = np.frombuffer(buffers[1], np.int64, len(col) + 1, 8 * col.offset) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def binary_array(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """The other way round: an Arrow array over ``data`` cut at ``off``, without copying."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    )


def tidy() -> None:
    """Give freed memory back to the system; a worker lives on, and the next task may be another operator's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in order, in parts whose texts have at most ``most`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_bytes(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(off, off[begin] + most, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end
    tidy()


def per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags are set between each two offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes that don't cross texts: starts, ends and the row of each."""
    before = np.zeros(len(data), bool)
    before[1:] = is_word[:-1]
    before[off[:-1][off[:-1] < len(data)]] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = is_word[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def packed(data: np.ndarray, is_word: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The words' bytes as an Arrow array."""
    kept = data[is_word]
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(is_word, out=at[1:])
    return binary_array(kept, np.append(at[starts], len(kept)))


def lookup(chars: bytes | range) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: Bytes that are not in words ``[^\x20\x09-\x0D]+``.
SPACE = lookup(b" \t\n\x0b\x0c\r")
