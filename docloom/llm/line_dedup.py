"""Line dedup that can be taken back.

A line's key is the line without blanks at both ends, A-Z in small letters. A table of exact
reference counts has, for each key, in how many documents it stands; adding documents adds
to it, and deleting documents subtracts the same, so any history of both leaves the counts
of the documents that are left. Keys with enough documents are frequent and lose all their
lines.

Keys are 128 bits of a hash. They are dealt to shards by their first bits, about
``SHARD_KEYS`` to each. A shard's frequent keys are fingerprints in a cuckoo filter of its
own, where they can be inserted and deleted one by one. The filter alone would be wrong for
few keys; all keys of a shard are probed where its counts lie, and those that it takes
falsely are stored beside it. So filter and exceptions decide every counted key exactly, at
some two bytes for a frequent one.

While all filters together have at most ``MOST_BYTES``, tasks get them whole and texts stay
where they are. Beyond, the distinct keys of each text meet the frequent keys by a join
(those in over a thousandth of the documents by broadcast), and what a text loses meets the
texts. Both give the same rows.

Nulls, ties and odd tables: a null or empty text is one empty line; an empty key is never
frequent, whatever ``least_chars``. Each row is a document, so repeated rows and null ids
count one by one; lines that repeat in a text count once for it and go together. A text of
any length is one row, at some fifty bytes for each of its own. An empty table gives no rows.
Other columns may have any names: they are carried by place, and the operator's own results
stand behind them. Deleting what was never added is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import SPACE, discard, named, slices, staged, text_bytes, with_facts

#: Documents that make a key frequent, and code points that a key has at least.
LEAST_DOCS, LEAST_CHARS = 10, 1
#: Counted keys that a shard has, about.
SHARD_KEYS = 1 << 14
#: Bytes of filters that tasks get whole.
MOST_BYTES = 32 << 20
#: Slots of a bucket, share of slots that are filled at most when a filter is made, moves before it is made anew.
SLOTS, LOAD, MOVES = 4, 0.84, 500
#: An odd number that spreads fingerprints over buckets.
SPREAD = 0x5BD1E995

RESULTS = {"n_lines": "long", "n_dropped": "long", "kept_sha256": "string"}


class Cuckoo:
    """A cuckoo filter over keys of two 64-bit numbers: 16-bit fingerprints in one of two buckets."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.mask = buckets - 1
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def of(cls, keys: list[tuple[int, int]]) -> Cuckoo:
        """A filter of all the keys, as small as they fit."""
        buckets = 1
        while buckets * SLOTS * LOAD < len(keys):
            buckets *= 2
        while True:
            made = cls(buckets)
            if all(made.insert(hi, lo) for hi, lo in keys):
                return made
            buckets *= 2

    def places(self, hi: int, lo: int) -> tuple[int, int, int]:
        mark = lo & 0xFFFF or 1
        home = hi & self.mask
        return mark, home, self.across(home, mark)

    def across(self, bucket: int, mark: int) -> int:
        return (bucket ^ mark * SPREAD) & self.mask

    def insert(self, hi: int, lo: int) -> bool:
        """False where no slot was found; the filter is then spoilt."""
        mark, home, other = self.places(hi, lo)
        for bucket in (home, other):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        bucket = other
        for move in range(MOVES):
            slot = move % SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = self.across(bucket, mark)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        return False

    def delete(self, hi: int, lo: int) -> None:
        mark, home, other = self.places(hi, lo)
        for bucket in (home, other):
            at = np.flatnonzero(self.table[bucket] == mark)
            if len(at):
                self.table[bucket, at[0]] = 0
                return
        raise KeyError("a key that isn't in the filter")


def hits(table: np.ndarray, base: np.ndarray, mask: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Which keys a filter takes; ``base`` and ``mask`` tell where in ``table`` each key's filter is and its size."""
    mark = lo & np.uint64(0xFFFF)
    mark[mark == 0] = 1
    home = hi & mask
    other = (home ^ mark * np.uint64(SPREAD)) & mask
    mark = mark.astype(np.uint16)[:, None]
    return (table[base + home] == mark).any(axis=1) | (table[base + other] == mark).any(axis=1)


class Lines(NamedTuple):
    """The lines of a column's texts: where each begins and ends, its row, its key, and whether the key counts."""

    data: np.ndarray
    off: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hi: np.ndarray
    lo: np.ndarray
    counts: np.ndarray


def lines_of(texts: pa.Array, least_chars: int) -> Lines:
    data, off = text_bytes(texts)
    cuts = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([off[:-1], cuts + 1]), kind="stable")
    row = np.searchsorted(cuts, off[:-1])  # lines before a text: its number, and a line break for each of theirs
    n_lines = np.diff(np.append(row, np.searchsorted(cuts, off[-1]))) + 1
    row = np.repeat(np.arange(len(off) - 1), n_lines)
    last = np.zeros(len(begin), bool)
    last[np.cumsum(n_lines) - 1] = True
    end = np.where(last, off[1:][row], np.append(begin[1:], 0) - 1)
    solid = np.flatnonzero(~SPACE[data])
    a, b = np.searchsorted(solid, begin), np.searchsorted(solid, end)
    full = a < b
    first, after = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    first[full], after[full] = solid[a[full]], solid[b[full] - 1] + 1
    small = data.copy()
    small[(data >= 65) & (data <= 90)] += 32
    view = small.tobytes()
    digests = b"".join([xxhash.xxh3_128_digest(view[i:j]) for i, j in zip(first.tolist(), after.tolist(), strict=True)])
    keys = np.frombuffer(digests, "<u8").reshape(-1, 2)
    counts = full
    if least_chars > 1:
        heads = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
        counts = full & (heads[after] - heads[first] >= least_chars)
    return Lines(data, off, begin, end, row, keys[:, 0].copy(), keys[:, 1].copy(), counts)


def distinct_keys(lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and key of each distinct key of each text that counts."""
    at = np.flatnonzero(lines.counts)
    at = at[np.lexsort((lines.lo[at], lines.hi[at], lines.row[at]))]
    row, hi, lo = lines.row[at], lines.hi[at], lines.lo[at]
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    return row[new], hi[new], lo[new]


def references(docs: DataFrame, text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """``hi`` and ``lo``, a key, and ``refs``, the documents that have it. Counted within batches first, then by task, then by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            _, hi, lo = distinct_keys(lines_of(part.column("text"), least_chars))
            order = np.lexsort((lo, hi))
            hi, lo = hi[order], lo[order]
            new = np.ones(len(hi), bool)
            new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
            at = np.flatnonzero(new)
            refs = np.diff(np.append(at, len(hi)))
            yield pa.RecordBatch.from_arrays([pa.array(hi[at].view(np.int64)), pa.array(lo[at].view(np.int64)), pa.array(refs.astype(np.int64))], names=["hi", "lo", "refs"])

    counted = docs.select(named(text).alias("text")).mapInArrow(run, "hi bigint, lo bigint, refs bigint")
    return counted.groupBy("hi", "lo").agg(F.sum("refs").alias("refs"))


class Index(NamedTuple):
    """The counts, the filters made of them, the bits of a key that are its shard's number, and the limits they hold for."""

    refs: DataFrame
    filters: DataFrame
    bits: int
    least_docs: int
    least_chars: int


FILTER = "shard bigint, buckets int, marks binary, wrong binary"


def _shard(bits: int):
    return (F.shiftrightunsigned("hi", 64 - bits) if bits else F.lit(0)).cast("long").alias("shard")


def _row(shard: int, made: Cuckoo, hi: np.ndarray, lo: np.ndarray, rare: np.ndarray) -> pa.Table:
    """A shard's filter with the rare keys that it takes falsely."""
    at = np.flatnonzero(rare)
    zero = np.zeros(len(at), np.uint64)
    at = at[hits(made.table, zero, zero + np.uint64(made.mask), hi[at], lo[at])]
    wrong = np.column_stack([hi[at], lo[at]]).astype("<u8").tobytes()
    return pa.table(
        {"shard": pa.array([shard], pa.int64()), "buckets": pa.array([made.mask + 1], pa.int32()), "marks": pa.array([made.table.astype("<u2").tobytes()], pa.binary()), "wrong": pa.array([wrong], pa.binary())}
    )


def _numbers(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Keys in order, so that the same keys make the same filter."""
    columns = [table.column(c).to_numpy() for c in table.column_names if c != "shard"]
    hi, lo = (c.view(np.uint64) for c in columns[:2])
    order = np.lexsort((lo, hi))
    return hi[order], lo[order], *(c[order] for c in columns[2:])


def _pairs(hi: np.ndarray, lo: np.ndarray, which: np.ndarray) -> list[tuple[int, int]]:
    return list(zip(hi[which].tolist(), lo[which].tolist(), strict=True))


def filtered(refs: DataFrame, bits: int, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row for each shard that has keys: its filter and the keys that the filter takes falsely."""

    def make(table: pa.Table) -> pa.Table:
        hi, lo, n = _numbers(table)
        return _row(table.column("shard")[0].as_py(), Cuckoo.of(_pairs(hi, lo, n >= least_docs)), hi, lo, n < least_docs)

    return refs.select("hi", "lo", "refs", _shard(bits)).groupBy("shard").applyInArrow(make, FILTER)


def built(docs: DataFrame, text: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, shard_keys: int = SHARD_KEYS) -> Index:
    """Counts and filters of the documents."""
    refs = staged(references(docs, text, least_chars), "line-refs")
    bits = max(0, (max(1, refs.count()) - 1) // shard_keys).bit_length()
    return Index(refs, staged(filtered(refs, bits, least_docs), "line-filters"), bits, least_docs, least_chars)


def updated(index: Index, added: DataFrame | None = None, removed: DataFrame | None = None, text: str = "text", shard_keys: int = SHARD_KEYS) -> Index:
    """The index after documents came and went; that of before stays as it is, so nothing is lost if this fails.

    Filters of shards take in and give up only keys that crossed the limit. A filter that has
    no room is made anew from its shard's counts, all are once shards have four times their keys.
    """
    before = index.refs.select("hi", "lo", "refs", F.lit(0).cast("long").alias("change"))
    for docs, sign in ((added, 1), (removed, -1)):
        if docs is not None:
            before = before.unionByName(references(docs, text, index.least_chars).select("hi", "lo", F.lit(0).cast("long").alias("refs"), (F.col("refs") * sign).alias("change")))
    both = staged(before.groupBy("hi", "lo").agg(F.sum("refs").alias("refs"), F.sum("change").alias("change")), "line-changes")
    after = F.when(F.col("refs") + F.col("change") < 0, F.raise_error(F.lit("a document is deleted that was never added")).cast("long")).otherwise(F.col("refs") + F.col("change"))
    refs = staged(both.select("hi", "lo", after.alias("refs")).filter("refs > 0"), "line-refs")
    bits = max(0, (max(1, refs.count()) - 1) // shard_keys).bit_length()
    if bits > index.bits + 2:
        discard(both)
        return Index(refs, staged(filtered(refs, bits, index.least_docs), "line-filters"), bits, index.least_docs, index.least_chars)
    least = index.least_docs

    def change(old: pa.Table, rows: pa.Table) -> pa.Table:
        hi, lo, n, more = _numbers(rows.select(["shard", "hi", "lo", "refs", "change"]))
        shard, came, went = rows.column("shard")[0].as_py(), (n < least) & (n + more >= least), (n >= least) & (n + more < least)
        made = Cuckoo(1)
        if old.num_rows:
            made = Cuckoo(old.column("buckets")[0].as_py(), np.frombuffer(old.column("marks")[0].as_py(), "<u2").reshape(-1, SLOTS).astype(np.uint16))
        for key in _pairs(hi, lo, went):
            made.delete(*key)
        if not all(made.insert(*key) for key in _pairs(hi, lo, came)):
            made = Cuckoo.of(_pairs(hi, lo, n + more >= least))
        return _row(shard, made, hi, lo, (n + more < least) & (n + more > 0))

    rows = both.select("hi", "lo", "refs", "change", _shard(index.bits))
    filters = staged(index.filters.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(change, FILTER), "line-filters")
    discard(both)
    return Index(refs, filters, index.bits, least, index.least_chars)


class Probe:
    """All filters in one table, with their exceptions."""

    def __init__(self, rows: list, bits: int):
        self.bits = bits
        self.base, self.mask, at = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), 1
        for shard, buckets, _, _ in rows:
            self.base[shard], self.mask[shard] = at, buckets - 1
            at += buckets
        self.table = np.frombuffer(b"\0" * 2 * SLOTS + b"".join(r[2] for r in rows), "<u2").reshape(-1, SLOTS)  # shards without keys share an empty bucket
        wrong = np.frombuffer(b"".join(r[3] for r in rows), "<u8").reshape(-1, 2)
        self.wrong = set(map(tuple, wrong.tolist()))

    def frequent(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        shard = hi >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(hi), np.uint64)
        found = hits(self.table, self.base[shard], self.mask[shard], hi, lo)
        if self.wrong:
            at = np.flatnonzero(found)
            found[at] = [key not in self.wrong for key in zip(hi[at].tolist(), lo[at].tolist(), strict=True)]
        return found


def _results(lines: Lines, drop: np.ndarray, keep: bool) -> list[pa.Array]:
    n = len(lines.off) - 1
    dropped = np.bincount(lines.row[drop], minlength=n)
    data = lines.data.tobytes()
    first = np.searchsorted(lines.row, np.arange(n + 1))
    kept = []
    for i in range(n):
        if not dropped[i]:
            kept.append(data[lines.off[i] : lines.off[i + 1]])
            continue
        own = np.flatnonzero(~drop[first[i] : first[i + 1]]) + first[i]
        kept.append(b"\n".join(data[a:b] for a, b in zip(lines.begin[own].tolist(), lines.end[own].tolist(), strict=True)))
    out = [pa.array(np.diff(first).astype(np.int64)), pa.array(dropped.astype(np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
    return [*out, pa.array(kept, pa.binary()).cast(pa.string())] if keep else out


def fits(index: Index, most_bytes: int = MOST_BYTES) -> bool:
    """Whether all filters are small enough for tasks to get them whole."""
    return (index.filters.agg(F.sum(F.length("marks") + F.length("wrong") + 16)).first()[0] or 0) + (16 << index.bits) <= most_bytes


def dedup(docs: DataFrame, index: Index, text: str = "text", carry: tuple[str, ...] | None = None, keep: bool = False, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The documents with ``n_lines``, ``n_dropped`` and ``kept_sha256``, with ``keep`` the text that stays as ``kept``.

    The documents must be counted in the index. ``carry``: the columns that are given back, all without it.
    """
    columns = list(docs.columns if carry is None else carry)
    results = RESULTS | ({"kept": "string"} if keep else {})
    columns = [c for c in columns if c not in results]
    carried = F.struct(F.lit(0).alias("c"), *(named(c).alias(f"c{i}") for i, c in enumerate(columns))).alias("carried")
    rows = docs.select(carried, named(text).alias("text"))
    schema = StructType([rows.schema["carried"]])
    for name, kind in results.items():
        schema = schema.add(name, kind)
    least_chars = index.least_chars

    def finished(part: pa.RecordBatch, lines: Lines, drop: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("carried"), *_results(lines, drop, keep)], names=schema.names)

    if fits(index, most_bytes):
        bits, filters = index.bits, [tuple(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, r)) for r in index.filters.collect()]

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            all_shards = Probe(filters, bits)
            for part in slices(batches, "text"):
                lines = lines_of(part.column("text"), least_chars)
                yield finished(part, lines, lines.counts & all_shards.frequent(lines.hi, lines.lo))

        done = rows.mapInArrow(probe, schema)
    else:
        key = F.struct("hi", "lo").alias("key")
        rows = rows.withColumn("one", F.xxhash64(F.lit(1), "text")).withColumn("two", F.xxhash64(F.lit(2), "text"))

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                row, hi, lo = distinct_keys(lines_of(part.column("text"), least_chars))
                yield pa.RecordBatch.from_arrays([part.column("one").take(pa.array(row)), part.column("two").take(pa.array(row)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))], names=["one", "two", "hi", "lo"])

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                lines = lines_of(part.column("text"), least_chars)
                gone = [set() if g is None else {(x["hi"], x["lo"]) for x in g} for g in part.column("gone").to_pylist()]
                signed = zip(lines.row.tolist(), lines.hi.view(np.int64).tolist(), lines.lo.view(np.int64).tolist(), strict=True)
                yield finished(part, lines, lines.counts & np.fromiter(((h, l) in gone[r] for r, h, l in signed), bool, len(lines.row)))

        own = rows.select("text", "one", "two").mapInArrow(keys, "one bigint, two bigint, hi bigint, lo bigint").distinct().select("one", "two", key)
        frequent = index.refs.filter(F.col("refs") >= index.least_docs).select(key, "refs")
        lost = with_facts(own, frequent, "key", "refs", docs.count()).groupBy("one", "two").agg(F.collect_list("key").alias("gone"))
        done = rows.join(lost.hint("merge"), ["one", "two"], "left").select("carried", "text", "gone").mapInArrow(drop, schema)
    return done.select(*(F.col(f"carried.c{i}").alias(c) for i, c in enumerate(columns)), *schema.names[1:])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index = built(docs)
    out = dedup(docs, index, carry=("doc_id",))
    if fits(index):  # then the result holds the filters itself
        discard(index.refs, index.filters)
    return out


CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{CAPITALS}', '{SMALL}') AS key FROM l
), hot AS (
  SELECT key FROM (SELECT DISTINCT rid, key FROM k WHERE length(key) >= {LEAST_CHARS}) GROUP BY key HAVING count(*) >= {LEAST_DOCS}
)
SELECT doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot ON k.key = hot.key GROUP BY rid, doc_id
"""
