"""Near duplicates by BagMinHash.

A text is the multiset of its shingles of five words. Every shingle has Poisson processes
of points in time over intervals of weight, [0, 1), [1, 2), [2, 4) and so on, all seeded
by the shingle. A point falls in one slot of the signature, and counts if its height is
below the shingle's weight in the text; a slot keeps its earliest point. The chance that
two texts have the same point in a slot is their weighted Jaccard similarity. Points come
in order of time, so those later than the latest slot are never made.

Texts of equal multisets are one from the start. Slots are banded; texts that share a band
are candidates, and candidates are collected into families by connected components, with
one edge from each member of a band to its smallest. Inside a family links are verified by
the exact overlap of the multisets of shingles' hashes:

* a family of at most ``PART`` texts is one group, and all its pairs are tried;
* a larger one is dealt into parts of about ``PART`` texts. Each part meets a few pivots of
  the family, texts that are compared with all others. What pivots leave apart from the
  family's largest class is compared with the whole family, too, by more pivots for a few
  rounds, then in blocks of all that is left. A pair is left out only if both of its texts
  are in the largest class already, so no link that could join two classes is lost. For
  copies with edits the work grows with the family; only a family of many texts that share
  bands but have no links is compared with itself in blocks.

Blocks pass on a spanning forest of the links they find, and the components of these are
the classes. Rows are numbered once, in the table that holds their signatures; all later
jobs read that table, so a lost or added executor can't change a number. Texts without any
candidate are not moved again.

Nulls, ties and odd tables: texts of one to four words have one shingle of all of them;
those without words, null included, are all alike. Repeated rows are copies. ``class_id``
is the smallest id of a class (null only if all are); of rows with that id the one with the
lowest number is first. Nothing else in a row decides anything, and ids may be of any type
that has an order. An empty table gives no rows. A long text is hashed as a whole, so a task holds some
forty bytes for each byte of its longest text. Carried columns may have any names; the
operator's own results take the place of carried columns of their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import SLICE_BYTES, SPACE, discard, slices, staged, text_bytes, tidy, with_facts, words
from .components import components

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 40, 8  # a pair at 0.8 shares a band but for 6 in 10,000, before families join such pairs by others
SLOTS = BANDS * ROWS
PART = 256  # texts of a family in one group,
PART_SHINGLES = 1 << 21  # and about as many shingles
PIVOTS, ROUNDS = 16, 3  # of a large family in each round, and rounds before all that is left is compared

BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread evenly (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stride(k: int) -> np.uint64:
    return np.uint64(k * int(BASE) & 0xFFFFFFFFFFFFFFFF)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    base = pow(int(BASE), -1, 1 << 64) if inverse else int(BASE)
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle of a column, rows in order."""
    data, off = text_bytes(texts)
    starts, ends, row = words(data, off, ~SPACE[data])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    upto = np.zeros(len(data) + 1, np.uint64)
    byte = mix(np.arange(1, 257, dtype=np.uint64))[data]
    np.cumsum(byte * powers(len(data)), out=upto[1:])
    word = mix((upto[ends] - upto[starts]) * powers(len(data), True)[starts] + (ends - starts).astype(np.uint64))
    n = np.bincount(row, minlength=len(off) - 1)
    last = np.cumsum(n)[row]
    k = np.minimum(SHINGLE, n[row])
    first = np.flatnonzero(np.arange(len(row)) + k <= last)
    out = k[first].astype(np.uint64)
    for i in range(SHINGLE):
        at = np.minimum(first + i, len(word) - 1)
        out = np.where(i < k[first], mix(out * BASE + word[at]), out)
    return row[first], out


def weighted(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted, and how often each stands there."""
    by = np.lexsort((h, row))
    row, h = row[by], h[by]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """Times of the earliest points, (n, slots); infinity in rows without shingles."""
    sig = np.full((n, slots), np.inf)
    lows, rows_, seeds, lengths, most = [], [], [], [], []
    low, high, level = 0, 1, 0
    while len(live := np.flatnonzero(weight > low)):
        rows_.append(row[live])
        seeds.append(mix(h[live] + stride(level)))
        lows.append(np.full(len(live), low))
        lengths.append(np.full(len(live), high - low))
        most.append(weight[live])
        low, high, level = high, 2 * high, level + 1
    if not rows_:
        return sig
    r, seed, low, length, w = (np.concatenate(x) for x in (rows_, seeds, lows, lengths, most))
    t = np.zeros(len(r))
    flat = sig.reshape(-1)
    while len(r):
        many = max(1, min(64, 200_000 // len(r)))
        draws = mix(seed[:, None] + np.arange(1, many + 1, dtype=np.uint64) * BASE)
        seed = seed + stride(many)
        gap = -np.log((draws >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / (slots * length[:, None])
        gap[:, 0] += t
        times = np.cumsum(gap, axis=1)
        t = times[:, -1]
        other = mix(draws)
        slot = ((other >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
        height = low[:, None] + ((other & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) * length[:, None]
        good = height < w[:, None]
        place = (r[:, None] * slots + slot.astype(np.int64))[good]
        np.minimum.at(flat, place, times[good])
        live = t <= sig.max(axis=1)[r]
        r, seed, low, length, w, t = r[live], seed[live], low[live], length[live], w[live], t[live]
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    """One hash of each band's number and slots, (n, BANDS)."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), BANDS, ROWS)
    out = np.tile(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sig), 1))
    for i in range(ROWS):
        out = mix(out * BASE + bits[:, :, i])
    return out.view(np.int64)


def sign(docs: DataFrame, plain: bool) -> DataFrame:
    """doc_id, carried, text (compressed unless ``plain``), number of shingles, a digest of the multiset and the bands of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            row, h, w = weighted(*shingles(part.column("text")))
            n = part.num_rows
            cut = np.searchsorted(row, np.arange(n + 1))
            pairs = np.stack([h, w.astype(np.uint64)], axis=1)
            bags = [hashlib.blake2b(pairs[a:b].tobytes(), digest_size=16).digest() for a, b in zip(cut, cut[1:])]
            found = bands(signatures(row, h, w, n))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(found.reshape(-1)))
            size = np.bincount(row, weights=w, minlength=n).astype(np.int64)
            mine = [part.column("doc_id"), part.column("carried"), part.column("text") if plain else zipped(part.column("text"))]
            yield pa.RecordBatch.from_arrays([*mine, pa.array(size), pa.array(bags, pa.binary()), lists], names=["doc_id", "carried", "text", "n_shingles", "bag", "bands"])

    schema = StructType([docs.schema[c] for c in ("doc_id", "carried")]).add("text", docs.schema["text"].dataType if plain else "binary")
    return docs.select("doc_id", "carried", "text").mapInArrow(run, schema.add("n_shingles", "long").add("bag", "binary").add("bands", ArrayType(LongType())))


def zipped(texts: pa.Array) -> pa.Array:
    """Each text by itself, compressed for the way through a table and a shuffle. Null: empty."""
    data, off = text_bytes(texts)
    z, whole = zstandard.ZstdCompressor(level=1), data.tobytes()
    return pa.array([z.compress(whole[a:b]) for a, b in zip(off, off[1:])], pa.binary())


def unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with their texts as they were, in parts of some two megabytes of text (one row at least)."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        upto = np.cumsum([0, *(zstandard.frame_content_size(x) for x in texts)])
        at, z, begin = batch.schema.get_field_index("text"), zstandard.ZstdDecompressor(), 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + SLICE_BYTES, "right")) - 1)
            yield batch.slice(begin, end - begin).set_column(at, "text", pa.array([z.decompress(x) for x in texts[begin:end]], pa.large_binary()))
            begin = end


def hashed(nodes: DataFrame, plain: bool) -> DataFrame:
    """The nodes with ``h``, their shingles' hashes, in place of ``text``; the k-th of equal shingles has a hash of its own."""
    names = [c for c in nodes.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches if plain else unzipped(batches)):
            row, h, w = weighted(*shingles(part.column("text")))
            copy = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            row, h = np.repeat(row, w), mix(np.repeat(h, w) + copy.astype(np.uint64) * BASE)
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array([h[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=[*names, "h"])

    return nodes.select(*names, "text").mapInArrow(run, StructType([nodes.schema[c] for c in names]).add("h", "binary"))


def overlaps(sets: list[bytes], pivots: int) -> np.ndarray:
    """Size of the common part of each of the first ``pivots`` sets with every set: shared hashes become columns, some thousand at a time."""
    size = np.array([len(x) // 8 for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True, return_counts=True)
    common = count[column] > 1
    row, column = row[common], (np.cumsum(count > 1) - 1)[column[common]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    out = np.zeros((pivots, len(sets)), np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        a, b = np.searchsorted(column, [begin, begin + 8192])
        has = np.zeros((len(sets), 8192), np.float32)
        has[row[a:b], column[a:b] - begin] = 1
        out += has[:pivots] @ has.T
    return out


def links(sets: list[bytes], pivots: int, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of similarity ``least`` or more that one of the first ``pivots`` sets is in."""
    both = overlaps(sets, pivots).astype(np.float64)
    size = np.array([len(x) / 8 for x in sets])
    similar = both >= least * (size[:pivots, None] + size[None, :] - both) - 1e-9
    root, out = list(range(len(sets))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(*np.nonzero(similar)):
        x, y = find(int(a)), find(int(b))
        if x != y:
            root[y] = x
            out.append((int(a), int(b)))
    return out


def verified(members: DataFrame, pivots: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) of verified links between pivots and members of the same family, part and block.

    Both have component, part, block, id and h; a member that is a pivot of its own group is one set there.
    """

    def run(table: pa.Table) -> pa.Table:
        by = pc.sort_indices(table, [("pivot", "descending"), ("id", "ascending")])
        ids, pivot = table.column("id").to_numpy()[by], table.column("pivot").to_numpy(zero_copy_only=False)[by]
        n = int(pivot.sum())
        keep = np.flatnonzero(pivot | ~np.isin(ids, ids[:n]))
        ids, sets = ids[keep], table.column("h").take(by).take(pa.array(keep)).to_pylist()
        found = links(sets, n, least)
        tidy()
        return pa.table({"a": pa.array(ids[[x for x, _ in found]], pa.int64()), "b": pa.array(ids[[y for _, y in found]], pa.int64())})

    columns = ["component", "part", "block", "id", "h"]
    groups = members.select(*columns, F.lit(False).alias("pivot")).unionByName(pivots.select(*columns, F.lit(True).alias("pivot")))
    return groups.groupBy("component", "part", "block").applyInArrow(run, "a bigint, b bigint")


def some(rows: DataFrame, most: int) -> DataFrame:
    """At most so many ids of each component, by their hashes: first of each of 64 parts, then of what these leave."""
    for key in (["component", F.pmod(F.xxhash64("id"), F.lit(64))], ["component"]):
        rows = rows.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("id", F.lit(1)), "id"))).filter(F.col("at") <= most).drop("at")
    return rows


def family_links(nodes: DataFrame, least: float, part: int) -> DataFrame:
    """Links of all families: ``nodes`` has component, parts (of its family), id and h, and is a staged table."""
    total = max(1, nodes.count())
    here = nodes.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("block", F.lit(0))
    small, large = here.filter("parts = 1"), here.filter("parts > 1")
    found = [staged(verified(small.filter(F.lit(False)), small, least), "bag-links")]
    left, done = large.select("component", "id"), None
    for turn in range(ROUNDS + 1):
        n = left.groupBy("component").count().agg(F.max("count"), F.sum("count")).first()
        if not n[1]:
            break
        if turn < ROUNDS and n[0] > part // 2:
            chosen, last = some(left, PIVOTS).withColumn("block", F.lit(0)).withColumn("blocks", F.lit(1)), False
        else:  # all that is left, in blocks
            sizes = left.groupBy("component").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / (part // 2)).cast("int"))
            chosen = with_facts(left, sizes, "component", "n", n[1]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
            last = True
        chosen = staged(chosen.select("id", "block", "blocks"), "bag-pivots")
        sets = large.drop("block", "part").join(chosen, "id")
        pivots = sets.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        most = sets.groupBy("component").agg(F.max("blocks").alias("blocks"), F.max(F.col("parts") * part).alias("m"))
        members = with_facts(large.drop("block"), most, "component", "m", total).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        found.append(staged(verified(members, pivots, least), "bag-links"))
        if last:
            break
        classes = components(reduce(DataFrame.unionByName, found[1:]))
        mine = large.select("component", "id").join(classes.withColumnRenamed("component", "class"), "id", "left").withColumn("class", F.coalesce("class", "id"))
        mine = staged(mine, "bag-members")
        sizes = mine.groupBy("component", "class").count()
        top = staged(sizes.groupBy("component").agg(F.max(F.struct("count", "class"))["class"].alias("top"), F.sum("count").alias("m")), "bag-tops")
        done = chosen.select("id") if done is None else done.unionByName(chosen.select("id"))
        apart = with_facts(mine, top, "component", "m", total).filter("class <> top").select("component", "id")
        left = staged(apart.join(done, "id", "left_anti"), "bag-left")
    return reduce(DataFrame.unionByName, found)


RESULTS = ["n_shingles", "class_id", "class_size", "is_first"]


def near_duplicates(docs: DataFrame, least: float = LEAST, carry: tuple[str, ...] = (), part: int = PART) -> DataFrame:
    """doc_id and ``carry`` columns, ``n_shingles``, ``class_id``, ``class_size`` and ``is_first`` (whether it stands for its class) of each document (doc_id, text)."""
    columns = [c for c in carry if c not in ("doc_id", "text", *RESULTS)]
    carried = F.struct(F.lit(0).alias("c"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns))).alias("carried")
    plain = "text" in carry  # texts that aren't carried move compressed
    signed = staged(sign(docs.select("doc_id", "text", carried), plain).withColumn("row", F.monotonically_increasing_id()), "bag-signatures")
    total = signed.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))).alias("head")
    bags = staged(signed.groupBy("bag").agg(F.min("row").alias("rep"), F.count("*").alias("copies"), first), "bags")
    reps = staged(signed.filter("n_shingles > 0").join(bags, signed["row"] == bags["rep"], "left_semi").select("row", F.explode("bands").alias("key")), "bag-bands")
    shared = staged(reps.groupBy("key").agg(F.min("row").alias("a"), F.count("*").alias("m")).filter("m > 1"), "bag-shared")
    n = reps.agg(F.count("*")).first()[0]
    met = with_facts(reps.withColumnRenamed("row", "b"), shared, "key", "m", n)
    families = components(met.select("a", "b").filter("a <> b").distinct())
    families = staged(families.join(signed.select(F.col("row").alias("id"), "n_shingles"), "id"), "bag-families")
    sizes = families.groupBy("component").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("n")).filter("m > 1")
    parts = F.ceil(F.greatest(F.col("m") / part, F.col("n") / PART_SHINGLES)).cast("int")
    sizes = staged(sizes.select("component", "m", parts.alias("parts")), "bag-sizes")
    placed = with_facts(families, sizes, "component", "m", max(1, families.count())).select("id", "component", "parts")
    merged = signed.select(F.col("row").alias("id"), "text").join(placed.hint("merge"), "id")  # placed grows with the corpus: one plan at every size
    nodes = staged(hashed(merged, plain), "bag-nodes")
    discard(reps, shared)
    classes = components(family_links(nodes, least, part))
    texts = bags.join(classes.select(F.col("id").alias("rep"), "component"), "rep", "left").select("bag", "copies", "head", F.coalesce("component", "rep").alias("class"))
    texts = staged(texts, "bag-classes")
    best = staged(texts.groupBy("class").agg(F.min("head").alias("head"), F.sum("copies").alias("class_size"), F.count("*").alias("texts")), "bag-heads")
    facts = with_facts(texts.select("bag", "copies", "class"), best, "class", "texts", max(1, texts.count()))
    facts = staged(facts.select("bag", "copies", F.col("head.doc_id").alias("class_id"), F.col("head.row").alias("head"), "class_size"), "bag-facts")
    rows = with_facts(signed.select("doc_id", "text", "carried", "row", "n_shingles", "bag") if plain else signed.select("doc_id", "carried", "row", "n_shingles", "bag"), facts, "bag", "copies", max(1, total))
    mine = [F.col("text")] * plain + [F.col(f"carried.c{i}").alias(c) for i, c in enumerate(columns)]
    return rows.select("doc_id", *mine, "n_shingles", "class_id", "class_size", (F.col("row") == F.col("head")).alias("is_first"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
