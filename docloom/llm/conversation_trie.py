"""A prefix trie of conversations, with totals of every subtree.

A node of depth d is a distinct sequence of d turns, and its members are the conversations
that begin with it. The trie is built by van Emde Boas recursion: sequences are cut at half
depth, the prefixes before the cut get names, and the upper trie and the forests below each
name are cut again. All parts of one recursion are rows of one table, so the rounds are the
logarithm of the depth, however long a conversation is.

Going in: equal halves get equal digests, from blocks of ``BLOCK`` turns up to halves of the
whole. Going down, a part's prefix is known; its left half keeps it, and its right half's is
the digest of it and of the left half. Coming back: totals of parts of one turn are the
nodes' own; where two parts meet, what the forest below a cut node comes to is grafted on the
cut node and on its ancestors in the upper part, which are the prefixes of one of its members.

Names are SHA-256 digests, so no name needs its other bearers, and equal prefixes of any
number of conversations meet in sums only, which tasks begin. Turns are numbered by ranges,
and the ids that end at a node are joined in runs of ``RUN`` before one task of a node hashes
the runs one after the other, holding one batch of them.

Nulls, ties and odd tables: turns without a number come first, null roles and texts are
empty. Turns of equal number are ordered by digest. Turns without a conversation id are one
conversation, which counts as a member but has no id to be smallest or to be joined.
Conversations of equal turns share all nodes. A long text is hashed by the JVM; only its
digest and length go on. An empty table has no nodes, not even a root. Columns of other names
are left aside, so they can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc, discard, numbered, staged, with_facts

#: Turns of a block, below which the recursion doesn't go; ids that are joined at once.
BLOCK, RUN = 8, 1024
NOTHING = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """Turns by digest: ``key`` of the conversation (empty without an id), ``conv_id``, ``pos`` from 0, ``n`` turns of the conversation, ``turn_name`` and ``bytes`` of the text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"),
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("turn_name"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    rows = staged(rows, "trie-turns")
    out = numbered(rows, "key", ["turn", "turn_name"], "trie-order")
    done = staged(out.drop("turn"), "trie-numbered")
    discard(rows, out.numbered_at)
    return done


def lengths(turns: DataFrame) -> DataFrame:
    """``key``, ``conv_id`` and ``n`` of each conversation."""
    return turns.groupBy("key").agg(F.max("conv_id").alias("conv_id"), F.max("n").alias("n"))


def _joined(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def named_paths(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, int]:
    """The nodes that each conversation passes, and the largest depth.

    ``turns`` has ``key``, ``pos``, ``turn_name`` and ``bytes``; ``convs`` has ``key``, ``conv_id`` and
    ``total``, its number of turns. Rows are ``key``, ``conv_id``, ``depth``, ``name``, ``parent``, ``bytes`` and
    ``is_end``; the root has the empty name.
    """
    blocks = turns.groupBy("key", F.expr(f"pos div {BLOCK}").alias("part")).agg(F.array_sort(F.collect_list(F.struct("pos", "turn_name", "bytes"))).alias("turns"))
    blocks = staged(blocks, "trie-blocks")
    most = convs.agg(F.max("total")).first()[0] or 0
    rounds = (most // BLOCK).bit_length()

    whole = staged(blocks.filter(F.size("turns") == BLOCK).select("key", "part", F.sha2(F.array_join("turns.turn_name", ""), 256).alias("content")), "trie-halves")
    halves = [whole]
    for _ in range(rounds - 1):
        two = halves[-1].groupBy("key", F.expr("part div 2").alias("part")).agg(*(F.max(F.when(F.col("part") % 2 == i, F.col("content"))).alias(f"half{i}") for i in (0, 1)))
        halves.append(staged(two.filter("half0 IS NOT NULL AND half1 IS NOT NULL").select("key", "part", _joined(F.col("half0"), F.col("half1")).alias("content")), "trie-halves"))

    cuts = convs.filter("total > 0").select("key", F.lit(0).cast("long").alias("part"), F.lit("").alias("prefix"))
    for level in reversed(halves if rounds else []):
        left = cuts.withColumn("part", F.col("part") * 2)
        right = left.join(level.hint("merge"), ["key", "part"]).select("key", (F.col("part") + 1).alias("part"), _joined(F.col("prefix"), F.col("content")).alias("prefix"))
        below = staged(left.unionByName(right), "trie-cuts")
        discard(level, *([cuts] if hasattr(cuts, "staged_at") else []))
        cuts = below
    if not rounds:
        discard(whole)

    after = cuts.select("key", (F.col("part") - 1).alias("part"), F.col("prefix").alias("whole"))  # a whole block ends where the next part begins
    placed = blocks.join(cuts.hint("merge"), ["key", "part"]).join(after.hint("merge"), ["key", "part"], "left")
    upto = lambda i: F.when(i == 0, F.col("prefix")).when(i == BLOCK, F.col("whole")).otherwise(F.sha2(F.concat("prefix", F.array_join(F.slice(F.col("turns.turn_name"), F.lit(1), i), "")), 256))
    names = F.transform(F.sequence(F.lit(0), F.size("turns")), upto)
    nodes = F.transform(F.col("turns"), lambda t, i: F.struct((t["pos"] + 1).alias("depth"), F.get(F.col("names"), i + 1).alias("name"), F.get(F.col("names"), i).alias("parent"), t["bytes"].alias("bytes")))
    rows = placed.withColumn("names", names).select("key", F.explode(nodes).alias("node")).select("key", "node.*")
    ends = convs.select("key", "conv_id", "total")
    rows = rows.join(ends.hint("merge"), "key").select("key", "conv_id", "depth", "name", "parent", "bytes", (F.col("depth") == F.col("total")).alias("is_end"))
    zero = F.lit(0).cast("long")
    roots = ends.select("key", "conv_id", zero.alias("depth"), F.lit("").alias("name"), F.lit(None).cast("string").alias("parent"), zero.alias("bytes"), (F.col("total") == 0).alias("is_end"))
    paths = staged(rows.unionByName(roots), "trie-paths")
    discard(blocks, *([cuts] if hasattr(cuts, "staged_at") else []))
    return paths, most


def grafted(nodes: DataFrame, paths: DataFrame, most: int, sums: list[str]) -> DataFrame:
    """``name`` and the ``sums`` of each node's own values over its subtree."""
    total = staged(nodes.select("name", *sums), "trie-totals")

    def over(more: DataFrame) -> DataFrame:
        return total.unionByName(more).groupBy("name").agg(*(F.sum(s).alias(s) for s in sums))

    def forests(roots: str) -> DataFrame:
        found = nodes.filter(roots).select("name", "parent").join(total.hint("merge"), "name")
        return found.groupBy("parent").agg(*(F.sum(s).alias(s) for s in sums))

    size = 1
    while size < most:  # parts of so many turns become parts of twice as many
        cut = nodes.filter(f"depth % {2 * size} = {size}").select(F.col("name").alias("parent"), F.col("member").alias("key"), F.expr(f"depth div {2 * size}").alias("part"))
        weights = forests(f"depth % {2 * size} = {(size + 1) % (2 * size)} AND depth > 1").join(cut.hint("merge"), "parent")
        upper = paths.filter(f"depth > 0 AND (depth - 1) % {2 * size} < {size}").select("key", F.expr(f"(depth - 1) div {2 * size}").alias("part"), "name")
        more = upper.join(weights.select("key", "part", *sums).hint("merge"), ["key", "part"]).select("name", *sums)
        new = staged(over(more), "trie-totals")
        discard(total)
        total, size = new, 2 * size
    new = staged(over(forests("depth = 1").withColumnRenamed("parent", "name")), "trie-totals")
    discard(total)
    return new


def end_digests(paths: DataFrame) -> DataFrame:
    """``name`` and ``ends_sha256``, the digest of the ids of the conversations that end at the node, in order and joined by commas."""
    ends = staged(paths.filter("is_end AND conv_id IS NOT NULL").select("name", "conv_id"), "trie-ends")
    order = numbered(ends, "name", ["conv_id"], "trie-ends-order")
    runs = order.groupBy("name", F.expr(f"pos div {RUN}").alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, done = None, None, []
        for batch in batches:
            for name, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if name == last:
                    state.update(b",")
                else:
                    if last is not None:
                        done.append((last, state.hexdigest()))
                    last, state = name, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_pylist([{"name": n, "ends_sha256": d} for n, d in done], pa.schema({"name": pa.string(), "ends_sha256": pa.string()}))
            done = []
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"name": last, "ends_sha256": state.hexdigest()}])

    out = staged(runs.repartition("name").sortWithinPartitions("name", "run").select("name", "ids").mapInArrow(digest, "name string, ends_sha256 string"), "trie-digests")
    discard(ends, order.numbered_at)
    return out


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (key, pos, turn_name, bytes) of the conversations ``convs`` (key, conv_id, total)."""
    paths, most = named_paths(turns, convs)
    found = paths.groupBy("name").agg(
        F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.min("key").alias("member"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes")
    )
    found = staged(found, "trie-found")
    children = found.filter("depth > 0").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    n_children = F.coalesce("n_children", F.lit(0).cast("long"))
    nodes = found.join(children.hint("merge"), "name", "left").withColumn("n_children", n_children)
    nodes = staged(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes")), "trie-nodes")
    totals = grafted(nodes, paths, most, ["n_leaves", "saved_tokens"])
    digests = end_digests(paths)
    discard(found, paths)
    rows = nodes.select("name", "parent", "conv_id", "depth", "n_convs", "n_children")
    above = rows.filter("n_children > 0").select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    placed = with_facts(rows.filter("depth > 0"), above, "parent", "weight", nodes.count()).drop("weight")
    placed = placed.unionByName(rows.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = placed.join(totals.hint("merge"), "name").join(digests.hint("merge"), "name", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation of the query takes over."""
    return F.coalesce((F.crc32(conv_id.cast("string").cast("binary")) % 9).cast("long"), F.lit(0).cast("long"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query's conversations: each begins with turns of another, then goes on with its own after as many.

    Conversation c takes the first h turns of c - c % 5, all if there are fewer, none if it isn't there,
    and drops its own first h, where h is the crc32 of c's digits modulo 9.
    """
    own = lengths(turns)
    other = own.select((F.col("conv_id")).alias("origin"), F.col("n").alias("there"))
    plan = own.withColumn("h", borrowed(F.col("conv_id"))).withColumn("origin", F.col("conv_id") - F.col("conv_id") % 5).join(other.hint("merge"), "origin", "left")
    plan = plan.withColumn("lent", F.least("h", F.coalesce("there", F.lit(0).cast("long"))))
    convs = staged(plan.select("key", "conv_id", "h", "lent", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))).alias("total")), "trie-convs")
    rest = turns.select("key", "pos", "turn_name", "bytes").join(convs.select("key", "h", "lent").hint("merge"), "key").filter("pos >= h")
    rest = rest.select("key", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "turn_name", "bytes")
    near = F.filter(F.array(*(F.try_add("conv_id", F.lit(i).cast("long")) for i in range(-4, 5))), lambda c: (c - c % 5 == F.col("conv_id")) & (F.col("pos") < borrowed(c)))
    lent = turns.filter("pos < 8 AND conv_id % 5 = 0").select(F.explode(F.transform(near, lambda c: c.cast("string"))).alias("key"), "pos", "turn_name", "bytes").join(convs.select("key").hint("merge"), "key", "left_semi")
    return rest.unionByName(lent), convs


def query(spark, sf_dir: str) -> DataFrame:
    turns = turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return trie(*rebuilt(turns))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS name, octet_length(encode(coalesce(text, ''))) AS bytes,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations
), c AS (
  SELECT DISTINCT conv_id, n, conv_id - conv_id % 5 AS origin, {crc("conv_id")} % 9 AS h FROM t
), r AS (
  SELECT c.conv_id, i, name, bytes FROM c JOIN t ON t.conv_id = c.origin AND i <= h
  UNION ALL
  SELECT c.conv_id, least(c.h, coalesce(o.n, 0)) + i - c.h, name, bytes FROM c JOIN t ON t.conv_id = c.conv_id AND i > h LEFT JOIN c o ON o.conv_id = c.origin
), u AS (
  SELECT conv_id, i AS depth, bytes, sha256(string_agg(name, '') OVER (PARTITION BY conv_id ORDER BY i)) AS name FROM r
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM c
), p AS (
  SELECT *, lag(name) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS is_end FROM u
), k AS (
  SELECT name, max(depth) AS depth, max(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n, max(bytes) AS bytes, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE is_end), '') AS ends FROM p GROUP BY name
), m AS (SELECT parent AS name, count(*) AS n_children FROM k WHERE depth > 0 GROUP BY parent), own AS (
  SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN m ON m.name = k.name
), s AS (
  SELECT p.name, sum((own.n_children = 0)::INT) AS n_leaves, sum((own.n - 1) * own.bytes) AS saved FROM own JOIN p ON p.conv_id = own.conv_id AND p.depth <= own.depth GROUP BY p.name
)
SELECT own.conv_id, CAST(own.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, own.n AS n_convs, own.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(own.ends) AS ends_sha256
FROM own JOIN s ON s.name = own.name LEFT JOIN own up ON up.name = own.parent
"""
