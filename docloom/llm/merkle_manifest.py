"""A Merkle manifest of a dataset.

Each row is a leaf, the hash of its fields. The leaves of a group, in order, form runs of
``FANOUT``; a run's digests, one after the other, hash to its parent, until one node is
left: the group's subroot. The subroots, in the order of their groups, are leaves of one
more tree, whose last node is the root.

Going up is a slot pivot: conditional aggregates spread a parent's children into one column
for each slot. All columns concatenated hash to the parent; all but a child's own are its
siblings, those before it and those after it. ``STEP`` levels share one shuffle, as nodes
are dealt by the ancestor that many levels up, and a step's block keeps the pivots of its
levels, one inside the other. Going down again, blocks meet the path of their top by a join,
and each level that opens puts its siblings before what its parent's path has. So a path is
sent once for a block, not once for each leaf, and a row's text is never sent at all.

Nulls, ties and odd tables: a null field is ``-``, so an empty one differs from it; a null
group comes first, a null order key first in its group. Leaves of equal keys are ordered by
digest, and equal leaves may change places, which no digest can tell. A group of one row is
its own subroot. A text of any length is hashed by the JVM as it is. An empty table gives no
rows. Columns may have any names: those that are carried go by place, and the manifest's own
stand behind them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc, discard, named, numbered, staged

FANOUT, STEP = 3, 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
RESULTS = ["leaf", "subroot", "root", "path"]


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("", *parts), 256)


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: of each field its bytes and its value, or ``-``."""
    values = [f.cast("string") for f in fields]
    return hashed(*(F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values))


def climbed(nodes: DataFrame) -> DataFrame:
    """``STEP`` levels up: a row for each node there, ``below`` the slots of the levels under it, each inside the one above.

    ``nodes`` has ``tree``, ``pos`` in it, ``n`` nodes on its level, ``digest`` and ``below``. A level
    of one node is the tree's last: it is handed up as it is.
    """
    out = nodes.withColumn("block", F.expr(f"pos div {FANOUT**STEP}")).repartition("tree", "block")
    for _ in range(STEP):
        child = [F.first(F.when(F.pmod("pos", F.lit(FANOUT)) == s, F.struct("digest", "below")), ignorenulls=True).alias(f"slot{s}") for s in range(FANOUT)]
        out = out.groupBy("tree", "block", F.expr(f"pos div {FANOUT}").alias("pos")).agg(F.max("n").alias("n"), *child)
        slots, many = [f"slot{s}" for s in range(FANOUT)], F.col("n") > 1
        digest = F.when(many, hashed(*(F.col(f"{s}.digest") for s in slots))).otherwise(F.col("slot0.digest"))
        out = out.select("tree", "block", "pos", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), digest.alias("digest"), F.struct(many.alias("many"), *slots).alias("below"))
    return out.drop("block")


def grown(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The staged blocks of each step, from below, and the last node of each tree (its ``digest``)."""
    most, steps = nodes.agg(F.max("n")).first()[0] or 1, []
    while most > 1:
        steps.append(staged(climbed(nodes), "merkle-step"))
        nodes = steps[-1].select("tree", "pos", "n", "digest", F.struct(F.lit(0).alias("none")).alias("below"))
        for _ in range(STEP):
            most = -(-most // FANOUT)
    return steps, nodes


def opened(tops: DataFrame, steps: list[DataFrame], leaves: DataFrame, facts: list[str]) -> DataFrame:
    """``leaves`` with their ``path`` and the ``facts`` of their tree's top.

    ``tops`` has ``tree``, ``pos`` 0, ``path`` from the top on, and the facts. A path is an array of
    ``left`` and ``right``, the digests of the siblings on either side, from the leaf's level up, and
    ``many``, false where a last node was handed up.
    """
    for blocks in reversed(steps):
        tops = blocks.select("tree", "pos", "below").join(tops.select("tree", "pos", "path", *facts).hint("merge"), ["tree", "pos"])
        for _ in range(STEP):
            ways = []
            for s in range(FANOUT):
                left, right = ([F.col(f"below.slot{i}.digest") for i in range(FANOUT) if (i < s if before else i > s)] for before in (True, False))
                level = F.struct(F.concat_ws("", *left).alias("left"), F.concat_ws("", *right).alias("right"), F.col("below.many").alias("many"))
                ways.append(F.struct((F.col("pos") * FANOUT + s).alias("pos"), level.alias("level"), F.col(f"below.slot{s}").alias("child")))
            tops = tops.select("tree", "path", *facts, F.explode(F.filter(F.array(*ways), lambda w: w["child"].isNotNull())).alias("way"))
            tops = tops.select("tree", "way.pos", F.concat(F.array("way.level"), "path").alias("path"), *facts, "way.child.digest", "way.child.below")
    if steps:
        return tops
    return leaves.join(tops.select("tree", "pos", "path", *facts).hint("merge"), ["tree", "pos"])


def manifest(docs: DataFrame, fields: list[str] | None = None, group: str = "source", order: str = "doc_id", carry: tuple[str, ...] | None = None) -> DataFrame:
    """The ``carry`` columns (``order`` without it) of each row with its ``leaf``, the ``subroot`` of its group, the ``root`` and its ``path``."""
    fields, columns = fields or FIELDS, [c for c in (carry or (order,)) if c not in RESULTS]
    own = docs.select(
        F.coalesce(F.concat(F.lit("1"), named(group).cast("string")), F.lit("0")).alias("tree"),
        named(order).alias("place"),
        leaf([named(c) for c in fields]).alias("digest"),
        F.struct(F.lit(0).alias("c"), *(named(c).alias(f"c{i}") for i, c in enumerate(columns))).alias("below"),
    )
    own = staged(own, "merkle-leaves")
    leaves = numbered(own, "tree", ["place", "digest"], "merkle-order")
    steps, last = grown(leaves)
    groups = staged(last.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "merkle-groups")
    groups = numbered(groups, "tree", ["name"], "merkle-names").withColumn("below", F.struct("name"))
    above, top = grown(groups)
    tops = top.select("tree", "pos", F.expr("CAST(array() AS array<struct<left: string, right: string, many: boolean>>)").alias("path"), F.col("digest").alias("root"))
    listed = opened(tops, above, groups, ["root"])
    tops = listed.select(F.col("below.name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
    out = opened(tops, steps, leaves, ["subroot", "root"])
    if steps:
        discard(own, leaves.numbered_at)
    return out.select(*(F.col(f"below.c{i}").alias(c) for i, c in enumerate(columns)), F.col("digest").alias("leaf"), "subroot", "root", "path")


def folded(own: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, own, lambda digest, x: F.when(x["many"], hashed(x["left"], digest, x["right"])).otherwise(digest))


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    forged = leaf([changed if c == "text" else F.col(c) for c in FIELDS])
    out = manifest(docs.withColumn("forged", forged), carry=("doc_id", "forged"))
    out = out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.col("forged"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in [*FIELDS[:-1], text]) + ")"


def _up_sql(name: str, begin: str) -> str:
    return f"""{name}(tree, pos, n, level, h) AS (
  {begin}
  UNION ALL
  SELECT tree, pos // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, level + 1, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, pos // {FANOUT}, n, level
)"""


def _path_sql(leaves: str, nodes: str, item: str) -> str:
    run = f"CAST(pow({FANOUT}, x.level) AS BIGINT)"
    return f"""SELECT {item}, x.level, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (WHERE x.pos < l.pos // {run}), '') AS l,
    coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (WHERE x.pos > l.pos // {run}), '') AS r
  FROM {leaves} l JOIN {nodes} x ON x.tree = l.tree AND x.n > 1 AND x.pos // {FANOUT} = l.pos // ({FANOUT} * {run}) GROUP BY {item}, x.level, l.pos"""


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('1' || source, '0') AS tree, {_leaf_sql("text")} AS leaf,
    CASE WHEN {crc("doc_id")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS forged FROM documents
), own AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d
), {_up_sql("up", "SELECT tree, pos, n, 0, leaf FROM own")}, s AS (
  SELECT '' AS tree, tree AS name, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
), {_up_sql("above", "SELECT tree, pos, n, 0, h FROM s")}, p AS (
  {_path_sql("own", "up", "rid")}
  UNION ALL
  SELECT own.rid, 1000 + q.level, l, r FROM ({_path_sql("s", "above", "name")}) q JOIN own ON own.tree = q.name
), k AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY level) AS k, count(*) OVER (PARTITION BY rid) AS m FROM p), f(rid, k, h) AS (
  SELECT rid, 0, forged FROM own
  UNION ALL
  SELECT f.rid, k.k, sha256(k.l || f.h || k.r) FROM f JOIN k ON k.rid = f.rid AND k.k = f.k + 1
), e AS (
  SELECT own.rid, coalesce(max(m), 0) AS m, sha256(coalesce(string_agg(l || r, '' ORDER BY k), '')) AS proof FROM own LEFT JOIN k ON k.rid = own.rid GROUP BY own.rid
)
SELECT doc_id, leaf, s.h AS subroot, top.h AS root, proof AS proof_sha256, f.h AS folded_root, f.h = top.h AS verified
FROM own JOIN s ON s.name = own.tree JOIN (SELECT h FROM above WHERE n = 1) top ON true JOIN e ON e.rid = own.rid JOIN f ON f.rid = own.rid AND f.k = e.m
"""
