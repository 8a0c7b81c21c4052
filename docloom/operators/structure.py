"""Sections as a structure: neighbours, support, pictures, mirrors, publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import SECTIONS, sections, table
from .ranks import running_sums


def neighbours(rows: DataFrame, seeds: DataFrame, reach: int = 1) -> DataFrame:
    """Sections (doc_id, section_id) within ``reach`` of a seed (qid, doc_id, section_id) with the least distance, without the seeds.

    The range becomes ids to join by, so the join is on equal keys.
    """
    near = seeds.select("qid", "doc_id", "section_id", F.explode(F.sequence(F.col("section_id") - reach, F.col("section_id") + reach)).alias("near"))
    near = near.withColumn("distance", F.abs(F.col("near") - F.col("section_id"))).filter("distance > 0")
    best = near.groupBy("qid", "doc_id", F.col("near").alias("section_id")).agg(F.min("distance").alias("distance"))
    return best.join(rows, ["doc_id", "section_id"]).join(seeds.select("qid", "doc_id", "section_id"), ["qid", "doc_id", "section_id"], "left_anti")


def adjacent_support(rows: DataFrame, safety: Column) -> DataFrame:
    """Sections whose predecessor in the same document is about safety, with that predecessor."""
    w = Window.partitionBy("doc_id").orderBy("section_id")
    flagged = rows.withColumn("_safe", safety)
    return flagged.withColumn("support", F.when(F.lag("_safe").over(w), F.lag("section_id").over(w))).filter("support IS NOT NULL AND NOT _safe").drop("_safe")


def span_pics(chunks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Pictures of each chunk (doc_id, chunk, start, end): anchors (doc_id, pic_id, offset) inside it, both ends included, in order.

    A document's only picture goes to chunks of a short text that have none.
    """
    inside = chunks.join(anchors, "doc_id").filter(F.col("offset").between(F.col("start"), F.col("end")))
    got = inside.groupBy("doc_id", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", "pic_id"))), lambda s: s["pic_id"]).alias("pics"))
    alone = anchors.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("pic_id").alias("only"))
    rows = chunks.join(got, ["doc_id", "chunk"], "left").join(alone, "doc_id", "left")
    pics = F.when(F.col("pics").isNotNull(), F.array_distinct("pics")).when((F.col("n") == 1) & (F.col("text_len") <= 1400), F.array("only")).otherwise(F.expr("CAST(array() AS array<string>)"))
    return rows.select("doc_id", "chunk", pics.alias("pics"))


def picture_owner(rows: DataFrame, images: DataFrame) -> DataFrame:
    """The first section (doc_id, section_id, pics) that has each image (doc_id, pic_id)."""
    own = rows.select("doc_id", "section_id", F.explode("pics").alias("pic_id"))
    return images.join(own, ["doc_id", "pic_id"]).groupBy("doc_id", "pic_id").agg(F.min("section_id").alias("section_id"))


def figure_groups(figures: DataFrame, starts: Column) -> DataFrame:
    """Groups of figures in document order: one begins where ``starts`` holds."""
    w = Window.partitionBy("doc_id").orderBy("section_id").rowsBetween(Window.unboundedPreceding, 0)
    return figures.withColumn("grp", F.sum(starts.cast("int")).over(w))


def figure_cards(rows: DataFrame, captions: DataFrame) -> DataFrame:
    """One card per picture of a section: the text before and after its mark, its place, and its caption where there is one."""
    parts = F.split("text", r"<PIC>")
    cards = rows.filter(F.size("pics") > 0).select("doc_id", "section_id", parts.alias("parts"), F.posexplode("pics").alias("place", "pic_id"))
    piece = lambda i: F.coalesce(F.get("parts", i), F.lit(""))
    cards = cards.select("doc_id", "section_id", "place", "pic_id", F.trim(piece(F.col("place"))).alias("before"), F.trim(piece(F.col("place") + 1)).alias("after"))
    return cards.join(captions, ["doc_id", "pic_id"], "left")


def caption_lookup(images: DataFrame, captions: DataFrame) -> DataFrame:
    """Captions by product and image, else by image alone where only one product has it."""
    alone = captions.groupBy("image_id").agg(F.count_distinct("product").alias("n"), F.min("caption").alias("any_caption")).filter("n = 1").drop("n")
    return images.join(captions, ["product", "image_id"], "left").join(alone, "image_id", "left").select("product", "image_id", F.coalesce("caption", "any_caption").alias("caption"))


def balanced(ranked: DataFrame, n: int = 8) -> DataFrame:
    """Hits of several products (qid, product, position, rank, fingerprint) in turns, equal ones once, the first n."""
    first = Window.partitionBy("qid", "fingerprint").orderBy("rank", "position")
    w = Window.partitionBy("qid").orderBy("rank", "position")
    rows = ranked.withColumn("_f", F.row_number().over(first)).filter("_f = 1").drop("_f")
    return rows.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= n)


def renumbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``chunk_id`` from 0 over all groups in order, by sums over ranges of the rows: no group and no list of groups meets in one place."""
    return running_sums(rows, [], [group, *order]).withColumnRenamed("sum_before", "chunk_id").drop("sum_all")


def replaced(old: DataFrame, new: DataFrame, key: str = "product") -> DataFrame:
    """Old rows but those of keys that are published anew, and the new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def publish_diff(old: DataFrame, new: DataFrame, key: str = "product") -> DataFrame:
    """What a publication does to each key (key, digest): created, replaced, unchanged or kept."""
    both = old.select(key, F.col("digest").alias("was")).join(new.select(key, F.col("digest").alias("is")), key, "full_outer")
    change = F.when(F.col("was").isNull(), "created").when(F.col("is").isNull(), "kept").when(F.col("was") == F.col("is"), "unchanged").otherwise("replaced")
    return both.select(key, change.alias("change"))


def content_digest(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows and a digest that doesn't depend on their order: the sum of the rows' hashes, so that repeated rows count."""
    return rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).cast("string").alias("digest"))


def quality_metrics(chunks: DataFrame, target: int, short: int, long: int, text_chars: DataFrame) -> DataFrame:
    """Sizes, short, long and repeated chunks, and coverage of each product (product, text), with errors and status."""
    per = chunks.withColumn("n", F.length("text")).groupBy("product", "text").agg(F.count("*").alias("copies"), F.max("n").alias("n"))
    w = F.col("copies")
    agg = per.groupBy("product").agg(
        F.sum("copies").alias("chunks"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        F.floor(F.sum(F.col("n") * w) * 10.0 / F.sum(w) + 0.5).alias("avg10"),
        F.sum(F.when(F.col("n") < short, w).otherwise(0)).alias("short"),
        F.sum(F.when(F.col("n") > long, w).otherwise(0)).alias("long"),
        F.sum(w - 1).alias("duplicates"),
        F.sum(F.least("n", F.lit(target)) * w).alias("covered"),
    )
    rows = agg.join(text_chars, "product").withColumn("coverage", F.floor(F.least(F.lit(1.0), F.col("covered") / F.greatest("chars", F.lit(1))) * 10000 + 0.5) / 10000)
    status = F.when(F.col("long") > 0, "error").when((F.col("short") > 0) | (F.col("duplicates") > 0), "warning").otherwise("ok")
    return rows.select("product", "chunks", "least", "most", (F.col("avg10") / 10).alias("avg"), "short", "long", "duplicates", "coverage", status.alias("status"))


def mirror_tags(rows: DataFrame) -> DataFrame:
    """One row per chunk and distinct tag."""
    return rows.select("chunk_id", F.explode(F.array_distinct("tags")).alias("tag"))


def chunk_filter(rows: DataFrame, manual=None, ids=None, keyword=None, with_pics: bool = False, tag=None, tags: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Chunks by manual, ids, keyword in heading or text (any case), pictures and tag, in the order of ids."""
    if manual is not None:
        rows = rows.filter(F.col("product") == manual)
    if ids is not None:
        rows = rows.filter(F.col("chunk_id").isin(list(ids)))
    if keyword is not None:
        rows = rows.filter(F.contains(F.lower("heading"), F.lit(keyword.lower())) | F.contains(F.lower("text"), F.lit(keyword.lower())))
    if with_pics:
        rows = rows.filter("pic_count > 0")
    if tag is not None:
        rows = rows.join(tags.filter(F.col("tag") == tag).select("chunk_id"), "chunk_id", "left_semi")
    rows = rows.orderBy("chunk_id")
    return rows if limit is None else rows.limit(limit)


def searchable(rows: DataFrame) -> DataFrame:
    """Product, heading, summary and text joined by newlines, empty ones left out."""
    parts = F.filter(F.array(*(F.trim(F.coalesce(c, F.lit(""))) for c in ("product", "heading", "summary", "text"))), lambda x: x != "")
    return rows.withColumn("searchable", F.array_join(parts, "\n"))


def set_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows each side has that the other lacks, copies counted."""
    only = lambda x, y: x.exceptAll(y).agg(F.count("*").alias("n"))
    return only(a, b).select(F.lit("left").alias("side"), "n").unionByName(only(b, a).select(F.lit("right").alias("side"), "n"))


def unseen(results: DataFrame, history: DataFrame) -> DataFrame:
    """Results (session, product, heading, text) whose fingerprint isn't in the session's history, each once."""
    mark = F.sha2(F.concat_ws("\u0000", "product", "heading", F.trim(F.regexp_replace("text", r"\s+", " "))), 256)
    return results.withColumn("mark", mark).dropDuplicates(["session", "mark"]).join(history.withColumn("mark", mark).select("session", "mark"), ["session", "mark"], "left_anti")


def insert_or_ignore(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


_PICS = "transform(sequence(1, 1 + section_id % 3), i -> concat('pic', doc_id, '_', section_id + i))"


def _pic_sections(s, d):
    return sections(s, d).withColumn("pics", F.expr(_PICS)).withColumn("text", F.regexp_replace("text", r"\.\s", ". <PIC>"))


def _chunk_rows(s, d):
    rows = sections(s, d).withColumn("tags", T.tags(F.col("heading"), F.col("text")))
    return rows.withColumn("chunk_id", F.col("doc_id") * 1_000_000 + F.col("section_id"))


def _chars(s, d):
    return table(s, d, "documents").groupBy(F.col("source").alias("product")).agg(F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("chars"))


_S = lambda body, rest: f"WITH {SECTIONS}{body} {rest}"
_SQL_PICS = "list_transform(range(1, 2 + section_id % 3), lambda i: 'pic' || doc_id || '_' || (section_id + i))"


def _span(s, d):
    chunks = sections(s, d).select("doc_id", F.col("section_id").alias("chunk"), (F.col("section_id") * 100).alias("start"), (F.col("section_id") * 100 + 120).alias("end"), F.col("char_len").alias("text_len"))
    anchors = sections(s, d).filter("char_len > 80 OR lang = 'fr'").select("doc_id", F.concat(F.lit("p"), "section_id").alias("pic_id"), (F.col("section_id") * 60).alias("offset"))
    return span_pics(chunks, anchors).select("doc_id", "chunk", F.array_join("pics", ",").alias("pics"))


def _publish(s, d):
    rows = sections(s, d).groupBy("product").agg(F.count("*").alias("n"), F.sum("char_len").alias("digest"))
    new = rows.filter("product LIKE 'src1%'").withColumn("digest", F.col("digest") + F.when(F.col("product") == "src1", 1).otherwise(0))
    return rows.filter("product <> 'src10'"), new


QUERIES = {
    "neighbor_sections": (
        lambda s, d: neighbours(sections(s, d).select("doc_id", "section_id", "heading"), sections(s, d).filter("char_len < 60").select((F.col("doc_id") % 5).alias("qid"), "doc_id", "section_id"), 2),
        _S(
            ", sd AS (SELECT doc_id % 5 AS qid, doc_id, section_id FROM sections WHERE char_len < 60), m AS (SELECT qid, s.doc_id, s.section_id, s.heading, min(abs(s.section_id - sd.section_id)) AS distance FROM sd JOIN sections s ON s.doc_id = sd.doc_id AND abs(s.section_id - sd.section_id) <= 2 GROUP BY ALL)",
            "SELECT qid, doc_id, section_id, distance, heading FROM m WHERE distance > 0 AND (qid, doc_id, section_id) NOT IN (SELECT (qid, doc_id, section_id) FROM sd)",
        ),
    ),
    "adjacent_support": (
        lambda s, d: adjacent_support(sections(s, d), F.col("text").rlike(r"(?i)\bthe\b")).select("doc_id", "section_id", "support"),
        _S(r", f AS (SELECT *, regexp_matches(text, '(?i)\bthe\b') AS safe FROM sections), l AS (SELECT *, lag(safe) OVER w AS ps, lag(section_id) OVER w AS p FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY section_id))", "SELECT doc_id, section_id, p AS support FROM l WHERE ps AND NOT safe"),
    ),
    "span_pics": (
        _span,
        _S(
            """, a AS (SELECT doc_id, 'p' || section_id AS pic_id, section_id * 60 AS offs FROM sections WHERE char_len > 80 OR lang = 'fr'), g AS (SELECT s.doc_id, s.section_id, string_agg(pic_id, ',' ORDER BY offs) AS pics FROM sections s JOIN a ON a.doc_id = s.doc_id AND offs BETWEEN section_id * 100 AND section_id * 100 + 120 GROUP BY ALL),
            o AS (SELECT doc_id, count(*) AS n, min(pic_id) AS sole FROM a GROUP BY doc_id)""",
            "SELECT s.doc_id, s.section_id AS chunk, coalesce(pics, CASE WHEN n = 1 AND char_len <= 1400 THEN sole END, '') AS pics FROM sections s LEFT JOIN g ON g.doc_id = s.doc_id AND g.section_id = s.section_id LEFT JOIN o ON o.doc_id = s.doc_id",
        ),
    ),
    "image_owner": (
        lambda s, d: picture_owner(_pic_sections(s, d).select("doc_id", "section_id", "pics"), _pic_sections(s, d).select("doc_id", F.explode("pics").alias("pic_id")).distinct()),
        _S("", f"SELECT doc_id, pic_id, min(section_id) AS section_id FROM (SELECT doc_id, section_id, unnest({_SQL_PICS}) AS pic_id FROM sections) GROUP BY doc_id, pic_id"),
    ),
    "figure_cards": (
        lambda s, d: figure_cards(_pic_sections(s, d), table(s, d, "labels").select("doc_id", F.concat(F.lit("pic"), "doc_id", F.lit("_1")).alias("pic_id"), F.concat(F.lit("q"), "quality").alias("caption"))),
        _S(
            rf", p AS (SELECT doc_id, section_id, {_SQL_PICS} AS pics, string_split(regexp_replace(text, '\.\s', '. <PIC>', 'g'), '<PIC>') AS parts FROM sections), c AS (SELECT doc_id, section_id, i - 1 AS place, pics[i] AS pic_id, trim(coalesce(parts[i], '')) AS before, trim(coalesce(parts[i + 1], '')) AS after FROM p, LATERAL (SELECT unnest(range(1, len(pics) + 1)) AS i) t)",
            "SELECT c.doc_id, section_id, CAST(place AS INT) AS place, pic_id, before, after, 'q' || quality AS caption FROM c LEFT JOIN labels l ON l.doc_id = c.doc_id AND pic_id = 'pic' || l.doc_id || '_1'",
        ),
    ),
    "figure_groups": (
        lambda s, d: figure_groups(sections(s, d), F.col("char_len") < 80).select("doc_id", "section_id", "grp"),
        _S("", "SELECT doc_id, section_id, CAST(sum(CAST(char_len < 80 AS INT)) OVER (PARTITION BY doc_id ORDER BY section_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM sections"),
    ),
    "caption_lookup": (
        lambda s, d: caption_lookup(
            sections(s, d).select(F.concat(F.lit("d"), F.col("doc_id") % 50).alias("product"), F.concat(F.lit("i"), "section_id").alias("image_id")).distinct(),
            table(s, d, "labels").select(F.concat(F.lit("d"), F.col("doc_id") % 20).alias("product"), F.concat(F.lit("i"), F.col("doc_id") % 60).alias("image_id"), F.concat(F.lit("c"), F.col("doc_id") % 20 + F.col("doc_id") % 60).alias("caption")).distinct(),
        ),
        _S(
            ", im AS (SELECT DISTINCT 'd' || (doc_id % 50) AS product, 'i' || section_id AS image_id FROM sections), c AS (SELECT DISTINCT 'd' || (doc_id % 20) AS product, 'i' || (doc_id % 60) AS image_id, 'c' || (doc_id % 20 + doc_id % 60) AS caption FROM labels), o AS (SELECT image_id, min(caption) AS a FROM c GROUP BY image_id HAVING count(DISTINCT product) = 1)",
            "SELECT im.product, im.image_id, coalesce(caption, a) AS caption FROM im LEFT JOIN c ON c.product = im.product AND c.image_id = im.image_id LEFT JOIN o ON o.image_id = im.image_id",
        ),
    ),
    "balanced_results": (
        lambda s, d: balanced(sections(s, d).select((F.col("doc_id") % 9).alias("qid"), "product", F.col("doc_id").alias("position"), (F.col("section_id") + 1).alias("rank"), F.md5("text").alias("fingerprint"))).select("qid", "product", "position", "rank", "turn"),
        _S(
            ", r AS (SELECT doc_id % 9 AS qid, product, doc_id AS position, section_id + 1 AS rank, text FROM sections), f AS (SELECT *, row_number() OVER (PARTITION BY qid, text ORDER BY rank, position) AS k FROM r), t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, position) AS turn FROM f WHERE k = 1)",
            "SELECT qid, product, position, rank, turn FROM t WHERE turn <= 8",
        ),
    ),
    "renumber": (lambda s, d: renumbered(sections(s, d), "product", "doc_id", "section_id").select("doc_id", "section_id", "chunk_id"), _S("", "SELECT doc_id, section_id, row_number() OVER (ORDER BY product, doc_id, section_id) - 1 AS chunk_id FROM sections")),
    "publish_merge": (
        lambda s, d: replaced(*_publish(s, d)),
        _S(", r AS (SELECT product, count(*) AS n, CAST(sum(char_len) AS BIGINT) AS digest FROM sections GROUP BY product)", "SELECT product, n, CASE WHEN product = 'src1' THEN digest + 1 ELSE digest END AS digest FROM r"),
    ),
    "publish_diff": (
        lambda s, d: publish_diff(*_publish(s, d)),
        _S(
            ", r AS (SELECT product, CAST(sum(char_len) AS BIGINT) AS digest FROM sections GROUP BY product), o AS (SELECT * FROM r WHERE product <> 'src10'), p AS (SELECT product, CASE WHEN product = 'src1' THEN digest + 1 ELSE digest END AS digest FROM r WHERE starts_with(product, 'src1'))",
            "SELECT coalesce(o.product, p.product) AS product, CASE WHEN o.product IS NULL THEN 'created' WHEN p.product IS NULL THEN 'kept' WHEN o.digest = p.digest THEN 'unchanged' ELSE 'replaced' END AS change FROM o FULL JOIN p ON o.product = p.product",
        ),
    ),
    "section_quality": (
        lambda s, d: quality_metrics(sections(s, d), 720, 140, 1100, _chars(s, d)),
        _S(
            r""", c AS (SELECT source AS product, sum(length(regexp_replace(text, '\s', '', 'g'))) AS chars FROM documents GROUP BY 1), p AS (SELECT product, text, count(*) AS w, max(char_len) AS n FROM sections GROUP BY product, text), g AS (
            SELECT product, sum(w) AS chunks, min(n) AS least, max(n) AS most, floor(sum(n * w) * 10.0 / sum(w) + 0.5) / 10 AS a, sum(w) FILTER (n < 140) AS s, sum(w) FILTER (n > 1100) AS l, sum(w - 1) AS dup, sum(least(n, 720) * w) AS cov FROM p GROUP BY product)""",
            "SELECT product, CAST(chunks AS BIGINT) AS chunks, least, most, a AS avg, CAST(coalesce(s, 0) AS BIGINT) AS short, CAST(coalesce(l, 0) AS BIGINT) AS long, CAST(dup AS BIGINT) AS duplicates, floor(least(1.0, cov / greatest(chars, 1)) * 10000 + 0.5) / 10000 AS coverage, CASE WHEN coalesce(l, 0) > 0 THEN 'error' WHEN coalesce(s, 0) > 0 OR dup > 0 THEN 'warning' ELSE 'ok' END AS status FROM g JOIN c USING (product)",
        ),
    ),
    "catalog": (
        lambda s, d: sections(s, d).groupBy("product").agg(F.sum("char_len").alias("total_chars"), F.count("*").alias("section_count"), F.count_distinct("doc_id").alias("manuals"), F.max("section_id").alias("last_section")),
        _S("", "SELECT product, CAST(sum(char_len) AS BIGINT) AS total_chars, count(*) AS section_count, count(DISTINCT doc_id) AS manuals, max(section_id) AS last_section FROM sections GROUP BY product"),
    ),
    "light_sections": (lambda s, d: sections(s, d).select("doc_id", "section_id", "heading", "char_len"), _S("", "SELECT doc_id, section_id, heading, char_len FROM sections")),
    "mirror_tags": (
        lambda s, d: mirror_tags(_chunk_rows(s, d)).groupBy("tag").agg(F.count("*").alias("n")),
        _S(", b AS (SELECT *, lower(heading || chr(10) || text) AS both_ FROM sections), t AS (SELECT doc_id, section_id, unnest([" + ", ".join(f"CASE WHEN regexp_matches(both_, '{p}') THEN '{n}' END" for n, p in T.TAG_RULES) + f", CASE WHEN regexp_matches(text, '{T.STEP}') OR len(regexp_extract_all(text, '{T.NUMBERED}')) >= 2 THEN 'procedure' END]) AS tag FROM b)", "SELECT tag, count(DISTINCT (doc_id, section_id)) AS n FROM t WHERE tag IS NOT NULL GROUP BY tag"),
    ),
    "chunk_filter": (
        lambda s, d: chunk_filter(_chunk_rows(s, d), manual="src3", keyword="tion and", limit=100).select("chunk_id", "heading"),
        _S("", "SELECT doc_id * 1000000 + section_id AS chunk_id, heading FROM sections WHERE product = 'src3' AND (contains(lower(heading), 'tion and') OR contains(lower(text), 'tion and')) ORDER BY 1 LIMIT 100"),
    ),
    "chunk_counts": (lambda s, d: sections(s, d).groupBy("product").agg(F.count("*").alias("n")), _S("", "SELECT product, count(*) AS n FROM sections GROUP BY product")),
    "searchable_text": (
        lambda s, d: searchable(sections(s, d).withColumn("summary", T.summary(F.col("text"), 160))).select("doc_id", "section_id", F.md5("searchable").alias("digest")),
        _S(
            r", f AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM sections), m AS (SELECT *, CASE WHEN length(t) <= 160 THEN t ELSE regexp_replace(substr(t, 1, 157), '[ ,，。]+$', '') || '...' END AS summary FROM f)",
            "SELECT doc_id, section_id, md5(array_to_string(list_filter([trim(product), trim(heading), trim(summary), trim(text)], lambda x: x <> ''), chr(10))) AS digest FROM m",
        ),
    ),
    "set_equality": (
        lambda s, d: set_equal(table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id")),
        "SELECT 'left' AS side, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels) UNION ALL SELECT 'right', count(*) FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)",
    ),
    "dedupe_seen": (
        lambda s, d: unseen(sections(s, d).withColumn("session", F.col("doc_id") % 10), sections(s, d).filter("char_len < 60").withColumn("session", F.col("doc_id") % 10)).groupBy("session").agg(F.count("*").alias("n")),
        _S(
            r", r AS (SELECT DISTINCT doc_id % 10 AS session, product, heading, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM sections), h AS (SELECT doc_id % 10 AS session, product, heading, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM sections WHERE char_len < 60)",
            "SELECT session, count(*) AS n FROM (SELECT * FROM r EXCEPT SELECT * FROM h) GROUP BY session",
        ),
    ),
    "insert_or_ignore": (
        lambda s, d: insert_or_ignore(table(s, d, "lineitem"), ["l_orderkey", "l_linestatus"], "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").groupBy("l_linestatus").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines")),
        "SELECT l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem) WHERE k = 1 GROUP BY l_linestatus",
    ),
}
