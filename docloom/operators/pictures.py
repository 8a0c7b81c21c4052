"""Pictures of an answer: binding to passages, owners, figure groups and what is around them.

A figure group is a run of pictures of one source passage, between subheadings. Candidates for
an answer come in three hops, each with where it came from: what was retrieved, the rest of its
groups, then neighbouring sections; ``MOST`` at most. A group is completed as a whole or not at all.

Nulls and ties: null texts are empty, null or blank picture ids are none. Picture ids are compared
without case where they come from answers. Equal places go by id. A picture that several passages
have is given once, to the first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import SECTIONS, sections, table
from . import retrieval as R

#: Candidates of a question, and how far neighbouring sections may be, for any question and for wide ones.
MOST, NEAR, WIDE = 48, 1, 8
#: What stands for a picture in a passage, and a line that is a subheading.
MARK = "<PIC>"
SUBHEADING = r"(?m)^[ \t]{0,3}#{1,6}[ \t]+\S[^\r\n]*$"
#: Words that a question and a heading don't share.
STOP = ["about", "after", "before", "could", "does", "have", "how", "into", "other", "should", "there", "these", "this", "using", "want", "what", "when", "which", "while", "with", "would", "your", "the", "and", "for"]
#: Wordings of questions that go over several sections.
SCOPE = ["有哪些", "包括什么", "组成", "介绍", "不同", "各自", "步骤", "如何", "怎样", "what are", "what kinds", "introduce", "different", "other functions", "requirements", "limitations", "characteristics", "how to", "how do i", "what should"]
#: Wordings that count figures, and what a heading speaks of that a question of use or of service doesn't.
COUNTED = r"\b(?:only|first|second|third|one|two|three|four)\b|仅|只|第[一二三四五六七八九十\d]+"
USES, CHANGES, CHANGED = ["how to use", "how do i use", "use the"], ["change", "modify", "setting", "configure", "default"], ["changing", "setting", "configuration", "default"]
SERVICE, SETUP = ["clean", "replace", "maintain", "care"], ["initial setup", "first installation", "packaging"]


def _any(text: Column, wordings: list[str]) -> Column:
    out = F.lit(False)
    for w in wordings:
        out = out | F.contains(text, F.lit(w))
    return out


def terms(text: Column) -> Column:
    """Distinct Latin terms of three letters at least, in the singular, without stop words."""
    found = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z][a-z0-9-]+)"), 1), lambda t: (F.length(t) >= 3) & ~t.isin(STOP))
    cut = lambda t, n: F.substring(t, F.lit(1), F.length(t) - n)
    return F.array_distinct(F.transform(found, lambda t: F.when(t.endswith("ies") & (F.length(t) > 4), F.concat(cut(t, 3), F.lit("y"))).when(t.endswith("s") & ~t.endswith("ss") & (F.length(t) > 4), cut(t, 1)).otherwise(t)))


def is_wide(question: Column) -> Column:
    return _any(F.lower(F.coalesce(question, F.lit(""))), SCOPE)


def bound_pictures(answers: DataFrame, results: DataFrame, most: int = 8) -> DataFrame:
    """Pictures of the passages that an answer used: ``answers`` (qid, answer), ``results`` (qid, rank, text, pics).

    Passages are ordered by what they share with the answer. A picture is given once, the best
    ``most`` stay, and they come in the order of the passages (``place`` from 1).
    """
    grams, tokens = T.trigrams, lambda c: F.array_distinct(F.filter(T.words(c), lambda w: F.length(w) >= 2))
    own = lambda c: F.coalesce(F.col(c), F.lit(""))
    a = answers.filter(F.trim(own("answer")) != "").select("qid", grams(own("answer")).alias("ag"), tokens(own("answer")).alias("at"))
    r = results.filter(F.trim(own("text")) != "").select("qid", "rank", "pics", grams(own("text")).alias("pg"), tokens(own("text")).alias("pt"))
    shared = lambda x, y: F.size(F.array_intersect(x, y))
    rows = r.join(a, "qid").select("qid", "rank", "pics", shared("ag", "pg").alias("g"), shared("at", "pt").alias("t"), *(F.greatest(F.size(c), F.lit(1)).alias(f"n_{c}") for c in ("ag", "pg", "pt"))).filter("g > 0 OR t > 0")
    score = F.round(0.58 * F.col("g") / F.col("n_pg") + 0.27 * F.col("g") / F.col("n_ag") + 0.15 * F.col("t") / F.col("n_pt"), 8)
    each = rows.select("qid", "rank", score.alias("score"), F.posexplode("pics").alias("spot", "pic")).withColumn("pic", F.trim("pic")).filter("pic <> ''")
    first = each.groupBy("qid", "pic").agg(F.min(F.struct((-F.col("score")).alias("by"), "rank", "spot")).alias("first"))
    best = Window.partitionBy("qid").orderBy("first", "pic")
    kept = first.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= most)
    order = Window.partitionBy("qid").orderBy("first.rank", "first.spot", "pic")
    return kept.select("qid", "pic", F.row_number().over(order).alias("place"))


def picture_owners(asked: DataFrame, chunks: DataFrame, preferred: DataFrame) -> DataFrame:
    """For each picture of an answer (qid, pic) the chunk that has it (``chunk_id``, null if none has).

    ``chunks`` has chunk_id, product, direct_pics and linked_pics. A chunk's own picture goes before a
    linked one, then one of the ``preferred`` products (qid, product), then the first chunk. What chunks have
    is brought down to the first of each picture, kind and product before it meets the questions.
    """
    kind = lambda c, n: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda p: F.struct(F.lower(F.trim(p)).alias("key"), F.lit(n).alias("linked")))
    own = chunks.select("chunk_id", "product", F.explode(F.concat(kind("direct_pics", 0), kind("linked_pics", 1))).alias("p"))
    own = own.select("product", "p.*", "chunk_id").filter("key <> ''").groupBy("key", "linked", "product").agg(F.min("chunk_id").alias("chunk_id"))
    rows = asked.select("qid", "pic", F.lower(F.trim("pic")).alias("key")).filter("key <> ''").distinct().join(own, "key", "left")
    liked = preferred.select("qid", "product", F.lit(False).alias("other")).distinct()
    ranked = rows.join(liked, ["qid", "product"], "left").groupBy("qid", "pic").agg(F.min(F.when(F.col("chunk_id").isNotNull(), F.struct("linked", F.coalesce("other", F.lit(True)).alias("other"), "chunk_id"))).alias("best"))
    return ranked.select("qid", "pic", F.col("best.chunk_id").alias("chunk_id"), (F.col("best.linked") == 0).alias("direct"))


def figure_ranges(passages: DataFrame) -> DataFrame:
    """Figures of source passages (product, passage, heading, text, pics): one row for each picture.

    The text has ``MARK`` where a picture stands. A picture with a subheading between it and the last begins a new
    group. Rows have ``group``, from 0 in a passage, and ``spot``, the picture's place in the passage.
    """
    pics = F.filter("pics", lambda p: F.trim(p) != "")
    before = F.transform(F.split(F.coalesce("text", F.lit("")), MARK), lambda part: part.rlike(SUBHEADING))
    own = passages.select("product", "passage", "heading", F.array_distinct(pics).alias("pics"), before.alias("before")).filter(F.size("pics") > 0)
    rows = own.select("product", "passage", "heading", "before", F.posexplode("pics").alias("spot", "pic"))
    group = F.aggregate(F.slice("before", 2, F.greatest(F.col("spot"), F.lit(0))), F.lit(0), lambda n, b: n + b.cast("int"))
    return rows.select("product", "passage", "heading", "pic", "spot", group.alias("group"))


def figure_candidates(questions: DataFrame, seeds: DataFrame, figures: DataFrame, groups: DataFrame, routed: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """Pictures that may answer a question, with ``origin`` and ``place``.

    ``seeds`` (qid, pic, rank) were retrieved; ``figures`` (pic, product, section_order, parts, image_order) tells where
    pictures stand, ``parts`` being the heading's; ``groups`` is ``figure_ranges``. Neighbours are looked up by a section's
    number and those around it, never by comparing all with all. ``routed`` (qid, product) limits neighbours.
    """
    where = figures.groupBy("pic").agg(F.min(F.struct("product", "section_order", "image_order", "parts")).alias("w")).select("pic", "w.*")
    first = seeds.groupBy("qid", "pic").agg(F.min("rank").alias("rank")).join(where, "pic")
    cards = first.select("qid", "pic", F.lit(0).alias("hop"), F.col("rank").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "product", "section_order", "parts")
    mine = groups.select("product", "passage", "group", "pic", "spot")
    met = first.select("qid", "rank", "product", "pic").join(mine.select("product", "pic", "passage", "group"), ["product", "pic"])
    fellows = met.groupBy("qid", "product", "passage", "group").agg(F.min("rank").alias("rank")).join(mine, ["product", "passage", "group"])
    fellows = fellows.groupBy("qid", "pic").agg(F.min(F.struct(F.col("rank").cast("long").alias("a"), F.col("spot").cast("long").alias("b"))).alias("o")).join(where, "pic")
    cards = cards.unionByName(fellows.select("qid", "pic", F.lit(1).alias("hop"), "o.a", "o.b", "product", "section_order", "parts"))
    cards = _ranked(cards, most)

    wide = questions.select("qid", is_wide(F.col("text")).alias("wide"))
    around = cards.select("qid", "product", "section_order", "parts").distinct().join(wide, "qid")
    steps = F.when(F.col("wide"), F.sequence(F.lit(-WIDE), F.lit(WIDE))).otherwise(F.sequence(F.lit(-NEAR), F.lit(NEAR)))
    around = around.select("qid", "product", "wide", F.col("parts").alias("seed_parts"), F.explode(steps).alias("step"), "section_order").withColumn("section_order", F.col("section_order") + F.col("step"))
    common = T.common_prefix(F.col("seed_parts"), F.col("parts"))
    near = around.join(figures, ["product", "section_order"]).filter((common >= 2) | (F.col("wide") & (common >= 1) & (F.abs("step") <= 1)))
    if routed is not None:
        some = routed.select("qid").distinct().withColumn("limited", F.lit(True))
        near = near.join(some, "qid", "left").join(routed.select("qid", "product", F.lit(True).alias("there")).distinct(), ["qid", "product"], "left").filter("limited IS NULL OR there")
    near = near.groupBy("qid", "pic").agg(F.min(F.struct(F.abs("step").cast("long").alias("d"), F.col("section_order").cast("long").alias("s"), F.col("image_order").cast("long").alias("i"))).alias("o"))
    more = near.select("qid", "pic", F.lit(2).alias("hop"), F.col("o.d").alias("a"), (F.col("o.s") * 1000 + F.col("o.i")).alias("b"))
    every = _ranked(cards.select("qid", "pic", "hop", "a", "b").unionByName(more), most)
    origin = F.element_at(F.array(F.lit("retrieved"), F.lit("source_group"), F.lit("structural_neighbor")), F.col("hop") + 1)
    return every.select("qid", "pic", origin.alias("origin"), "place")


def _ranked(cards: DataFrame, most: int) -> DataFrame:
    """Each picture of a question once, by its first hop; the first ``most``."""
    rest = [c for c in cards.columns if c not in ("qid", "pic", "hop", "a", "b", "place")]
    one = cards.groupBy("qid", "pic").agg(F.min(F.struct("hop", "a", "b", *rest)).alias("c")).select("qid", "pic", "c.*")
    return one.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("hop", "a", "b", "pic"))).filter(F.col("place") <= most)


def heading_fit(question: Column, heading: Column) -> Column:
    """Shared terms, less three where the question is about use and the heading about changing, or about service and setting up."""
    q, h = F.lower(F.coalesce(question, F.lit(""))), F.lower(F.coalesce(heading, F.lit("")))
    use = _any(q, USES) & ~_any(q, CHANGES) & _any(h, CHANGED)
    service = _any(q, SERVICE) & _any(h, SETUP)
    return F.size(F.array_intersect(terms(q), terms(h))) - F.when(use, 3).otherwise(0) - F.when(service, 3).otherwise(0)


def completed_groups(questions: DataFrame, cards: DataFrame, chosen: DataFrame) -> DataFrame:
    """Pictures (qid, pic) that complete groups: ``cards`` (qid, group, group_heading, context, pic, spot, heading), ``chosen`` (qid, pic).

    A group of two to four pictures, of which some but not all are chosen, is completed if each missing
    one has the heading of a chosen one and the question is about the whole group. All of it comes from one sum over
    the group's cards; the missing ones are looked up again for those groups only.
    """
    picked = chosen.select("qid", "pic", F.lit(True).alias("picked")).distinct()
    rows = cards.join(picked, ["qid", "pic"], "left").withColumn("picked", F.coalesce("picked", F.lit(False)))
    rows = rows.withColumn("key", F.array_join(F.transform(T.heading_parts(F.coalesce("heading", F.lit(""))), lambda p: F.lower(p)), "/"))
    per = rows.groupBy("qid", "group").agg(
        F.count_distinct("pic").alias("n"),
        F.count_distinct(F.when(F.col("picked"), F.col("pic"))).alias("chosen"),
        F.collect_set(F.when(F.col("picked"), F.col("key"))).alias("chosen_keys"),
        F.collect_set(F.when(~F.col("picked"), F.col("key"))).alias("missing_keys"),
        F.min("group_heading").alias("group_heading"),
        F.min("context").alias("context"),
        F.collect_set(F.coalesce("heading", F.lit(""))).alias("headings"),
    )
    per = per.filter("n BETWEEN 2 AND 4 AND chosen BETWEEN 1 AND n - 1").filter(F.size(F.array_except("missing_keys", "chosen_keys")) == 0)
    said = per.join(questions.select("qid", F.lower(F.coalesce("text", F.lit(""))).alias("q")), "qid")
    source = F.concat_ws(" ", "group_heading", "context", F.array_join(F.array_sort("headings"), " "))
    runs = F.regexp_extract_all(source, F.lit(r"([一-鿿]{4,})"), 1)
    in_q = F.exists(runs, lambda run: F.exists(F.sequence(F.lit(1), F.length(run) - 3), lambda i: F.contains(F.col("q"), F.substring(run, i, F.lit(4)))))
    scope = F.size(F.array_intersect(terms(F.col("q")), terms(source))) + in_q.cast("int")
    fit = F.array_max(F.transform("headings", lambda h: heading_fit(F.col("q"), h)))
    counted = F.col("q").rlike(COUNTED) & ~(F.contains("q", F.lit("besides")) & F.contains("q", F.lit("other")))
    wide = is_wide(F.col("q"))
    whole = ~counted & ((scope >= 2) | ((F.col("chosen") >= 2) & wide & (scope >= 1) & (fit >= 1)) | ((F.col("n") == 2) & wide & (fit >= 1)))
    good = said.filter(whole).select("qid", "group")
    return rows.filter("NOT picked").join(good, ["qid", "group"], "left_semi").select("qid", "pic").distinct()


# Queries over the test tables: a document is a source passage, most of its lines have a picture, every fifth is a subheading.


def _lines(s, d) -> DataFrame:
    return sections(s, d).withColumn("pic", F.when(F.col("section_id") % 3 > 0, F.concat_ws("_", "doc_id", "section_id")))


def _passages(s, d) -> DataFrame:
    line = F.concat(F.when(F.col("section_id") % 5 == 0, "# ").otherwise(""), F.col("text"), F.when(F.col("pic").isNotNull(), f" {MARK}").otherwise(""))
    rows = _lines(s, d).groupBy("product", F.col("doc_id").alias("passage")).agg(F.array_sort(F.collect_list(F.struct("section_id", line.alias("line"), "pic", "heading"))).alias("ls"))
    return rows.select("product", "passage", F.col("ls")[0]["heading"].alias("heading"), F.array_join("ls.line", "\n").alias("text"), F.array_compact("ls.pic").alias("pics"))


def _figures(s, d) -> DataFrame:
    order = F.col("doc_id") * 100_000 + F.col("section_id")
    parts = F.array(F.col("product"), F.concat(F.lit("d"), "doc_id"), F.concat(F.lit("p"), F.expr("section_id div 4")))
    return _lines(s, d).filter("pic IS NOT NULL").select("pic", "product", order.alias("section_order"), parts.alias("parts"), F.lit(0).alias("image_order"))


def _ask(s, d) -> DataFrame:
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("item_id") % 2 == 0, " What are the steps?").otherwise(""))
    return table(s, d, "benchmark").select(F.col("item_id").alias("qid"), text.alias("text"))


def _seeds(s, d) -> DataFrame:
    return _lines(s, d).filter("pic IS NOT NULL AND section_id % 7 = 1").join(_ask(s, d).select("qid"), F.col("doc_id") % 100 == F.col("qid")).select("qid", "pic", F.expr("doc_id div 100").alias("rank"))


def _answers(s, d) -> DataFrame:
    return _ask(s, d).withColumnRenamed("text", "answer")


def _results(s, d) -> DataFrame:
    hits = R.bm25_top(s, d, 5).select("qid", "doc_id", "rank")
    pics = F.array(F.concat_ws("_", "doc_id", F.lit("0")), F.concat(F.lit("shared"), F.col("doc_id") % 3), F.lit(" "), F.concat_ws("_", "doc_id", F.lit("1")))
    return hits.join(table(s, d, "documents").select("doc_id", "text"), "doc_id").select("qid", "rank", "text", pics.alias("pics"))


def _owners(s, d) -> DataFrame:
    chunk = F.col("doc_id") * 1000 + F.col("section_id")
    lines = _lines(s, d)
    linked = F.array(F.concat(F.lit("P"), F.col("doc_id") % 50), F.concat_ws("_", "doc_id", F.col("section_id") + 1))
    chunks = lines.select(chunk.alias("chunk_id"), "product", F.array(F.col("pic")).alias("direct_pics"), linked.alias("linked_pics"))
    asked = lines.filter("section_id < 3").select((F.col("doc_id") % 60).alias("qid"), F.explode(F.array(F.concat(F.lit("p"), F.col("doc_id") % 60), F.upper(F.concat_ws("_", "doc_id", "section_id")))).alias("pic"))
    liked = table(s, d, "documents").select((F.col("doc_id") % 60).alias("qid"), F.concat(F.lit("src"), F.col("doc_id") % 5).alias("product"))
    return picture_owners(asked, chunks, liked)


def _group_cards(s, d) -> DataFrame:
    """The figure groups of the documents that a question is about."""
    g = figure_ranges(_passages(s, d))
    head = _lines(s, d).filter("pic IS NOT NULL").select("pic", F.concat_ws(" / ", "product", F.expr("section_id div 6")).alias("heading"))
    rows = g.join(head.withColumnRenamed("heading", "own"), "pic")
    return rows.select((F.col("passage") % 100).alias("qid"), F.concat_ws("/", "passage", "group").alias("group"), F.col("heading").alias("group_heading"), F.lit("").alias("context"), "pic", "spot", F.col("own").alias("heading"))


def _completed(s, d) -> DataFrame:
    cards = _group_cards(s, d)
    chosen = cards.filter("spot % 3 = 0").select("qid", "pic")
    asked = table(s, d, "documents").filter("doc_id < 100").select(F.col("doc_id").alias("qid"), F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" How to use "), "source", F.lit("?"))).otherwise(" only one")).alias("text"))
    return completed_groups(asked, cards, chosen)


_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
_TERMS = f"list_distinct(list_transform(list_filter(regexp_extract_all(lower(coalesce({{}}, '')), '[a-z][a-z0-9-]+'), lambda t: length(t) >= 3 AND NOT list_contains({_STOPS}, t)), lambda t: CASE WHEN ends_with(t, 'ies') AND length(t) > 4 THEN substr(t, 1, length(t) - 3) || 'y' WHEN ends_with(t, 's') AND NOT ends_with(t, 'ss') AND length(t) > 4 THEN substr(t, 1, length(t) - 1) ELSE t END))"


def _any_sql(text: str, wordings: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in wordings) + ")"


_WIDE = _any_sql("lower({0})", SCOPE)
_LINES = f"{SECTIONS}, ln AS (SELECT *, CASE WHEN section_id % 3 > 0 THEN doc_id || '_' || section_id END AS pic FROM sections)"
_RANGES = f"""{_LINES}, rn AS (SELECT *, sum((regexp_matches(text, '^[ \\t]{{0,3}}#{{1,6}}[ \\t]+\\S') OR section_id % 5 = 0)::INT) OVER (PARTITION BY doc_id ORDER BY section_id) AS heads FROM ln),
g0 AS (SELECT product, doc_id AS passage, pic, heads, CAST(row_number() OVER w - 1 AS INT) AS spot, lag(heads) OVER w AS last FROM rn WHERE pic IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY section_id)),
g AS (SELECT product, passage, pic, spot, CAST(sum(CASE WHEN last IS NOT NULL AND heads > last THEN 1 ELSE 0 END) OVER (PARTITION BY passage ORDER BY spot) AS INT) AS grp FROM g0)"""
_Q2 = "q AS (SELECT item_id AS qid, coalesce(text, '') || CASE WHEN item_id % 2 = 0 THEN ' What are the steps?' ELSE '' END AS text FROM benchmark)"
_FLAT = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"

QUERIES = {
    "bound_pictures": (
        lambda s, d: bound_pictures(_answers(s, d), _results(s, d), 6),
        f"""WITH {R.STATS}, {R.A}, {_Q2}, r AS (SELECT a.qid, rank, d.text, q.text AS answer, [doc_id || '_0', 'shared' || (doc_id % 3), doc_id || '_1'] AS pics, [0, 1, 3] AS spots FROM a JOIN documents d USING (doc_id) JOIN q ON q.qid = a.qid WHERE rank <= 5 AND trim(coalesce(d.text, '')) <> ''),
        f AS (SELECT *, {_FLAT.format("answer")} AS fa, {_FLAT.format("text")} AS fp, list_distinct(list_filter({R._W.format("answer")}, lambda w: length(w) >= 2)) AS ta, list_distinct(list_filter({R._W.format("text")}, lambda w: length(w) >= 2)) AS tp FROM r),
        g AS (SELECT *, CASE WHEN length(fa) >= 3 THEN list_distinct(list_transform(range(1, length(fa) - 1), lambda i: substr(fa, i, 3))) ELSE [] END AS ga, CASE WHEN length(fp) >= 3 THEN list_distinct(list_transform(range(1, length(fp) - 1), lambda i: substr(fp, i, 3))) ELSE [] END AS gp FROM f),
        k AS (SELECT qid, rank, pics, spots, len(list_intersect(ga, gp)) AS g, len(list_intersect(ta, tp)) AS t, greatest(len(ga), 1) AS na, greatest(len(gp), 1) AS np, greatest(len(tp), 1) AS nt FROM g),
        e AS (SELECT qid, rank, round(0.58 * g / np + 0.27 * g / na + 0.15 * t / nt, 8) AS score, unnest(pics) AS pic, unnest(spots) AS spot FROM k WHERE g > 0 OR t > 0),
        o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, pic ORDER BY score DESC, rank, spot) AS n FROM e) WHERE n = 1), m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank, spot, pic) AS k FROM o)
        SELECT qid, pic, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank, spot, pic) AS INT) AS place FROM m WHERE k <= 6""",
    ),
    "picture_owners": (
        _owners,
        f"""WITH {_LINES}, c AS (SELECT doc_id * 1000 + section_id AS chunk_id, product, lower(unnest(['p' || (doc_id % 50), doc_id || '_' || (section_id + 1)])) AS key, 1 AS linked FROM ln UNION ALL SELECT doc_id * 1000 + section_id, product, lower(pic), 0 FROM ln WHERE pic IS NOT NULL),
        a AS (SELECT DISTINCT doc_id % 60 AS qid, unnest(['p' || (doc_id % 60), upper(doc_id || '_' || section_id)]) AS pic FROM ln WHERE section_id < 3), p AS (SELECT DISTINCT doc_id % 60 AS qid, 'src' || (doc_id % 5) AS product FROM documents),
        k AS (SELECT a.qid, pic, chunk_id, linked, row_number() OVER (PARTITION BY a.qid, pic ORDER BY linked, p.qid IS NULL, chunk_id) AS k FROM a LEFT JOIN c ON c.key = lower(pic) LEFT JOIN p ON p.qid = a.qid AND p.product = c.product) SELECT qid, pic, chunk_id, linked = 0 AS direct FROM k WHERE k = 1""",
    ),
    "figure_ranges": (lambda s, d: figure_ranges(_passages(s, d)).select("product", "passage", "pic", "spot", "group"), f'WITH {_RANGES} SELECT product, passage, pic, spot, grp AS "group" FROM g'),
    "figure_candidates": (
        lambda s, d: figure_candidates(_ask(s, d), _seeds(s, d), _figures(s, d), figure_ranges(_passages(s, d))),
        f"""WITH {_RANGES}, {_Q2}, fg AS (SELECT pic, product, doc_id * 100000 + section_id AS so, doc_id, section_id FROM ln WHERE pic IS NOT NULL), seed AS (SELECT qid, pic, product, doc_id // 100 AS rank, so FROM fg JOIN q ON doc_id % 100 = qid WHERE section_id % 7 = 1),
        mg AS (SELECT qid, passage, grp, min(rank) AS rank FROM seed JOIN g USING (pic) GROUP BY ALL), fe AS (SELECT qid, g.pic, 1 AS hop, min(rank * 1000000 + spot) // 1000000 AS a, min(rank * 1000000 + spot) % 1000000 AS b FROM mg JOIN g ON g.passage = mg.passage AND g.grp = mg.grp GROUP BY ALL),
        h1 AS (SELECT qid, pic, 0 AS hop, rank AS a, 0 AS b FROM seed UNION ALL SELECT * FROM fe), u1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, pic ORDER BY hop, a, b) AS n FROM h1) WHERE n = 1), c1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hop, a, b, pic) AS place FROM u1) WHERE place <= {MOST}),
        sd AS (SELECT c1.qid, fg.product, so, fg.doc_id, {_WIDE.format("q.text")} AS wide FROM c1 JOIN fg USING (pic) JOIN q ON q.qid = c1.qid),
        nb AS (SELECT sd.qid, x.pic, 2 AS hop, min(abs(x.so - sd.so) * 100000000000000 + x.so) // 100000000000000 AS a, (min(abs(x.so - sd.so) * 100000000000000 + x.so) % 100000000000000) * 1000 AS b FROM sd JOIN fg x ON x.product = sd.product AND abs(x.so - sd.so) <= CASE WHEN wide THEN {WIDE} ELSE {NEAR} END AND (x.doc_id = sd.doc_id OR (wide AND abs(x.so - sd.so) <= 1)) GROUP BY ALL),
        h2 AS (SELECT qid, pic, hop, a, b FROM c1 UNION ALL SELECT * FROM nb), u2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, pic ORDER BY hop, a, b) AS n FROM h2) WHERE n = 1)
        SELECT * FROM (SELECT qid, pic, ['retrieved', 'source_group', 'structural_neighbor'][hop + 1] AS origin, CAST(row_number() OVER (PARTITION BY qid ORDER BY hop, a, b, pic) AS INT) AS place FROM u2) WHERE place <= {MOST}""",
    ),
    "completed_groups": (
        _completed,
        f"""WITH {_RANGES}, hd AS (SELECT doc_id AS passage, min_by(heading, section_id) AS group_heading FROM ln GROUP BY doc_id), c AS (SELECT g.passage % 100 AS qid, g.passage || '/' || grp AS grp, group_heading, g.pic, spot, g.product || ' / ' || (section_id // 6) AS heading, spot % 3 = 0 AS picked FROM g JOIN hd USING (passage) JOIN ln ON ln.pic = g.pic),
        q AS (SELECT doc_id AS qid, lower(coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN ' How to use ' || source || '?' ELSE ' only one' END) AS q FROM documents WHERE doc_id < 100),
        p AS (SELECT qid, grp, count(DISTINCT pic) AS n, count(DISTINCT pic) FILTER (picked) AS chosen, list(DISTINCT heading) FILTER (picked) AS ck, list(DISTINCT heading) FILTER (NOT picked) AS mk, min(group_heading) AS gh, list(DISTINCT heading) AS hs FROM c GROUP BY qid, grp),
        s AS (SELECT p.*, q, {_WIDE.format("q")} AS wide, regexp_matches(q, '\\b(only|first|second|third|one|two|three|four)\\b|仅|只|第[一二三四五六七八九十0-9]+') AND NOT (contains(q, 'besides') AND contains(q, 'other')) AS counted, len(list_intersect({_TERMS.format("q")}, {_TERMS.format("gh || ' ' || array_to_string(hs, ' ')")})) AS scope,
          list_max(list_transform(hs, lambda h: len(list_intersect({_TERMS.format("q")}, {_TERMS.format("h")})) - CASE WHEN {_any_sql("q", USES)} AND NOT {_any_sql("q", CHANGES)} AND {_any_sql("lower(h)", CHANGED)} THEN 3 ELSE 0 END - CASE WHEN {_any_sql("q", SERVICE)} AND {_any_sql("lower(h)", SETUP)} THEN 3 ELSE 0 END)) AS fit
          FROM p JOIN q USING (qid) WHERE n BETWEEN 2 AND 4 AND chosen BETWEEN 1 AND n - 1 AND len(list_filter(mk, lambda x: NOT list_contains(ck, x))) = 0)
        SELECT DISTINCT qid, pic FROM c JOIN s USING (qid, grp) WHERE NOT picked AND NOT counted AND (scope >= 2 OR (chosen >= 2 AND wide AND scope >= 1 AND fit >= 1) OR (n = 2 AND wide AND fit >= 1))""",
    ),
}
