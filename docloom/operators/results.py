"""Final results, narrowed headings, figures of a group, guards of publication, and the clean-up of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import SECTIONS, sections, table
from . import retrieval as R

# Spellings of picture marks and of circled numbers in manuals.
PIC_NAME = r"[A-Za-z][A-Za-z0-9_]*\d+_\d+"
PIC_MARKS = [
    (rf"(?i)<\s*PIC\s*>\s*({PIC_NAME})?\s*<\s*/\s*PIC\s*>", "<PIC>"),
    (r"(?i)[\[【(（《]\s*PIC\s*[\]】)）》]", "<PIC>"),
    (r"(?i)<\s*PIC\s*>", "<PIC>"),
    (r"(?i)<\s*/\s*PIC\s*>", ""),
    (rf"<PIC>\s*({PIC_NAME})", "<PIC>"),
]
#: What each match of these has.
PIC_NEEDS = [["/"], list("[【(（《"), ["<"], ["/"], ["<PIC>"]]
PIC_REF = r"(?i)\[\[\s*PIC\s*:\s*([^\]\n]+?)\s*\]\]"
BARE_PIC = r"(?<![<A-Za-z])PIC(?![A-Za-z>])"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"
SECOND = "[ⓐ-ⓩⒶ-Ⓩ○]"  # read in place of ② between ① and ③


def _text(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def picture_marks(text: Column | str) -> Column:
    """All spellings of a picture's mark as ``<PIC>``; names inside or right after a mark go. Null: empty."""
    out = _text(text)
    for (pattern, by), needs in zip(PIC_MARKS, PIC_NEEDS, strict=True):
        out = T.replaced(out, pattern, by, *needs)
    return out


def inline_pictures(text: Column | str) -> tuple[Column, Column]:
    """Text with ``[[PIC:name]]`` as ``<PIC>``, and the names in order."""
    names = F.filter(F.transform(F.regexp_extract_all(_text(text), F.lit(PIC_REF), 1), F.trim), lambda x: x != "")
    return F.regexp_replace(_text(text), PIC_REF, "<PIC>"), names


def named_pictures(text: Column | str, pics: Column) -> Column:
    """Text with its k-th ``<PIC>`` as ``[[PIC:name]]`` by the k-th of ``pics``; marks beyond these stay."""
    pieces = F.split(_text(text), "<PIC>", -1)
    mark = lambda i: F.when(i == 0, F.lit("")).otherwise(F.coalesce(F.concat(F.lit("[[PIC:"), F.get(pics, i - 1), F.lit("]]")), F.lit("<PIC>")))
    return F.array_join(F.transform(pieces, lambda piece, i: F.concat(mark(i), piece)), "")


def repaired_marks(text: Column | str, expected: Column) -> Column:
    """The first bare words ``PIC`` as marks, as many as are missing from ``expected``."""

    def mended(out: Column) -> Column:
        marks = ((F.length(out) - F.length(F.replace(out, F.lit("<PIC>"), F.lit("")))) / 5).cast("int")
        pieces = lambda missing: F.transform(F.split(out, BARE_PIC, -1), lambda piece, i: F.concat(F.when(i == 0, "").when(i <= missing, "<PIC>").otherwise("PIC"), piece))
        return F.when(expected > marks, F.array_join(pieces(expected - marks), "")).otherwise(out)

    return T.once(_text(text), mended)


def reference_symbols(text: Column | str) -> Column:
    """Circled numbers as characters; in a line that has ① and ③ a circled letter or an empty circle is ②."""

    def signs(out: Column) -> Column:
        for n, sign in enumerate(CIRCLED, 1):
            out = F.regexp_replace(out, rf"\$?\\textcircled\{{(?:\\scriptsize\{{)?{n}\}}?\}}\$?", sign)
        return F.regexp_replace(out, r"\$\\circledcirc\$|\\circledcirc", "②")

    mend = lambda line: F.when(line.contains("①") & line.contains("③"), F.regexp_replace(line, SECOND, "②")).otherwise(line)
    lines = lambda out: F.array_join(F.transform(F.split(out, "\n", -1), mend), "\n")
    out = T.once(_text(text), lambda x: F.when(F.contains(x, F.lit("circled")), signs(x)).otherwise(x))
    return T.once(out, lambda x: F.when(F.contains(x, F.lit("①")) & F.contains(x, F.lit("③")), lines(x)).otherwise(x))


def without_names(text: Column | str, pics: Column | None = None) -> Column:
    """Text without names of picture files: those of the row's ``pics``, longest first, then all that look like one."""
    out = _text(text)
    if pics is not None:
        longest = F.transform(F.sort_array(F.transform(F.filter(pics, lambda p: p != ""), lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))), asc=False), lambda s: F.concat(F.lit(r"\Q"), s["p"], F.lit(r"\E")))
        out = F.when(F.exists(pics, lambda p: (p != "") & F.contains(out, p)), F.regexp_replace(out, F.concat(F.lit(r"\b(?:"), F.array_join(longest, "|"), F.lit(r")\b")), F.lit(""))).otherwise(out)
    return T.replaced(out, rf"\b{PIC_NAME}\b", "", "_")


def tidy_blanks(text: Column | str) -> Column:
    """One blank in place of several, none around line ends, one empty line at most, none at the ends."""
    out = T.replaced(_text(text), "\r\n?", "\n", "\r")
    for pattern, by, *needs in ((r"[ \t]{2,}|\t", " ", "  ", "\t"), (r" +\n *|\n +", "\n", " \n", "\n "), (r"\n{3,}", "\n\n", "\n\n\n"), (r"^\n+", "", "\n")):
        out = T.replaced(out, pattern, by, *needs)
    return T.once(out, lambda x: F.when(F.right(x, F.lit(2)).rlike(r"[\s\x{85}\x{2028}\x{2029}]"), F.regexp_replace(x, r"\s+$", "")).otherwise(x))


def compact(text: Column | str, limit: int) -> Column:
    """Text with single blanks; one longer than ``limit`` ends in an ellipsis."""
    out = F.trim(F.regexp_replace(_text(text), r"\s+", " "))
    return F.when(F.length(out) <= limit, out).otherwise(F.concat(F.trim(F.substring(out, 1, limit - 1)), F.lit("…")))


def distinct_strings(values: Column, limit: int, count: int) -> Column:
    """The first ``count`` values that differ in more than case, compacted, in order."""
    short = F.filter(F.transform(values, lambda v: compact(v, limit)), lambda v: v != "")
    lower = F.transform(short, F.lower)
    return F.slice(F.filter(short, lambda v, i: F.array_position(lower, F.lower(v)) == i + 1), 1, count)


def fenced_json(text: Column | str, schema: str) -> Column:
    """The object of ``schema`` in a text, with or without a fence of code around it; null where it can't be read."""
    body = F.regexp_replace(F.trim(_text(text)), r"^```[A-Za-z]*\s*|\s*```$", "")
    return F.when(body.rlike(r"(?s)^\s*\{.*\}\s*$"), F.from_json(body, schema, {"mode": "PERMISSIVE"}))


def manual_detail(rows: DataFrame, chunks: DataFrame, product: str) -> DataFrame:
    """All sections and chunks (product, doc_id, place, text) of one product; the filter reaches both scans."""
    parts = [x.filter(F.col("product") == product).select(F.lit(kind).alias("kind"), "product", "doc_id", "place", "text") for kind, x in (("section", rows), ("chunk", chunks))]
    return parts[0].unionByName(parts[1])


def first_seen_counts(rows: DataFrame, key: str, place: str) -> DataFrame:
    """How many rows each key has, and ``first``, the place where it is seen first (order by it for the order of appearance)."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(place).alias("first"))


def refusals(new: DataFrame, published: DataFrame, replace: Column) -> DataFrame:
    """Why each product of ``new`` (product, n_errors) may not be published: it exists and isn't to be replaced, or has errors; null if it may."""
    there = published.select("product").distinct().withColumn("there", F.lit(True))
    why = F.when(F.col("there") & ~replace, "exists").when(F.col("n_errors") > 0, "quality")
    return new.join(there, "product", "left").withColumn("refused", why).drop("there")


def group_figures(seeds: DataFrame, groups: DataFrame, most: int = 48) -> DataFrame:
    """Other figures of the source groups (group_id, product, place, pic_id) of seeds (qid, product, pic_id): the first ``most`` of a query."""
    near = seeds.join(groups.select("product", "pic_id", "group_id"), ["product", "pic_id"]).select("qid", "group_id").distinct()
    found = near.join(groups, "group_id").groupBy("qid", "product", "pic_id").agg(F.min(F.struct("group_id", "place")).alias("at"))
    fresh = found.join(seeds.select("qid", "product", "pic_id"), ["qid", "product", "pic_id"], "left_anti")
    order = Window.partitionBy("qid").orderBy("at", "pic_id")
    return fresh.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).drop("at")


def first_siblings(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """The first ``n`` sections of a seed's document (qid, doc_id, n), in the manual's order; none where no n is asked for."""
    asked = seeds.filter("n IS NOT NULL").select("qid", "doc_id", "n")
    order = Window.partitionBy("qid", "doc_id").orderBy("section_id")
    return rows.join(asked, "doc_id").withColumn("k", F.row_number().over(order)).filter("k <= 10 AND k <= n")


def narrowed(ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """Ranked results (qid, doc_id, rank, heading, role) of a question, or only its one best heading.

    That one has two or more terms of the question, more than any other heading, is one of the
    first three, and no other heading has a term of the question that it lacks. Where both
    primary and support sections are among the results, these are kept instead.
    """
    terms = questions.select("qid", R.heading_terms(F.col("text")).alias("asked"))
    rows = ranked.join(terms, "qid").withColumn("shared", F.array_intersect("asked", R.heading_terms(F.col("heading"))))
    w = Window.partitionBy("qid")
    rows = rows.withColumn("hits", F.size("shared"))
    rows = rows.withColumn("best", F.max(F.struct(F.col("hits"), (-F.col("rank")).alias("at"), F.col("shared"))).over(w))
    for name, what in (
        ("leaders", F.sum((F.col("hits") == F.col("best.hits")).cast("int"))),
        ("news", F.max(F.size(F.array_except("shared", "best.shared")))),
        ("primary", F.max(F.coalesce(F.col("role") == "primary", F.lit(False)).cast("int"))),
        ("support", F.max(F.coalesce(F.col("role") == "support", F.lit(False)).cast("int"))),
    ):
        rows = rows.withColumn(name, what.over(w))
    both = (F.col("primary") == 1) & (F.col("support") == 1)
    one = (F.size("asked") >= 2) & (F.col("best.hits") >= 2) & (F.col("leaders") == 1) & (F.col("best.at") >= -3) & (F.col("news") == 0)
    keep = F.when(both, F.col("role").isin("primary", "support")).when(one, F.col("hits") == F.col("best.hits")).otherwise(True)
    return rows.filter(keep).select("qid", "doc_id", F.when(one & ~both, "primary").otherwise(F.col("role")).alias("role"), F.when(~both & one, F.size("shared")).otherwise(0).alias("n_shared"))


def final_results(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Results as they are returned, from hits (qid, chunk_id, product, parent_section_id, heading, text, rank, combined, role).

    Of hits of the same parent section the first stays. The parent's heading and text stand
    for the hit's own where there is a parent (product, section_id, heading, text). The score
    is the combined relevance, or 1/rank; ``place`` is the order in the document.
    """
    one = Window.partitionBy("qid", F.lower(F.trim("product")), "parent_section_id").orderBy("rank", "chunk_id")
    first = hits.withColumn("k", F.row_number().over(one)).filter("k = 1").drop("k")
    p = parents.select("product", F.col("section_id").alias("parent_section_id"), F.col("heading").alias("p_heading"), F.col("text").alias("p_text"))
    rows = first.join(p, ["product", "parent_section_id"], "left")
    order = Window.partitionBy("qid").orderBy("parent_section_id", "chunk_id")
    return rows.select(
        "qid",
        "chunk_id",
        "product",
        F.coalesce("p_heading", "heading").alias("heading"),
        F.coalesce("p_text", "text").alias("text"),
        F.coalesce(F.col("combined"), 1 / F.col("rank")).alias("score"),
        F.coalesce(F.col("role"), F.lit("ranked")).alias("role"),
        F.col("parent_section_id").alias("document_order"),
        F.when(F.col("p_text").isNotNull(), "parent_section").otherwise("matched_chunk").alias("return_mode"),
        F.row_number().over(order).alias("place"),
    )


def _hits(s, d):
    docs = table(s, d, "documents").select("doc_id", "text", F.col("source").alias("product"), F.substring_index("text", ".", 1).alias("heading"))
    role = F.when((F.col("qid") % 5 == 0) & (F.col("rank") == 1), "primary").when((F.col("qid") % 5 == 0) & (F.col("rank") == 2), "support")
    return R.bm25_top(s, d).join(docs, "doc_id").withColumn("role", role)


def _final(s, d):
    hits = _hits(s, d).withColumnRenamed("doc_id", "chunk_id").withColumn("parent_section_id", F.floor(F.col("chunk_id") / 4) * 4)
    hits = hits.withColumn("combined", F.when(F.col("rank") % 3 == 0, F.col("rank") / 32))
    parents = table(s, d, "documents").select(F.col("source").alias("product"), F.col("doc_id").alias("section_id"), F.substring_index("text", ".", 1).alias("heading"), "text")
    return final_results(hits, parents).withColumn("n", F.length("text")).drop("text")


def _marked(s, d):
    """Whole texts between spellings of marks and symbols."""
    shown = F.concat(F.lit("\n\n<pic>man"), F.col("doc_id"), F.lit("_1</PIC>  x"), F.lit("\t "), _text("text"), F.lit(" \n\n\n\n[pic] see \\textcircled{3} ① Ⓐ man1_2\n【 PIC 】 Ⓐ [[PIC: a"), F.col("doc_id"), F.lit(".png ]] \n "))
    return table(s, d, "documents").select("doc_id", shown.alias("text"))


def _markup(s, d):
    text, names = inline_pictures("text")
    rows = _marked(s, d).select("doc_id", reference_symbols(picture_marks(text)).alias("text"), names.alias("names"))
    rows = rows.withColumn("text", tidy_blanks(without_names("text", F.col("names"))))
    return rows.select("doc_id", F.md5("text").alias("digest"), F.array_join("names", ",").alias("names"), (F.size(F.split("text", "<PIC>", -1)) - 1).alias("marks"))


_MARKUP = rf"""WITH m AS (SELECT doc_id, chr(10) || chr(10) || '<pic>man' || doc_id || '_1</PIC>  x' || chr(9) || ' ' || coalesce(text, '') || ' ' || repeat(chr(10), 4) || '[pic] see \textcircled{{3}} ① Ⓐ man1_2' || chr(10) || '【 PIC 】 Ⓐ [[PIC: a' || doc_id || '.png ]] ' || chr(10) || ' ' AS t FROM documents),
i AS (SELECT doc_id, regexp_replace(t, '{PIC_REF}', '<PIC>', 'g') AS t, 'a' || doc_id || '.png' AS names FROM m),
""" + ",\n".join(f"i{k + 1} AS (SELECT doc_id, names, regexp_replace(t, '{p}', '{by}', 'g') AS t FROM i{k or ''})" for k, (p, by) in enumerate([*PIC_MARKS, (r"\\textcircled\{3\}", "③")])) + rf""",
l AS (SELECT doc_id, names, array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN contains(x, '①') AND contains(x, '③') THEN regexp_replace(x, '{SECOND}', '②', 'g') ELSE x END), chr(10)) AS t FROM i6),
n AS (SELECT doc_id, names, regexp_replace(replace(t, names, ''), '\b{PIC_NAME}\b', '', 'g') AS t FROM l),
b AS (SELECT doc_id, names, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n\n\n+', chr(10) || chr(10), 'g'), '^\n+', ''), '\s+$', '') AS t FROM n)
SELECT doc_id, md5(t) AS digest, names, CAST(len(string_split(t, '<PIC>')) - 1 AS INT) AS marks FROM b"""

_LINES = r"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda v: trim(regexp_replace(v, '\s+', ' ', 'g'))), lambda v: v <> '')"
_SHORT = f"list_transform({_LINES}, lambda v: CASE WHEN length(v) <= 40 THEN v ELSE trim(substr(v, 1, 39)) || '…' END)"
_ROLES = f"{R.STATS}, {R.A}, h AS (SELECT a.qid, a.doc_id, a.rank, d.source AS product, split_part(d.text, '.', 1) AS heading, d.text, CASE WHEN a.qid % 5 = 0 AND rank = 1 THEN 'primary' WHEN a.qid % 5 = 0 AND rank = 2 THEN 'support' END AS role FROM a JOIN documents d USING (doc_id))"

QUERIES = {
    "final_results": (
        _final,
        f"""WITH {_ROLES}, k AS (SELECT *, doc_id // 4 * 4 AS parent, row_number() OVER (PARTITION BY qid, lower(trim(product)), doc_id // 4 ORDER BY rank, doc_id) AS k FROM h)
        SELECT qid, k.doc_id AS chunk_id, product, coalesce(split_part(p.text, '.', 1), heading) AS heading, CASE WHEN rank % 3 = 0 THEN rank / 32 ELSE 1 / rank END AS score, coalesce(role, 'ranked') AS role, parent AS document_order,
          CASE WHEN p.text IS NOT NULL THEN 'parent_section' ELSE 'matched_chunk' END AS return_mode, CAST(row_number() OVER (PARTITION BY qid ORDER BY parent, k.doc_id) AS INT) AS place, CAST(length(coalesce(p.text, k.text)) AS INT) AS n
        FROM k LEFT JOIN documents p ON p.source = product AND p.doc_id = parent WHERE k = 1""",
    ),
    "narrowed_headings": (
        lambda s, d: narrowed(_hits(s, d), table(s, d, "benchmark").select(F.col("item_id").alias("qid"), "text")),
        f"""WITH {_ROLES}, q AS (SELECT item_id AS qid, {R._TERMS.format("text")} AS asked FROM benchmark), t AS (SELECT h.*, asked, list_intersect(asked, {R._TERMS.format("heading")}) AS shared FROM h JOIN q USING (qid)),
        b AS (SELECT qid, arg_max(shared, len(shared) * 1000 - rank) AS top, max(len(shared)) AS hits, arg_max(rank, len(shared) * 1000 - rank) AS at_, count(DISTINCT role) AS roles FROM t GROUP BY qid),
        o AS (SELECT qid, count(*) FILTER (len(shared) = hits) AS leaders, max(len(list_filter(shared, lambda x: NOT list_contains(top, x)))) AS news FROM t JOIN b USING (qid) GROUP BY qid),
        w AS (SELECT t.*, roles = 2 AS both_, roles < 2 AND len(asked) >= 2 AND hits >= 2 AND leaders = 1 AND at_ <= 3 AND news = 0 AS one, hits FROM t JOIN b USING (qid) JOIN o USING (qid))
        SELECT qid, doc_id, CASE WHEN one THEN 'primary' ELSE role END AS role, CAST(CASE WHEN one THEN len(shared) ELSE 0 END AS INT) AS n_shared FROM w WHERE CASE WHEN both_ THEN role IS NOT NULL WHEN one THEN len(shared) = hits ELSE true END""",
    ),
    "first_siblings": (
        lambda s, d: first_siblings(
            sections(s, d).select("doc_id", "section_id"),
            R.bm25_top(s, d, 3).select("qid", "doc_id", T.first_n(F.when(F.col("qid") % 4 > 0, F.concat(F.lit("the first "), F.col("qid") % 10 + 1, F.lit(" items"))).otherwise("all items")).alias("n")),
        ),
        f"""WITH {R.STATS}, {R.A}, {SECTIONS}, k AS (SELECT qid, a.doc_id, CAST(qid % 10 + 1 AS INT) AS n, section_id, CAST(row_number() OVER (PARTITION BY qid, a.doc_id ORDER BY section_id) AS INT) AS k FROM a JOIN sections USING (doc_id) WHERE rank <= 3 AND qid % 4 > 0)
        SELECT qid, doc_id, section_id, n, k FROM k WHERE k <= n""",
    ),
    "group_figures": (
        lambda s, d: group_figures(
            sections(s, d).filter("section_id % 3 = 0").select((F.col("doc_id") % 50).alias("qid"), "product", F.concat_ws("_", "doc_id", "section_id").alias("pic_id")),
            sections(s, d).select(F.col("doc_id").alias("group_id"), "product", F.col("section_id").alias("place"), F.concat_ws("_", "doc_id", "section_id").alias("pic_id")),
        ),
        f"""WITH {SECTIONS}, k AS (SELECT doc_id % 50 AS qid, product, doc_id || '_' || section_id AS pic_id, CAST(row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id, section_id) AS INT) AS k FROM sections WHERE section_id % 3 <> 0) SELECT * FROM k WHERE k <= 48""",
    ),
    "publish_refusals": (
        lambda s, d: refusals(
            table(s, d, "documents").groupBy(F.concat_ws("-", "source", "lang").alias("product")).agg(F.sum(F.when(F.length("text") < 60, 1).otherwise(0)).alias("n_errors")),
            table(s, d, "documents").filter("lang IN ('en', 'fr')").select(F.concat_ws("-", "source", "lang").alias("product")),
            F.col("product").endswith("fr"),
        ),
        """SELECT p AS product, n_errors, CASE WHEN p LIKE '%-en' THEN 'exists' WHEN n_errors > 0 THEN 'quality' END AS refused FROM (SELECT concat_ws('-', source, lang) AS p, CAST(sum(CASE WHEN length(text) < 60 THEN 1 ELSE 0 END) AS BIGINT) AS n_errors FROM documents GROUP BY ALL)""",
    ),
    "first_seen_counts": (
        lambda s, d: first_seen_counts(table(s, d, "documents"), "source", "doc_id"),
        "SELECT source, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY source",
    ),
    "distinct_lines": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(distinct_strings(F.split(_text("text"), "\n"), 40, 8), "|").alias("lines")),
        f"SELECT doc_id, array_to_string(list_filter(v, lambda x, i: list_position(low, lower(x)) = i)[1:8], '|') AS lines FROM (SELECT doc_id, v, list_transform(v, lambda x: lower(x)) AS low FROM (SELECT doc_id, {_SHORT} AS v FROM documents))",
    ),
    "answer_markup": (_markup, _MARKUP),
    "fenced_objects": (
        lambda s, d: table(s, d, "documents").select("doc_id", fenced_json(F.concat(F.when(F.col("doc_id") % 3 > 0, " ```json\n").otherwise(""), F.lit('{"id": '), F.col("doc_id"), F.lit(', "n": '), F.col("n_chars"), F.when(F.col("doc_id") % 5 > 0, "}").otherwise(""), F.when(F.col("doc_id") % 3 > 0, "\n``` ").otherwise("")), "id bigint, n bigint").alias("o")).select("doc_id", "o.id", "o.n"),
        "SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN doc_id END AS id, CASE WHEN doc_id % 5 > 0 THEN CAST(n_chars AS BIGINT) END AS n FROM documents",
    ),
    "manual_detail": (
        lambda s, d: manual_detail(
            sections(s, d).withColumn("place", F.col("section_id")), table(s, d, "documents").select(F.col("source").alias("product"), "doc_id", F.lit(0).alias("place"), "text"), "src1"
        ).withColumn("n", F.length("text")).drop("text"),
        f"WITH {SECTIONS} SELECT 'section' AS kind, product, doc_id, section_id AS place, char_len AS n FROM sections WHERE product = 'src1' UNION ALL SELECT 'chunk', source, doc_id, 0, CAST(length(text) AS INT) FROM documents WHERE source = 'src1'",
    ),
}
