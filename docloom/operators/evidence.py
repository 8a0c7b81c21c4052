"""Evidence around hits: parents, siblings, anchors, gates, traces, pictures; and the mixed tokeniser."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import SECTIONS, sections, table
from . import answers as A
from . import retrieval as R

CJK = re.compile("[㐀-鿿]+")
RUN = re.compile(r"[㐀-鿿]+|[^\W_㐀-鿿]+")


def tokenize_one(text: str | None) -> list[str]:
    """Words in lower case, Chinese runs whole and as pairs of characters; then words between blanks that are new, such as model numbers.

    Frequencies come from the first pass. Without a dictionary a Chinese run is one word.
    """
    text = (text or "").strip().lower()
    out: list[str] = []
    for run in RUN.findall(text):
        out.append(run)
        if CJK.fullmatch(run) and len(run) > 1:
            out += [run[i : i + 2] for i in range(len(run) - 1)]
    if not CJK.search(text) or re.search("[a-z]", text):
        for raw in re.split(r"[\s,;:!?()\[\]{}\"'<>]+", text):
            clean = "".join(c for c in raw if c.isalnum() or c in "._-+/")
            for word in (clean, raw):
                if word and word not in out:
                    out.append(word)
    return out


def tokenize(text: str | Column, split=tokenize_one) -> Column:
    """Tokens of texts by ``split``, which callers may replace by a segmenter of their own."""
    return F.pandas_udf(lambda texts: texts.map(split), "array<string>")(text)


def with_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Hits (product, parent_section_id, heading, text) with their parent section's heading and text, their own where there is none."""
    p = parents.select("product", F.col("section_id").alias("parent_section_id"), F.col("heading").alias("_h"), F.col("text").alias("_t"))
    rows = hits.join(p, ["product", "parent_section_id"], "left")
    return rows.withColumn("heading", F.coalesce("_h", "heading")).withColumn("text", F.coalesce("_t", "text")).drop("_h", "_t")


def keyword_expansion(docs: DataFrame, keywords: DataFrame, each: int = 5) -> DataFrame:
    """The best ``each`` documents of every keyword (qid, place, text), one list a query: in the order of keywords, the first of equal ones stays."""
    hits = R.top(R.bm25(docs, keywords.select(F.col("text").alias("qid"), "text").distinct()), each).withColumnRenamed("qid", "text")  # equal keywords are searched once
    first = hits.join(keywords.select("qid", "place", "text"), "text").groupBy("qid", "doc_id").agg(F.min(F.struct("place", "rank")).alias("at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("at"))).drop("at")


def siblings(rows: DataFrame, seeds: DataFrame, least: int = 2, share: float = 0.45, most: int = 2) -> DataFrame:
    """Sections of a seed's document whose heading has ``least`` terms and ``share`` of its terms in the seed's text; the best ``most``."""
    s = seeds.select("qid", "doc_id", F.col("section_id").alias("seed"), R.heading_terms(F.col("text")).alias("said"))
    h = rows.select("doc_id", "section_id", R.heading_terms(F.col("heading")).alias("terms"))
    hits = F.size(F.array_intersect("said", "terms"))
    pairs = s.join(h, "doc_id").filter(F.col("seed") != F.col("section_id")).withColumn("hits", hits)
    good = pairs.filter((F.col("hits") >= least) & (F.col("hits") >= share * F.greatest(F.size("terms"), F.lit(1))))
    w = Window.partitionBy("qid", "doc_id", "seed").orderBy(F.desc("hits"), "section_id")
    return good.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).select("qid", "doc_id", "seed", "section_id", "hits")


def heading_anchor(headings: DataFrame, queries: DataFrame, ranked: DataFrame, within: int = 3) -> DataFrame:
    """At most one hit a query whose heading's terms are all in the question, among the first ranks; the most terms win."""
    q = queries.select("qid", R.heading_terms(F.col("text")).alias("asked"))
    h = headings.select("doc_id", R.heading_terms(F.col("heading")).alias("terms")).filter(F.size("terms") > 0)
    rows = ranked.filter(F.col("rank") <= within).join(h, "doc_id").join(q, "qid").filter(F.size(F.array_except("terms", "asked")) == 0)
    return rows.groupBy("qid").agg(F.max_by(F.struct("doc_id", "rank"), F.struct(F.size("terms"), -F.col("rank"))).alias("a")).select("qid", "a.*")


def hamming_similar(hashes: DataFrame, least: float) -> DataFrame:
    """Pairs of 64-bit hashes (id, hash) whose similarity 1 - distance / 64 is ``least`` or more.

    Pairs of at most d different bits agree in one of d + 1 bands, so candidates come from
    joins on bands, and equal hashes are one from the start.
    """
    bits = int((1 - least) * 64 + 1e-9)
    cuts = [round(i * 64 / (bits + 1)) for i in range(bits + 2)]
    band = F.posexplode(F.array(*(F.expr(f"shiftrightunsigned(hash, {a}) & {(1 << (b - a)) - 1}L" if b - a < 63 else "hash") for a, b in zip(cuts, cuts[1:]))))
    one = hashes.groupBy("hash").agg(F.min("id").alias("id"))
    keys = one.select("id", "hash", band.alias("band", "part"))
    left, right = keys.select(F.col("id").alias("a"), F.col("hash").alias("ha"), "band", "part"), keys.select(F.col("id").alias("b"), F.col("hash").alias("hb"), "band", "part")
    pairs = left.join(right, ["band", "part"]).filter("a < b").select("a", "b", "ha", "hb").distinct()
    return pairs.withColumn("similarity", 1 - F.bit_count(F.col("ha").bitwiseXOR(F.col("hb"))) / 64).filter(F.col("similarity") >= least).select("a", "b", "similarity")


def sign_hash(vector: Column) -> Column:
    """One bit of the sign of each of up to 64 dimensions, the first one highest."""
    return F.aggregate(vector, F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("bigint")))


def hash_members(hashes: DataFrame) -> DataFrame:
    """Of each id the least one of the same hash, which stands for it in the pairs of ``hamming_similar``."""
    return hashes.join(hashes.groupBy("hash").agg(F.min("id").alias("representative")), "hash").select("id", "representative")


def similar_members(hashes: DataFrame, least: float) -> DataFrame:
    """Pairs of ``hamming_similar`` and, with ``similarity`` 1, the members (b) of each hash's representative (a)."""
    members = hash_members(hashes).filter("id <> representative").select(F.col("representative").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"), F.lit("member").alias("kind"))
    return hamming_similar(hashes, least).withColumn("kind", F.lit("pair")).unionByName(members)


def trace_hits(traces: DataFrame) -> DataFrame:
    """Hits named in the lines of text traces (trace_id, text): ``[n] product: P | section: S``."""
    lines = traces.select("trace_id", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    pattern = r"^\[(\d+)\]\s*(?:产品|product):\s*([^|]*?)\s*\|\s*(?:章节|section):\s*(.*?)\s*$"
    return lines.filter(F.col("said").rlike(pattern)).select("trace_id", "line", *(F.regexp_extract("said", pattern, i).alias(n) for i, n in ((1, "n"), (2, "product"), (3, "section"))))


def legacy_answer(answer: Column) -> tuple[Column, Column]:
    """Answer and pictures of the old form ``answer, ["id", ...]``."""
    tail = F.regexp_extract(answer, r'(?s),\s*(\[\s*(?:"[^"]*"\s*,?\s*)*\])\s*$', 1)
    return F.when(tail != "", F.regexp_replace(answer, r'(?s),\s*\[\s*(?:"[^"]*"\s*,?\s*)*\]\s*$', "")).otherwise(answer), F.when(tail != "", F.from_json(tail, "array<string>"))


def clauses(questions: DataFrame) -> DataFrame:
    """Clauses of questions (qid, text), split at punctuation and words that join."""
    parts = F.filter(F.split("text", r"[,，;；。.?？!！\n]+|\s+(?:and|or)\s+|以及|还有"), lambda c: F.length(F.trim(c)) >= 3)
    return questions.select("qid", F.posexplode(F.transform(parts, lambda c: F.trim(c))).alias("place", "text"))


def kept_or_all(rows: DataFrame, keep: Column, by: str = "qid") -> DataFrame:
    """Rows that ``keep`` holds for; of queries where it holds for none, all."""
    any_ = F.max(F.coalesce(keep, F.lit(False)).cast("int")).over(Window.partitionBy(by))
    return rows.withColumn("_any", any_).filter((F.col("_any") == 0) | keep).drop("_any")


def quality_label(text: Column, target: int = 720) -> Column:
    """By characters: ``short`` below 140, ``long`` beyond 1.4 times the target (in whole numbers, as 1.4 * 720 is below 1008 in floating point)."""
    n = F.length(text)
    return F.when(n < 140, "short").when(5 * n > 7 * target, "long").otherwise("ready")


def trace_kind(row: dict[str, Column]) -> Column:
    """What an audit view shows: service answers, picture matches, or retrieval."""
    return F.when(row["route"] == "service", "customer_service").when(row["image_count"] > 0, "visual_manual").otherwise("manual_rag")


def dominant_product(hits: DataFrame) -> DataFrame:
    """Of each query (qid, product, rank) the product with most hits, the first seen of equals, and how many."""
    per = hits.groupBy("qid", "product").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    return per.groupBy("qid").agg(F.max_by(F.struct("product", "n"), F.struct("n", -F.col("first"))).alias("d"), F.count("*").alias("products")).select("qid", "d.product", "d.n", "products")


def ordered_pictures(hits: DataFrame, most: int = 20) -> DataFrame:
    """Distinct pictures of a query's hits (qid, rank, pics) in order."""
    first = hits.select("qid", "rank", F.posexplode("pics").alias("place", "pic")).groupBy("qid", "pic").agg(F.min(F.struct("rank", "place")).alias("at"))
    return first.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("at"))).filter(F.col("k") <= most).select("qid", "pic", "k")


def joined_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions and answers of the same ids, and where one is missing or blank, what is wrong."""
    both = questions.join(answers, "id", "full_outer")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    wrong = F.when(F.col("question").isNull(), "no question").when(F.col("answer").isNull(), "no answer").when(blank("question") | blank("answer"), "blank")
    return both.withColumn("wrong", wrong)


def sanitized_keywords(keywords: DataFrame, questions: DataFrame) -> DataFrame:
    """Keywords (qid, keyword) all of whose words are in the question."""
    q = questions.select("qid", T.words(F.col("text")).alias("said"))
    return keywords.join(q, "qid").filter(F.size(F.array_except(T.words(F.col("keyword")), "said")) == 0).drop("said")


def regression(cases: DataFrame, found: DataFrame, within: int = 3) -> DataFrame:
    """Of cases (case_id, product) and ranked finds (case_id, product, rank): how many there are, fail, and put another product first."""
    top = found.filter(F.col("rank") <= within).groupBy("case_id").agg(F.collect_set("product").alias("products"), F.min_by("product", "rank").alias("first"))
    rows = cases.join(top, "case_id", "left")
    miss = ~F.coalesce(F.array_contains("products", F.col("product")), F.lit(False))
    return rows.agg(F.count("*").alias("cases"), F.count_distinct("product").alias("products"), F.sum(F.when(miss, 1).otherwise(0)).alias("failures"), F.sum(F.when(F.col("first") != F.col("product"), 1).otherwise(0)).alias("other_first"))


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text")


def _ask(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _keywords(s, d):
    return _ask(s, d).select("qid", F.posexplode(T.words(F.coalesce("text", F.lit("")))).alias("place", "text"))


def _hits(s, d):
    return R.bm25_top(s, d).join(table(s, d, "documents").select("doc_id", F.col("source").alias("product")), "doc_id")


def _regression(s, d):
    cases = A.unique_phrases(sections(s, d).select("product", "heading")).filter("k = 1").select(F.crc32(F.col("phrase").cast("binary")).alias("case_id"), "product", "phrase")
    found = R.top(R.bm25(_docs(s, d), cases.select(F.col("case_id").alias("qid"), F.col("phrase").alias("text"))), 3)
    found = found.join(table(s, d, "documents").select("doc_id", F.col("source").alias("product")), "doc_id").withColumnRenamed("qid", "case_id")
    return regression(cases.select("case_id", "product"), found)


def _sign_hashes(s, d):
    """Vectors, and of each fifth a copy with its last 0 to 3 dimensions turned round."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    turned = F.transform("embedding", lambda x, i: F.when(i >= 64 - F.col("id") % 4, -x).otherwise(x))
    copies = e.filter("id % 5 = 0").select((F.col("id") + 1_000_000_000).alias("id"), turned.alias("embedding"))
    return e.unionByName(copies).select("id", sign_hash(F.col("embedding")).alias("hash"))


_KW = rf"SELECT item_id * 1000 + i - 1 AS item_id, w[i] AS text, item_id AS q, i - 1 AS place FROM (SELECT item_id, {R._W.format('text')} AS w FROM benchmark), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) t"

QUERIES = {
    "mixed_tokens": (
        lambda s, d: sections(s, d).select("doc_id", "section_id", F.size(tokenize("text")).alias("tokens")).groupBy("doc_id").agg(F.sum("tokens").alias("tokens")),
        None,
    ),
    "keyword_expansion": (
        lambda s, d: keyword_expansion(_docs(s, d), _keywords(s, d)),
        f"""WITH {R.STATS}, kw AS ({_KW}), ks AS (SELECT q, place, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dl)))), 6) AS score FROM kw JOIN post ON token = kw.text JOIN stats USING (token) JOIN dl USING (doc_id) GROUP BY ALL),
        kr AS (SELECT *, row_number() OVER (PARTITION BY q, place ORDER BY score DESC, doc_id) AS k FROM ks WHERE score > 0), f AS (SELECT q AS qid, doc_id, min(place * 100 + k) AS at_ FROM kr WHERE k <= 5 GROUP BY ALL) SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY at_) AS rank FROM f""",
    ),
    "parent_results": (
        lambda s, d: with_parents(
            sections(s, d).select(F.col("doc_id").alias("product"), "section_id", (F.col("section_id") - F.col("doc_id") % 3).alias("parent_section_id"), "heading", "text"),
            sections(s, d).filter("char_len > 80").select(F.col("doc_id").alias("product"), "section_id", "heading", "text"),
        ).select("product", "section_id", "heading", F.length("text").alias("n")),
        f"WITH {SECTIONS} SELECT a.doc_id AS product, a.section_id, coalesce(b.heading, a.heading) AS heading, CAST(length(coalesce(b.text, a.text)) AS INT) AS n FROM sections a LEFT JOIN sections b ON a.doc_id = b.doc_id AND b.section_id = a.section_id - a.doc_id % 3 AND b.char_len > 80",
    ),
    "sibling_sections": (
        lambda s, d: siblings(sections(s, d), sections(s, d).withColumn("qid", F.col("doc_id") % 4)),
        f"""WITH {SECTIONS}, s AS (SELECT doc_id % 4 AS qid, doc_id, section_id AS seed, {R._TERMS.format("text")} AS said FROM sections), h AS (SELECT doc_id, section_id, {R._TERMS.format("heading")} AS terms FROM sections),
        p AS (SELECT qid, s.doc_id, seed, section_id, CAST(len(list_intersect(said, terms)) AS INT) AS hits, len(terms) AS n FROM s JOIN h ON s.doc_id = h.doc_id AND seed <> section_id),
        k AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id, seed ORDER BY hits DESC, section_id) AS k FROM p WHERE hits >= 2 AND hits >= 0.45 * greatest(n, 1)) SELECT qid, doc_id, seed, section_id, hits FROM k WHERE k <= 2""",
    ),
    "heading_anchor": (
        lambda s, d: heading_anchor(R._headings(s, d), _ask(s, d), R.bm25_top(s, d), 20),
        f"""WITH {R.STATS}, {R.A}, {R.HEAD}, m AS (SELECT a.qid, a.doc_id, a.rank, len(h_terms) AS n FROM a JOIN h USING (doc_id) JOIN hq ON hq.qid = a.qid WHERE len(h_terms) > 0 AND len(list_filter(h_terms, lambda t: NOT list_contains(q_terms, t))) = 0)
        SELECT qid, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, rank) AS k FROM m) WHERE k = 1""",
    ),
    "dominant_product": (
        lambda s, d: dominant_product(_hits(s, d)),
        f"""WITH {R.STATS}, {R.A}, g AS (SELECT qid, source AS product, count(*) AS n, min(rank) AS first FROM a JOIN documents USING (doc_id) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, first) AS k, count(*) OVER (PARTITION BY qid) AS products FROM g)
        SELECT qid, product, n, products FROM k WHERE k = 1""",
    ),
    "ordered_pictures": (
        lambda s, d: ordered_pictures(_hits(s, d).withColumn("pics", F.array(F.concat(F.lit("p"), F.col("doc_id") % 7), F.concat(F.lit("p"), F.col("doc_id") % 5)))),
        f"""WITH {R.STATS}, {R.A}, p AS (SELECT qid, rank * 10 + i AS at_, CASE i WHEN 0 THEN 'p' || (doc_id % 7) ELSE 'p' || (doc_id % 5) END AS pic FROM a, (VALUES (0), (1)) v(i)), f AS (SELECT qid, pic, min(at_) AS at_ FROM p GROUP BY ALL)
        SELECT * FROM (SELECT qid, pic, row_number() OVER (PARTITION BY qid ORDER BY at_) AS k FROM f) WHERE k <= 20""",
    ),
    "question_clauses": (
        lambda s, d: clauses(_ask(s, d)),
        r"""WITH c AS (SELECT item_id AS qid, list_transform(list_filter(string_split_regex(text, '[,，;；。.?？!！\n]+|\s+(?:and|or)\s+|以及|还有'), lambda c: length(trim(c)) >= 3), lambda c: trim(c)) AS cs FROM benchmark)
        SELECT qid, CAST(i - 1 AS INT) AS place, cs[i] AS text FROM c, LATERAL (SELECT unnest(range(1, len(cs) + 1)) AS i) t""",
    ),
    "mode_filter": (
        lambda s, d: kept_or_all(_hits(s, d).select("qid", "doc_id", "product", "rank"), F.col("product").isin("src1", "src2", "src3")),
        f"""WITH {R.STATS}, {R.A}, h AS (SELECT qid, doc_id, source AS product, rank, source IN ('src1', 'src2', 'src3') AS keep FROM a JOIN documents USING (doc_id)), w AS (SELECT *, max(CAST(keep AS INT)) OVER (PARTITION BY qid) AS any_ FROM h) SELECT qid, doc_id, product, rank FROM w WHERE keep OR any_ = 0""",
    ),
    "quality_labels": (
        lambda s, d: sections(s, d).groupBy("product", quality_label(F.col("text")).alias("label")).agg(F.count("*").alias("n")),
        f"WITH {SECTIONS} SELECT product, CASE WHEN char_len < 140 THEN 'short' WHEN char_len > 1008 THEN 'long' ELSE 'ready' END AS label, count(*) AS n FROM sections GROUP BY ALL",
    ),
    "question_answers": (
        lambda s, d: joined_answers(table(s, d, "documents").filter("lang <> 'fr'").select(F.col("doc_id").alias("id"), F.lit("q").alias("question")), table(s, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, " ").otherwise("a").alias("answer"))).select("id", "wrong"),
        "SELECT coalesce(d.doc_id, l.doc_id) AS id, CASE WHEN d.doc_id IS NULL THEN 'no question' WHEN l.doc_id IS NULL THEN 'no answer' WHEN toxic = 1 THEN 'blank' END AS wrong FROM (SELECT doc_id FROM documents WHERE lang <> 'fr') d FULL JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "keyword_sanitize": (
        lambda s, d: sanitized_keywords(_ask(s, d).select("qid", F.explode(F.split("text", r"\.\s")).alias("keyword")).unionByName(_ask(s, d).select((F.col("qid") + 1).alias("qid"), F.substring_index("text", " ", 2).alias("keyword"))), _ask(s, d)),
        rf"""WITH q AS (SELECT item_id AS qid, {R._W.format("text")} AS said FROM benchmark), k AS (SELECT item_id AS qid, unnest(string_split_regex(text, '\.\s')) AS keyword FROM benchmark UNION ALL SELECT item_id + 1, array_to_string(string_split(text, ' ')[1:2], ' ') FROM benchmark)
        SELECT qid, keyword FROM k JOIN q USING (qid) WHERE len(list_filter({R._W.format("keyword")}, lambda w: NOT list_contains(said, w))) = 0""",
    ),
    "similar_hashes_64": (
        lambda s, d: similar_members(_sign_hashes(s, d), 0.96),
        """WITH v AS (SELECT vec_id AS id, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000000, list_transform(embedding, lambda x, i: CASE WHEN i > 64 - vec_id % 4 THEN -x ELSE x END) FROM embeddings WHERE vec_id % 5 = 0),
        h AS (SELECT id, CAST(array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS BIT) AS hash FROM v), o AS (SELECT hash, min(id) AS id FROM h GROUP BY hash)
        SELECT x.id AS a, y.id AS b, 1 - bit_count(xor(x.hash, y.hash)) / 64 AS similarity, 'pair' AS kind FROM o x JOIN o y ON x.id < y.id WHERE 1 - bit_count(xor(x.hash, y.hash)) / 64 >= 0.96
        UNION ALL SELECT o.id, h.id, 1.0, 'member' FROM h JOIN o USING (hash) WHERE h.id <> o.id""",
    ),
    "route_regression": (_regression, None),
}
