"""Citations: which blocks of a source an answer uses, how far a source supports it, and follow-ups about a remembered part.

All scores are expressions of one pair of texts; what is best in a source comes from one window over its blocks.

Nulls and ties: null texts are empty and share nothing. Where all blocks of a source are as good, the first one is the best.
Rows of equal question, source and place are blocks of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import answers as A
from . import retrieval as R

#: Words that citations aren't told by, marks of pictures, and what begins a question about a remembered part.
STOP = ["a", "an", "and", "are", "as", "at", "be", "by", "can", "do", "for", "from", "how", "in", "is", "it", "of", "on", "or", "the", "this", "to", "use", "using", "what", "when", "with", "you", "your"]
MARKS = r"(?i)<PIC(?::[^>]+)?>|\[\[PIC:[^\]]+\]\]"
PICTURE = r"(?i)\[\[PIC:([^\]]+)\]\]"
PRONOUN = r"^(?:它|这个|那个|该(?:部件|配件|功能|装置)?)(的|在|要|该|怎么|如何|是否|能否|可以|需要|用于|有什么|有哪些|是)"
#: Words of a former question that tell what was done, not with what.
ACTIONS = ["如何", "怎么", "怎样", "什么", "干什么", "做什么", "为什么", "为何", "请问", "告诉", "介绍", "说明", "操作", "步骤", "方法", "使用", "开启", "关闭", "启动", "插入", "取出", "安装", "拆卸", "维护", "保养", "清洁", "设置", "调节", "调整", "更换", "处理", "进行", "这个", "那个", "该项", "功能", "一下", "哪些", "还有", "是否"]
#: Weights and limits of a block's score, of a source's support, and of an answer that a source covers.
BLOCK, CUT, SHARE, SUPPORT, COVERED = (0.58, 0.22, 0.20), 0.11, 0.48, (0.62, 0.38), (0.88, 0.85)


def match_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), MARKS, " "), "[^a-z0-9㐀-鿿%]+", " "))


def match_tokens(matched: Column) -> Column:
    """Distinct Latin words of two characters at least, short Chinese runs, and pairs of ideographs, of a ``match_text``."""
    words = F.filter(F.regexp_extract_all(matched, F.lit("([a-z0-9][a-z0-9%]*)"), 1), lambda w: (F.length(w) >= 2) & ~w.isin(STOP))
    runs = F.filter(F.regexp_extract_all(matched, F.lit("([㐀-鿿]+)"), 1), lambda r: F.length(r) > 1)

    def pairs(run: Column) -> Column:
        chars = F.filter(F.split(run, ""), lambda c: c != "")
        return F.array_compact(F.zip_with(chars, F.slice(chars, 2, F.size(chars)), lambda a, b: F.concat(a, b)))

    return F.array_distinct(F.concat(words, F.filter(runs, lambda r: F.length(r) <= 4), F.flatten(F.transform(runs, pairs))))


def match_grams(matched: Column) -> Column:
    """Distinct runs of three characters of a ``match_text`` without blanks."""
    chars = F.filter(F.split(F.regexp_replace(matched, " ", ""), ""), lambda c: c != "")
    after = lambda n: F.slice(chars, n, F.greatest(F.size(chars), F.lit(1)))
    two = F.zip_with(chars, after(2), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.array_compact(F.zip_with(two, after(3), lambda a, b: F.concat(a, b))))


def shared_language(left: Column, right: Column) -> Column:
    """Whether two ``match_text``s are both mostly Chinese or both mostly Latin, so that sharing nothing means something."""
    def profile(c: Column) -> tuple[Column, Column, Column]:
        cjk, latin = F.regexp_count(c, F.lit("[㐀-鿿]")), F.regexp_count(c, F.lit("[a-z]"))
        return cjk, F.regexp_count(c, F.lit(r"\b[a-z]{2,}\b")), cjk / F.greatest(cjk + latin, F.lit(1))

    (lc, lw, ls), (rc, rw, rs) = profile(left), profile(right)
    return ((lc >= 4) & (rc >= 4) & (ls >= 0.25) & (rs >= 0.25)) | ((lw >= 3) & (rw >= 3) & (ls < 0.25) & (rs < 0.25))


def pictures_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PICTURE), 1), F.lower)


def _measured(rows: DataFrame, text: str) -> DataFrame:
    """Grams and tokens of ``text`` and of the answer, and what they share."""
    both = rows.select("*", match_text(F.col(text)).alias("_b"), match_text(F.col("answer")).alias("_a"))
    both = both.select("*", match_grams(F.col("_b")).alias("_bg"), match_grams(F.col("_a")).alias("_ag"), match_tokens(F.col("_b")).alias("_bt"), match_tokens(F.col("_a")).alias("_at"))
    shared = lambda x, y: F.size(F.array_intersect(x, y))
    wanted = F.transform(F.coalesce("pics", F.array().cast("array<string>")), lambda p: F.lower(F.trim(p)))
    return both.select("*", shared("_bg", "_ag").alias("grams"), shared("_bt", "_at").alias("tokens"), F.arrays_overlap(pictures_of(F.col(text)), F.filter(wanted, lambda p: p != "")).alias("pictured"))


def cited_blocks(rows: DataFrame) -> DataFrame:
    """The blocks of each source that an answer uses: ``rows`` has qid, source, place, block, answer and pics.

    A block with a picture of the answer, or that the answer contains, or the other way round, is used; others are by their score, as
    near the source's best one as ``SHARE``. A source whose best block is weak isn't cited if answer and source have a language in common,
    and is cited as a whole if they haven't.
    """
    m = _measured(rows, "block")
    n = lambda c: F.greatest(F.size(c), F.lit(1))
    cover, tokens = F.col("grams") / n("_bg"), F.col("tokens") / n("_bt")
    flat = lambda c: F.regexp_replace(c, " ", "")
    exact = (F.least(F.length(flat("_b")), F.length(flat("_a"))) >= 6) & (F.contains(flat("_a"), flat("_b")) | F.contains(flat("_b"), flat("_a")))
    base = BLOCK[0] * cover + BLOCK[1] * F.sqrt(cover * F.col("grams") / n("_ag")) + BLOCK[2] * tokens
    score = F.greatest(base, F.when(F.col("exact"), 0.92).otherwise(0.0), F.when(F.col("pictured"), 1.0).otherwise(0.0))
    rows = m.withColumn("exact", exact).withColumn("score", F.round(score, 6))
    rows = rows.withColumn("strong", F.col("pictured") | F.col("exact") | (F.col("grams") >= 3) | ((F.col("tokens") >= 2) & (F.col("score") >= 0.12)))
    one = Window.partitionBy("qid", "source")
    best = F.max(F.struct("score", (-F.col("place")).alias("at"), "strong")).over(one)
    rows = rows.withColumn("best", best).withColumn("common", F.max(shared_language(F.col("_a"), F.col("_b")).cast("int")).over(one) == 1)
    near = (F.col("score") >= F.greatest(F.lit(CUT), SHARE * F.col("best.score"))) & ((F.col("grams") >= 3) | (F.col("tokens") >= 2))
    used = F.col("pictured") | F.col("exact") | near | (-F.col("place") == F.col("best.at"))
    kept = rows.filter(F.when(F.col("best.strong"), used).otherwise(~F.col("common")))
    return kept.select("qid", "source", "place", "score")


def supports(rows: DataFrame) -> DataFrame:
    """How far a source supports an answer, and whether it covers it ``whole``: ``rows`` has qid, source, content, answer and pics."""
    m = _measured(rows, "content")
    grams, tokens = F.col("grams") / F.greatest(F.size("_ag"), F.lit(1)), F.col("tokens") / F.greatest(F.size("_at"), F.lit(1))
    support = F.when(F.col("pictured"), 1.0).otherwise(SUPPORT[0] * grams + SUPPORT[1] * tokens)
    whole = (F.size("_ag") >= 8) & (F.size("_at") >= 4) & (grams >= COVERED[0]) & (tokens >= COVERED[1])
    return m.select("qid", "source", F.round(support, 6).alias("support"), whole.alias("whole"))


def about_component(question: Column, component: Column) -> Column:
    """The question with a leading pronoun replaced by the part that the turns before were about; itself without either."""
    said, part = F.trim(F.coalesce(question, F.lit(""))), F.regexp_replace(F.coalesce(component, F.lit("")), r"\s+", "")
    return F.when((part != "") & said.rlike(PRONOUN), F.concat(part, F.regexp_replace(said, PRONOUN, "$1"))).otherwise(said)


def subject_terms(tokens: Column, most: int = 10) -> Column:
    """The words of a former question without those of its action and its grammar, the first ``most``."""
    kept = F.filter(F.transform(tokens, lambda t: F.trim(t)), lambda t: (t != "") & ~F.lower(t).isin(ACTIONS) & ~t.rlike("^(?:是|的|了|吗|呢|为|把|给|我|你|它|这|那)+$"))
    return F.array_join(F.slice(F.array_distinct(kept), 1, most), " ")


def primary_language(text: Column) -> Column:
    """The language of most of a mixed text: ``zh`` from two ideographs on, ``en`` from four letters on, else empty."""
    own = F.coalesce(text, F.lit(""))
    han, latin = F.regexp_count(own, F.lit("[一-鿿]")), F.regexp_count(own, F.lit("[A-Za-z]"))
    return F.when((han >= 2) & (han >= latin), "zh").when((latin >= 4) & (latin > han), "en").when(han >= 2, "zh").when(latin >= 4, "en").otherwise("")


def any_chinese(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")).rlike("[一-鿿]"), "zh").otherwise("en")


# Queries over the test tables: a question's passage and a line as the answer, the lines of the best documents as blocks.


def _rows(s, d) -> DataFrame:
    pairs = A._pairs(s, d)
    source, place = F.substring_index("passage", "/", 1).cast("long"), F.substring_index("passage", "/", -1).cast("int")
    return pairs.select(F.col("block").alias("qid"), source.alias("source"), place.alias("place"), F.col("passage_text").alias("block"), F.col("block_text").alias("answer"), F.array(F.lit("p1")).alias("pics"))


def _sources(s, d) -> DataFrame:
    own = R.bm25_top(s, d, 5).join(R._docs(s, d).select("doc_id", "text"), "doc_id").join(R._ask(s, d).withColumnRenamed("text", "answer"), "qid")
    return own.select("qid", F.col("doc_id").alias("source"), F.col("text").alias("content"), "answer", F.lit(None).cast("array<string>").alias("pics"))


_M = "trim(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9㐀-鿿%]+', ' ', 'g'))"
_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
_TOK = f"list_distinct(list_filter(regexp_extract_all({{0}}, '[a-z0-9][a-z0-9%]*'), lambda w: length(w) >= 2 AND NOT list_contains({_STOPS}, w)))"
_GR = "CASE WHEN len({0}) >= 3 THEN list_distinct(list_transform(range(1, len({0}) - 1), lambda i: {0}[i] || {0}[i + 1] || {0}[i + 2])) ELSE [] END"
_CHARS = "string_split(replace({}, ' ', ''), '')"


def _measured_sql(name: str) -> str:
    """From ``name`` (qid, source, place, b, a): what both texts have and share."""
    return f"""{name}1 AS (SELECT qid, source, place, {_M.format("b")} AS b, {_M.format("a")} AS a FROM {name}), {name}2 AS (SELECT *, {_CHARS.format("b")} AS bc, {_CHARS.format("a")} AS ac FROM {name}1),
    {name}3 AS (SELECT *, {_GR.format("bc")} AS bg, {_GR.format("ac")} AS ag, {_TOK.format("b")} AS bt, {_TOK.format("a")} AS at_ FROM {name}2), {name}4 AS (SELECT *, len(list_intersect(bg, ag)) AS grams, len(list_intersect(bt, at_)) AS tokens FROM {name}3)"""


QUERIES = {
    "cited_blocks": (
        lambda s, d: cited_blocks(_rows(s, d)),
        f"""WITH {A.ALIGN.split(", p AS (")[0]}, x AS (SELECT qid, s.doc_id AS source, section_id AS place, s.text AS b, bm.text AS a FROM a JOIN sections s USING (doc_id) JOIN benchmark bm ON item_id = qid WHERE rank <= 5), {_measured_sql("x")},
        y AS (SELECT *, grams / greatest(len(bg), 1) AS cover, least(length(replace(b, ' ', '')), length(replace(a, ' ', ''))) >= 6 AND (contains(replace(a, ' ', ''), replace(b, ' ', '')) OR contains(replace(b, ' ', ''), replace(a, ' ', ''))) AS exact FROM x4),
        z AS (SELECT *, round(greatest(0.58 * cover + 0.22 * sqrt(cover * grams / greatest(len(ag), 1)) + 0.2 * tokens / greatest(len(bt), 1), CASE WHEN exact THEN 0.92 ELSE 0 END), 6) AS score FROM y),
        w AS (SELECT *, exact OR grams >= 3 OR (tokens >= 2 AND score >= 0.12) AS strong, len(regexp_extract_all(b, '\\b[a-z]{{2,}}\\b')) >= 3 AND len(regexp_extract_all(a, '\\b[a-z]{{2,}}\\b')) >= 3 AS lang FROM z),
        v AS (SELECT *, max(score) OVER one AS best, first_value(place) OVER (PARTITION BY qid, source ORDER BY score DESC, place) AS best_at, first_value(strong) OVER (PARTITION BY qid, source ORDER BY score DESC, place) AS best_strong, bool_or(lang) OVER one AS common FROM w WINDOW one AS (PARTITION BY qid, source))
        SELECT qid, source, place, score FROM v WHERE CASE WHEN best_strong THEN exact OR (score >= greatest(0.11, 0.48 * best) AND (grams >= 3 OR tokens >= 2)) OR place = best_at ELSE NOT common END""",
    ),
    "source_support": (
        lambda s, d: supports(_sources(s, d)),
        f"""WITH {R.STATS}, {R.A}, x AS (SELECT qid, doc_id AS source, 0 AS place, dd.text AS b, bm.text AS a FROM a JOIN documents dd USING (doc_id) JOIN benchmark bm ON item_id = qid WHERE rank <= 5), {_measured_sql("x")}
        SELECT qid, source, round(0.62 * grams / greatest(len(ag), 1) + 0.38 * tokens / greatest(len(at_), 1), 6) AS support, len(ag) >= 8 AND len(at_) >= 4 AND grams / greatest(len(ag), 1) >= 0.88 AND tokens / greatest(len(at_), 1) >= 0.85 AS whole FROM x4""",
    ),
}
