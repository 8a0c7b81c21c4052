"""Gates before an answer, expansions of a question, and the row that is handed in.

Most of them are expressions of one row; captions and visual hits are joins on keys, with one window for
each question.

Nulls and ties: null texts are empty, and an empty one shares nothing. Hits of equal score go by rank, then by id. Rows of
equal id are kept one by one where a row is judged alone, and are one question where hits are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import SECTIONS, sections, table
from . import results as S
from . import retrieval as R

# What tells no topic, warnings, wordings of states, and the score that a picture needs to name a product.
TOPIC_STOP = ["如何", "怎么", "怎样", "什么", "哪些", "是否", "可以", "请问", "请", "我", "的", "为", "给", "与", "和", "及", "或", "在", "中", "从", "到", "通过", "使用", "说明", "方法", "步骤", "操作", "添加", "加入", "装入", "安装", "更换", "打开", "关闭", "调节", "洗涤", "部件", "问题", "产品", "手册", "功能", "相关", "what", "which", "how", "does", "do", "the", "with", "for", "from", "your", "my", "about", "manual"]
SAFETY = r"警告|注意|请勿|切勿|不得|禁止|危险|火灾|触电|爆炸|伤害|损坏|高温|电源插头"
STATES = r"(?i)指示|图标|标识|符号|圆点|红点|灯|屏幕|显示|状态|模式|按键|按钮|indicator|icon|display|light|dot|symbol|mode|button"
VISUAL_LEAST = 0.42
# Generic beginnings of phrases, and sections that name no component.
PREFIXES = ["使用前", "使用", "操作", "安装", "维护", "清洁", "保养", "故障", "安全", "注意", "产品", "功能", "设置", "using", "operation", "maintenance", "cleaning", "safety"]
GENERIC_SECTION = r"(?:注意事项|安全说明|操作方法|使用方法|功能说明|推荐使用|清洁设备|日常维护|烹饪参考|烹饪指南)$"
# Questions that list modes or features, the words that are added to them, and one product's own words.
MODES = r"(?i)(?:还有|其他|哪些|什么|全部|所有|列(?:个|出)?|清单).{0,12}模式|模式.{0,12}(?:还有|其他|哪些|什么|全部|所有|列(?:个|出)?|清单)"
FEATURES = r"(?i)(?:还有|其他|哪些|什么|全部|所有).{0,12}(?:技术|功能|特性|特点|能力)|(?:技术|功能|特性|特点|能力).{0,12}(?:还有|其他|哪些|什么|全部|所有)|\b(?:what|which).{0,24}(?:features?|technolog(?:y|ies)|functions?|capabilities?)\b|\b(?:features?|technolog(?:y|ies)|functions?|capabilities?).{0,24}(?:what|which|other|all|available)\b"
COOLING_WORDS = "空调运行模式 制冷模式 制热模式 除湿模式 循环模式 极速制冷 极速制热 自动运行 自动转换 节能制冷"
MODE_WORDS = "运行模式 自动模式 高级模式"
FEATURE_WORDS = "技术 功能 智能功能 特性 特点 模式 设置 控制 反馈 传感 feature features smart technology technologies capability capabilities mode modes setting settings control controls feedback sensor sensing app"
MIXTURE, SCREW, SCREW_WORDS = r"(?:混合气|空燃比|混合比)", r"(?:螺钉|螺丝|油针|调节|调整|怎么拧|如何拧)", "化油器 调节螺钉 高速油针 H 低速油针 L 怠速调节螺钉 T"
COOLER, BLOWER = "空调手册", "吹风机手册"
# Words that captions aren't compared by, and answers where nothing is left.
CAPTION_STOP = ["what", "which", "how", "does", "do", "the", "a", "an", "is", "are", "on", "in", "to", "of", "for", "or", "and", "when", "with", "show", "displayed", "my", "your", "this", "that", "什么", "如何", "怎么", "哪些", "这个", "显示", "手册", "产品"]
NO_ANSWER, NO_REPLY = "未在手册中找到相关内容，建议联系售后确认。", "您好，您的问题已收到，我们会尽快为您处理。"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def topic_phrases(text: Column) -> Column:
    """Latin words of four characters at least, and runs of two to six ideographs; none that tell no topic."""
    spans = F.filter(F.regexp_extract_all(F.lower(_text(text)), F.lit(r"([a-z0-9][a-z0-9._/-]*|[一-鿿]+)"), 1), lambda s: ~s.isin(TOPIC_STOP))
    latin = F.filter(spans, lambda s: s.rlike("^[a-z0-9]") & (F.length(s) >= 4))

    def runs(s: Column) -> Column:
        chars = F.filter(F.split(s, ""), lambda c: c != "")
        out, last = [], chars
        for n in range(2, 7):
            last = F.zip_with(last, F.slice(chars, n, F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b))
            out.append(F.array_compact(last))
        return F.concat(*out)

    cjk = F.flatten(F.transform(F.filter(spans, lambda s: ~s.rlike("^[a-z0-9]") & (F.length(s) >= 2)), runs))
    return F.array_distinct(F.filter(F.concat(latin, cjk), lambda p: ~p.isin(TOPIC_STOP)))


def topic_gate(questions: DataFrame, related: DataFrame) -> DataFrame:
    """Related hits (qid, doc_id, heading, text) that an answer may use: ``on_topic`` by the heading, ``warns`` by a warning on the question's topic."""
    asked = questions.select("qid", topic_phrases(F.col("text")).alias("asked"))
    rows = related.join(asked, "qid")
    warns = _text(F.col("text")).rlike(SAFETY) & F.arrays_overlap("asked", topic_phrases(F.col("text")))
    return rows.select("qid", "doc_id", F.arrays_overlap("asked", topic_phrases(F.col("heading"))).alias("on_topic"), warns.alias("warns"))


def specific_phrase(phrase: Column, generic: list[str] = ()) -> Column:
    """Whether a phrase names a part or a function, not a kind of chapter: no generic term, and after a generic beginning five characters at least."""
    key = lambda c: F.lower(F.regexp_replace(c, r"[\s\W_]+", "")) if isinstance(c, Column) else "".join(x for x in c.lower() if x.isalnum())
    own = F.lower(F.regexp_replace(_text(phrase), r"(?U)[\s\W_]+", ""))
    out = ~own.isin([key(g) for g in generic]) if generic else F.lit(True)
    for prefix in PREFIXES:
        out = out & ~(F.startswith(own, F.lit(key(prefix))) & (F.length(own) - len(key(prefix)) < 5))
    return out


def visual_gate(hits: DataFrame, catalogue: DataFrame, scope: DataFrame | None = None, least: float = VISUAL_LEAST) -> DataFrame:
    """The best picture (qid, product, image_id, score) of the ``catalogue`` (product) and of a question's ``scope`` (qid, product), and whether it is ``accepted``.

    Questions without a row in the scope have all products; those without any hit that counts have no row.
    """
    rows = hits.join(catalogue.select("product").distinct(), "product", "left_semi")
    if scope is not None:
        limits = scope.select("qid", "product").distinct()
        rows = rows.join(limits.select("qid").distinct(), "qid", "left_anti").unionByName(rows.join(limits, ["qid", "product"], "left_semi"))
    best = rows.groupBy("qid").agg(F.min(F.struct((-F.col("score")).alias("by"), "image_id", "product", "score")).alias("b"))
    return best.select("qid", "b.product", "b.image_id", "b.score", (F.col("b.score") >= least).alias("accepted"))


def keeps_products(visual: Column, captions: Column, *texts: Column) -> Column:
    """Whether a picture's product doesn't lock the search: the first product of the captions is another, and the texts speak of states or signs."""
    named = F.filter(F.transform(captions, lambda p: F.trim(_text(p))), lambda p: p != "")
    own = F.trim(_text(visual))
    return (own != "") & (F.size(named) > 0) & (F.get(named, F.lit(0)) != own) & F.concat_ws(" ", *texts).rlike(STATES)


def expanded(question: Column, products: Column) -> Column:
    """The question with words that manuals use for what it lists, 500 characters at most, and a product's own words for a paraphrase."""
    said = F.trim(_text(question))
    add = lambda more: F.substring(F.concat(said, F.lit("\n" + more)), 1, 500)
    only = (F.size(products) == 1) & F.array_contains(products, COOLER)
    listed = F.when(said.rlike(MODES) & F.coalesce(only, F.lit(False)), add(COOLING_WORDS)).when(said.rlike(MODES), add(MODE_WORDS)).when(said.rlike(FEATURES), add(FEATURE_WORDS)).otherwise(said)
    mixture = F.coalesce(F.array_contains(products, BLOWER), F.lit(False)) & said.rlike(MIXTURE) & said.rlike(SCREW)
    return F.when(mixture, F.concat(listed, F.lit("\n" + SCREW_WORDS))).otherwise(listed)


def literal_keywords(tokens: Column, question: Column, most: int = 16) -> Column:
    """The first distinct tokens of two characters at least, or the question itself."""
    found = F.slice(F.array_distinct(F.filter(F.transform(tokens, lambda t: F.trim(t)), lambda t: F.length(t) >= 2)), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.trim(_text(question))))


def turn_component(question: Column, section: Column) -> Column:
    """What a turn was about: the leaf of its primary source's heading without a figure's number, or the longest part of it that the question names."""
    parts = F.filter(F.transform(F.split(_text(section), "/"), lambda p: F.trim(p)), lambda p: p != "")
    leaf = F.trim(F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), r"[（(](?:图|表|步骤|第).{0,20}[）)]\s*$", ""))
    said = F.regexp_replace(_text(question), r"\s+", "")
    named = F.filter(F.transform(F.split(leaf, "[、与和及]"), lambda p: F.trim(p)), lambda p: (F.length(p) >= 2) & F.contains(said, p))
    longest = F.try_element_at(F.array_sort(F.transform(named, lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("p")))), F.lit(1))["p"]
    return F.when((F.length(leaf) >= 2) & (F.length(leaf) <= 40) & ~leaf.rlike(GENERIC_SECTION), F.coalesce(longest, leaf)).otherwise(F.lit(""))


def caption_terms(text: Column) -> Column:
    """Distinct words of two characters at least, without ing and s at their ends."""
    kept = F.filter(T.words(_text(text)), lambda t: (F.length(t) >= 2) & ~t.isin(CAPTION_STOP))
    cut = lambda t, n: F.substring(t, F.lit(1), F.length(t) - n)
    return F.array_distinct(F.transform(kept, lambda t: F.when(t.endswith("ing") & (F.length(t) > 5), cut(t, 3)).when(t.endswith("s") & (F.length(t) > 3), cut(t, 1)).otherwise(t)))


def figure_captions(questions: DataFrame, results: DataFrame, captions: DataFrame, most: int = 5) -> DataFrame:
    """Captions of the results' figures that share words with the question, the best ``most``, in the results' order.

    ``results`` has qid, rank, product, role, text and pics; ``captions`` product, image_id and caption. Figures of ``support``
    results are held against the words of the ``primary`` ones, too. A figure of a product counts once, at its first result.
    """
    asked = questions.select("qid", caption_terms(F.col("text")).alias("asked")).filter(F.size("asked") > 0)
    primary = results.filter("role = 'primary'").groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list(caption_terms(F.col("text"))))).alias("more"))
    figures = results.select("qid", "rank", "product", "role", F.posexplode("pics").alias("spot", "image_id")).filter("image_id <> ''")
    first = figures.groupBy("qid", "product", "image_id").agg(F.min(F.struct("rank", "spot", "role")).alias("f")).select("qid", "product", "image_id", "f.*")
    known = captions.filter(F.trim(_text(F.col("caption"))) != "").select("product", "image_id", caption_terms(F.col("caption")).alias("said"))
    rows = first.join(known, ["product", "image_id"]).join(asked, "qid").join(primary, "qid", "left")
    target = F.when(F.col("role") == "support", F.array_union("asked", F.coalesce("more", F.array().cast("array<string>")))).otherwise(F.col("asked"))
    shared = F.array_intersect(target, F.col("said"))
    score = 4 * F.size(shared) + F.when(F.array_contains(shared, "battery") & F.array_contains(shared, "statu"), 4).otherwise(0)
    scored = rows.withColumn("score", score).filter("score > 0")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "rank", "spot", "image_id", "product")
    kept = scored.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= most)
    return kept.select("qid", "product", "image_id", "score", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "spot", "image_id", "product")).alias("place"))


def figure_clauses(text: Column, numbers: Column) -> Column:
    """The clauses of a text that cite one of the figures' ``numbers``, each once, in the order of the numbers."""
    pattern = lambda n: F.concat(F.lit(r"(?i)(?:^|[.!?]\s+|\n)\s*([^.!?\n]{0,420}?\b(?:figure|fig\.?)\s*\Q"), n.cast("string"), F.lit(r"\E\b[^.!?\n]*)"))
    found = F.flatten(F.transform(numbers, lambda n: F.regexp_extract_all(_text(text), pattern(n), F.lit(1))))
    flat = F.filter(F.transform(found, lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))), lambda c: c != "")
    return F.array_join(F.array_distinct(flat), " ")


def submissions(rows: DataFrame, is_service: Column) -> DataFrame:
    """What is handed in for answers (id, answer, pics): clean text, with the pictures as a list behind it where there are any.

    Service answers have no pictures and no contacts. Of the others marks and pictures are brought to the same number. Where
    nothing is left, a fixed sentence stands.
    """
    none = F.array().cast("array<string>")
    # One step to a column: what several later expressions read is worked out once, and only for the kind of answer that needs it.
    out = rows.select("id", is_service.alias("service"), F.coalesce("pics", none).alias("pics"), T.strip_markdown(_text(F.col("answer"))).alias("t"))
    out = out.withColumn("t", F.when(F.col("service"), F.col("t")).otherwise(S.reference_symbols(F.col("t"))))
    plain, inline = S.inline_pictures(F.col("t"))
    named = F.array_distinct(F.filter(F.concat(inline, "pics"), lambda p: F.trim(_text(p)) != ""))
    out = out.select("id", "service", plain.alias("t"), F.when(F.col("service"), none).otherwise(named).alias("p"))
    out = out.withColumn("t", S.picture_marks(F.col("t")))
    bare = F.when(F.col("service"), F.replace("t", F.lit("<PIC>"), F.lit(""))).otherwise(S.repaired_marks(F.col("t"), F.size("p")))
    out = out.withColumn("t", bare)
    out = out.withColumn("t", S.without_names(F.col("t"), F.col("p")))
    pieces = F.split(F.col("t"), "<PIC>", -1)
    kept = F.array_join(F.transform("pieces", lambda piece, i: F.concat(F.when((i > 0) & (i <= F.size("p")), "<PIC>").otherwise(""), piece)), "")
    out = out.withColumn("pieces", pieces).withColumn("pics", F.slice("p", 1, F.least(F.size("p"), F.size("pieces") - 1)))
    out = out.withColumn("m", S.tidy_blanks(F.when(F.col("service"), T.redact(F.col("t"))).otherwise(kept)))
    answer = F.when(F.col("service"), F.when(F.col("m") == "", NO_REPLY).otherwise(F.col("m"))).otherwise(F.when(F.col("m") == "", NO_ANSWER).otherwise(F.col("m")))
    shown = F.when(F.col("service") | (F.col("m") == ""), F.array().cast("array<string>")).otherwise(F.col("pics"))
    listed = F.concat(F.lit('["'), F.array_join(F.transform(shown, lambda p: F.regexp_replace(F.regexp_replace(p, r"\\", r"\\\\"), '"', r'\\"')), '", "'), F.lit('"]'))
    done = out.select("id", answer.alias("a"), shown.alias("pics"), listed.alias("list"))
    return done.select("id", T.basic_plane(F.when(F.size("pics") > 0, F.concat("a", F.lit(","), "list")).otherwise(F.col("a"))).alias("ret"))


# Queries over the test tables.


def _related(s, d) -> DataFrame:
    text = F.concat(_text(F.col("text")), F.when(F.col("doc_id") % 4 == 0, "警告").otherwise(""))
    return R.bm25_top(s, d).join(table(s, d, "documents").select("doc_id", F.substring_index("text", ".", 1).alias("heading"), text.alias("text")), "doc_id")


def _visual(s, d) -> DataFrame:
    e = table(s, d, "embeddings")
    hits = R.dense_top(e.select("vec_id", "embedding"), e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding"), 20).filter("qid <> doc_id")
    rows = hits.join(e.select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("p"), "label").alias("product")), "doc_id").select("qid", "product", F.col("doc_id").alias("image_id"), "score")
    products = e.select(F.concat(F.lit("p"), "label").alias("product")).filter("product <> 'p3'").distinct()
    return visual_gate(rows, products, e.filter("vec_id % 200 = 0").select(F.col("vec_id").alias("qid"), F.explode(F.array(F.lit("p1"), F.lit("p2"), F.concat(F.lit("p"), "label"))).alias("product")), 0.36)


def _captioned(s, d) -> DataFrame:
    hits = R.bm25_top(s, d, 6).join(table(s, d, "documents").select("doc_id", "text", F.col("source").alias("product")), "doc_id")
    pics = F.array(F.concat(F.lit("i"), F.col("doc_id") % 40), F.concat(F.lit("j"), F.col("doc_id")), F.lit(""))
    rows = hits.select("qid", "rank", "product", F.when(F.col("rank") == 1, "primary").when(F.col("rank") % 2 == 0, "support").otherwise("other").alias("role"), "text", pics.alias("pics"))
    lines = sections(s, d).filter("section_id < 3")
    captions = lines.select("product", F.when(F.col("section_id") == 0, F.concat(F.lit("j"), "doc_id")).otherwise(F.concat(F.lit("i"), F.col("doc_id") * 3 + F.col("section_id"))).alias("image_id"), F.col("text").alias("caption"))
    captions = captions.groupBy("product", "image_id").agg(F.min("caption").alias("caption"))
    return figure_captions(table(s, d, "benchmark").select(F.col("item_id").alias("qid"), "text"), rows, captions)


_STOP = "[" + ", ".join(f"'{w}'" for w in TOPIC_STOP) + "]"
_PHRASES = f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({{}}, '')), '[a-z0-9][a-z0-9._/-]*'), lambda p: length(p) >= 4 AND NOT list_contains({_STOP}, p)))"
_CAPTION = f"list_distinct(list_transform(list_filter({R._W.format('{}')}, lambda t: length(t) >= 2 AND NOT list_contains([{', '.join(repr(w) for w in CAPTION_STOP)}], t)), lambda t: CASE WHEN ends_with(t, 'ing') AND length(t) > 5 THEN substr(t, 1, length(t) - 3) WHEN ends_with(t, 's') AND length(t) > 3 THEN substr(t, 1, length(t) - 1) ELSE t END))".replace("{{", "{").replace("}}", "}")


def _caption_sql(text: str) -> str:
    return _CAPTION.replace("coalesce({}, '')", f"coalesce({text}, '')")


QUERIES = {
    "topic_gate": (
        lambda s, d: topic_gate(table(s, d, "benchmark").select(F.col("item_id").alias("qid"), "text"), _related(s, d)),
        f"""WITH {R.STATS}, {R.A}, r AS (SELECT qid, a.doc_id, {_PHRASES.format("b.text")} AS q, {_PHRASES.format("split_part(d.text, '.', 1)")} AS h, {_PHRASES.format("d.text")} AS t FROM a JOIN documents d USING (doc_id) JOIN benchmark b ON item_id = qid)
        SELECT qid, doc_id, len(list_intersect(q, h)) > 0 AS on_topic, doc_id % 4 = 0 AND len(list_intersect(q, t)) > 0 AS warns FROM r""",
    ),
    "visual_gate": (
        _visual,
        f"""WITH {R.DENSE}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 20 AND qid <> doc_id AND xl <> 3 AND (qid % 200 > 0 OR xl IN (1, 2, ql)))
        SELECT qid, 'p' || xl AS product, doc_id AS image_id, score, score >= 0.36 AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS n FROM k) WHERE n = 1""",
    ),
    "figure_captions": (
        _captioned,
        f"""WITH {R.STATS}, {R.A}, {SECTIONS}, c AS (SELECT product, CASE WHEN section_id = 0 THEN 'j' || doc_id ELSE 'i' || (doc_id * 3 + section_id) END AS image_id, min(text) AS caption FROM sections WHERE section_id < 3 GROUP BY ALL),
        cc AS (SELECT product, image_id, {_caption_sql("caption")} AS said FROM c), r AS (SELECT qid, rank, source AS product, CASE WHEN rank = 1 THEN 'primary' WHEN rank % 2 = 0 THEN 'support' ELSE 'other' END AS role, text, doc_id FROM a JOIN documents USING (doc_id) WHERE rank <= 6),
        q AS (SELECT item_id AS qid, {_caption_sql("text")} AS asked FROM benchmark), p AS (SELECT qid, {_caption_sql("text")} AS more FROM r WHERE rank = 1), f AS (SELECT qid, rank, product, role, 0 AS spot, 'i' || (doc_id % 40) AS image_id FROM r UNION ALL SELECT qid, rank, product, role, 1, 'j' || doc_id FROM r),
        o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, product, image_id ORDER BY rank, spot) AS n FROM f) WHERE n = 1),
        s AS (SELECT o.*, list_intersect(CASE WHEN role = 'support' THEN list_distinct(list_concat(asked, more)) ELSE asked END, said) AS shared FROM o JOIN cc USING (product, image_id) JOIN q USING (qid) LEFT JOIN p USING (qid) WHERE len(asked) > 0),
        k AS (SELECT *, CAST(4 * len(shared) + CASE WHEN list_contains(shared, 'battery') AND list_contains(shared, 'statu') THEN 4 ELSE 0 END AS INT) AS score FROM s WHERE len(shared) > 0), b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank, spot, image_id, product) AS k FROM k)
        SELECT qid, product, image_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank, spot, image_id, product) AS INT) AS place FROM b WHERE k <= 5""",
    ),
    "submission_rows": (
        lambda s, d: submissions(
            table(s, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("## "), _text(F.col("text")), F.lit(" [pic] **see** man1_2 <PIC>\n\n\n\n【 PIC 】 call 400-123-4567 [[PIC: a.png ]]")).alias("answer"), F.slice(F.array(F.lit("x1"), F.lit('q"2'), F.lit("x1"), F.lit("x3")), 1, (F.col("doc_id") % 4 + 1).cast("int")).alias("pics")),
            F.col("id") % 5 == 0,
        ).select("id", F.sha2("ret", 256).alias("digest")),
        None,
    ),
}
