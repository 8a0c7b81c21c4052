"""Reviewed questions by a key of their letters and by concepts, ordered ranges in questions, captions by six ways, and whole catalogues.

Keys need Unicode's compatibility forms, which Spark has no function for, so they come from a pandas UDF over the
distinct texts' column; all joins and scores are Spark's.

Nulls and ties: null texts are empty; an empty key matches nothing, not even another. Of cases of equal score and
shared tokens the smaller id is first. Captions of equal text and product are one.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import SECTIONS, sections, table
from . import answers as A

#: Spellings of one concept in both languages, words and characters that tell nothing.
CONCEPTS = [
    (r"(?:洗涤剂|洗涤块|洗涤粉|洗涤液|detergent\s*tablets?|dishwasher\s*tablets?)", " detergent "),
    (r"(?:洗碗机|dish\s*washer|dishwasher)", " dishwasher "),
    (r"(?:水上摩托|摩托艇|jet\s*ski|jetski|watercraft|waverunner)", " jetski "),
    (r"(?:吸尘器|扫地机器人|vacuum\s*cleaner|robot\s*vacuum|roomba)", " vacuum "),
    (r"(?:滤网|过滤器|filters?|filter)", " filter "),
    (r"(?:清洁|清洗|擦拭|clean(?:ing)?|wash(?:ing)?)", " clean "),
    (r"(?:更换|替换|replace|replacement)", " replace "),
    (r"(?:拆卸|取下|移除|remove|detach)", " remove "),
    (r"(?:安装|装配|组装|install(?:ing)?|assemble)", " install "),
    (r"(?:转弯|转向|turning|steering|turn)", " turn "),
]
CJK_STOP = {"请", "请问", "我", "想", "要", "你", "您", "这", "这个", "这款", "那个", "的", "了", "吗", "呢", "有", "和", "与", "及", "在", "中", "里", "上", "下", "前", "后", "时", "是", "能", "可以", "是否", "哪些", "什么", "怎么", "怎样", "如何", "为什么", "介绍", "说明", "一下", "需要", "应该"}
GRAMMAR = set("的了吗呢啊呀和与及在中里上下前后时是能请问我你您这那")
ENGLISH_STOP = {"a", "an", "and", "are", "can", "do", "does", "for", "how", "i", "if", "in", "is", "it", "my", "of", "on", "please", "the", "this", "to", "what", "when", "where", "which", "with", "you", "your", "proper", "correct", "procedure", "steps", "step", "detail", "detailed"}
SEGMENT = re.compile(r"[a-z0-9_]+|[㐀-鿿]+")
_CONCEPTS = [(re.compile(p, re.I), by) for p, by in CONCEPTS]
#: How ordered ranges are said.
NUMBER = r"(\d{1,2}|[一二两三四五六七八九十]{1,3}|one|two|three|four|five|six|seven|eight|nine|ten)"
UNIT = r"(?:步骤|条|项|步|steps?|items?|points?)"


def folded(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "").casefold()


def letters_of(text: str | None) -> str:
    """Letters, marks and digits of the folded text."""
    return "".join(c for c in folded(text) if unicodedata.category(c)[0] not in "PSZC")


def concepts_of(text: str | None, split=None) -> list[str]:
    """Distinct tokens: Latin words, and Chinese words by ``split`` or, without one, short runs and pairs of characters; concepts by one name."""
    out, said = [], folded(text)
    for pattern, by in _CONCEPTS:
        said = pattern.sub(by, said)
    tells = lambda w: w not in CJK_STOP and not GRAMMAR & set(w)
    for run in SEGMENT.findall(said):
        if run.isascii():
            out += [run] if len(run) > 1 and run not in ENGLISH_STOP else []
        elif run not in CJK_STOP:
            known = [w.strip() for w in split(run) if len(w.strip()) >= 2 and tells(w.strip())] if split else []
            if len(known) > 1:
                out += known
            else:
                out += [run] if len(run) <= 4 else []
                out += [run[i : i + 2] for i in range(len(run) - 1) if tells(run[i : i + 2])]
    return list(dict.fromkeys(out))


def letters_key(text: Column) -> Column:
    """What a question is compared by where only its letters and digits count, whatever their width and case."""
    return F.pandas_udf(lambda texts: texts.map(letters_of), "string")(text)


def concept_tokens(text: Column, split=None) -> Column:
    return F.pandas_udf(lambda texts: texts.map(lambda t: concepts_of(t, split)), "array<string>")(text)


def answers_by_letters(questions: DataFrame, reviewed: DataFrame) -> DataFrame:
    """``questions`` (qid, question) with the reviewed case (case_id, question) of the same letters, and the SHA-256 of their key."""
    key = letters_key(F.coalesce("question", F.lit(""))).alias("key")
    r = reviewed.select("case_id", key).filter("key <> ''").groupBy("key").agg(F.min("case_id").alias("case_id"))
    return questions.select("qid", key).join(r, "key").select("qid", "case_id", F.sha2("key", 256).alias("hash"))


def answers_by_concepts(questions: DataFrame, reviewed: DataFrame, split=None) -> DataFrame:
    """The reviewed case that a question means, by shared concepts and tokens, equal or an edit apart; as ``answers.fuzzy_answers`` beyond its tokens."""
    tokens = lambda c: concept_tokens(F.coalesce(c, F.lit("")), split)
    return A.fuzzy_by_tokens(questions.select("qid", tokens("question").alias("tokens")), reviewed.select("case_id", tokens("question").alias("tokens")))


def small_number(said: Column) -> Column:
    """A number from 1 to 99 in figures, in English to ten, or in Chinese."""
    one = lambda c: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in T.NUMERALS.items() for x in pair)), c), F.lit(0))
    at = lambda i: F.substring(said, i, 1)
    ten, n = F.lit("十"), F.length(said)
    chinese = F.when((n == 2) & (at(1) == ten) & (one(at(2)) > 0), 10 + one(at(2))).when((n == 2) & (at(2) == ten) & (one(at(1)) > 0), 10 * one(at(1))).when((n == 3) & (at(2) == ten) & (one(at(1)) > 0) & (one(at(3)) > 0), 10 * one(at(1)) + one(at(3)))
    number = F.coalesce(said.try_cast("int"), F.nullif(one(said), F.lit(0)), chinese)
    return F.when((number >= 1) & (number <= 99), number)


def ordered_range(question: Column) -> Column:
    """What part of an ordered list a question asks for: ``first`` and ``last`` from 1, or the ``count`` of the last ones (``from_end``); null without one.

    Steps a to b are looked for before the first n, and these before the last n.
    """
    q = F.lower(F.trim(F.regexp_replace(F.coalesce(question, F.lit("")), r"\s+", " ")))
    get = lambda pattern, i: small_number(F.regexp_extract(q, pattern, i))
    shape = lambda a, b, end: F.struct(a.cast("int").alias("first"), b.cast("int").alias("last"), F.lit(end).alias("from_end"))
    between, through = rf"(?:第\s*)?{NUMBER}\s*(?:到|至|[-–—~])\s*(?:第\s*)?{NUMBER}\s*{UNIT}", rf"{UNIT}\s+{NUMBER}\s+(?:to|through)\s+{NUMBER}"
    prefix, suffix = (rf"(?:(?:{zh})\s*{NUMBER}\s*(?:个)?\s*{UNIT}|{en}\s+{NUMBER}\s+{UNIT})" for zh, en in (("前|最初", "first"), ("最后|末尾", "last")))
    ranged = lambda p: F.when(get(p, 1) <= get(p, 2), shape(get(p, 1), get(p, 2), False))
    count = lambda p: F.coalesce(get(p, 1), get(p, 2))
    return F.coalesce(ranged(between), ranged(through), F.when(count(prefix).isNotNull(), shape(F.lit(1), count(prefix), False)), F.when(count(suffix).isNotNull(), shape(F.lit(None), count(suffix), True)))


def locator(product: Column) -> Column:
    """A manual's name without the word for a manual, blanks and marks."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(product, F.lit(""))), r"(?:用户)?手册\s*$", ""), r"(?U)[\s\W_]+", "")


def figure_context(heading: Column, text: Column) -> Column:
    """Heading and text of a figure's section, 420 characters at most; null without either."""
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "(?i)<PIC>", " "), r"\s+", " "))
    h, t = clean(heading), clean(text)
    both = F.when((h != "") & F.startswith(t, h), t).otherwise(F.array_join(F.filter(F.array(h, t), lambda x: x != ""), "。 "))
    return F.when(both != "", F.concat(F.lit("手册图示上下文："), F.substring(both, 1, 420)))


def caption_cascade(images: DataFrame, captions: DataFrame, figures: DataFrame) -> DataFrame:
    """The caption of each image (product, image_id) and the ``way`` it was found, null where none was.

    ``captions`` has product, image_id and caption, ``figures`` product, image_id, caption, heading and text of the sections with the
    image. Ways in order: ``exact``; ``product``, the only one of the image whose product has the same locator; ``image``, among
    captions that differ in product and text the only one of the product, else the only one at all; ``source``, the same over
    captions of sections, or what stands around the image where a section has none.
    """
    trim = lambda c: F.trim(F.coalesce(c, F.lit("")))
    own = captions.select("product", "image_id", trim("caption").alias("caption"), locator(F.col("product")).alias("key"))
    exact = own.filter("caption <> ''").groupBy("product", "image_id").agg(F.min("caption").alias("exact"))
    named = own.groupBy("image_id", "key").agg(F.count("*").alias("n"), F.min("caption").alias("named")).filter("n = 1 AND named <> ''").drop("n")
    source = figures.select("product", "image_id", F.coalesce(F.nullif(trim("caption"), F.lit("")), figure_context(F.col("heading"), F.col("text"))).alias("caption"), locator(F.col("product")).alias("key")).filter("caption IS NOT NULL")
    rows = images.select("product", "image_id", locator(F.col("product")).alias("key")).join(exact, ["product", "image_id"], "left").join(named, ["image_id", "key"], "left")
    for name, pool in (("image", own.filter("caption <> ''")), ("source", source)):
        each = pool.select("product", "image_id", "caption", "key").distinct()
        of_product = each.groupBy("image_id", "key").agg(F.count("*").alias("n"), F.min("caption").alias(f"{name}_own")).filter("n = 1 AND key <> ''").drop("n")
        alone = each.groupBy("image_id").agg(F.count("*").alias("n"), F.min("caption").alias(f"{name}_alone")).filter("n = 1").drop("n")
        rows = rows.join(of_product, ["image_id", "key"], "left").join(alone, "image_id", "left").withColumn(name, F.coalesce(f"{name}_own", f"{name}_alone"))
    ways = [("exact", "exact"), ("named", "product"), ("image", "image"), ("source", "source")]
    way = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(w)) for c, w in ways))
    return rows.select("product", "image_id", F.coalesce(*(F.col(c) for c, _ in ways)).alias("caption"), way.alias("way"))


def merged_items(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keyed arrays of audit traces (request_id, path, item_key, place, value): the later trace's items first, in its order, then those that only the former has.

    An empty later value leaves the former one; a path that the later trace has no items for stays as it was.
    """
    n = new.select("request_id", "path", "item_key", F.col("place").alias("p"), F.col("value").alias("v"))
    both = old.join(n, ["request_id", "path", "item_key"], "full_outer")
    order = Window.partitionBy("request_id", "path").orderBy(F.col("p").isNull(), F.coalesce("p", "place"), "item_key")
    return both.select("request_id", "path", "item_key", F.row_number().over(order).alias("place"), F.coalesce(F.nullif("v", F.lit("")), "value").alias("value"))


def catalogue_entries(rows: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """One entry for each product: characters, pictures, sections and chunks, the SHA-256 of its source, and its sections in order.

    ``rows`` has product, section_id, heading, summary, char_len, pic_count and tags; ``chunks`` product; ``sources`` product and source.
    """
    section = F.struct(F.col("section_id").alias("id"), F.col("heading").alias("title"), "summary", "char_len", "pic_count", "tags")
    own = rows.groupBy("product").agg(F.sum("char_len").alias("total_chars"), F.sum("pic_count").alias("total_pics"), F.count("*").alias("section_count"), F.array_sort(F.collect_list(section)).alias("sections"))
    n = chunks.groupBy("product").agg(F.count("*").alias("retrieval_chunk_count"))
    digest = sources.select("product", F.sha2(F.coalesce("source", F.lit("")), 256).alias("source_sha256"))
    return own.join(n, "product", "left").join(digest, "product", "left").withColumn("retrieval_chunk_count", F.coalesce("retrieval_chunk_count", F.lit(0).cast("long")))


# Queries over the test tables.


def _noisy(s, d):
    """Benchmark questions in other widths, cases and marks."""
    wide = F.translate(F.upper("text"), "ABCDEFGH ", "ＡＢＣＤＥＦＧＨ　")
    return table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.when(F.col("item_id") % 3 == 0, F.col("text")).when(F.col("item_id") % 3 == 1, wide).otherwise(F.concat(F.lit("«"), F.regexp_replace("text", " ", " - "), F.lit("»!"))).alias("question"))


def _cases(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("question"))


def _captions(s, d):
    lines = sections(s, d).filter("section_id < 6").withColumn("image_id", F.concat(F.lit("i"), F.col("doc_id") % 400, F.lit("_"), "section_id"))
    captions = lines.filter("section_id % 3 < 2").select(F.when(F.col("doc_id") % 4 == 0, F.concat("product", F.lit("手册"))).otherwise(F.col("product")).alias("product"), "image_id", F.when(F.col("doc_id") % 7 > 0, F.col("heading")).alias("caption"))
    figures = lines.select("product", "image_id", F.when(F.col("doc_id") % 3 == 0, F.col("heading")).alias("caption"), "heading", "text")
    return caption_cascade(lines.select("product", "image_id").distinct(), captions, figures)


def _entries(s, d):
    rows = sections(s, d).select(F.concat_ws("/", "product", F.col("doc_id") % 50).alias("product"), (F.col("doc_id") * 100_000 + F.col("section_id")).alias("section_id"), "heading", F.substring("text", 1, 20).alias("summary"), "char_len", (F.col("section_id") % 3).alias("pic_count"), F.array("lang").alias("tags"))
    sources = table(s, d, "documents").groupBy(F.concat_ws("/", "source", F.col("doc_id") % 50).alias("product")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("source"))
    e = catalogue_entries(rows, rows.filter("char_len > 40"), sources)
    return e.select("product", "total_chars", "total_pics", "section_count", "retrieval_chunk_count", "source_sha256", F.md5(F.array_join(F.transform("sections", lambda x: F.concat_ws("|", x["id"], x["title"], x["char_len"])), ",")).alias("listing"))


def _folded_sql() -> str:
    """The SQL of the plain fuzzy match with the one letter folded that lower() leaves."""
    fold, sql = A._TOK.replace("lower({})", "replace(lower({}), 'ß', 'ss')"), A.QUERIES["reviewed_fuzzy"][1]
    for text in (r"regexp_replace(regexp_replace(text, '^(..).', '\1'), '\s+\S+$', '')", "text"):
        sql = sql.replace(A._TOK.format(text), fold.format(text))
    return sql


QUERIES = {
    "reviewed_letters": (
        lambda s, d: answers_by_letters(_noisy(s, d), _cases(s, d)),
        "WITH k AS (SELECT item_id AS case_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}\\p{M}]+', '', 'g') AS key FROM benchmark), f AS (SELECT key, min(case_id) AS case_id FROM k WHERE key <> '' GROUP BY key) SELECT k.case_id AS qid, f.case_id, sha256(key) AS hash FROM k JOIN f USING (key)",
    ),
    "reviewed_concepts": (lambda s, d: answers_by_concepts(A._typos(s, d), _cases(s, d)), _folded_sql()),
    "caption_cascade": (
        lambda s, d: _captions(s, d).select("product", "image_id", F.md5("caption").alias("digest"), "way"),
        rf"""WITH {SECTIONS}, l AS (SELECT *, 'i' || (doc_id % 400) || '_' || section_id AS image_id FROM sections WHERE section_id < 6), c AS (SELECT CASE WHEN doc_id % 4 = 0 THEN product || '手册' ELSE product END AS product, product AS key, image_id, trim(CASE WHEN doc_id % 7 > 0 THEN heading ELSE '' END) AS caption FROM l WHERE section_id % 3 < 2),
        fx AS (SELECT product, image_id, doc_id, trim(regexp_replace(heading, '\s+', ' ', 'g')) AS h, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, trim(heading) AS own FROM l), f AS (SELECT product, image_id, CASE WHEN doc_id % 3 = 0 AND own <> '' THEN own ELSE '手册图示上下文：' || substr(CASE WHEN h <> '' AND starts_with(t, h) THEN t ELSE array_to_string(list_filter([h, t], lambda x: x <> ''), '。 ') END, 1, 420) END AS caption FROM fx),
        i AS (SELECT DISTINCT product, image_id FROM l), e AS (SELECT product, image_id, min(caption) AS exact FROM c WHERE caption <> '' GROUP BY ALL), n AS (SELECT image_id, key AS product, min(caption) AS named FROM c GROUP BY ALL HAVING count(*) = 1 AND min(caption) <> ''),
        cd AS (SELECT DISTINCT product, key, image_id, caption FROM c WHERE caption <> ''), co AS (SELECT image_id, key AS product, min(caption) AS x FROM cd GROUP BY ALL HAVING count(*) = 1), ca AS (SELECT image_id, min(caption) AS y FROM cd GROUP BY ALL HAVING count(*) = 1),
        fd AS (SELECT DISTINCT product, image_id, caption FROM f), fo AS (SELECT image_id, product, min(caption) AS u FROM fd GROUP BY ALL HAVING count(*) = 1), fa AS (SELECT image_id, min(caption) AS v FROM fd GROUP BY ALL HAVING count(*) = 1)
        SELECT product, image_id, md5(coalesce(exact, named, x, y, u, v)) AS digest, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN named IS NOT NULL THEN 'product' WHEN coalesce(x, y) IS NOT NULL THEN 'image' WHEN coalesce(u, v) IS NOT NULL THEN 'source' END AS way
        FROM i LEFT JOIN e USING (product, image_id) LEFT JOIN n USING (product, image_id) LEFT JOIN co USING (product, image_id) LEFT JOIN ca USING (image_id) LEFT JOIN fo USING (product, image_id) LEFT JOIN fa USING (image_id)""",
    ),
    "catalogue_entries": (
        _entries,
        f"""WITH {SECTIONS}, r AS (SELECT product || '/' || (doc_id % 50) AS product, doc_id * 100000 + section_id AS id, heading, char_len, section_id % 3 AS pics FROM sections), s AS (SELECT source || '/' || (doc_id % 50) AS product, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id)) AS source_sha256 FROM documents GROUP BY 1)
        SELECT r.product, CAST(sum(char_len) AS BIGINT) AS total_chars, CAST(sum(pics) AS BIGINT) AS total_pics, count(*) AS section_count, count(*) FILTER (char_len > 40) AS retrieval_chunk_count, any_value(source_sha256) AS source_sha256, md5(string_agg(id || '|' || heading || '|' || char_len, ',' ORDER BY id)) AS listing FROM r JOIN s USING (product) GROUP BY r.product""",
    ),
}
