"""Text rules over tables: languages, tags, summaries, clean-up, routing by patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import SECTIONS, sections, table

#: Patterns of the questions that go to service or to the manuals.
ROUTES = {
    "greeting": r"(?i)^(?:你好|您好|嗨|哈喽|hello|hi|在吗|有人吗|早上好|上午好|中午好|下午好|晚上好|谢谢|感谢|辛苦了|再见|拜拜)[！!。,.，？?~～\s]*$",
    "service": r"(?i)订单|物流|快递|发货|到货|退款|退货|换货|退换|售后|保修服务|维修服务|发票|价格|优惠|购买|下单|店铺|商家|平台|人工客服|联系客服|投诉|纸质版说明书|电子版说明书|生产日期|批次|延长试用|上门安装",
    "service_priority": r"(?i)订单|物流|快递|发货|到货|退款|退货|换货|退换|售后|发票|价格|优惠|购买渠道|人工客服|联系客服|投诉|申请(?:换货|退货|退款|售后|维修)|(?:可以吗|能否|是否).{0,24}(?:换货|退货|退款|售后|维修)",
    "tech": r"(?i)安装|使用|设置|操作|启动|开机|关机|冷机|热机|清洁|维护|保养|排障|故障|更换|拆卸|组装|按钮|部件|螺丝|滤网|电池|保险丝|灯泡|参数|规格|安全|警告|warranty|policy|statement|disclaimer|maintenance|troubleshooting|install|replace|clean",
    "service_topic": r"(?i)保质期|临期|过期|寄到国外|国际配送|以旧换新|智能客服|运费|上门安装|试用装",
    "service_transaction": r"(?i)订单|物流|退款|退货|换货|售后|赔偿|投诉|发票|运费|补寄|收货|更换.{0,12}(?:尺寸|款式)|换成.{0,12}(?:尺寸|款式)|差价",
    "product_content": r"(?i)配备哪些附件|有哪些附件|包装盒里|包装内|盒内|随箱|随机附件|包含哪些配件",
    "service_case": r"(?i)上门检修|延长试用期限|维修.{0,20}(?:配件费|收费|承诺)|承诺.{0,12}维修",
    "commercial_change": r"(?i)换成.{0,12}(?:尺寸|尺码|款式)|更换.{0,12}(?:尺寸|尺码|款式).{0,12}差价|(?:尺寸|尺码).{0,12}(?:换大|换小|换码|更换|改大|改小)",
    "accessory": r"(?i)(?:外接|延长).{0,16}(?:电源线|延长线|插线板|插排)|(?:电源线|延长线|插线板|插排).{0,20}(?:多长|多少米|多少m|可以外接|能外接|可以用|能用)",
}
#: Markers of questions about a whole operation or several things.
SCOPE_WIDE = ["有哪些", "包括什么", "组成", "介绍", "不同", "各自", "步骤", "如何", "怎样", "what are", "what kinds", "introduce", "different", "other functions", "requirements", "limitations", "characteristics", "how to", "how do i", "what should"]
PROCEDURE = r"(?i)步骤|如何|怎么|怎样|\bhow (?:to|do|can|should)\b|\bsteps?\b|\bprocedure\b"
COMPARISON = r"(?i)区别|不同|对比|比较|\bdifferen(?:ce|t)\b|\bcompare\b|\bversus\b|\bvs\b"


#: What decides, in order: kinds of which one is enough, kinds that must be absent, and where the question goes.
DECISIONS = [
    (("greeting", "service_case", "commercial_change", "accessory"), (), "service"),
    (("product_content",), ("service_transaction",), "tech"),
    (("service_priority", "service_topic"), (), "service"),
    (("service",), ("tech",), "service"),
]


def question_route(question: Column, patterns: dict[str, str] = ROUTES) -> Column:
    """``service`` or ``tech`` by the first decision that fits the kinds of patterns a question has; where none fits, ``tech``."""
    text = F.coalesce(F.trim(question), F.lit(""))
    out = F.lit("tech")
    for has, lacks, route in reversed(DECISIONS):
        fits = reduce(Column.__or__, [text.rlike(patterns[k]) for k in has])
        out = F.when(reduce(Column.__and__, [~text.rlike(patterns[k]) for k in lacks], fits), route).otherwise(out)
    return out


def intent_flags(question: Column) -> list[Column]:
    """Whether a question asks for a procedure, a comparison, or a whole scope."""
    lower = F.lower(question)
    wide = F.lit(False)
    for marker in SCOPE_WIDE:
        wide = wide | F.contains(lower, F.lit(marker))
    return [question.rlike(PROCEDURE).alias("procedural"), question.rlike(COMPARISON).alias("comparison"), wide.alias("scope_wide")]


def image_type(content: Column, declared: Column) -> Column:
    """The type that the first bytes tell, null unless the declared one is the same."""
    head = F.hex(F.substring(content, 1, 12))
    found = F.when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("47494638"), "image/gif")
    found = found.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    return F.when(found == F.lower(declared), found)


def public_url(url: Column) -> Column:
    """Whether a url has http or https, a host, and no credentials."""
    return F.coalesce(F.lower(url).rlike(r"^https?://[^/?#@]+(?:[/?#]|$)"), F.lit(False))


def cache_eligible(question: Column, images: Column, has_history: Column) -> Column:
    """Whether a reviewed answer may be given: no images, no url, no history."""
    return ~F.coalesce(question.rlike(r"(?i)https?://|www\."), F.lit(False)) & (F.coalesce(images, F.lit(0)) == 0) & ~F.coalesce(has_history, F.lit(False))


def _docs(s, d):
    return table(s, d, "documents")


#: Words of the test tables' texts that stand beside the fixed patterns, as these tables hold no Chinese questions.
_LATIN = {"greeting": "^zz$", "service": "stale", "service_priority": "worthless|licen[cs]e", "tech": "quote", "service_topic": "token|email", "service_transaction": "copyright", "product_content": "thereof|question", "service_case": "stupid|pathetic", "commercial_change": "swap", "accessory": "cable"}
_ROUTES = {k: f"{v}|{_LATIN[k]}" for k, v in ROUTES.items()}


def _route_sql() -> str:
    hit = lambda k: f"regexp_matches(trim(text), '{_ROUTES[k]}')"
    whens = (f"WHEN ({' OR '.join(map(hit, has))}){''.join(f' AND NOT {hit(k)}' for k in lacks)} THEN '{route}'" for has, lacks, route in DECISIONS)
    return f"CASE {' '.join(whens)} ELSE 'tech' END"


_SQL_TAGS = ", ".join(f"CASE WHEN regexp_matches(both_, '{p}') THEN '{n}' END" for n, p in T.TAG_RULES)


def _strip_sql(x: str) -> str:
    for pattern, by in T.MARKDOWN:
        x = f"regexp_replace({x}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return x


def _redact_sql(x: str) -> str:
    for pattern in T.CONTACTS:
        x = f"regexp_replace({x}, '{pattern}', '', 'g')"
    return x


_CLEAN = r"list_transform(regexp_extract_all(html, '(?:https?://|www\.)[^\s<>\x22\x27]+'), lambda u: regexp_replace(u, '[.,;:!?)\]}。，！]+$', ''))"

QUERIES = {
    "detect_language": (
        lambda s, d: _docs(s, d).select("doc_id", T.language(F.col("text")).alias("language"), T.dominant_language(F.col("text")).alias("dominant")),
        """SELECT doc_id, CASE WHEN c >= 8 AND c >= 0.18 * l THEN 'zh' ELSE 'en' END AS language, CASE WHEN c >= 4 AND c >= 0.3 * l THEN 'zh' WHEN l >= 4 THEN 'en' ELSE '' END AS dominant
        FROM (SELECT doc_id, len(regexp_extract_all(text, '[\\x{3400}-\\x{9fff}]')) AS c, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM documents)""".replace("\\\\", "\\"),
    ),
    "infer_tags": (
        lambda s, d: sections(s, d).select("doc_id", "section_id", F.array_join(T.tags(F.col("heading"), F.col("text")), ",").alias("tags")),
        f"""WITH {SECTIONS}, b AS (SELECT *, lower(heading || chr(10) || text) AS both_ FROM sections)
        SELECT doc_id, section_id, array_to_string(list_distinct_ordered, ',') AS tags FROM (
          SELECT doc_id, section_id, list_filter(ts, lambda x, i: x IS NOT NULL AND list_position(ts, x) = i) AS list_distinct_ordered FROM (
            SELECT doc_id, section_id, [{_SQL_TAGS}, CASE WHEN regexp_matches(text, '{T.STEP}') OR len(regexp_extract_all(text, '{T.NUMBERED}')) >= 2 THEN 'procedure' END] AS ts FROM b))""",
    ),
    "summaries": (
        lambda s, d: sections(s, d).select("doc_id", "section_id", T.summary(F.col("text"), 180).alias("summary")),
        rf"""WITH {SECTIONS}, f AS (SELECT doc_id, section_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM sections)
        SELECT doc_id, section_id, CASE WHEN length(t) <= 180 THEN t ELSE regexp_replace(substr(t, 1, 177), '[ ,，。]+$', '') || '...' END AS summary FROM f""",
    ),
    "normalize_text": (
        lambda s, d: _docs(s, d).select("doc_id", F.md5(T.normalize(F.col("text"))).alias("digest")),
        r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' +\n', chr(10), 'g'), '\n{4,}', repeat(chr(10), 3), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents""",
    ),
    "strip_markdown": (lambda s, d: _docs(s, d).select("doc_id", F.md5(T.strip_markdown(F.col("text"))).alias("digest")), f"SELECT doc_id, md5({_strip_sql('text')}) AS digest FROM documents"),
    "redact_contacts": (
        lambda s, d: _docs(s, d).select("doc_id", F.md5(T.redact(F.col("text"))).alias("digest"), (F.length("text") - F.length(T.redact(F.col("text")))).cast("bigint").alias("n_removed")),
        f"SELECT doc_id, md5(r) AS digest, CAST(length(text) - length(r) AS BIGINT) AS n_removed FROM (SELECT doc_id, text, {_redact_sql('text')} AS r FROM documents)",
    ),
    "extract_urls": (
        lambda s, d: table(s, d, "pages").select("page_id", F.posexplode(T.urls(F.concat_ws(" ", "url", "html"))).alias("pos", "found")).select("page_id", F.col("pos").cast("bigint").alias("pos"), "found"),
        f"""WITH u AS (SELECT page_id, list_transform({_CLEAN.replace("html", "url || ' ' || html")}, lambda x: CASE WHEN starts_with(x, 'www.') THEN 'https://' || x ELSE x END) AS us FROM pages),
        o AS (SELECT page_id, list_filter(us, lambda x, i: list_position(us, x) = i) AS us FROM u) SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, us[i] AS found FROM o, LATERAL (SELECT unnest(range(1, len(us) + 1)) AS i) t""",
    ),
    "question_route": (
        lambda s, d: table(s, d, "benchmark").select("item_id", question_route(F.col("text"), _ROUTES).alias("route")),
        f"SELECT item_id, {_route_sql()} AS route FROM benchmark",
    ),
    "public_urls": (
        lambda s, d: table(s, d, "pages").select("page_id", public_url(F.col("url")).alias("public")),
        r"SELECT page_id, regexp_matches(lower(url), '^https?://[^/?#@]+(?:[/?#]|$)') AS public FROM pages",
    ),
    "cache_eligible": (
        lambda s, d: table(s, d, "conversations").filter("role = 'user'").select("conv_id", "turn", cache_eligible(F.col("text"), F.lit(0), F.col("turn") > 0).alias("eligible")),
        r"SELECT conv_id, turn, NOT regexp_matches(text, '(?i)https?://|www\.') AND turn = 0 AS eligible FROM conversations WHERE role = 'user'",
    ),
}
