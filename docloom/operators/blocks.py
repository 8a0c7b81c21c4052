"""Headings that lost their line break, blocks under a title, and answers that quote their source.

Repair of headings only inserts line breaks: without them the text is what it was. Blocks are cut
by a line grammar: a line with a label opens a topic, whose scope ends at the next label of its level or at a
blank line. Whether an answer quotes its source is decided by units of a sentence: contained in the source, or with most of
their pairs of characters in it; an answer meets its source by a join on the
question, and only whole texts are shuffled.

Nulls and ties: a null text stays null in repairs and is empty elsewhere; it has no blocks and quotes nothing. Rows of equal id are
judged one by one and counted together.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import sections, table
from .evidence import tokenize_one

#: How titles end that sections of manuals have, those whose stem the body takes up, and how bodies begin.
ENDS = "功能|说明|数据|操作|设置|安装|维护|清洁|保养|调节|调整|运行|模式|显示|按钮|部件|组件|装备|安全|警告|注意事项|概览|规格|步骤|存放|连接|排水|洗涤剂|洗涤块|亮碟剂|滤网|系统|程序|电池|温度|餐具|物品|建议|高度|停机|介绍|使用|检查|更换|拆卸|组装|充电|开机|关机|故障排除"
STEM_ENDS = "功能|说明|数据|操作|设置|安装|维护|清洁|警告|注意事项|概览|部件|规格|步骤|存放|模式|显示|运行|安全|准备|故障排除"
REPEATS = "区|功能|模式|按钮|显示|装置|系统|器|表|灯|键|孔|盖|架|盒|门|盘|滤网|设置|步骤|方法|说明"
STARTS = "本|该|此|这|通过|使用|按(?:下)?|请|将|可|需|为|在|从|要|如|若|当|对于|以下|图|[0-9]+[.、]|[-•*]|<PIC>"
ENGLISH = r"The|This|Your|To|When|If|Before|After|Use|Check|Press|Remove|Install|Do|Never|Push|As|One|Severe|Risk|<PIC>|[0-9]+\."
#: A labelled line, a bullet, and words that tell no topic.
LABEL = re.compile(r"^(?P<bullet>[•*\-–—]?\s*)(?P<label>[^：:\n。！？；\[\]]{2,40})[：:](?P<body>.*)$")
BULLET = re.compile(r"^[•*\-–—]\s*")
TOPIC_STOP = {"说明", "系统", "功能", "使用", "处理", "菜单", "信息", "通用", "附加", "产品", "相关", "其他", "注意", "事项", "the", "and", "with", "for"}
#: A unit's end, and shares of pairs of characters that make a unit and an opening sentence the source's.
UNIT_END = r"(?<=[。！？.!?])\s*"
MARKS, LINE_ENDS = "。！？.!?", "\n\v\f\r\x85\u2028\u2029"
FIRST_LINE, UNIT_ENDS = re.compile(f"(?: *[{LINE_ENDS}])*[^{LINE_ENDS}]*"), re.compile(f"[{MARKS}{LINE_ENDS}]")
FLAT_ASCII, LOWER = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(256)).lower()
SHARE, MATCHED, OPENING, UNIT, LEAD = 0.78, 0.9, 0.45, 6, 140

_C = r"(?:(?!#{1,6} )[^\n])"  # a character that begins no other heading


def _title() -> str:
    """What a title may be that a space and its body follow; of several the first that fits."""
    rules = [
        rf"(?<again>{_C}{{2,36}}?)(?= \k<again>(?:{REPEATS}))",  # the body repeats it
        rf"(?<stem>{_C}{{2,36}}?)(?:{STEM_ENDS})(?= \k<stem>)",  # or its stem
        rf"{_C}{{2,48}}?(?:{ENDS})(?= (?!#{{1,6}} )\S)",  # it ends like one
        rf"{_C}{{2,44}}?(?= (?:{STARTS}))",  # the body begins like one
        rf"[A-Z][A-Za-z0-9 /&'()_-]{{2,64}}(?= (?:{ENGLISH}))",
    ]
    return "|".join(f"(?:{r})" for r in rules)


def on_own_lines(text: Column) -> Column:
    """Headings begin lines: a line break before each mark that stands inside one."""
    return F.regexp_replace(text, r"(?<=[^\n#])(?=#{1,6} )", "\n")


def repaired_headings(text: Column) -> Column:
    """Marks of headings on lines of their own, and a line break where a heading's title ends and its body begins."""
    return F.regexp_replace(on_own_lines(text), rf"((?<!#)#{{1,6}} +)((?! )(?:{_title()}))", "$1$2\n")


def heading_repairs(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key``, the repaired ``text`` and how many line breaks came and how many of them end titles; rows that need none are left out."""
    fixed = rows.select(key, F.col(text).alias("before"), on_own_lines(F.col(text)).alias("lines"), repaired_headings(F.col(text)).alias("text"))
    count = lambda a, b: (F.length(a) - F.length(b)).cast("long")
    return fixed.filter("before <> text").select(key, "text", count("text", "before").alias("line_breaks"), count("text", "lines").alias("titles"))


def topic_terms(text: str) -> set[str]:
    return {t.casefold() for t in tokenize_one(text) if len(t.strip()) > 1 and t.casefold() not in TOPIC_STOP}


def bounded(text: str | None, heading: str | None, pics: list | None) -> list[str]:
    """The blocks of one section.

    A label without a bullet opens a topic, one with a bullet only if it shares a word with the heading. A
    paragraph without topics is a block, unless the block before is a short title that waits for it. A title over nothing but
    bullets, two at least, gives a block for each of them.
    """
    text = (text or "").strip()
    for pic in pics if pics is not None else []:
        text = text.replace("<PIC>", f"[[PIC:{pic}]]", 1)
    about, blocks = topic_terms(heading or ""), []
    for paragraph in re.split(r"\n\s*\n", text):
        topics, opened = [], False
        for line in filter(None, (x.strip() for x in paragraph.splitlines())):
            label = LABEL.match(line)
            opens = bool(label) and (not label["bullet"].strip() or bool(topic_terms(label["label"].strip()) & about))
            opened |= opens
            if opens or not topics:
                topics.append([])
            topics[-1].append(line)
        if opened:
            blocks += ["\n".join(t) for t in topics]
        elif topics:
            body = "\n".join(topics[0])
            if blocks and len(blocks[-1]) <= 80 and re.search(r"[：:]\s*$", blocks[-1]):
                blocks[-1] += "\n" + body
            else:
                blocks.append(body)
    out = []
    for block in blocks:
        title, *rest = block.split("\n")
        label = LABEL.match(title)
        listed = label and not label["bullet"].strip() and len(rest) >= 2 and all(map(BULLET.match, rest))
        out += [f"{title}\n{line}" for line in rest] if listed else [block]
    return out


def bounded_blocks(rows: DataFrame, key: str) -> DataFrame:
    """``key``, ``place`` from 0 and ``block`` of sections (text, heading, pics)."""

    @F.pandas_udf("array<string>")
    def cut(text: pd.Series, heading: pd.Series, pics: pd.Series) -> pd.Series:
        return pd.Series([bounded(t, h, p) for t, h, p in zip(text, heading, pics, strict=True)])

    return rows.select(key, F.posexplode(cut("text", "heading", "pics")).alias("place", "block"))


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9㐀-鿿]+", "")


def flat(text: str | None, more: str = "") -> str:
    """``compact`` of one text, which may keep ``more`` characters; the short way where all its characters are Latin-1."""
    text = text or ""
    try:
        return text.encode("latin-1").translate(LOWER, bytes(i for i in range(256) if chr(i) not in FLAT_ASCII + more)).decode("latin-1")
    except UnicodeEncodeError:
        return re.sub(rf"[^a-z0-9㐀-鿿{more}]+", "", text.lower())


def shares(units: list[str], source: str) -> np.ndarray:
    """The share of each flat unit's distinct pairs of characters that the flat source has; 1 where the source contains the unit."""
    out, missing = np.ones(len(units)), [i for i, u in enumerate(units) if u not in source]
    if not missing:
        return out
    codes = lambda text: np.frombuffer(text.encode("utf-16-le"), "<u2").astype(np.int64)
    pairs = lambda c: c[:-1] << 16 | c[1:]
    owner = np.repeat(np.arange(len(missing)), [len(units[i]) for i in missing])
    keys = np.unique((owner[:-1] << 32 | pairs(codes("".join(units[i] for i in missing))))[owner[:-1] == owner[1:]])
    has = np.isin(keys & 0xFFFFFFFF, np.unique(pairs(codes(source))))
    out[missing] = np.bincount(keys >> 32, has, len(missing)) / np.bincount(keys >> 32, minlength=len(missing))
    return out


def quoted_units(answer: str | None, source: str | None) -> tuple[int, int]:
    """How many units an answer has behind its first line, and how many of them are the source's; none where the source is empty."""
    source = flat(source)
    rest = (answer or "")[FIRST_LINE.match(answer or "").end() :]
    units = [u for u in UNIT_ENDS.split(flat(rest, MARKS + LINE_ENDS)) if len(u) >= UNIT] if source else []
    return len(units), int((shares(units, source) >= SHARE).sum())


def literal_answers(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Whether answers (qid, answer) are excerpts of their sources (qid, source): ``units``, those that ``matched``, and ``literal``.

    The first line may be an opening of its own; of the others nine in ten units of ``UNIT`` characters
    must stand in the source, or have ``SHARE`` of their pairs of characters there.
    """

    @F.pandas_udf("units long, matched long")
    def counts(answer: pd.Series, source: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([quoted_units(a, s) for a, s in zip(answer, source, strict=True)], columns=["units", "matched"])

    rows = answers.select("qid", "answer").join(sources.select("qid", "source"), "qid", "left").select("qid", counts("answer", "source").alias("c"))
    out = rows.groupBy("qid").agg(F.sum("c.units").alias("units"), F.sum("c.matched").alias("matched"))
    return out.withColumn("literal", (F.col("units") > 0) & (F.col("matched") >= MATCHED * F.col("units")))


def backed_openings(drafts: DataFrame, sources: DataFrame) -> DataFrame:
    """The first sentence of drafts (qid, draft) that leads in to the source without quoting it: ``opening``.

    It is one short sentence without pictures, isn't contained in the source, and has ``OPENING`` of its pairs of characters there.
    """
    lines = F.filter(F.transform(F.split(F.coalesce("draft", F.lit("")), r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.trim(F.get(F.split(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), UNIT_END, 2), F.lit(0)))
    ends = F.length(F.regexp_replace(F.col("opening"), "[^。！？.!?]", ""))
    one = drafts.select("qid", first.alias("opening")).filter((F.length("opening") <= LEAD) & ~F.contains("opening", F.lit("[[PIC:")) & ~F.contains("opening", F.lit("<PIC")) & (ends <= 1))
    units = one.select("qid", "opening", compact(F.col("opening")).alias("unit")).filter(F.length("unit") >= UNIT)

    @F.pandas_udf("double")
    def share(unit: pd.Series, source: pd.Series) -> pd.Series:
        return pd.Series([None if u in s else shares([u], s)[0] for u, s in zip(unit, source.map(flat), strict=True)], dtype="float64")

    return units.join(sources.select("qid", "source"), "qid").filter(share("unit", "source") >= OPENING).select("qid", "opening")


# Queries over the test tables: lines of documents whose headings ran into them, and answers made of lines of two documents.


def _flattened(s, d) -> DataFrame:
    """Documents of which each fourth line lost its break before it, and the one after its title."""
    rows = sections(s, d)
    title = F.initcap(F.substring_index("heading", " ", 2))
    line = F.when(F.col("section_id") % 4 == 1, F.concat(F.lit("## "), title, F.lit(" The "), "text")).when(F.col("section_id") % 4 == 2, F.concat(F.lit("# 安全说明 "), "text")).otherwise(F.col("text"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_id", line.alias("line")))), lambda x: x["line"]), " ").alias("text"))


def _labelled(s, d) -> DataFrame:
    """Sections with labels, bullets and a picture each, made of a document's lines."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    shaped = F.transform(lines, lambda x, i: F.when(i % 5 == 0, F.concat(F.substring(x, 1, 12), F.lit(": <PIC>"))).when(i % 5 < 3, F.concat(F.lit("- "), x)).when(i % 5 == 3, F.concat(F.lit("\n"), x)).otherwise(F.concat(F.substring_index(x, " ", 1), F.lit(": "), x)))
    return table(s, d, "documents").select("doc_id", F.array_join(shaped, "\n").alias("text"), F.substring_index("text", " ", 2).alias("heading"), F.array(F.concat(F.lit("p"), F.col("doc_id"))).alias("pics"))


def _quoted(s, d) -> tuple[DataFrame, DataFrame]:
    docs = table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.substring("text", 1, 600).alias("other"))
    rows = docs.join(other, "doc_id", "left")
    mixed = F.concat_ws("\n", F.concat(F.lit("Read this: "), F.substring("text", 1, 40)), F.when(F.col("doc_id") % 3 > 0, F.col("text")).otherwise(F.translate("text", "aeiou", "eioua")), F.when(F.col("doc_id") % 2 == 0, F.col("other")))
    return rows.select(F.col("doc_id").alias("qid"), mixed.alias("answer")), docs.select(F.col("doc_id").alias("qid"), F.col("text").alias("source"))


QUERIES = {
    "heading_repairs": (lambda s, d: heading_repairs(_flattened(s, d), "doc_id").select("doc_id", "line_breaks", "titles", F.sha2("text", 256).alias("digest")), None),
    "bounded_blocks": (lambda s, d: bounded_blocks(_labelled(s, d), "doc_id").select("doc_id", "place", F.sha2("block", 256).alias("digest")), None),
    "literal_answers": (
        lambda s, d: literal_answers(*_quoted(s, d)),
        rf"""WITH q AS (SELECT d.doc_id AS qid, coalesce(d.text, '') AS source, 'Read this: ' || substr(coalesce(d.text, ''), 1, 40) || chr(10) || CASE WHEN d.doc_id % 3 > 0 THEN coalesce(d.text, '') ELSE translate(coalesce(d.text, ''), 'aeiou', 'eioua') END || CASE WHEN d.doc_id % 2 = 0 AND o.doc_id IS NOT NULL THEN chr(10) || substr(coalesce(o.text, ''), 1, 600) ELSE '' END AS answer FROM documents d LEFT JOIN documents o ON o.doc_id = d.doc_id + 1),
        l AS (SELECT qid, source, list_filter(list_transform(string_split(answer, chr(10)), lambda x: trim(x)), lambda x: x <> '')[2:] AS ls FROM q), u AS (SELECT qid, source, unnest(flatten(list_transform(ls, lambda x: string_split(regexp_replace(x, '([。！？.!?])\s*', '\1' || chr(1), 'g'), chr(1))))) AS unit FROM l),
        k AS (SELECT qid, row_number() OVER () AS n, unit FROM (SELECT qid, regexp_replace(lower(unit), '[^a-z0-9㐀-鿿]+', '', 'g') AS unit FROM u) WHERE length(unit) >= {UNIT}), s AS (SELECT qid, regexp_replace(lower(source), '[^a-z0-9㐀-鿿]+', '', 'g') AS src FROM q),
        sg AS (SELECT DISTINCT qid, unnest(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])) AS gram FROM (SELECT qid, string_split(src, '') AS c FROM s)), ug AS (SELECT DISTINCT n, qid, unnest(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])) AS gram FROM (SELECT qid, n, string_split(unit, '') AS c FROM k)),
        sh AS (SELECT n, count(sg.gram) / count(*) AS share FROM ug LEFT JOIN sg ON sg.qid = ug.qid AND sg.gram = ug.gram GROUP BY n), m AS (SELECT k.qid, count(*) AS units, CAST(sum((contains(src, unit) OR share >= {SHARE})::INT) AS BIGINT) AS matched FROM k JOIN s ON s.qid = k.qid AND src <> '' JOIN sh ON sh.n = k.n GROUP BY k.qid)
        SELECT q.qid, coalesce(units, 0) AS units, coalesce(matched, 0) AS matched, coalesce(units, 0) > 0 AND coalesce(matched, 0) >= {MATCHED} * coalesce(units, 0) AS literal FROM q LEFT JOIN m ON m.qid = q.qid""",
    ),
}
