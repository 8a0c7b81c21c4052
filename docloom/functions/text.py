"""Text functions as column expressions; they stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the rules below, as regular expressions in their order of precedence.
TAG_RULES = [
    ("warning", r"\b(?:danger|warning|caution)\b|危险|警告|注意|严禁|不得"),
    ("procedure", r"\b(?:step|install|remove|press|connect|clean|replace|setup)\b|步骤|安装|拆卸|按下|连接|清洁|更换|设置"),
    ("troubleshooting", r"\btroubleshoot|problem|error|fault|does not|cannot\b|故障|问题|错误|无法|不工作"),
    ("parts", r"\b(?:parts?|components?|overview|control panel)\b|部件|组件|配件|控制面板"),
    ("specification", r"\b(?:specifications?|voltage|capacity|dimensions?|weight)\b|规格|电压|容量|尺寸|重量"),
    ("warranty", r"\b(?:warranty|guarantee|support)\b|保修|质保|售后"),
]
STEP = r"^\s*(?:步骤\s*)?(?:\d{1,3}[.)、．:]|[A-Za-z][.)、．:]|[①②③④⑤⑥⑦⑧⑨⑩]|[-*•])\s*"
NUMBERED = r"(?:^|\n)\s*\d+[.)、．]?\s*"
CONTACTS = [
    r"(?i)https?://\S+|www\.\S+",
    r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    r"\b(?:400[-\s]?[0-9A-ZXx*]{3,4}[-\s]?[0-9A-ZXx*]{4}|1[3-9]\d{9}|0\d{2,3}-\d{7,8})\b",
    r"客服热线|客服电话|官方客服|官方网站|官网|微信(?:号|公众号)?|小程序|12315",
]
MARKDOWN = [
    (r"```[^\n]*\n?", ""),
    (r"(?m)^[ \t|:\-]+$", ""),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"\*([^*\n]+)\*", "$1"),
    (r"`([^`\n]+)`", "$1"),
    (r"(?m)^#{1,6}\s*", ""),
    (r"(?m)^[ \t]*[-*+][ \t]+", ""),
    (r"(?m)^[ \t]*>[ \t]?", ""),
    (r"\\([*_`\[\]()])", "$1"),
]
#: What each match of these has.
MARKDOWN_NEEDS = [["```"], [], ["**"], ["*"], ["`"], ["#"], ["- ", "* ", "+ ", "-\t", "*\t", "+\t"], [">"], ["\\"]]
URL = r"(?:https?://|www\.)[^\s<>\"']+"


def language(text: Column) -> Column:
    """``zh`` if Chinese characters are eight at least and 18 percent of Latin letters, else ``en``."""
    cjk, latin = F.regexp_count(text, F.lit(r"[㐀-鿿]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when((cjk >= 8) & (cjk >= 0.18 * latin), "zh").otherwise("en")


def dominant_language(text: Column) -> Column:
    """``zh`` or ``en`` where it has more characters of its own, else the empty string."""
    cjk, latin = F.regexp_count(text, F.lit(r"[㐀-鿿]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when((cjk >= 4) & (cjk >= 0.3 * latin), "zh").when(latin >= 4, "en").otherwise("")


def summary(text: Column, limit: int) -> Column:
    """Whitespace collapsed; longer ones cut three short of the limit, without trailing blanks or commas, and with dots."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, limit - 3), "[ ,，。]+$", ""), F.lit("...")))


def tags(heading: Column, text: Column, has_pic: Column | None = None) -> Column:
    """Tags in the order of the rules, each once; ``procedure`` also where lines are steps."""
    both = F.lower(F.concat_ws("\n", heading, text))
    found = [F.when(both.rlike(pattern), F.lit(name)) for name, pattern in TAG_RULES]
    if has_pic is not None:
        found.append(F.when(has_pic, F.lit("has_pic")))
    found.append(F.when(text.rlike(STEP) | (F.regexp_count(text, F.lit(NUMBERED)) >= 2), F.lit("procedure")))
    return F.array_distinct(F.array_compact(F.array(*found)))


def normalize(text: Column) -> Column:
    """Line ends as \\n, no NUL, blanks collapsed and cut at line ends, three newlines at most."""
    out = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\x00", "")
    out = F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), " +\n", "\n")
    return F.regexp_replace(F.regexp_replace(out, "\n{4,}", "\n\n\n"), r"^\s+|\s+$", "")


def once(value: Column, use) -> Column:
    """``use(value)``, where ``value`` is worked out once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def replaced(text: Column, pattern: str, by: str, *needs: str) -> Column:
    """``regexp_replace`` that reads only texts with one of the strings that each match ``needs``; with none given, all."""
    if not needs:
        return F.regexp_replace(text, pattern, by)
    there = lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(n)) for n in needs])
    return once(text, lambda x: F.when(there(x), F.regexp_replace(x, pattern, by)).otherwise(x))


def strip_markdown(text: Column) -> Column:
    """Fences, table rules, emphasis, code, headings, lists, quotes and escapes without their marks; lines stay."""
    for (pattern, by), needs in zip(MARKDOWN, MARKDOWN_NEEDS, strict=True):
        text = replaced(text, pattern, by, *needs)
    return text


def redact(text: Column, by: str = "") -> Column:
    """Without urls, mail addresses, telephone numbers and words that name contacts."""
    for pattern in CONTACTS:
        text = F.regexp_replace(text, pattern, by)
    return text


def urls(text: Column) -> Column:
    """Distinct urls in order, without punctuation at their ends; those of ``www.`` with https."""
    found = F.regexp_extract_all(text, F.lit(f"({URL})"), 1)
    clean = F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)\]}。，！]+$", ""))
    return F.array_distinct(F.transform(clean, lambda u: F.when(u.startswith("www."), F.concat(F.lit("https://"), u)).otherwise(u)))


def basic_plane(text: Column) -> Column:
    """Without variation selector 16 and characters beyond U+FFFF."""
    return F.regexp_replace(text, r"[\x{FE0F}\x{10000}-\x{10FFFF}]", "")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def stem(term: Column) -> Column:
    """Light stemming: ies to y, then without ing, es and s of longer words."""
    return F.regexp_replace(F.regexp_replace(term, "(..)ies$", "$1y"), "(...)(?:ing|es|s)$", "$1")


def heading_parts(heading: Column) -> Column:
    return F.filter(F.transform(F.split(heading, r"\s*[>/|]\s*"), lambda p: F.trim(p)), lambda p: p != "")


def common_prefix(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def question_key(question: Column) -> Column:
    """Whitespace collapsed, lower case: what questions are compared by."""
    return F.lower(F.trim(F.regexp_replace(question, r"\s+", " ")))


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of the letters and digits in lower case."""
    chars = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", ""), ""), lambda c: c != "")
    after = lambda n: F.slice(chars, n, F.greatest(F.size(chars), F.lit(1)))
    two = F.zip_with(chars, after(2), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.array_compact(F.zip_with(two, after(3), lambda a, b: F.concat(a, b))))


#: Numerals that count requests such as "first three items" may use.
NUMERALS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}


def first_n(question: Column) -> Column:
    """N of "first N" or "前N", null without one."""
    said = F.regexp_extract(F.lower(question), r"(?:first\s+|前\s*)(\d{1,2}|one|two|three|four|five|six|seven|eight|nine|ten|[一二两三四五六七八九十])", 1)
    table = F.create_map(*(F.lit(x) for pair in NUMERALS.items() for x in pair))
    return F.coalesce(said.try_cast("int"), F.try_element_at(table, said))


def safe_name(name: Column) -> Column:
    """A product name without characters that file names can't have, 96 at most."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(name, r"[\\/:*?\"<>|\x00-\x1f]", "_"), r"\s+", " ")), 1, 96)
