"""Reviewed answers, alignment of answers with passages, and routing to products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import SECTIONS, sections, table
from . import retrieval as R

#: Words that questions are not compared by.
QUESTION_STOP = ["a", "an", "and", "are", "can", "do", "does", "for", "how", "i", "if", "in", "is", "it", "my", "of", "on", "please", "the", "this", "to", "what", "when", "where", "which", "with", "you", "your", "proper", "correct", "procedure", "steps", "step", "detail", "detailed"]
COVERAGE, F1, GAP, CLOSE = 0.82, 0.34, 0.08, 4


def exact_answers(questions: DataFrame, reviewed: DataFrame) -> DataFrame:
    """``questions`` (qid, question) with the reviewed answers (case_id, question) of the same key."""
    q = questions.withColumn("key", T.question_key(F.col("question")))
    r = reviewed.select("case_id", T.question_key(F.col("question")).alias("key"))
    return q.join(r, "key").select("qid", "case_id")


def question_tokens(question: Column) -> Column:
    """Distinct words of two characters at least, without stop words."""
    found = F.regexp_extract_all(F.lower(question), F.lit("([a-z0-9_]+)"), 1)
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(QUESTION_STOP)))


def near_keys(token: Column) -> Column:
    """What two tokens of four characters at least share if one edit makes them equal: themselves or all but a character."""
    cut = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, F.length(token))))
    return F.when(F.length(token) >= CLOSE, F.array_distinct(F.concat(F.array(token), cut))).otherwise(F.array(token))


def fuzzy_answers(questions: DataFrame, reviewed: DataFrame) -> DataFrame:
    """The reviewed case that a question means: by shared tokens, equal or an edit apart.

    Candidates come from joins on ``near_keys``, so no two questions are compared that share
    none. Too little coverage, or a second case that is nearly as good, gives no answer.
    """
    tokens = question_tokens(F.col("question")).alias("tokens")
    return fuzzy_by_tokens(questions.select("qid", tokens), reviewed.select("case_id", tokens))


def fuzzy_by_tokens(questions: DataFrame, reviewed: DataFrame) -> DataFrame:
    """``fuzzy_answers`` over ``tokens`` that are made already, of questions (qid) and reviewed cases (case_id)."""
    q, r = questions.filter(F.size("tokens") >= 2), reviewed
    left = q.select("qid", F.size("tokens").alias("nq"), F.explode("tokens").alias("a")).withColumn("key", F.explode(near_keys(F.col("a"))))
    right = r.select("case_id", F.size("tokens").alias("nc"), F.explode("tokens").alias("b")).withColumn("key", F.explode(near_keys(F.col("b"))))
    pairs = left.join(right, "key").select("qid", "case_id", "nq", "nc", "a", "b").distinct()
    close = (F.col("a") == F.col("b")) | ((F.least(F.length("a"), F.length("b")) >= CLOSE) & (F.levenshtein("a", "b", 1) >= 0))
    best = pairs.filter(close).groupBy("qid", "case_id", "nq", "nc", "a").agg(F.min(F.struct(F.col("a") != F.col("b"), "b"))["b"].alias("b"))
    score = best.groupBy("qid", "case_id", "nq", "nc").agg(F.count("*").alias("shared"), F.count_distinct("b").alias("hit"))
    cq, cc = F.col("shared") / F.col("nq"), F.col("hit") / F.col("nc")
    f1 = 2 * cq * cc / (cq + cc)
    good = score.filter((F.col("shared") >= 2) & (cq >= COVERAGE) & (f1 >= F1)).select("qid", "case_id", "shared", F.round(0.7 * cq + 0.3 * f1, 6).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("shared"), "case_id")
    first = good.withColumn("next", F.lead("score").over(w)).withColumn("n", F.row_number().over(w))
    return first.filter((F.col("n") == 1) & (F.col("next").isNull() | (F.round(F.col("score") - F.col("next"), 6) >= GAP))).select("qid", "case_id", "score")


def cache_stats(reviewed: DataFrame) -> DataFrame:
    """Entries, distinct questions, and questions with several answers of a cache (question, answer)."""
    keys = reviewed.groupBy(T.question_key(F.col("question")).alias("key")).agg(F.count("*").alias("n"), F.count_distinct("answer").alias("answers"))
    return keys.agg(F.sum("n").alias("entries"), F.count("*").alias("questions"), F.sum(F.when(F.col("answers") > 1, 1).otherwise(0)).alias("ambiguous"))


def overlap_scores(pairs: DataFrame) -> DataFrame:
    """Alignment scores of pairs (block, passage, with the columns ``block_text`` and ``passage_text``).

    ``strong`` by containment of either in the other, from eight letters on, or by enough shared trigrams and words.
    """
    g = lambda c: T.trigrams(F.col(c))
    t = lambda c: F.array_distinct(F.filter(T.words(F.col(c)), lambda w: F.length(w) >= 2))
    rows = pairs.select("*", g("block_text").alias("bg"), g("passage_text").alias("pg"), t("block_text").alias("bt"), t("passage_text").alias("pt"))
    shared = F.size(F.array_intersect("bg", "pg"))
    rows = rows.withColumn("shared", shared)
    share = lambda n, d: n / F.greatest(F.size(d), F.lit(1))
    recall, precision, tokens = share(F.col("shared"), "bg"), share(F.col("shared"), "pg"), share(F.size(F.array_intersect("bt", "pt")), "bt")
    flat = lambda c: F.regexp_replace(F.lower(F.col(c)), r"[^\p{L}\p{N}]+", "")
    short = F.least(F.length(flat("block_text")), F.length(flat("passage_text")))
    exact = (short >= 8) & (F.contains(flat("passage_text"), flat("block_text")) | F.contains(flat("block_text"), flat("passage_text")))
    base = 0.55 * recall + 0.25 * tokens + 0.20 * F.sqrt(recall * precision)
    score = F.round(F.when(exact, F.greatest(base, F.lit(0.96))).otherwise(base), 6)
    strong = exact | ((F.col("shared") >= 3) & (score >= 0.14) & ((recall >= 0.16) | (tokens >= 0.25)))
    cite = F.round(0.58 * recall + 0.22 * tokens + 0.20 * F.sqrt(recall * precision), 6)
    return rows.select("block", "passage", score.alias("score"), strong.alias("strong"), cite.alias("cite"))


def cited(scores: DataFrame) -> DataFrame:
    """Blocks that a passage is cited for: those near the passage's best."""
    best = F.max("cite").over(Window.partitionBy("passage"))
    return scores.withColumn("best", best).filter(F.col("cite") >= F.greatest(F.lit(0.11), 0.48 * F.col("best"))).drop("best")


def unique_phrases(headings: DataFrame) -> DataFrame:
    """For each product (product, heading) the longest, the middle and the shortest phrase of 5 to 26 characters that no other has."""
    key = F.lower(F.trim(F.regexp_replace("heading", r"\s+", " ")))
    rows = headings.select("product", key.alias("phrase")).filter(F.length("phrase").between(5, 26))
    own = rows.groupBy("phrase").agg(F.count_distinct("product").alias("n"), F.min("product").alias("product")).filter("n = 1")
    w = Window.partitionBy("product").orderBy(F.desc(F.length("phrase")), "phrase")
    ranked = own.withColumn("k", F.row_number().over(w)).withColumn("m", F.count("*").over(Window.partitionBy("product")))
    return ranked.filter((F.col("k") == 1) | (F.col("k") == F.expr("m div 2 + 1")) | (F.col("k") == F.col("m"))).select("product", "phrase", "k", "m")


def word_ngrams(words: Column, low: int, high: int) -> Column:
    """Distinct runs of ``low`` to ``high`` words; longer runs are zipped from shorter ones, so each is made once."""
    runs, out = words, []
    for n in range(1, high + 1):
        if n > 1:
            runs = F.zip_with(runs, F.slice(words, n, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        if n >= low:
            out.append(F.array_compact(runs))
    return F.array_distinct(F.concat(*out))


def phrase_route(questions: DataFrame, texts: DataFrame, least: int = 20, lead: float = 3.0) -> DataFrame:
    """The product whose texts alone have a question's phrases, where their weight is enough and well ahead.

    Only phrases that a question has are kept, before the texts' phrases are shuffled.
    """
    grams = word_ngrams(T.words(F.coalesce("text", F.lit(""))), 2, 4)
    asked = questions.select("qid", F.explode(grams).alias("phrase"))
    there = texts.select("product", F.explode(grams).alias("phrase")).join(asked.select("phrase").distinct(), "phrase", "left_semi")
    owner = there.groupBy("phrase").agg(F.count_distinct("product").alias("n"), F.min("product").alias("product")).filter("n = 1")
    weight = F.sum(2 * F.size(F.split("phrase", " ")) + 1)
    votes = asked.join(owner, "phrase").groupBy("qid", "product").agg(weight.alias("weight"))
    w = Window.partitionBy("qid").orderBy(F.desc("weight"), "product")
    best = votes.withColumn("second", F.coalesce(F.lead("weight").over(w), F.lit(0))).withColumn("k", F.row_number().over(w))
    return best.filter((F.col("k") == 1) & (F.col("weight") >= least) & (F.col("weight") >= lead * F.col("second"))).select("qid", "product", "weight")


def content_vote(ranked: DataFrame, most: int = 18, n: int = 3) -> DataFrame:
    """Products by the votes of ranked hits (qid, product, section, rank), one vote a section, over the first sections."""
    first = ranked.groupBy("qid", "product", "section").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("qid").orderBy("rank", "product", "section")
    votes = first.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most)
    total = votes.groupBy("qid", "product").agg(F.round(F.sum(1.0 / F.col("rank")), 8).alias("vote"))
    return R.top(total, n, score="vote", tie="product")


#: Characters of texts without blanks between words.
CJK = r"[\u3400-\u9fff]"


#: Aliases that go to every task in one pass over the questions, and first words of aliases that runs of words are looked for by.
MOST_ALIASES, MOST_FIRST = 1 << 20, 4096


def alias_route(questions: DataFrame, aliases: DataFrame, most: int = MOST_ALIASES) -> DataFrame:
    """The product of the longest alias (alias, product) that stands as words in a question, or with Chinese characters anywhere in it.

    Questions become runs of as many words as aliases have, and runs of characters of the lengths that
    Chinese aliases have, so the match is a join. Aliases go to the tasks, ``most`` at a time, so runs are never shuffled.
    """
    a = aliases.select(F.array_join(T.words(F.col("alias")), " ").alias("phrase"), "product").filter("phrase <> ''")
    a = a.groupBy("phrase").agg(F.max("product").alias("product")).withColumn("cjk", F.col("phrase").rlike(CJK))
    counts = sorted(r[0] for r in a.select(F.size(F.split("phrase", " "))).distinct().collect())
    sizes = sorted(r[0] for r in a.filter("cjk").select(F.length("phrase")).distinct().collect())
    first = [r[0] for r in a.select(F.substring_index("phrase", " ", 1)).distinct().limit(MOST_FIRST + 1).collect()]
    begins = lambda w: w.isin(first) if len(first) <= MOST_FIRST else F.lit(True)
    said = questions.select("qid", T.words(F.coalesce("text", F.lit(""))).alias("said"))
    said = said.withColumn("at", F.array_compact(F.transform("said", lambda w, i: F.when(begins(w), i + 1))))
    run = lambda n: F.array_compact(F.transform("at", lambda i: F.when(i + n - 1 <= F.size("said"), F.array_join(F.slice("said", i, F.lit(n)), " "))))
    runs = said.select("qid", F.explode(F.concat(F.array().cast("array<string>"), *map(run, counts))).alias("phrase"))
    if sizes:
        flat = said.select("qid", F.array_join("said", " ").alias("flat")).filter(F.col("flat").rlike(CJK))
        # what is farther from Chinese characters than an alias is long can't be inside one; a line break stands for it
        far, k = CJK.replace("[", "[^"), max(sizes[-1] - 1, 1)
        chars = F.split(F.regexp_replace("flat", f"({far}{{{k}}}){far}*({far}{{{k}}})", "$1\n$2"), "")
        cut = lambda n: F.transform("chars", lambda _, i: F.array_join(F.slice("chars", i + 1, F.lit(n)), ""))
        near = flat.select("qid", F.filter(chars, lambda c: c != "").alias("chars"))
        places = near.select("qid", F.explode(F.array_distinct(F.filter(F.concat(*map(cut, sizes)), lambda x: x.rlike(CJK)))).alias("phrase"))
        runs = runs.unionByName(places)
    passes = max(1, -(-a.count() // most))
    found = None
    for i in range(passes):
        part = runs.join(F.broadcast(a.filter(F.pmod(F.xxhash64("phrase"), F.lit(passes)) == i)), "phrase").select("qid", "phrase", "product")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("qid").agg(F.max_by("product", F.struct(F.length("phrase"), "product")).alias("product"), F.max(F.length("phrase")).alias("size"))


def best_product(scored: DataFrame, n: int = 3) -> DataFrame:
    """The best score of each product (qid, product, score, title coverage and whether the title is in the question), the best n."""
    total = F.col("score") + 30 * F.col("title_coverage") + F.when(F.col("title_in"), 10).otherwise(0)
    return R.top(scored.groupBy("qid", "product").agg(F.round(F.max(total), 6).alias("score")), n, tie="product")


def _ask(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _reviewed(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("case_id"), F.explode(F.split("text", "\n")).alias("question"))


def _typos(s, d):
    """Questions with the last word and one character of the first lost."""
    text = F.regexp_replace(F.regexp_replace("text", r"^(..).", "$1"), r"\s+\S+$", "")
    return table(s, d, "benchmark").select(F.col("item_id").alias("qid"), text.alias("question"))


def _pairs(s, d):
    """Questions with the sections of their five best documents."""
    best = R.bm25_top(s, d, 5).select("qid", "doc_id")
    rows = best.join(sections(s, d), "doc_id").join(_ask(s, d).withColumnRenamed("text", "block_text"), "qid")
    return rows.select(F.col("qid").alias("block"), F.concat_ws("/", "doc_id", "section_id").alias("passage"), "block_text", F.col("text").alias("passage_text"))


def _product_candidates(s, d):
    head = R.heading_recall(R._headings(s, d), R._ask(s, d)).select("qid", "doc_id", F.col("coverage").alias("title_coverage"), (F.col("score") >= 0.45).alias("title_in"))
    rows = R.bm25_top(s, d).join(head, ["qid", "doc_id"], "left").join(table(s, d, "documents").select("doc_id", F.col("source").alias("product")), "doc_id")
    return best_product(rows.select("qid", "product", "score", F.coalesce("title_coverage", F.lit(0.0)).alias("title_coverage"), F.coalesce("title_in", F.lit(False)).alias("title_in")))


def _named(s, d):
    """Documents whose text goes on with a part's whole name or, without blanks, with a Chinese alias."""
    part = table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit(" about the "), "p_name").alias("name"))
    chinese = F.when(F.col("doc_id") % 9 == 0, " 我的吸尘器坏了").otherwise("")
    rows = table(s, d, "documents").select("doc_id", "text").join(part, "doc_id", "left")
    return rows.select(F.col("doc_id").alias("qid"), F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 4 == 0, F.coalesce("name", F.lit(""))).otherwise(""), chinese).alias("text"))


def _whole_aliases(s, d):
    part = table(s, d, "part").select(F.col("p_name").alias("alias"), F.col("p_brand").alias("product"))
    six = table(s, d, "benchmark").select(F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("alias"), F.concat(F.lit("b"), "item_id").alias("product"))
    chinese = s.createDataFrame([("吸尘器", "vacuum"), ("尘", "dust")], "alias string, product string")
    return part.unionByName(six).unionByName(chinese)


_STOP = "[" + ", ".join(f"'{w}'" for w in QUESTION_STOP) + "]"
_TOK = f"list_distinct(list_filter(regexp_extract_all(lower({{}}), '[a-z0-9_]+'), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t)))"
_G = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_TRI = "CASE WHEN length({0}) >= 3 THEN list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3))) ELSE [] END"
_NG = "list_distinct(flatten(list_transform(range({lo}, {hi} + 1), lambda n: CASE WHEN len(w) >= n THEN list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')) ELSE CAST([] AS VARCHAR[]) END)))"
ALIGN = f"""{R.STATS}, {R.A}, {SECTIONS}, p AS (
  SELECT qid AS block, s.doc_id || '/' || section_id AS passage, {_G.format("b.text")} AS bf, {_G.format("s.text")} AS pf, list_distinct(list_filter({R._W.format("b.text")}, lambda w: length(w) >= 2)) AS bt, list_distinct(list_filter({R._W.format("s.text")}, lambda w: length(w) >= 2)) AS pt
  FROM a JOIN sections s USING (doc_id) JOIN benchmark b ON item_id = qid WHERE rank <= 5
), g AS (SELECT *, {_TRI.format("bf")} AS bg, {_TRI.format("pf")} AS pg FROM p), r AS (
  SELECT *, len(list_intersect(bg, pg)) AS shared, len(list_intersect(bg, pg)) / greatest(len(bg), 1) AS recall, len(list_intersect(bg, pg)) / greatest(len(pg), 1) AS prec, len(list_intersect(bt, pt)) / greatest(len(bt), 1) AS tokens, least(length(bf), length(pf)) >= 8 AND (contains(pf, bf) OR contains(bf, pf)) AS exact FROM g
), sc AS (
  SELECT *, round(CASE WHEN exact THEN greatest(0.55 * recall + 0.25 * tokens + 0.2 * sqrt(recall * prec), 0.96) ELSE 0.55 * recall + 0.25 * tokens + 0.2 * sqrt(recall * prec) END, 6) AS score, round(0.58 * recall + 0.22 * tokens + 0.2 * sqrt(recall * prec), 6) AS cite FROM r
), scores AS (SELECT block, passage, score, exact OR (shared >= 3 AND score >= 0.14 AND (recall >= 0.16 OR tokens >= 0.25)) AS strong, cite FROM sc)"""

QUERIES = {
    "reviewed_exact": (
        lambda s, d: exact_answers(sections(s, d).select(F.concat_ws("/", "doc_id", "section_id").alias("qid"), F.col("text").alias("question")), _reviewed(s, d)),
        rf"""WITH {SECTIONS}, r AS (SELECT item_id AS case_id, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g'))) AS key FROM benchmark)
        SELECT doc_id || '/' || section_id AS qid, case_id FROM sections JOIN r ON lower(trim(regexp_replace(sections.text, '\s+', ' ', 'g'))) = key""",
    ),
    "reviewed_fuzzy": (
        lambda s, d: fuzzy_answers(_typos(s, d), table(s, d, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("question"))),
        rf"""WITH q AS (SELECT item_id AS qid, {_TOK.format(r"regexp_replace(regexp_replace(text, '^(..).', '\1'), '\s+\S+$', '')")} AS ts FROM benchmark), r AS (SELECT item_id AS case_id, {_TOK.format("text")} AS ts FROM benchmark),
        l AS (SELECT qid, len(ts) AS nq, unnest(ts) AS a FROM q WHERE len(ts) >= 2), c AS (SELECT case_id, len(ts) AS nc, unnest(ts) AS b FROM r), m AS (
          SELECT qid, case_id, nq, nc, a, min_by(b, (a <> b, b)) AS b FROM l, c WHERE a = b OR (least(length(a), length(b)) >= 4 AND abs(length(a) - length(b)) <= 1 AND levenshtein(a, b) <= 1) GROUP BY qid, case_id, nq, nc, a
        ), g AS (SELECT qid, case_id, count(*) AS shared, count(*) / nq AS cq, count(DISTINCT b) / nc AS cc FROM m GROUP BY qid, case_id, nq, nc), k AS (
          SELECT qid, case_id, shared, round(0.7 * cq + 0.3 * (2 * cq * cc / (cq + cc)), 6) AS score FROM g WHERE shared >= 2 AND cq >= 0.82 AND 2 * cq * cc / (cq + cc) >= 0.34
        ), o AS (SELECT *, lead(score) OVER w AS nxt, row_number() OVER w AS n FROM k WINDOW w AS (PARTITION BY qid ORDER BY score DESC, shared DESC, case_id))
        SELECT qid, case_id, score FROM o WHERE n = 1 AND (nxt IS NULL OR round(score - nxt, 6) >= 0.08)""",
    ),
    "cache_stats": (
        lambda s, d: cache_stats(sections(s, d).select(F.col("text").alias("question"), F.col("doc_id").alias("answer"))),
        rf"WITH {SECTIONS}, k AS (SELECT lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS key, count(*) AS n, count(DISTINCT doc_id) AS m FROM sections GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS entries, count(*) AS questions, count(*) FILTER (m > 1) AS ambiguous FROM k",
    ),
    "align_blocks": (lambda s, d: overlap_scores(_pairs(s, d)), f"WITH {ALIGN} SELECT * FROM scores"),
    "cite_blocks": (lambda s, d: cited(overlap_scores(_pairs(s, d))), f"WITH {ALIGN}, b AS (SELECT *, max(cite) OVER (PARTITION BY passage) AS best FROM scores) SELECT * EXCLUDE (best) FROM b WHERE cite >= greatest(0.11, 0.48 * best)"),
    "unique_phrases": (
        lambda s, d: unique_phrases(sections(s, d).select("product", "heading")),
        rf"""WITH {SECTIONS}, r AS (SELECT product, lower(trim(regexp_replace(heading, '\s+', ' ', 'g'))) AS phrase FROM sections), o AS (SELECT phrase, min(product) AS product FROM r WHERE length(phrase) BETWEEN 5 AND 26 GROUP BY phrase HAVING count(DISTINCT product) = 1),
        k AS (SELECT product, phrase, row_number() OVER (PARTITION BY product ORDER BY length(phrase) DESC, phrase) AS k, count(*) OVER (PARTITION BY product) AS m FROM o) SELECT product, phrase, k, m FROM k WHERE k = 1 OR k = m // 2 + 1 OR k = m""",
    ),
    "phrase_route": (
        lambda s, d: phrase_route(_ask(s, d), table(s, d, "documents").select(F.col("source").alias("product"), "text"), 20, 3.0),
        f"""WITH a AS (SELECT item_id AS qid, {R._W.format("text")} AS w FROM benchmark), q AS (SELECT qid, unnest({_NG.format(lo=2, hi=4)}) AS phrase FROM a), dd AS (SELECT source AS product, {R._W.format("text")} AS w FROM documents),
        t AS (SELECT product, unnest({_NG.format(lo=2, hi=4)}) AS phrase FROM dd), o AS (SELECT phrase, min(product) AS product FROM t GROUP BY phrase HAVING count(DISTINCT product) = 1),
        v AS (SELECT qid, product, CAST(sum(2 * len(string_split(phrase, ' ')) + 1) AS BIGINT) AS weight FROM q JOIN o USING (phrase) GROUP BY ALL), b AS (SELECT *, coalesce(lead(weight) OVER w, 0) AS second, row_number() OVER w AS k FROM v WINDOW w AS (PARTITION BY qid ORDER BY weight DESC, product))
        SELECT qid, product, weight FROM b WHERE k = 1 AND weight >= 20 AND weight >= 3 * second""",
    ),
    "content_vote": (
        lambda s, d: content_vote(R.bm25_top(s, d).join(table(s, d, "documents").select("doc_id", F.col("source").alias("product")), "doc_id").select("qid", "product", F.col("doc_id").alias("section"), "rank")),
        f"""WITH {R.STATS}, {R.A}, f AS (SELECT qid, source AS product, doc_id AS section, rank FROM a JOIN documents USING (doc_id)), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, product, section) AS k FROM f),
        v AS (SELECT qid, product, round(sum(1.0 / rank), 8) AS vote FROM k WHERE k <= 18 GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY vote DESC, product) AS rank FROM v) WHERE rank <= 3""",
    ),
    "alias_route_whole": (
        lambda s, d: alias_route(_named(s, d), _whole_aliases(s, d)),
        f"""WITH al AS (SELECT array_to_string({R._W.format("alias")}, ' ') AS phrase, max(product) AS product FROM (SELECT p_name AS alias, p_brand AS product FROM part UNION ALL SELECT array_to_string(string_split(text, ' ')[1:6], ' '), 'b' || item_id FROM benchmark UNION ALL VALUES ('吸尘器', 'vacuum'), ('尘', 'dust')) GROUP BY 1),
        q AS (SELECT doc_id AS qid, array_to_string({R._W.format("t")}, ' ') AS flat FROM (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 4 = 0 THEN coalesce(' about the ' || p_name, '') ELSE '' END || CASE WHEN doc_id % 9 = 0 THEN ' 我的吸尘器坏了' ELSE '' END AS t FROM documents LEFT JOIN part ON p_partkey = doc_id))
        SELECT qid, max_by(product, (length(phrase), product)) AS product, CAST(max(length(phrase)) AS INT) AS size FROM q JOIN al ON contains(' ' || flat || ' ', ' ' || phrase || ' ') OR (regexp_matches(phrase, '[\u4e00-\u9fff]') AND contains(flat, phrase)) WHERE phrase <> '' GROUP BY qid""",
    ),
    "product_candidates": (
        _product_candidates,
        f"""WITH {R.STATS}, {R.A}, {R.HEAD}, s AS (SELECT a.qid, source AS product, a.score + 30 * coalesce(coverage, 0) + CASE WHEN coalesce(h.score >= 0.45, false) THEN 10 ELSE 0 END AS t FROM a LEFT JOIN heads h USING (qid, doc_id) JOIN documents USING (doc_id)),
        g AS (SELECT qid, product, round(max(t), 6) AS score FROM s GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, product) AS rank FROM g) WHERE rank <= 3""",
    ),
}
