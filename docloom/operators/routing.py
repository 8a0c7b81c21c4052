"""Routing of questions to products: names in the text, a cascade of matchers, clauses, and fusion with content.

All names of a catalogue are looked for in one pass over the texts, by an automaton that goes to
every task; a catalogue beyond ``MOST_BYTES`` goes in as many passes as it takes, by hashes
of the terms, with the same result.

Nulls and ties: a null question is an empty one and has no route. Questions of equal id are one.
Products of equal rank go by ``place``, their order in the catalogue, then by name. Null and empty
terms match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructType

from ..functions import text as T
from ..sources.tables import SECTIONS, sections, table
from . import retrieval as R

#: Bytes of terms that one pass over the texts looks for; their automaton takes some 27 times as much in each task.
MOST_BYTES = 8 << 20

#: Aliases that are too common to lock a product alone, and parts that never name one.
GENERIC = ["phone", "printer", "camera", "tv", "boat"]
WEAK = ["滤网", "耳机", "耳塞", "烤架", "遥控器", "充电器"]
#: A display name doesn't count where the first pattern is found and the second isn't.
EXCLUSIONS = [
    ("Camera", r"\b(?:hybrid\s+)?instant\s+camera\b|\bcamera\s+manual\b", None),
    ("Phone", r"\b(my|cell|smart|mobile)\s*phone|smartphone", r"landline|cordless|handset|base station"),
]
#: What parts a question's clauses.
CLAUSES = r"[；;。！？!?]+|[，,]\s*(?:并且?|以及|同时|另外|然后)|并且|以及|同时|另外|然后|(?<!合)并(?![行列])"
#: Characters of texts without blanks.
IDEOGRAPHS = r"㐀-䶿一-鿿豈-﫿"

KINDS = ["display", "functional", "nickname", "alias"]


def name_hits(questions: DataFrame, terms: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Where ``terms`` (term, kind, product, place) stand in ``questions`` (qid, text), whatever the case.

    One row for each term that is found: ``qid``, the term's columns, ``size``, ``at``, its first
    character from 0, and ``word_at``, that of its first place between characters other than a-z and 0-9.
    """
    known = terms.select(F.lower(F.trim("term")).alias("term"), "kind", "product", F.col("place").cast("long").alias("place")).filter("term <> ''").distinct()
    total = known.agg(F.sum(F.octet_length("term") + F.coalesce(F.octet_length("product"), F.lit(0)) + 32)).first()[0] or 0
    passes = max(1, -(-total // most_bytes))
    rows = questions.select("qid", F.coalesce("text", F.lit("")).alias("text"))
    schema = StructType([rows.schema["qid"]])
    for name, kind in (("kind", StringType()), ("product", known.schema["product"].dataType), ("place", LongType()), ("term", StringType()), ("size", LongType()), ("at", LongType()), ("word_at", LongType())):
        schema = schema.add(name, kind)

    pa_fields = list(to_arrow_schema(schema))[1:]

    def one_pass(i: int) -> DataFrame:
        owners: dict[str, list] = {}
        for r in known.filter(F.pmod(F.xxhash64("term"), F.lit(passes)) == i).collect():
            owners.setdefault(r.term, []).append((r.kind, r.product, r.place))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for term in owners:
                machine.add_word(term, term)
            machine.make_automaton()
            for batch in batches:
                found = []
                for row, text in enumerate(batch.column("text").to_pylist()):
                    for term, (at, word_at) in first_places(machine, text.lower()).items() if owners else ():
                        found += [(row, *owner, term, len(term), at, word_at) for owner in owners[term]]
                columns = list(zip(*found, strict=True)) or [[] for _ in range(8)]
                own = [pa.array(list(c), f.type) for c, f in zip(columns[1:], pa_fields, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("qid").take(pa.array(list(columns[0]), pa.int64())), *own], names=schema.names)

        return rows.mapInArrow(run, schema)

    out = one_pass(0)
    for i in range(1, passes):
        out = out.unionByName(one_pass(i))
    return out


def first_places(machine: ahocorasick.Automaton, text: str) -> dict[str, tuple[int, int | None]]:
    """Each term's first place, and its first between characters other than a-z and 0-9."""
    out: dict[str, tuple[int, int | None]] = {}
    inner = lambda c: c.isascii() and c.isalnum()
    for end, term in machine.iter(text):
        at = end - len(term) + 1
        first, word_at = out.get(term, (at, None))
        if word_at is None and not (at and inner(text[at - 1])) and not (end + 1 < len(text) and inner(text[end + 1])):
            word_at = at
        out[term] = (first, word_at)
    return out


def named_product(questions: DataFrame, names: DataFrame) -> DataFrame:
    """The product of the catalogue's ``names`` (name) that a question has anywhere, and whether it has several.

    A name inside another name that is found doesn't count; which names are inside which is
    looked up by the same automaton over the names.
    """
    terms = names.select(F.col("name").alias("term"), F.lit("name").alias("kind"), F.col("name").alias("product"), F.lit(0).alias("place"))
    hits = name_hits(questions, terms).select("qid", "product").distinct()
    inside = name_hits(names.select(F.col("name").alias("qid"), F.col("name").alias("text")).distinct(), terms)
    inside = inside.filter((F.col("qid") != F.col("product")) & F.contains("qid", "product")).select(F.col("qid").alias("product"), F.col("product").alias("inner")).distinct()
    covered = hits.join(inside, "product").select("qid", F.col("inner").alias("product")).distinct()
    found = hits.join(covered, ["qid", "product"], "left_anti").groupBy("qid").agg(F.count("*").alias("n"), F.min("product").alias("one"))
    out = questions.select("qid").distinct().join(found, "qid", "left")
    return out.select("qid", F.when(F.col("n") == 1, F.col("one")).alias("product"), (F.coalesce("n", F.lit(0)) > 1).alias("ambiguous"))


def catalogue_terms(products: DataFrame, functional: DataFrame, nicknames: DataFrame, aliases: DataFrame, suffix: str = "手册") -> DataFrame:
    """The terms of a catalogue: ``products`` (product, place), and (product, alias, place) of each other kind.

    A display name is the product's, also without ``suffix`` and, of several words, written as one. Display
    names are aliases, too.
    """
    short = F.when(F.endswith("product", F.lit(suffix)), F.substring("product", F.lit(1), F.length("product") - len(suffix)))
    spellings = F.array_distinct(F.array_compact(F.array(F.col("product"), short)))
    joined = F.transform(F.filter(spellings, lambda s: F.contains(F.trim(s), F.lit(" ")) & ~s.rlike(f"[{IDEOGRAPHS}]")), lambda s: F.replace(s, F.lit(" "), F.lit("")))
    own = products.select("product", "place", F.explode(F.concat(spellings, joined)).alias("term"))
    out = own.select("term", F.lit("display").alias("kind"), "product", "place")
    out = out.unionByName(products.select(F.explode(spellings).alias("term"), F.lit("alias").alias("kind"), "product", "place"))
    for rows, kind in ((functional, "functional"), (nicknames, "nickname"), (aliases, "alias")):
        out = out.unionByName(rows.select(F.col("alias").alias("term"), F.lit(kind).alias("kind"), "product", "place"))
    return out


def name_evidence(questions: DataFrame, terms: DataFrame, exclusions: list = EXCLUSIONS, weak: list = WEAK) -> DataFrame:
    """For each question the products of each matcher, best first: ``display``, ``functional``, ``nickname``, ``alias``.

    ``display`` and ``nickname`` go by the longest name, ``functional`` by its place, ``alias`` by whole
    product names, then the longest. ``matched`` is the longest alias of the first alias' product, and
    ``literal`` the display products in the order of the text.
    """
    hits = name_hits(questions, terms)
    cjk = F.col("term").rlike(f"[{IDEOGRAPHS}]")
    counts = F.when(F.col("kind") == "display", cjk | F.col("word_at").isNotNull()).when(F.col("kind") == "nickname", F.col("word_at").isNotNull()).otherwise(True)
    hits = hits.filter(counts)
    if exclusions:
        text = F.lower(F.coalesce("text", F.lit("")))
        barred = [F.when(text.rlike(when) & (~text.rlike(unless) if unless else F.lit(True)), F.lit(product)) for product, when, unless in exclusions]
        out_of = questions.select("qid", F.explode(F.array_compact(F.array(*barred))).alias("product"), F.lit("display").alias("kind")).distinct()
        hits = hits.join(out_of, ["qid", "product", "kind"], "left_anti")
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    strong = ~F.col("term").isin(weak) if weak else F.lit(True)
    per = hits.groupBy("qid", "product").agg(
        F.max(of("display", F.col("size"))).alias("d"),
        F.min(of("display", F.col("at"))).alias("d_at"),
        F.min(of("functional", F.col("place"))).alias("f"),
        F.max(of("nickname", F.col("size"))).alias("n"),
        F.max(of("alias", F.when(strong, F.struct("size", "term")))).alias("a"),
        F.max(of("alias", F.struct("size", "term"))).alias("any"),
        F.min(F.when(F.col("kind") != "functional", F.col("place"))).alias("place"),
    )
    best = lambda when, *keys: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(*keys, "place", "product")))), lambda x: x["product"])
    whole = F.col("a.term") != F.lower("product")
    return per.groupBy("qid").agg(
        best(F.col("d").isNotNull(), -F.col("d")).alias("display"),
        best(F.col("f").isNotNull(), F.col("f")).alias("functional"),
        best(F.col("n").isNotNull(), -F.col("n")).alias("nickname"),
        best(F.col("a").isNotNull(), whole.alias("whole"), (-F.col("a.size")).alias("size")).alias("alias"),
        F.min(F.when(F.col("a").isNotNull(), F.struct(whole.alias("whole"), (-F.col("a.size")).alias("size"), "place", "product", F.col("any.term").alias("term"))))["term"].alias("matched"),
        best(F.col("d").isNotNull(), F.col("d_at")).alias("literal"),
    )


def _route(products: Column, confidence: str, reason: str) -> Column:
    return F.struct(products.alias("products"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))


def _first(name: str) -> Column:
    return F.get(name, F.lit(0))


def _named_route() -> Column:
    """The first matcher that hits, without the aliases: they are weighed against content."""
    alone = lambda name: F.slice(F.col(name), 1, 1)
    other = _first("functional").isNotNull() & (_first("functional") != _first("display"))
    return (
        F.when(_first("display").isNotNull() & other, _route(F.array(_first("display"), _first("functional")), "medium", "display_vs_functional_divergence"))
        .when(_first("display").isNotNull(), _route(alone("display"), "high", "explicit_product_name"))
        .when(_first("functional").isNotNull(), _route(alone("functional"), "medium", "functional_alias"))
        .when(_first("nickname").isNotNull(), _route(alone("nickname"), "high", "explicit_product_nickname"))
    )


def name_route(questions: DataFrame, terms: DataFrame, n: int = 3, **how) -> DataFrame:
    """The route of each question by names alone: display name, functional alias, nickname, alias in this order.

    A functional alias of another product than the display name's leaves both. Questions that
    name none have confidence ``none``.
    """
    found = questions.select("qid").distinct().join(name_evidence(questions, terms, **how), "qid", "left")
    aliases = F.when(_first("alias").isNotNull(), _route(F.slice("alias", 1, n), "high", "alias_or_name_match"))
    none = _route(F.array().cast("array<string>"), "none", "no_name")
    return found.select("qid", F.coalesce(_named_route(), aliases, none).alias("r")).select("qid", "r.*")


def weighted_vote(ranked: DataFrame, most: int = 18, n: int = 3) -> DataFrame:
    """Products by the votes of ranked hits (qid, product, section, rank up to 30): 4 for the first, 3, 2 and 1 further down.

    A section votes once, at its best rank, and the first ``most`` sections vote. Ties go to the product that was hit first.
    """
    first = ranked.filter("rank <= 30").groupBy("qid", "product", "section").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("qid").orderBy("rank", "product", "section")
    votes = first.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most)
    weight = F.when(F.col("rank") == 1, 4).when(F.col("rank") <= 3, 3).when(F.col("rank") <= 8, 2).otherwise(1)
    total = votes.groupBy("qid", "product").agg(F.sum(weight).alias("votes"), F.min("rank").alias("first"))
    best = Window.partitionBy("qid").orderBy(F.desc("votes"), "first", "product")
    return total.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n).select("qid", "product", "votes", "place")


def ideograph_grams(text: Column, low: int = 4, high: int = 6) -> Column:
    """Distinct runs of ``low`` to ``high`` ideographs."""
    spans = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"([{IDEOGRAPHS}]{{{low},}})"), 1)
    cut = lambda s, n: F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.concat(*(cut(s, n) for n in range(low, high + 1))))))


def ideograph_route(questions: DataFrame, texts: DataFrame, least: int = 4, lead: int = 3) -> DataFrame:
    """The product whose texts alone have runs of ideographs of a question, where they weigh enough and well ahead of the next."""
    asked = questions.select("qid", F.explode(ideograph_grams(F.col("text"))).alias("phrase")).distinct()
    there = texts.select("product", F.explode(ideograph_grams(F.col("text"))).alias("phrase")).join(asked.select("phrase").distinct(), "phrase", "left_semi")
    own = there.groupBy("phrase").agg(F.count_distinct("product").alias("n"), F.min("product").alias("product")).filter("n = 1")
    votes = asked.join(own, "phrase").groupBy("qid", "product").agg(F.sum(F.length("phrase")).alias("weight"))
    order = Window.partitionBy("qid").orderBy(F.desc("weight"), "product")
    best = votes.withColumn("second", F.coalesce(F.lead("weight").over(order), F.lit(0))).withColumn("k", F.row_number().over(order))
    return best.filter((F.col("k") == 1) & (F.col("weight") >= least) & (F.col("weight") >= lead * F.greatest("second", F.lit(1)))).select("qid", "product", "weight")


def alias_documents(products: DataFrame, aliases: DataFrame) -> DataFrame:
    """What the last resort searches: for each product its name, then name and aliases twice."""
    every = products.select("product", F.col("product").alias("alias")).unionByName(aliases.select("product", "alias")).groupBy("product").agg(F.array_join(F.array_sort(F.collect_set("alias")), " ").alias("names"))
    return every.select("product", F.concat_ws("\n", "product", "names", "names").alias("text"))


def last_resort(questions: DataFrame, alias_docs: DataFrame, n: int = 3) -> DataFrame:
    """``products``, ``confidence`` and ``reason`` by BM25 over the names, for questions that nothing else routes.

    A product needs two shared words, or one of three characters. Its score is BM25 and 0.35 for each
    shared word; how far the best three are apart decides.
    """
    words = lambda rows, key: rows.select(key, F.explode(F.array_distinct(T.words(F.coalesce("text", F.lit(""))))).alias("token"))
    shared = words(questions, "qid").join(words(alias_docs, "product"), "token").groupBy("qid", "product").agg(F.count("*").alias("shared"), F.max(F.length("token")).alias("longest"))
    scores = R.bm25(alias_docs.withColumnRenamed("product", "doc_id"), questions).withColumnRenamed("doc_id", "product")
    rows = shared.filter("shared >= 2 OR longest >= 3").join(scores, ["qid", "product"], "left")
    rows = rows.select("qid", "product", F.round(F.coalesce("score", F.lit(0.0)) + 0.35 * F.col("shared"), 6).alias("score")).filter("score > 0")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "product")
    ranked = rows.withColumn("k", F.row_number().over(order)).withColumn("top", F.max("score").over(Window.partitionBy("qid")))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("score")))
    near = F.transform(F.array_sort(F.collect_list(F.when((F.col("k") <= n) & (F.col("score") >= F.greatest(F.lit(1.0), F.round(0.7 * F.col("top"), 6))), F.struct("k", "product")))), lambda x: x["product"])
    per = ranked.groupBy("qid").agg(at(1).alias("one"), at(2).alias("two"), F.min(F.when(F.col("k") <= 3, F.col("score"))).alias("third"), F.min_by("product", "k").alias("best"), near.alias("near"))
    empty = F.array().cast("array<string>")
    some = questions.groupBy("qid").agg(F.max(F.size(T.words(F.coalesce("text", F.lit(""))))).alias("n_words")).join(per, "qid", "left")
    close = F.col("two").isNotNull() & (F.round(F.col("one") - F.col("third"), 6) < 1.5)
    route = (
        F.when(F.col("n_words") == 0, _route(empty, "none", "no_query_tokens"))
        .when(F.col("one").isNull(), _route(empty, "none", "no_positive_score"))
        .when(close & (F.col("one") < 5), _route(empty, "none", "ambiguous_top3_low_score"))
        .when((F.col("one") >= 3) & (F.round(F.col("one") - F.coalesce("two", F.lit(0.0)), 6) >= 1), _route(F.array("best"), "high", "bm25_router"))
        .when(F.col("one") >= 1.5, _route(F.col("near"), "medium", "bm25_router"))
        .otherwise(_route(empty, "none", "bm25_router"))
    )
    return some.select("qid", route.alias("r")).select("qid", "r.*")


def fused_route(questions: DataFrame, terms: DataFrame, votes: DataFrame, texts: DataFrame, alias_docs: DataFrame, n: int = 3, generic: list = GENERIC, **how) -> DataFrame:
    """The whole route of each question: names, then aliases against content, then BM25 over names.

    ``votes`` (qid, product, place) are the products of ``weighted_vote``, ``texts`` (product, text)
    those in which runs of ideographs are unique. Only questions that all else leaves go to ``last_resort``.
    """
    found = questions.groupBy("qid").agg(F.max(F.trim(F.coalesce("text", F.lit("")))).alias("said")).join(name_evidence(questions, terms, **how), "qid", "left")
    content = votes.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "product"))), lambda x: x["product"]).alias("content"))
    rare = ideograph_route(questions, texts).select("qid", F.col("product").alias("rare"))
    rows = found.join(content, "qid", "left").join(rare, "qid", "left")
    name, voted = _first("alias"), F.slice(F.coalesce("content", F.array().cast("array<string>")), 1, n)
    rest = F.array_remove(voted, F.coalesce(name, F.lit("")))
    merged = lambda most: F.slice(F.concat(F.array(name), F.array_remove(F.slice(voted, 1, most), name)), 1, n)
    both = name.isNotNull() & (F.size(voted) > 0)
    fusion = (
        F.when(F.col("said") == "", _route(F.array().cast("array<string>"), "none", "empty_question"))
        .when(name.isNull() & F.col("rare").isNotNull() & _named_route().isNull(), _route(F.array("rare"), "high", "phrase_grep_unique"))
        .when(both & F.array_contains(voted, name) & F.col("matched").isin(generic), _route(merged(n), "medium", "generic_alias_agree"))
        .when(both & F.array_contains(voted, name), _route(F.array(name), "high", "name_and_content_agree"))
        .when(both, _route(merged(n - 1), "medium", "name_vs_content_divergence"))
        .when(name.isNotNull(), _route(F.slice("alias", 1, n), "high", "alias_or_name_match"))
        .when(F.size(voted) > 0, _route(rest, "medium", "content_vote_only"))
    )
    routed = rows.select("qid", F.coalesce(F.when(F.col("said") != "", _named_route()), fusion).alias("r"))
    left = routed.filter("r IS NULL").select("qid")
    done = routed.filter("r IS NOT NULL").select("qid", "r.*")
    return done.unionByName(last_resort(questions.join(left, "qid", "left_semi"), alias_docs, n))


def clause_route(questions: DataFrame, terms: DataFrame, evidence: DataFrame | None = None, **how) -> DataFrame:
    """Questions that go to several products, as ``products`` in the order of the text, with the ``reason``.

    Either the display names that stand in the text are several, or at least two clauses lead to different
    products: a clause by its display name or nickname, else by ``evidence`` (qid, clause, product), which has
    a row where one heading alone fits the clause. Other questions have no row.
    """
    names = name_evidence(questions, terms, **how)
    explicit = names.filter(F.size("literal") >= 2).select("qid", F.col("literal").alias("products"), F.lit("explicit_multi_product").alias("reason"))
    clauses = clauses_of(questions.join(explicit.select("qid"), "qid", "left_anti"))
    several = clauses.groupBy("qid").agg(F.max("clause").alias("last")).filter("last > 0")
    clauses = clauses.join(several.select("qid"), "qid", "left_semi")
    keyed = clauses.select(F.struct("qid", "clause").alias("qid"), "text")
    own = name_evidence(keyed, terms, **how)
    by_name = own.select("qid.*", F.when(F.size("display") > 0, F.when(_first("functional").isNull() | (_first("functional") == _first("display")), _first("display"))).when(_first("functional").isNull(), _first("nickname")).alias("product"))
    by_name = by_name.filter("product IS NOT NULL")
    every = by_name
    if evidence is not None:
        more = evidence.select("qid", F.col("clause").cast("int").alias("clause"), "product").join(clauses.select("qid", "clause"), ["qid", "clause"], "left_semi")
        every = by_name.unionByName(more.join(by_name.select("qid", "clause"), ["qid", "clause"], "left_anti"))
    first = every.groupBy("qid", "product").agg(F.min("clause").alias("clause"))
    several = first.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("clause", "product"))), lambda x: x["product"]).alias("products")).filter(F.size("products") >= 2)
    return explicit.unionByName(several.select("qid", "products", F.lit("clause_multi_product").alias("reason")))


def word_spans(text: Column, low: int, high: int) -> Column:
    """Distinct spans of ``low`` to ``high`` characters with no a-z or 0-9 right before or after them."""
    inner = lambda i: F.substring(text, i, F.lit(1)).rlike("[a-z0-9]")
    last, none = F.length(text), F.array().cast("array<int>")
    between = lambda i, k: F.when(i <= k, F.sequence(i, F.greatest(i, k))).otherwise(none)
    starts = F.filter(between(F.lit(1), last - low + 1), lambda i: (i == 1) | ~inner(i - 1))
    ends = lambda i: F.filter(between(i + low - 1, F.least(i + high - 1, last)), lambda e: (e == last) | ~inner(e + 1))
    spans = F.flatten(F.transform(starts, lambda i: F.transform(ends(i), lambda e: F.substring(text, i, e - i + 1))))
    return F.array_distinct(spans)


def heading_evidence(clauses: DataFrame, headings: DataFrame, low: int = 8, high: int = 60) -> DataFrame:
    """Clauses (qid, clause, text) in which headings (product, heading) of one product alone stand as words.

    Spans of clauses meet headings by a join on the whole heading, so neither side is held by a task or the driver.
    """
    key = F.lower(F.trim(F.regexp_replace("heading", r"\s+", " ")))
    said = clauses.select("qid", "clause", F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("text"))
    asked = said.select("qid", "clause", F.explode(word_spans(F.col("text"), low, high)).alias("term"))
    there = headings.select("product", key.alias("term")).filter(F.length("term").between(low, high)).join(asked.select("term").distinct(), "term", "left_semi")
    own = there.groupBy("term").agg(F.count_distinct("product").alias("n"), F.min("product").alias("product")).filter("n = 1").drop("n")
    one = asked.join(own, "term").groupBy("qid", "clause").agg(F.count_distinct("product").alias("n"), F.min("product").alias("product")).filter("n = 1")
    return one.select("qid", "clause", "product")


def clauses_of(questions: DataFrame) -> DataFrame:
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), CLAUSES), lambda p: F.trim(p)), lambda p: p != "")
    return questions.select("qid", F.posexplode(parts).alias("clause", "text"))


# Queries over the test tables: sources as products, with names of parts as their aliases.


def _parts(s, d, by: str, alias: Column) -> DataFrame:
    first = table(s, d, "part").groupBy(by).agg(F.min("p_partkey").alias("place"))
    return first.select(F.concat(F.lit("src"), F.col("place") % 20).alias("product"), alias.alias("alias"), "place")


def _terms(s, d) -> DataFrame:
    products = table(s, d, "documents").groupBy(F.col("source").alias("product")).agg(F.min("doc_id").alias("place"))
    return catalogue_terms(
        products, _parts(s, d, "p_type", F.concat(F.lower("p_type"), F.lit(" system"))), _parts(s, d, "p_brand", F.col("p_brand")), _parts(s, d, "p_name", F.col("p_name"))
    )


_SAID = """CASE {i} % 10 WHEN 0 THEN coalesce(text, '') || ' with the src' || ({i} % 7) WHEN 1 THEN coalesce(text, '') || ' my src' || ({i} % 7) || ' with the ' || p_type || ' system' WHEN 2 THEN coalesce(text, '') || ' on the ' || p_type || ' system'
    WHEN 3 THEN coalesce(text, '') || ' of ' || p_brand WHEN 4 THEN coalesce(told, '') || ' one ' || p_name WHEN 5 THEN coalesce(text, '') || ' one ' || p_name WHEN 6 THEN p_name
    WHEN 7 THEN CASE {i} % 40 WHEN 7 THEN 'no7 unheardof' WHEN 17 THEN {first} WHEN 27 THEN 'no7 no7 no8 no8' ELSE 'unheardof' END WHEN 8 THEN CASE WHEN {i} % 20 = 8 THEN ' ' ELSE '??' END
    ELSE CASE WHEN {i} % 30 = 9 THEN '我想知道处理器单元怎么换' ELSE text END END"""


#: Names of parts that count as common ones.
_COMMON = [f"{a} {b}" for a in ("small", "red", "hot", "big") for b in ("ring", "widget", "bolt", "gear", "pipe", "nut", "rod", "plate")]
_COMMON_SQL = ", ".join(f"'{x}'" for x in _COMMON)


def _said(s, d, name: str, key: str) -> DataFrame:
    """Texts of a table with names of the part of the same number, and the first text of that name's product."""
    part = table(s, d, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    told = table(s, d, "documents").groupBy(F.col("source").alias("product")).agg(F.min_by("text", "doc_id").alias("told"))
    own = _parts(s, d, "p_name", F.col("p_name")).join(told, "product").select(F.col("alias").alias("p_name"), "told")
    text = _SAID.format(i=key, first="substring_index(p_name, ' ', 1)")
    rows = table(s, d, name).join(part.join(own, "p_name", "left"), F.col(key) == F.col("p_partkey"), "left")
    return rows.select(F.col(key).alias("qid"), F.expr(text).alias("text"))


def _names(s, d) -> DataFrame:
    part = table(s, d, "part")
    return part.select(F.col("p_name").alias("name")).union(part.select(F.concat("p_name", F.lit(" of "), "p_brand"))).distinct()


def _asked(s, d) -> DataFrame:
    part = table(s, d, "part").select("p_partkey", "p_name", "p_brand")
    said = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit(" the "), "p_name")).otherwise(""), F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit(" of "), "p_brand", F.lit("!"))).otherwise(""))
    return table(s, d, "documents").join(part, F.col("doc_id") == F.col("p_partkey"), "left").select(F.col("doc_id").alias("qid"), said.alias("text"))


def _rare_texts(s, d) -> DataFrame:
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") == 3, " 处理器单元").otherwise(""))
    return table(s, d, "documents").select(F.col("source").alias("product"), text.alias("text"))


def _fused(s, d) -> DataFrame:
    asked = _said(s, d, "benchmark", "item_id")
    docs = table(s, d, "documents").select("doc_id", "text")
    hits = R.top(R.bm25(docs, asked), 30).join(table(s, d, "documents").select("doc_id", F.col("source").alias("product")), "doc_id")
    votes = weighted_vote(hits.select("qid", "product", F.col("doc_id").alias("section"), "rank"))
    products = table(s, d, "documents").select(F.col("source").alias("product")).distinct()
    numbers = table(s, d, "part").filter("p_partkey < 20").select(F.concat(F.lit("src"), "p_partkey").alias("product"), F.concat(F.lit("no"), "p_partkey").alias("alias"))
    names = _parts(s, d, "p_name", F.col("p_name")).select("product", "alias").unionByName(numbers)
    out = fused_route(asked, _terms(s, d), votes, _rare_texts(s, d), alias_documents(products, names), generic=_COMMON)
    return out.select("qid", F.array_join("products", "|").alias("products"), "confidence", "reason")


_TWO = """CASE item_id % 4 WHEN 0 THEN 'Is src' || (item_id % 9) || ' as good as SRC' || (item_id % 7 + 9) || '?' WHEN 1 THEN 'Clean the src' || (item_id % 9) || '; what is ' || heading
    WHEN 2 THEN text || '！ how is ' || p_brand || '? ' || heading || '?' ELSE text END"""


def _clauses(s, d) -> DataFrame:
    heads = sections(s, d).select("product", "heading", "doc_id", "section_id")
    part = table(s, d, "part").select("p_partkey", "p_brand")
    rows = table(s, d, "benchmark").join(part, F.col("item_id") == F.col("p_partkey"), "left").join(heads.filter("section_id = 0").select("doc_id", "heading"), F.col("doc_id") == F.col("item_id"), "left")
    asked = rows.select(F.col("item_id").alias("qid"), F.expr(_TWO).alias("text"))
    evidence = heading_evidence(clauses_of(asked), heads.select("product", "heading"))
    return clause_route(asked, _terms(s, d), evidence).select("qid", F.array_join("products", "|").alias("products"), "reason")


_TERMS = """pr AS (SELECT source AS product, min(doc_id) AS place FROM documents GROUP BY source), pt AS (SELECT 'src' || (min(p_partkey) % 20) AS product, lower(p_type) || ' system' AS term, min(p_partkey) AS place FROM part GROUP BY p_type),
pb AS (SELECT 'src' || (min(p_partkey) % 20) AS product, lower(p_brand) AS term, min(p_partkey) AS place FROM part GROUP BY p_brand), pn AS (SELECT 'src' || (min(p_partkey) % 20) AS product, lower(p_name) AS term, min(p_partkey) AS place FROM part GROUP BY p_name),
terms AS (SELECT lower(product) AS term, 'display' AS kind, product, place FROM pr UNION SELECT lower(product), 'alias', product, place FROM pr UNION SELECT term, 'functional', product, place FROM pt UNION SELECT term, 'nickname', product, place FROM pb UNION SELECT term, 'alias', product, place FROM pn)"""
_EVIDENCE = """{n}h AS (
  SELECT q.qid, t.*, length(term) AS size, strpos(lower(text), term) - 1 AS spot FROM {q} q JOIN terms t ON contains(lower(text), term) WHERE kind IN ('functional', 'alias') OR regexp_matches(lower(text), '(^|[^a-z0-9])' || regexp_escape(term) || '($|[^a-z0-9])')
), {n}per AS (
  SELECT qid, product, max(size) FILTER (kind = 'display') AS d, min(spot) FILTER (kind = 'display') AS d_at, min(place) FILTER (kind = 'functional') AS f, max(size) FILTER (kind = 'nickname') AS n, max(size) FILTER (kind = 'alias') AS a,
    max_by(term, {{'s': size, 't': term}}) FILTER (kind = 'alias') AS at_, min(place) FILTER (kind <> 'functional') AS place FROM {n}h GROUP BY qid, product
), {n}ev AS (
  SELECT qid, list(product ORDER BY d DESC, place, product) FILTER (d IS NOT NULL) AS display, list(product ORDER BY f, product) FILTER (f IS NOT NULL) AS functional, list(product ORDER BY n DESC, place, product) FILTER (n IS NOT NULL) AS nickname,
    list(product ORDER BY at_ <> lower(product), a DESC, place, product) FILTER (a IS NOT NULL) AS alias, min_by(at_, {{'w': at_ <> lower(product), 'a': -a, 'p': place, 'q': product}}) FILTER (a IS NOT NULL) AS matched, list(product ORDER BY d_at, place, product) FILTER (d IS NOT NULL) AS literal FROM {n}per GROUP BY qid
), {n}nr AS (
  SELECT *, CASE WHEN display IS NOT NULL AND functional[1] <> display[1] THEN display[1] || '|' || functional[1] WHEN display IS NOT NULL THEN display[1] WHEN functional IS NOT NULL THEN functional[1] WHEN nickname IS NOT NULL THEN nickname[1] END AS named,
    CASE WHEN display IS NOT NULL AND functional[1] <> display[1] THEN 'display_vs_functional_divergence' WHEN display IS NOT NULL THEN 'explicit_product_name' WHEN functional IS NOT NULL THEN 'functional_alias' WHEN nickname IS NOT NULL THEN 'explicit_product_nickname' END AS why FROM {n}ev
)"""
_EV = _EVIDENCE.format(n="", q="q")
_SURE = "CASE WHEN {} IN ('display_vs_functional_divergence', 'functional_alias') THEN 'medium' ELSE 'high' END"


def _said_sql(name: str, key: str) -> str:
    told = "LEFT JOIN (SELECT source AS product, min_by(text, doc_id) AS told FROM documents GROUP BY source) td ON td.product = pn.product"
    said = _SAID.format(i=key, first="split_part(p_name, ' ', 1)").replace("coalesce(text", "coalesce(n.text").replace("ELSE text END", "ELSE n.text END")
    return f"q AS (SELECT {key} AS qid, {said} AS text FROM {name} n LEFT JOIN part ON p_partkey = {key} LEFT JOIN pn ON pn.term = lower(p_name) {told})"


_FUSED = f"""WITH {_TERMS}, {_said_sql("benchmark", "item_id")}, {_EV}, {R.STATS}, aq AS (SELECT qid, unnest({R._W.format("text")}) AS token FROM q), sc AS (
  SELECT qid, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dl)))), 6) AS score FROM aq JOIN post USING (token) JOIN stats USING (token) JOIN dl USING (doc_id) GROUP BY qid, doc_id
), hit AS (SELECT qid, source AS product, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) JOIN documents USING (doc_id) WHERE rank <= 30),
v AS (SELECT qid, product, sum(CASE WHEN rank = 1 THEN 4 WHEN rank <= 3 THEN 3 WHEN rank <= 8 THEN 2 ELSE 1 END) AS votes, min(rank) AS first FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS k FROM hit) WHERE k <= 18 GROUP BY qid, product),
c AS (SELECT qid, list(product ORDER BY votes DESC, first, product)[1:3] AS content FROM v GROUP BY qid), rare AS (SELECT qid, (SELECT source FROM documents WHERE doc_id = 3) AS rare FROM q WHERE contains(text, '处理器单元')),
r AS (
  SELECT q.qid, text, named, why, alias, matched, rare, coalesce(content, []) AS content, coalesce(alias[1] IS NOT NULL AND len(coalesce(content, [])) > 0, false) AS both_, list_filter(coalesce(content, []), lambda x: x IS DISTINCT FROM alias[1]) AS rest,
    list_filter(coalesce(content, [])[1:2], lambda x: x IS DISTINCT FROM alias[1]) AS rest2 FROM q LEFT JOIN nr USING (qid) LEFT JOIN c USING (qid) LEFT JOIN rare USING (qid)
), f AS (
  SELECT *, CASE WHEN trim(text) = '' THEN 'empty_question' WHEN why IS NOT NULL THEN why WHEN alias IS NULL AND rare IS NOT NULL THEN 'phrase_grep_unique' WHEN both_ AND list_contains(content, alias[1]) AND matched IN ({_COMMON_SQL}) THEN 'generic_alias_agree'
    WHEN both_ AND list_contains(content, alias[1]) THEN 'name_and_content_agree' WHEN both_ THEN 'name_vs_content_divergence' WHEN alias IS NOT NULL THEN 'alias_or_name_match' WHEN len(content) > 0 THEN 'content_vote_only' END AS reason FROM r
), al AS (SELECT product, product || ' ' || names || ' ' || names AS text FROM (SELECT product, string_agg(DISTINCT x, ' ' ORDER BY x) AS names FROM (SELECT product, product AS x FROM pr UNION ALL SELECT product, term FROM pn UNION ALL SELECT 'src' || p_partkey, 'no' || p_partkey FROM part WHERE p_partkey < 20) GROUP BY product)),
lt AS (SELECT product, unnest({R._W.format("text")}) AS token FROM al), lp AS (SELECT product, token, count(*) AS tf FROM lt GROUP BY ALL), ll AS (SELECT product, count(*) AS dl FROM lt GROUP BY product),
lr AS (SELECT token, ln((SELECT count(*) FROM al) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM lp GROUP BY token), li AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM lr) ELSE raw END AS idf FROM lr),
lq AS (SELECT qid, unnest({R._W.format("text")}) AS token FROM f WHERE reason IS NULL), lb AS (
  SELECT qid, product, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM ll)))), 6) AS score FROM lq JOIN lp USING (token) JOIN li USING (token) JOIN ll USING (product) GROUP BY qid, product
), ls AS (SELECT qid, product, count(*) AS shared, max(length(token)) AS longest FROM (SELECT DISTINCT qid, token FROM lq) JOIN lp USING (token) GROUP BY qid, product), lk AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, product) AS k, max(score) OVER (PARTITION BY qid) AS top FROM (SELECT ls.qid, ls.product, round(CASE WHEN lb.score > 0 THEN lb.score ELSE 0 END + 0.35 * shared, 6) AS score FROM ls LEFT JOIN lb USING (qid, product) WHERE shared >= 2 OR longest >= 3) WHERE score > 0
), lm AS (SELECT qid, max(score) FILTER (k = 1) AS one, max(score) FILTER (k = 2) AS two, min(score) FILTER (k <= 3) AS third, min_by(product, k) AS best, string_agg(product, '|' ORDER BY k) FILTER (k <= 3 AND score >= greatest(1, round(0.7 * top, 6))) AS near FROM lk GROUP BY qid),
lx AS (SELECT f.qid, one, two, best, near, CASE WHEN len({R._W.format("text")}) = 0 THEN 'no_query_tokens' WHEN one IS NULL THEN 'no_positive_score' WHEN two IS NOT NULL AND round(one - third, 6) < 1.5 AND one < 5 THEN 'ambiguous_top3_low_score' ELSE 'bm25_router' END AS reason FROM f LEFT JOIN lm USING (qid) WHERE f.reason IS NULL)
SELECT qid, CASE reason WHEN 'empty_question' THEN '' WHEN 'phrase_grep_unique' THEN rare WHEN 'generic_alias_agree' THEN array_to_string(list_prepend(alias[1], rest)[1:3], '|') WHEN 'name_and_content_agree' THEN alias[1] WHEN 'name_vs_content_divergence' THEN array_to_string(list_prepend(alias[1], rest2)[1:3], '|')
    WHEN 'alias_or_name_match' THEN array_to_string(alias[1:3], '|') WHEN 'content_vote_only' THEN array_to_string(content, '|') ELSE named END AS products,
  CASE WHEN reason = 'empty_question' THEN 'none' WHEN reason IN ('generic_alias_agree', 'name_vs_content_divergence', 'content_vote_only', 'functional_alias', 'display_vs_functional_divergence') THEN 'medium' ELSE 'high' END AS confidence, reason FROM f WHERE reason IS NOT NULL
UNION ALL
SELECT qid, CASE WHEN reason <> 'bm25_router' OR one < 1.5 THEN '' WHEN one >= 3 AND round(one - coalesce(two, 0), 6) >= 1 THEN best ELSE near END, CASE WHEN reason <> 'bm25_router' OR one < 1.5 THEN 'none' WHEN one >= 3 AND round(one - coalesce(two, 0), 6) >= 1 THEN 'high' ELSE 'medium' END, reason FROM lx"""

QUERIES = {
    "named_product": (
        lambda s, d: named_product(_asked(s, d), _names(s, d)),
        """WITH q AS (SELECT doc_id AS qid, coalesce(text, '') || CASE WHEN doc_id % 3 > 0 THEN ' the ' || p_name ELSE '' END || CASE WHEN doc_id % 3 = 2 THEN ' of ' || p_brand || '!' ELSE '' END AS text FROM documents LEFT JOIN part ON p_partkey = doc_id),
        n AS (SELECT p_name AS name FROM part UNION SELECT p_name || ' of ' || p_brand FROM part), h AS (SELECT qid, name FROM q JOIN n ON contains(lower(text), lower(name))),
        k AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.qid = h.qid AND o.name <> h.name AND contains(o.name, h.name)))
        SELECT q.qid, CASE WHEN count(name) = 1 THEN min(name) END AS product, count(name) > 1 AS ambiguous FROM q LEFT JOIN k ON k.qid = q.qid GROUP BY q.qid""",
    ),
    "name_route": (
        lambda s, d: name_route(_said(s, d, "documents", "doc_id"), _terms(s, d)).select("qid", F.array_join("products", "|").alias("products"), "confidence", "reason"),
        f"""WITH {_TERMS}, {_said_sql("documents", "doc_id")}, {_EV} SELECT q.qid, coalesce(named, array_to_string(alias[1:3], '|'), '') AS products,
        CASE WHEN why IS NULL AND alias IS NULL THEN 'none' ELSE {_SURE.format("coalesce(why, '')")} END AS confidence, coalesce(why, CASE WHEN alias IS NOT NULL THEN 'alias_or_name_match' ELSE 'no_name' END) AS reason FROM q LEFT JOIN nr USING (qid)""",
    ),
    "route_fusion": (_fused, _FUSED),
    "clause_route": (
        _clauses,
        f"""WITH {_TERMS}, {SECTIONS}, q AS (SELECT item_id AS qid, {_TWO} AS text FROM benchmark LEFT JOIN part ON p_partkey = item_id LEFT JOIN (SELECT doc_id, heading FROM sections WHERE section_id = 0) ON doc_id = item_id), {_EV},
        e AS (SELECT qid, array_to_string(literal, '|') AS products FROM ev WHERE len(literal) >= 2), cl AS (SELECT qid, list_filter(list_transform(string_split_regex(text, '[；;。！？!?]+|[，,]\\s*(?:并且?|以及|同时|另外|然后)|并且|以及|同时|另外|然后'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM q WHERE text IS NOT NULL AND qid NOT IN (SELECT qid FROM e)),
        cq AS (SELECT qid * 1000 + i AS qid, ps[i] AS text FROM cl, LATERAL (SELECT unnest(range(1, len(ps) + 1)) AS i) WHERE len(ps) >= 2), {_EVIDENCE.format(n="c", q="cq")},
        bn AS (SELECT qid, CASE WHEN display IS NOT NULL THEN CASE WHEN functional IS NULL OR functional[1] = display[1] THEN display[1] END WHEN functional IS NULL THEN nickname[1] END AS product FROM cev), hd AS (SELECT lower(trim(regexp_replace(heading, '\\s+', ' ', 'g'))) AS term, product FROM sections),
        ho AS (SELECT term, min(product) AS product FROM hd WHERE length(term) BETWEEN 8 AND 60 GROUP BY term HAVING count(DISTINCT product) = 1), he AS (
          SELECT qid, min(product) AS product FROM cq JOIN ho ON contains(regexp_replace(lower(text), '\\s+', ' ', 'g'), term) AND regexp_matches(regexp_replace(lower(text), '\\s+', ' ', 'g'), '(^|[^a-z0-9])' || regexp_escape(term) || '($|[^a-z0-9])') GROUP BY qid HAVING count(DISTINCT product) = 1
        ), every AS (SELECT qid, product FROM bn WHERE product IS NOT NULL UNION ALL SELECT qid, product FROM he WHERE qid NOT IN (SELECT qid FROM bn WHERE product IS NOT NULL)), fs AS (SELECT qid // 1000 AS qid, product, min(qid) AS spot FROM every GROUP BY ALL)
        SELECT qid, products, 'explicit_multi_product' AS reason FROM e UNION ALL SELECT qid, string_agg(product, '|' ORDER BY spot), 'clause_multi_product' FROM fs GROUP BY qid HAVING count(*) >= 2""",
    ),
}
