"""URL filters: a weighted vocabulary.

An Aho-Corasick automaton runs once over each lower-case url and counts the terms that
stand between boundaries (the url's ends, or anything but letters and digits). Each term
has a weight; a url is rejected when the weights of its distinct terms come to the threshold.
A strict term's weight is the threshold, so one is enough; of soft ones it takes several.
Rules on hosts and paths go first. ``load`` reads a vocabulary from a table of terms and
weights, so that lists of any origin can be used; ``TERMS`` is the one of the query.

Nulls, ties and odd tables: a null url, or one without ``://``, has an empty host and path,
and no rule fits it; the vocabulary still judges its text. Rules are of different lengths
where several fit. Repeated rows are judged one by one, a url of any length as a whole, and
an empty table gives no rows. Columns of the rows go by place and may have any names; the
operator's own results take the place of those of their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from .common import beside, named

#: Capital and small letters of ASCII, for translate().
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules on a host (with all its subdomains) and the path's start; the longest that fits wins.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: Distinct soft terms of weight 1 that reject, and the weight of a strict one.
THRESHOLD = 2.0

#: Terms and their weights.
TERMS = {
    **dict.fromkeys(["casino", "porn", "xxx", "viagra", "spam", "cheap-pills", "free-bets"], THRESHOLD),
    **dict.fromkeys(["bets", "bet", "win", "free", "cheap", "pills", "ads", "track", "adult", "poker", "loan", "crack", "farm", "click"], 1.0),
}

#: Terms that a vocabulary may have: it goes to every task as a whole.
MOST_TERMS = 1 << 20

RESULTS = ["n_strict", "n_soft", "weight", "host", "path", "rule", "verdict"]


def load(table: DataFrame, term: str = "term", weight: str = "weight") -> dict[str, float]:
    """A vocabulary from a table: terms in small letters, of equal ones the largest weight; null and empty terms and weights that aren't above 0 are left out."""
    rows = table.select(F.translate(F.trim(F.col(term)), CAPITALS, SMALL).alias("t"), F.col(weight).cast("double").alias("w")).filter("t <> '' AND w > 0").groupBy("t").agg(F.max("w").alias("w"))
    found = {r.t: r.w for r in rows.limit(MOST_TERMS + 1).collect()}
    if len(found) > MOST_TERMS:
        raise ValueError(f"a vocabulary of more than {MOST_TERMS} terms")
    return found


def automaton(terms: dict[str, float]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in terms.items():
        found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def count_terms(found: ahocorasick.Automaton, url: str, threshold: float) -> tuple[int, int, float]:
    """Distinct strict and soft terms between boundaries, and their weight together."""
    hits: dict[str, float] = {}
    ok = lambda c: not (c.isascii() and c.isalnum())
    for end, (term, weight) in found.iter(url) if len(found) else ():
        begin = end - len(term) + 1
        if (begin == 0 or ok(url[begin - 1])) and (end + 1 == len(url) or ok(url[end + 1])):
            hits[term] = weight
    strict = sum(w >= threshold for w in hits.values())
    return strict, len(hits) - strict, math.fsum(hits.values())


def vocabulary(pages: DataFrame, url: str = "url", terms: dict[str, float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows with ``n_strict`` and ``n_soft``, the distinct terms of each kind in the url, and ``weight``, theirs together."""
    terms = TERMS if terms is None else terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        found = automaton(terms)
        lower = str.maketrans(CAPITALS, SMALL)
        for batch in batches:
            hits = [count_terms(found, (u or "").translate(lower), threshold) for u in batch.column("judged").to_pylist()]
            yield batch, [pa.array([h[i] for h in hits], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64()))]

    return beside(pages, url, dict(zip(RESULTS[:3], (IntegerType(), IntegerType(), DoubleType()), strict=True)), run)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ``://``."""
    rest = F.substring_index(F.coalesce(url, F.lit("")), "://", 1)
    after = F.when(F.contains(url, F.lit("://")), F.substring(url, F.length(rest) + 4, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), CAPITALS, SMALL)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def verdicts(pages: DataFrame, url: str = "url", terms: dict[str, float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows with the vocabulary's counts, host, path, the rule that fits best and the verdict."""
    host, path = parts(F.col("url"))
    columns = [c for c in pages.columns if c not in RESULTS]
    carried = F.struct(F.lit(0).alias("c"), *(named(c).alias(f"c{i}") for i, c in enumerate(columns))).alias("carried")
    out = vocabulary(pages.select(carried, named(url).alias("url")), "url", terms, threshold).withColumn("host", host).withColumn("path", path)
    rule, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, domain, prefix in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == domain) | F.endswith("host", F.lit("." + domain))) & F.startswith("path", F.lit(prefix))
        rule = F.when(fits, F.lit(domain + prefix)).otherwise(rule)
        says = F.when(fits, F.lit(verdict)).otherwise(says)
    reject = F.col("weight") >= threshold
    verdict = F.coalesce(says, F.when(reject, F.lit("block")).otherwise(F.lit("allow")))
    return out.withColumn("rule", rule).withColumn("verdict", verdict).select(*(F.col(f"carried.c{i}").alias(c) for i, c in enumerate(columns)), *RESULTS)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return verdicts(pages).select("page_id", "host", "path", "rule", "verdict")


def _term_sql(terms: dict[str, float]) -> str:
    return " + ".join(f"{w} * CAST(regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS INT)" for t, w in terms.items())


ORACLE = rf"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, translate(coalesce(url, ''), '{CAPITALS}', '{SMALL}') AS u,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, u, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{CAPITALS}', '{SMALL}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(verdict, domain, prefix) AS (VALUES {", ".join(f"('{v}', '{d}', '{x}')" for v, d, x in RULES)}), best AS (
  SELECT page_id, max_by(domain || prefix, length(domain || prefix)) AS rule, max_by(verdict, length(domain || prefix)) AS said
  FROM h JOIN r ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix) GROUP BY page_id
)
SELECT h.page_id, host, path, rule,
  coalesce(said, CASE WHEN {_term_sql(TERMS)} >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN best ON h.page_id = best.page_id
"""
