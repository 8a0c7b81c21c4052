"""Line dedup against a plain version: through filters, through the join, and after documents came and went."""

import hashlib
import random
from collections import Counter

import pytest

from docloom.llm import line_dedup
from docloom.llm.line_dedup import Cuckoo, built, dedup, updated

from .cases import SCHEMA, documents, words

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return line.strip(BLANKS).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def plain(texts, least_docs, least_chars=1):
    texts = [t or "" for t in texts]
    count = Counter(k for t in texts for k in {key(line) for line in t.split("\n")})
    out = []
    for t in texts:
        lines = t.split("\n")
        kept = "\n".join(x for x in lines if len(key(x)) < max(1, least_chars) or count[key(x)] < least_docs)
        out.append((len(lines), sum(len(key(x)) >= max(1, least_chars) and count[key(x)] >= least_docs for x in lines), kept))
    return out


def some_texts(n=300, seed=1):
    r = random.Random(seed)
    pool = [words(r.randint(1, 6), i) for i in range(40)] + ["", " ", "\t\r", "É", "é", "A line", " a LINE\r", " ", "x\x00y"]
    texts = ["\n".join(r.choice(pool) if r.random() < 0.6 else words(4, r.random()) for _ in range(r.randint(0, 9))) for _ in range(n)]
    return [*texts, None, "", "\n", "\n\n", texts[0], texts[0], "the common line\n" + "word " * 50_000, "\n" * 3000 + "A line"] + ["the common line\n" + words(3, i) for i in range(120)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i % 50 else None, t) for i, t in enumerate(some_texts())], "doc_id long, text string").repartition(5).cache()


def same(rows, docs, least_docs, least_chars=1):
    all_texts = [r.text for r in docs.collect()]
    want = Counter((t, *w[:2], hashlib.sha256(w[2].encode()).hexdigest(), w[2]) for t, w in zip(all_texts, plain(all_texts, least_docs, least_chars), strict=True))
    assert Counter((r.text, r.n_lines, r.n_dropped, r.kept_sha256, r.kept) for r in rows.collect()) == want


@pytest.mark.parametrize("least_docs, least_chars, shard_keys", [(10, 1, 1 << 14), (2, 1, 7), (1, 3, 64), (5, 12, 1)])
def test_same_lines_as_plain(docs, least_docs, least_chars, shard_keys):
    index = built(docs, least_docs=least_docs, least_chars=least_chars, shard_keys=shard_keys)
    same(dedup(docs, index, keep=True), docs, least_docs, least_chars)
    same(dedup(docs, index, keep=True, most_bytes=0), docs, least_docs, least_chars)


def test_documents_come_and_go(spark, docs):
    first, second = docs.filter("doc_id % 3 < 2"), docs.filter("doc_id % 3 = 2 OR doc_id IS NULL")
    for shard_keys in (16, 1 << 14):
        begun = built(first, least_docs=4, shard_keys=shard_keys)
        grown = updated(begun, added=second, shard_keys=shard_keys)
        same(dedup(docs, grown, keep=True), docs, 4)
        back = updated(grown, removed=second, shard_keys=shard_keys)
        assert sorted(back.refs.collect()) == sorted(begun.refs.collect())
        same(dedup(first, back, keep=True), first, 4)
        swapped = updated(back, added=second, removed=first, shard_keys=shard_keys)
        same(dedup(second, swapped, keep=True), second, 4)
        none = updated(swapped, removed=second, shard_keys=shard_keys)
        assert none.refs.count() == 0 and not any(any(r.marks) or r.wrong for r in none.filters.collect())


def test_deleting_what_was_never_added(spark, docs):
    index = built(docs.filter("doc_id < 10"))
    with pytest.raises(Exception, match="never added"):
        updated(index, removed=spark.createDataFrame([(1, "a line of its own")], "doc_id long, text string")).refs.count()


def test_many_documents_more_make_shards_anew(spark):
    few = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    many = spark.createDataFrame([(i, f"line {i % 300}\na") for i in range(900)], "doc_id long, text string")
    index = updated(built(few, least_docs=3, shard_keys=8), added=many, shard_keys=8)
    assert index.bits > 2
    both = few.union(many)
    same(dedup(both, index, keep=True), both, 3)


def test_a_filter_takes_in_and_gives_up():
    r = random.Random(3)
    keys = [(r.getrandbits(64), r.getrandbits(64)) for _ in range(2000)]
    made = Cuckoo.of(keys)
    import numpy as np

    def taken(some):
        hi, lo = (np.array([k[i] for k in some], np.uint64) for i in (0, 1))
        zero = np.zeros(len(some), np.uint64)
        return line_dedup.hits(made.table, zero, zero + np.uint64(made.mask), hi, lo)

    assert taken(keys).all()
    for k in keys[:1000]:
        made.delete(*k)
    assert taken(keys[1000:]).all() and taken(keys[:1000]).sum() < 20
    for k in keys[1000:]:
        made.delete(*k)
    assert not made.table.any()
    with pytest.raises(KeyError):
        made.delete(*keys[0])


def test_keys_that_the_filter_takes_falsely_stay(spark):
    docs = spark.createDataFrame([(i, f"common {i % 4000}\nrare {i}") for i in range(12_000)], "doc_id long, text string")
    index = built(docs, least_docs=3)
    assert sum(len(r.wrong) for r in index.filters.collect()) > 0
    assert dedup(docs, index).filter("n_dropped <> 1").count() == 0


def test_odd_names_and_an_empty_table(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    odd = docs.selectExpr("text AS `a.b`", "doc_id AS n_lines", "doc_id", "lang AS carried", "source AS `one`", "n_chars AS ` `", "lang AS shard")
    for most in (1 << 20, 0):
        out = dedup(odd, built(odd, "a.b"), "a.b", most_bytes=most)
        assert out.columns == ["a.b", "doc_id", "carried", "one", " ", "shard", "n_lines", "n_dropped", "kept_sha256"]
        assert out.count() == docs.count() and out.filter("n_lines <> size(split(coalesce(`a.b`, ''), '\\n'))").count() == 0
    none = docs.limit(0)
    assert dedup(none, built(none)).collect() == dedup(none, built(none), most_bytes=0).collect() == []
