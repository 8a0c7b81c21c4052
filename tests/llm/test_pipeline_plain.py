"""The pipeline's stages against plain versions that share nothing with the operators."""

import re
from collections import Counter

import corpus_pipeline
import pytest

from docloom.llm import sentencepiece

from .cases import SCHEMA, documents, words

WORD = "[^\x20\x09-\x0d]+"


def passes(text):
    """Rules of quality on one text."""
    text = text or ""
    w = re.findall(WORD, text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    chars, symbols = sum(map(len, w)), sum(c in "#*$%&|<>" for c in text)
    return not (len(w) < 20 or 100 * len(again) > 30 * len(w) or 100 * symbols > 40 * len(w) or len(lines) > 2 and 100 * (len(lines) - len(set(lines))) > 60 * len(lines) or chars < 2 * len(w) or chars > 25 * len(w))


def classes(texts):
    """Class of each text: links of weighted Jaccard similarity 0.8 over multisets of five words, all with all."""
    def shingles(text):
        w = re.findall(WORD, text or "")
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter({(): 1})

    sets, of = [shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = sum((a & b).values())
            if both >= 0.8 * (sum(a.values()) + sum(b.values()) - both):
                of[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


def without_passages(rows):
    """Texts (in order of ids) without bytes of 100-byte strings that start earlier, and without characters that were cut."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        fresh = []
        for i in range(len(raw) - 99):
            piece = raw[i : i + 100]
            if piece in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(piece)
            fresh.append(piece)
        out.append(bytes(b for b, g in zip(raw, gone, strict=True) if not g))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    shared = words(60, 91)
    rows = [r for r in documents() if r[0] is not None and r[0] != 3]
    rows += [(100 + i, words(50 + i, i) + "\n" + (shared if i % 3 == 0 else words(20, 500 + i)) + " " + words(30, 700 + i), "en", f"src{i % 3}", 1) for i in range(24)]
    base = words(80, 300).split()
    for i in range(8):  # copies with edits
        w = list(base)
        w[10 * i] = f"edit{i}"
        rows.append((200 + i, " ".join(w), "en", "src0", 1))
    return spark.createDataFrame(rows, SCHEMA).cache()


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_quality(spark, docs):
    want = sorted(r.doc_id for r in docs.collect() if passes(r.text))
    assert ids(corpus_pipeline.quality(spark, docs, "")) == want and 0 < len(want) < docs.count()


def test_near_copies(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    of = classes([r.text for r in rows])
    want = sorted(rows[i].doc_id for i in set(of))
    assert ids(corpus_pipeline.near_dedup(spark, docs, "")) == want and len(want) < len(rows) - 7


def test_passages(spark, docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
    left = without_passages(rows)
    want = {i: raw for (i, text), raw in zip(rows, left, strict=True) if raw or not text}
    got = {r.doc_id: r for r in corpus_pipeline.passage_dedup(spark, docs, "").collect()}
    assert set(got) == set(want) and any(len(want[i]) < len((t or "").encode()) for i, t in rows if i in want)
    assert all((got[i].text or "") == want[i].decode(errors="ignore") and got[i].n_chars in (None, len(got[i].text or "")) for i in want)


def test_the_mix_keeps_everyone_and_repeats_none_more_than_twice(spark, docs):
    own, got = Counter(ids(docs)), Counter(ids(corpus_pipeline.mix(spark, docs, "")))
    assert set(own) == set(got)
    tokens = lambda t: len(re.findall(WORD, t or ""))
    by = {}
    for r in docs.collect():
        s = by.setdefault(r.source or "", [0, 0])
        s[0] += tokens(r.text)
        s[1] += tokens(r.text) * got[r.doc_id]
    shares = [after / before for before, after in by.values() if before]
    assert min(shares) >= 1 and max(shares) <= 2.05


def test_ids(spark, docs):
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in corpus_pipeline.tokenize(spark, docs, "").collect():
        assert r.ids == model.encode(texts[r.doc_id] or "") or texts[r.doc_id] is None
