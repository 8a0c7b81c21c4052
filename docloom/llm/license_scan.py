"""License scans: fuzzy search for short notices.

A notice of k allowed edits is split into k + 1 seeds. If a text holds the notice with at
most k edits, one seed at least stands in it unchanged (pigeonhole), so exact search for
the seeds finds every candidate place; there the ``regex`` library matches the whole
notice with bounded errors, which verifies the edits and gives the span. A notice begins and
ends at borders of words, and the word that tells its license from others must stand in it
unchanged: "released under the mpl license" is no mit license in two edits.

Texts are compared as lower-case words joined by single blanks. Phrases are notices of
no allowed edits: they are their own only seed, and every place of them is counted.

Nulls, ties and odd tables: null and empty texts give no words and no labels. Documents are
judged row by row, so repeated rows give repeated results, and an empty table gives no rows.
Of two places of one notice that overlap the one of fewer edits stays, of equal ones the
first; places of different notices may overlap. A text of any length is scanned as a whole
in a few copies of its bytes. Carried columns may have any names; the operator's own results
take the place of carried columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import lookup, slices, text_bytes, words

#: Phrases and labels, each counted wherever its words stand.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Short notices, their labels, the edits (of characters) that they may have, and the words that must
#: stand unchanged; so few edits that a seed has nine characters at least and seldom stands elsewhere.
NOTICES = [
    ("licensed under the gnu general public license", "gpl", 3, "gnu general"),
    ("licensed under the apache license version 2 0", "apache", 3, "apache"),
    ("released under the mit license", "mit", 2, "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 4, "permission"),
    ("creative commons attribution", "cc-by", 2, "commons"),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 4, "redistribution"),
    ("gnu lesser general public license", "lgpl", 2, "lesser"),
    ("mozilla public license", "mpl", 1, "mozilla"),
    ("all rights reserved", "proprietary", 1, "all"),
]

#: Bytes of words after lower-casing: digits, a-z and all of non-ASCII characters.
WORD = lookup([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def seeds(notice: str, edits: int) -> list[tuple[int, bytes]]:
    """Start and bytes of the edits + 1 parts of a notice, of even length."""
    raw = notice.encode()
    cuts = [round(i * len(raw) / (edits + 1)) for i in range(edits + 2)]
    return [(a, raw[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=None)
def pattern(notice: str, edits: int, fixed: str) -> regex.Pattern:
    """Between blanks, what is before the fixed words and what is after them, each with bounded errors."""
    before, after = (x.strip().encode() for x in f" {notice} ".split(f" {fixed} ", 1))
    fuzzy_ = lambda x: rb"(?:%s){e<=%d}" % (regex.escape(x, special_only=True), edits)
    head, tail = (b" " + fuzzy_(before) if before else b""), (fuzzy_(after) + b" " if after else b"")
    return regex.compile(b"(?b)" + head + b" " + fixed.encode() + b" " + tail)


@lru_cache(maxsize=100_000)
def verify(notice: str, edits: int, fixed: str, window: bytes) -> tuple[int, int, int] | None:
    """Span (without the blanks around it) and edits of the best match in a candidate's surroundings, or None."""
    found = pattern(notice, edits, fixed).search(window)
    cost = sum(found.fuzzy_counts) if found else edits + 1
    return (found.start() + 1, found.end() - 1, cost) if cost <= edits else None


def places(data: bytes, what: bytes) -> Iterator[int]:
    at = data.find(what)
    while at >= 0:
        yield at
        at = data.find(what, at + 1)


def fuzzy(data: bytes, notice: str, edits: int, fixed: str) -> list[tuple[int, int, int]]:
    """Non-overlapping spans in canonical text where the notice stands with at most ``edits`` edits."""
    raw_len, found, windows = len(notice.encode()), {}, set()
    for start, seed in seeds(notice, edits):
        windows.update(at - start for at in places(data, seed))
    for at in sorted(windows):
        lo = max(0, at - edits - 1)
        if hit := verify(notice, edits, fixed, data[lo : at + raw_len + edits + 1]):
            a, b, cost = lo + hit[0], lo + hit[1], hit[2]
            last = max(found, default=None)
            if last is not None and found[last][0] > a:  # the same place again: the better one stays
                if cost >= found[last][1]:
                    continue
                del found[last]
            found[a] = (b, cost)
    return [(a, b, cost) for a, (b, cost) in sorted(found.items())]


def canonical(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Each text as lower-case words with a blank before and after each, and its number of words."""
    data, off = text_bytes(texts)
    is_word = WORD[data]
    starts, ends, row = words(data, off, is_word)
    n = np.bincount(row, minlength=len(off) - 1)
    size = ends - starts + 1
    out = np.full(int(size.sum()), 32, np.uint8)
    at = np.arange(len(data))[is_word]
    moved = np.repeat(np.cumsum(size) - size - starts, size - 1)
    out[at + moved] = LOWER[data[is_word]]
    cut = np.zeros(len(n) + 1, np.int64)
    np.cumsum(np.bincount(row, weights=size, minlength=len(n)).astype(np.int64), out=cut[1:])
    raw = out.tobytes()
    return [b" " + raw[a:b] for a, b in zip(cut, cut[1:])], n


def scan(text: bytes) -> dict:
    """Places of all phrases and spans of all notices in one canonical text.

    ``spans`` has label, first word, words and edits of each hit.
    """
    spans, starts = [], []
    if len(text) > 1:
        blanks: np.ndarray | None = None
        for phrase, label in PHRASES.items():
            for at in places(text, b" %s " % phrase.encode()):
                if blanks is None:
                    blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
                first = int(np.searchsorted(blanks, at, "left"))
                starts.append(first)
                spans.append((label, first, phrase.count(" ") + 1, 0, 1.0, True))
        for notice, label, edits, fixed in NOTICES:
            for a, b, cost in fuzzy(text, notice, edits, fixed):
                if blanks is None:
                    blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
                first = max(0, int(np.searchsorted(blanks, a, "right")) - 1)
                last = int(np.searchsorted(blanks, b - 1, "left"))
                spans.append((label, first, max(1, last - first), cost, 1 - cost / len(notice), False))
    return {"starts": starts, "spans": spans}


SCHEMA = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first_word:bigint,n_words:bigint,edits:int>>"
)

RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]


def license_scan(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns of each document with its words, labels and spans.

    ``first_word`` and ``last_word`` are null where no phrase stands; ``score`` is the
    similarity of the best hit, 1 for a phrase, 0 without any.
    """
    carry = tuple(c for c in carry if c not in RESULTS)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), SCHEMA])
    types = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            texts, n = canonical(part.column(text))
            hits = [scan(t) for t in texts]
            starts = [h["starts"] for h in hits]
            base = [",".join(sorted({s[0] for s in h["spans"] if s[5]})) for h in hits]
            every = [",".join(sorted({s[0] for s in h["spans"]})) for h in hits]
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in carry),
                    pa.array(n, pa.int64()),
                    pa.array([len(s) for s in starts], pa.int64()),
                    pa.array([min(s, default=None) for s in starts], pa.int64()),
                    pa.array([max(s, default=None) for s in starts], pa.int64()),
                    pa.array(base, pa.string()),
                    pa.array(every, pa.string()),
                    pa.array([max((s[4] for s in h["spans"]), default=0.0) for h in hits], pa.float64()),
                    pa.array([[{"label": s[0], "first_word": s[1], "n_words": s[2], "edits": s[3]} for s in sorted(h["spans"])] for h in hits], types),
                ],
                names=[*carry, *RESULTS],
            )

    return docs.select(*dict.fromkeys((*carry, text))).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return license_scan(docs).drop("spans")
