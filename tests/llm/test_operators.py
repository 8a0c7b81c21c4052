"""Each operator against a plain version, over the odd documents and an empty table."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import audio_features, bag_minhash, language_model, license_scan, mixing, phrase_dedup, preferences, quality_rules, sentencepiece, url_vocabulary
from docloom.llm.components import components

from .cases import SCHEMA, documents, words


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


SPACES = "[^\x20\x09-\x0d]+"


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


# 1: SentencePiece


def test_encoding_is_the_librarys(spark, docs):
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    for r in sentencepiece.encode(docs.withColumn("ids", F.lit("clash"))).collect():
        assert r.ids == (None if r.text is None else model.encode(r.text))
        assert r.round_trip == ("▁" not in (r.text or ""))


def test_decoding_gives_the_text_back(docs):
    rows = sentencepiece.encode(docs.filter("text NOT LIKE '%▁%'")).withColumnRenamed("text", "was")
    for r in sentencepiece.decode(rows).collect():
        assert r.text == r.was


@pytest.mark.parametrize("part", [64, 300])
def test_long_chunks_go_in_windows(monkeypatch, part):
    import sentencepiece as library

    monkeypatch.setattr(sentencepiece, "PART_BYTES", part)
    monkeypatch.setattr(sentencepiece, "LONG", 16)
    model, v = library.SentencePieceProcessor(model_file=sentencepiece.MODEL), sentencepiece.load()
    texts = ["the" * 300, "a" * 500, "日本" * 200, "internationalization" * 9, " " * 90, words(80, 3)]
    assert sentencepiece.Encoder(v)(pa.array(texts)).to_pylist() == model.encode(texts)


def test_encoding_of_an_empty_table(none):
    assert sentencepiece.encode(none).collect() == []


# 2: licenses


def test_places_of_phrases(docs):
    for r in license_scan.license_scan(docs, carry=("doc_id", "text")).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text))
        starts = [i for p in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        labels = {label for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()}
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(starts), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(","))


def test_notices_with_edits_are_found_and_others_not():
    def labels(text):
        return {s[0] for s in license_scan.scan(license_scan.canonical(pa.array([text]))[0][0])["spans"]}

    assert labels("licensed under the apache licence version 2.0") == {"apache"}
    assert labels("x released undr the MIT  licence y") == {"mit"}
    assert labels("Permission is hereby granted, free of charge, to any persn obtaining a copy") == {"mit"}
    assert labels("licensed under a completely different set of terms") == set()


def labels_of(text):
    return {s[0] for s in license_scan.scan(license_scan.canonical(pa.array([text]))[0][0])["spans"]}


def test_other_licenses_within_the_edits_are_no_hits():
    for text in ("released under the mpl license", "small rights reserved", "overall rights reserved", "creative common attribution", "fully released under the bit license"):
        assert labels_of(text) == set(), text
    assert labels_of("all right reserved") == {"proprietary"} and labels_of("all rights reservedx") == {"proprietary"}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_notices(text):
    """Every stretch between blanks against every notice, with the fixed words in place."""
    blanks, out = [i for i, c in enumerate(text) if c == " "], set()
    for notice, label, edits, fixed in license_scan.NOTICES:
        before, after = f" {notice} ".split(f" {fixed} ", 1)
        for i in blanks:
            for j in blanks:
                span = text[i : j + 1]
                if abs(len(span) - len(notice) - 2) <= edits and f" {fixed} " in span:
                    for at in range(len(span)):
                        if span.startswith(f" {fixed} ", at):
                            head, tail = span[:at], span[at + len(fixed) + 2 :]
                            if bool(head) == bool(before) and bool(tail) == bool(after) and distance(head[1:], before[1:]) + distance(tail[:-1], after[:-1]) <= edits:
                                out.add(label)
    return out


def test_fuzzy_labels_are_those_of_edit_distance():
    import random

    for seed in range(120):
        r = random.Random(seed)
        notice, _, edits, _ = r.choice(license_scan.NOTICES)
        x = list(notice)
        for _ in range(r.randint(0, edits + 1)):
            at = r.randrange(len(x))
            x[at : at + r.randint(0, 1)] = r.choice(["", "q", "e"])
        text = f"{words(3, seed)} {''.join(x)} {words(3, seed + 999)}"
        canonical = license_scan.canonical(pa.array([text]))[0][0]
        phrases = {label for phrase, label in license_scan.PHRASES.items() if f" {phrase} " in canonical.decode()}
        assert labels_of(text) == plain_notices(canonical.decode()) | phrases, text


def test_license_scan_of_odd_tables(spark, docs, none):
    assert license_scan.license_scan(none).collect() == []
    d = docs.selectExpr("*", "1 AS labels", "2 AS n_words", "3 AS kept")
    out = license_scan.license_scan(d, carry=tuple(d.columns))
    assert out.columns == [*docs.columns, "kept", *license_scan.RESULTS] and {r.kept for r in out.collect()} == {3}
    text = "gnu general public license " * 3 + "all rights reserved all rights reserved"
    spans = license_scan.scan(license_scan.canonical(pa.array([text]))[0][0])["spans"]
    assert sorted(x[1] for x in spans) == [0, 4, 8, 12, 15]


def test_seeds_cover_a_notice():
    for notice, _, edits, _ in license_scan.NOTICES:
        parts = license_scan.seeds(notice, edits)
        assert len(parts) == edits + 1 and b"".join(p for _, p in parts) == notice.encode() and min(len(p) for _, p in parts) >= 9


# 3: mixing


def test_mix_keeps_budgets_and_limits(spark):
    rows = [(i, words(5 + i % 7, i), "big" if i < 300 else f"s{i % 3}") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(d, repeats=2.0).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    copies = Counter()
    for r in out:
        copies[r.source] += r.mix_copies * r.mix_tokens
        assert r.mix_copies >= 1
    least = min(sizes, key=sizes.get)
    assert copies["big"] == sizes["big"] and 1.85 <= copies[least] / sizes[least] <= 2.0
    assert mixing.realised(d, repeats=2.0).count() == sum(r.mix_copies for r in out)


def test_entropy_target(spark):
    s = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, n_tokens bigint")
    a = mixing.exponent(s, entropy=0.9)
    p = [(n / 1110) ** a for n in (1000, 100, 10)]
    assert abs(-sum(x / sum(p) * math.log(x / sum(p)) for x in p) - 0.9) < 1e-6


def test_mix_of_odd_documents(docs, none):
    rows = mixing.mix(docs, repeats=2.0, natural_budget=True).collect()
    assert len(rows) == docs.count()
    assert mixing.mix(none, repeats=2.0).collect() == []


def test_mix_within_a_budget_takes_whole_documents_in_order(spark):
    rows = [(i, words(5 + i % 7, i), "big" if i < 300 else f"s{i % 3}") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(d, repeats=1.5, budget=2000).collect()
    size, taken = Counter(), Counter()
    for r in out:
        size[r.source] += r.mix_tokens
        taken[r.source] += r.mix_tokens * r.mix_copies
    weight = {r.source: r.mix_weight for r in out}
    assert abs(sum(weight.values()) - 1) < 1e-9
    for s, w in weight.items():
        assert w * 2000 <= 1.5 * size[s] + 1 and w * 2000 - 12 <= taken[s] <= w * 2000 + 1


def test_mix_with_clashing_names_and_repeated_ids(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (1, "c", "y"), (None, None, None), (2, "d " * 50000, "y")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    d = d.selectExpr("*", "1 AS rest", "2 AS before", "3 AS passes", "4 AS mix_tokens", "5 AS n_tokens", "6 AS carried", "7 AS c", "8 AS mix_source", "9 AS own", "10 AS mix_id")
    out = mixing.mix(d, repeats=2.0)
    assert out.columns == [c for c in d.columns if c != "mix_tokens"] + mixing.ADDED
    assert sorted(r.mix_tokens for r in out.collect()) == [0, 1, 2, 2, 50000]
    back = mixing.realised(d, repeats=2.0)
    assert back.columns == d.columns and back.dtypes == d.dtypes
    assert {tuple(r)[3:] for r in back.collect()} == {(1, 2, 3, 4, 5, 6, 7, 8, 9, 10)} and {(r.doc_id, r.text) for r in back.collect()} == {r[:2] for r in rows}


# 4: language model


def test_scores_are_those_of_a_trie(docs, none):
    rows = docs.select("doc_id", "text").collect()
    trie, count = language_model.Trie(2), Counter()
    tokens = lambda t: re.findall(SPACES, lower(t)) + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    for r in rows:
        if not held(r.doc_id):
            count.update(tokens(r.text))
            b = bytes(2) + (r.text or "").encode()
            for i in range(2, len(b)):
                trie.learn(b[i - 2 : i], b[i])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for r in rows:
        t = tokens(r.text)
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        want[r.doc_id, held(r.doc_id), len(t), sum(count[x] > 0 for x in t), n, round(base, 4), round(trie.score((r.text or "").encode(), False), 2)] += 1
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 2)) for r in language_model.score(docs).collect())
    assert got == want
    assert language_model.score(none).collect() == []


def test_scores_without_rows_to_learn_from(spark):
    d = spark.createDataFrame([(1, "abc abc"), (2, None), (3, "x" * 3_000_000)], "doc_id bigint, text string").selectExpr("*", "1 AS score", "2 AS n_tokens")
    for order in (2, 5):
        got = {r.doc_id: r for r in language_model.score(d, F.lit(True), order).collect()}
        assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 for r in got.values())
        assert abs(got[1].score - 7 * math.log10(1 / 256)) < 1e-3 and got[2].score == 0 and abs(got[3].score / 3_000_000 - math.log10(1 / 256)) < 1e-4


def test_rare_words_are_joined(docs, monkeypatch):
    one = sorted(map(str, language_model.score(docs).select("doc_id", "n_known", F.round("base_score", 6)).collect()))
    monkeypatch.setattr(language_model, "FREQUENT", 1)
    assert one == sorted(map(str, language_model.score(docs).select("doc_id", "n_known", F.round("base_score", 6)).collect()))


@pytest.mark.parametrize("common", [language_model.COMMON, 1, 50])
def test_long_contexts_are_those_of_a_trie(spark, none, monkeypatch, common):
    rows = [(i, " ".join(f"w{(i * k) % 7} abcdef{(i + k) % 5}é" for k in range(i % 13))) for i in range(1, 60)] + [(60, None), (61, "zq!zq"), (None, "w3 abcdef1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(language_model, "COMMON", common)
    monkeypatch.setattr(language_model, "GATHER_GRAMS", 100)
    for order in (3, 5):
        trie = language_model.Trie(order)
        held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 0
        for i, text in rows:
            if not held(i):
                b = bytes(order) + (text or "").encode()
                for k in range(order, len(b)):
                    trie.learn(b[k - order : k], b[k])
        rule = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 0
        got = {r.doc_id: r.score for r in language_model.score(docs, rule, order).collect()}
        for i, text in rows:
            assert abs(got[i] - trie.score((text or "").encode(), False)) < 1e-6
    assert language_model.score(none, order=5).collect() == []


def test_probabilities_sum_to_one():
    import numpy as np

    table = language_model.table_of(np.array([97 << 16 | 98 << 8 | 99, 97 << 16 | 98 << 8 | 100, 98 << 8 | 99]), np.array([3, 1, 2]))
    for a, b in ((97, 98), (0, 98), (5, 5)):
        assert abs(sum(10.0 ** table[a << 16 | b << 8 : (a << 16 | b << 8) + 256].astype(float)) - 1) < 1e-5


def test_learning_lowers_the_cost_of_repeats(spark):
    d = spark.createDataFrame([(1, "abcabcabc" * 9), (2, words(16, 9)[:81])], "doc_id bigint, text string")
    a, b = (r.adaptive_score for r in language_model.adaptive(d).orderBy("doc_id").collect())
    assert b < a < 0


# 5: repeated passages


def plain_removal(rows, width=phrase_dedup.WIDTH):
    seen, out = set(), []
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for at in range(len(b) - width + 1):
            w = b[at : at + width]
            if w in seen:
                gone[at : at + width] = b"\1" * width
            seen.add(w)
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(b)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return Counter(out)


def test_removal_is_the_plain_one(spark, docs, none):
    order = lambda r: (r[0] is None, r[0] or 0)
    rows = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=order)
    got = Counter(tuple(r) for r in phrase_dedup.dedup(docs).collect())
    assert got == plain_removal(rows)
    assert phrase_dedup.dedup(none).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_removal_in_texts_full_of_copies(spark, seed):
    import random

    r = random.Random(seed)
    pool = [words(r.randint(8, 60), 100 + k) for k in range(8)]
    rows = [(i, " ".join(r.choice(pool)[r.randint(0, 30) :] for _ in range(r.randint(1, 6))) if i % 9 else "ab" * r.randint(40, 200)) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for limits in (phrase_dedup.Limits(), phrase_dedup.Limits(block=3000, piece=400), phrase_dedup.Limits(block=1000, piece=300, most_kinds=3), phrase_dedup.Limits(most_kinds=0)):
        assert Counter(tuple(x) for x in phrase_dedup.dedup(d, limits=limits).collect()) == plain_removal(rows)


def test_a_trigger_of_many_phrases_and_documents_larger_than_blocks(spark):
    common = words(6, 77)[:40]
    rows = [(i, words(9, 1000 + i) + common + words(9, 5000 + i % 50)) for i in range(400)] + [(1000, words(4000, 8)), (1001, words(4000, 8)[777:] + "x"), (999, "ab" * 9000)]
    d = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    want = plain_removal(sorted(rows))
    for limits in (phrase_dedup.Limits(), phrase_dedup.Limits(block=2000, piece=1000, most_kinds=20)):
        assert Counter(tuple(x) for x in phrase_dedup.dedup(d, limits=limits).collect()) == want


def test_removal_with_clashing_names_ids_and_repeated_rows(spark):
    a = words(60, 5)
    rows = [(None, a, 1), (None, a, 1), (2, a, 2), (2, a, 3), (7, None, 4)]
    d = spark.createDataFrame(rows, "doc_id smallint, text string, n_bytes int")
    d = d.selectExpr("*", "1 AS block", "2 AS `row`", "3 AS tie", "map(1, 2) AS carried", "4 AS c", "5 AS kept", "6 AS bucket")
    out = phrase_dedup.dedup(d, keep=True, carry=tuple(d.columns))
    assert out.columns == ["doc_id", "block", "row", "tie", "carried", "c", "bucket", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    got = out.collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got) == plain_removal([(2, a), (2, a), (7, None), (None, a), (None, a)])
    assert {(r.block, r.row, r.tie, r.c, r.bucket, r.carried[1]) for r in got} == {(1, 2, 3, 4, 6, 2)}
    with pytest.raises(TypeError):
        phrase_dedup.dedup(d.withColumn("doc_id", F.col("doc_id").cast("string")))


# 6: audio


def test_audio_round_trip_and_features(docs, none):
    seen = {}
    for r in audio_features.audio_columns(docs, carry=("doc_id", "text"), keep=True).collect():
        raw = (r.text or "").encode()
        pad = raw + bytes((64 - len(raw) % 64) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media.endswith(pad)
        assert seen.setdefault(r.text or "", r.feature) == r.feature
        table = pa.ipc.open_stream(pa.BufferReader(r.tensors)).read_all()
        assert (r.n_tensors, r.tensor_bytes, r.tensor_sha256) == (table.num_rows, len(r.tensors), hashlib.sha256(r.tensors).hexdigest())
        assert table["log_mel"].type.shape == [98, 40] and table.num_rows >= 1
        assert all(0 <= s.start_s < s.end_s for s in r.spans)
    assert audio_features.audio_columns(none).collect() == []


def test_a_tone_lands_in_its_band_and_span():
    import numpy as np

    p = audio_features.Params()
    t = np.arange(p.rate * 2)
    x = np.where((t > 8000) & (t < 24000), 100 * np.sin(2 * np.pi * 1000 * t / p.rate), 0) + 128
    text, spans, _, _ = audio_features.features(audio_features.to_wav(x.astype(np.uint8).tobytes(), p.rate), p)
    assert len(spans) == 1 and abs(spans[0][0] - 0.5) < 0.05 and abs(spans[0][1] - 1.5) < 0.05
    bank = audio_features.mel(p.bands, p.fft, p.to_rate)
    assert abs(int(text.rsplit("band=")[1]) - int(np.argmax(bank[round(1000 * p.fft / p.to_rate)]))) <= 1


def test_blocks_of_frames_join_without_seams():
    import numpy as np

    p = audio_features.Params()
    media = audio_features.to_wav(np.random.default_rng(1).integers(0, 255, 64 * p.rows * p.hop * 2 + 5000, np.uint8).tobytes(), p.rate)
    small = audio_features.Params(rows=7)
    a, b = (np.concatenate(list(audio_features.log_mel(media, q))) for q in (p, small))
    assert a.shape == b.shape and np.allclose(a, b, atol=1e-3)


def test_features_are_those_of_a_plain_convolution(spark):
    import numpy as np

    p = audio_features.Params()
    raw = ("The quick brown fox, " * 400 + "~" * 5000 + "zzz\x01" * 700).encode()
    row = audio_features.audio_columns(spark.createDataFrame([(1, raw.decode())], "doc_id bigint, text string"), keep=True).first()
    x = (np.frombuffer(audio_features.payload(raw), np.uint8).astype(float) - 128) / 128
    down = p.rate // p.to_rate
    t = np.arange(2 * p.taps) - (2 * p.taps - 1) / 2
    h = np.sinc(t / down) / down * np.hanning(2 * p.taps + 2)[1:-1]
    y = np.convolve(np.concatenate([np.zeros(p.taps), x, np.zeros(2 * p.taps)]), (h / h.sum())[::-1], "full")[2 * p.taps :][::down]
    n = len(x) * p.to_rate // p.rate
    frames = max(1, -(-(n - p.frame) // p.hop) + 1)
    y = np.concatenate([y[:n], np.zeros(p.frame * 2)])
    want = []
    for i in range(frames):
        part = y[i * p.hop : i * p.hop + p.frame] * np.hanning(p.frame)
        spectrum = [abs(sum(part * np.exp(-2j * np.pi * k * np.arange(p.frame) / p.fft))) ** 2 for k in range(p.fft // 2 + 1)] if i % 40 == 0 else np.abs(np.fft.rfft(part, p.fft)) ** 2
        want.append(np.log(np.array(spectrum) @ audio_features.mel(p.bands, p.fft, p.to_rate) + 1e-6))
    table = pa.ipc.open_stream(pa.BufferReader(row.tensors)).read_all()
    got = np.concatenate([c.to_numpy_ndarray() for c in table["log_mel"].chunks]).reshape(-1, p.bands)
    assert int(sum(table["n_frames"].to_pylist())) == frames == int(row.feature.split(";")[0].split("=")[1])
    inner = slice(2, frames - 4)  # the ends of the payload are taken as silence in either
    assert np.abs(got[:frames][inner] - np.array(want)[inner]).max() < 0.02
    starts, ends = table["start_s"].to_pylist(), table["end_s"].to_pylist()
    assert starts == [i * p.rows * p.hop / p.to_rate for i in range(len(starts))] and abs(ends[-1] - ((frames - 1) * p.hop + p.frame) / p.to_rate) < 1e-9


def test_audio_with_clashing_names(docs):
    d = docs.selectExpr("*", "1 AS feature", "2 AS spans", "3 AS media")
    out = audio_features.audio_columns(d, carry=tuple(d.columns))
    assert len(out.columns) == len(set(out.columns)) and {r.media for r in out.collect()} == {3}


# 7: near duplicates


def bag(text):
    w = re.findall(SPACES, text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def plain_classes(rows, least=0.8):
    bags, root = [bag(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(bags):
        for j, b in enumerate(bags[:i]):
            both = sum((a & b).values())
            if a == b or both >= least * (sum(a.values()) + sum(b.values()) - both) - 1e-9 and both:
                root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    return Counter((d, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for d in g)


def test_classes_are_the_plain_ones(spark, docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = bag_minhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == plain_classes(rows)
    assert sum(r.is_first for r in got) == len({r.class_id for r in got})
    assert bag_minhash.near_duplicates(none).collect() == []


def test_classes_hang_on_no_split_of_files(spark, tmp_path):
    """Files are split anew before each job, as when executors come and go."""
    rows = [(r[0], r[1]) for r in documents()] + [(1000 + i, words(30 + i // 2, i // 2)) for i in range(300)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7).write.parquet(str(tmp_path / "d"))
    docs, want = spark.read.parquet(str(tmp_path / "d")), plain_classes(rows)
    was, staged, turn = spark.conf.get("spark.sql.files.maxPartitionBytes"), bag_minhash.staged, []

    def shaken(df, name):
        turn.append(name)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(4096 + 977 * len(turn)))
        spark.conf.set("spark.sql.files.openCostInBytes", str(1 + 31 * len(turn)))
        return staged(df, name)

    bag_minhash.staged = shaken
    try:
        got = bag_minhash.near_duplicates(docs).collect()
    finally:
        bag_minhash.staged = staged
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want and len(turn) > 5


def test_classes_with_clashing_names_and_ids(spark):
    rows = [("b", words(30, 1), 1), ("a", words(30, 1), 2), (None, words(30, 1), 3), ("a", words(30, 1), 4), ("z", None, 5)]
    d = spark.createDataFrame(rows, "doc_id string, text string, `row` int").selectExpr("*", "7 AS bag", "8 AS carried", "9 AS class_id", "1 AS c", "2 AS component")
    out = bag_minhash.near_duplicates(d, carry=tuple(d.columns))
    assert out.columns == ["doc_id", "text", "row", "bag", "carried", "c", "component", "n_shingles", "class_id", "class_size", "is_first"]
    got = out.collect()
    assert sorted((r.row, r.class_id, r.class_size) for r in got) == [(1, "a", 4), (2, "a", 4), (3, "a", 4), (4, "a", 4), (5, "z", 1)]
    assert sum(r.is_first for r in got) == 2 and {r.doc_id for r in got if r.is_first} == {"a", "z"} and {(r.bag, r.carried, r.c, r.component) for r in got} == {(7, 8, 1, 2)}


def test_recall_on_a_whole_table(spark):
    """All pairs of sf0.01 at 0.8 or more, by a plain index of shingles, against the classes: none that a link joins may be apart."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    bags, where, both = {i: bag(t) for i, t in rows}, {}, Counter()
    for i, b in bags.items():
        for k in b:
            where.setdefault(k, []).append(i)
    for k, ids in where.items():
        for x, i in enumerate(ids):
            for j in ids[:x]:
                both[j, i] += min(bags[i][k], bags[j][k])
    size = {i: sum(b.values()) for i, b in bags.items()}
    pairs = {p for p, n in both.items() if n >= 0.8 * (size[p[0]] + size[p[1]] - n) - 1e-9}
    got = {r.doc_id: r.class_id for r in bag_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    found = sum(got[a] == got[b] for a, b in pairs)
    print(f"recall {found} of {len(pairs)}, not exact {sum(bags[a] != bags[b] for a, b in pairs)}")
    assert len(pairs) > 50 and found >= 0.9 * len(pairs)


@pytest.mark.parametrize("spread", [6, 40])
def test_a_family_larger_than_a_group(spark, spread):
    import random

    base, rows = words(150, 1).split(), []
    for i in range(60):
        r, w = random.Random(i), list(base)
        for _ in range(r.randint(0, spread)):
            w[r.randrange(150) if spread < 10 else r.randrange(30)] = f"x{r.random()}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = bag_minhash.near_duplicates(d, part=4).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == plain_classes(rows)


def test_signatures_estimate_weighted_similarity():
    import numpy as np

    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = rng.integers(0, 12, 400), rng.integers(0, 12, 400)
    row = np.repeat([0, 1], 400)[np.concatenate([a, b]) > 0]
    weight = np.concatenate([a, b])
    sig = bag_minhash.signatures(row, np.tile(h, 2)[weight > 0], weight[weight > 0], 2, slots=4096)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i != 20], "a bigint, b bigint")
    got = {r.id: r.component for r in components(e).collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(41)}


# 8: urls


def test_url_verdicts(spark):
    cases = [
        ("http://www.example.com/en/1?x", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("https://Blog.Example.com/en/2", "blog.example.com", "/en/2", "example.com/en/", "block"),
        ("https://a.net/es/", "a.net", "/es/", "net/es/", "block"),
        ("https://cheap-pills.com/x", "cheap-pills.com", "/x", "com/", "allow"),
        ("https://casino.example.org/x", "casino.example.org", "/x", None, "block"),
        ("https://free.win.example.org/", "free.win.example.org", "/", None, "block"),
        ("https://freewin.example.org/", "freewin.example.org", "/", None, "allow"),
        ("https://free.example.org/free#win", "free.example.org", "/free", None, "block"),
        ("no scheme casino", "", "", None, "block"),
        ("http://x.org", "x.org", "", None, "allow"),
        ("a://b://com/", "b:", "//com/", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ]
    d = spark.createDataFrame([(i, c[0], 1) for i, c in enumerate(cases)], "page_id bigint, url string, n_soft int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_vocabulary.verdicts(d).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


def test_a_vocabulary_from_a_table_with_weights(spark, none):
    table = spark.createDataFrame([("Evil", 3.0), ("evil", 1.0), ("half", 1.5), ("third", 1.0), (None, 9.0), ("", 9.0), ("void", 0.0)], "term string, weight double")
    terms = url_vocabulary.load(table)
    assert terms == {"evil": 3.0, "half": 1.5, "third": 1.0}
    urls = ["http://a.org/evil", "http://a.org/half", "http://a.org/half/half", "http://a.org/half-third", "http://a.org/third" + "/x" * 50000, "http://a.org/void", "http://a.org/evil"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr("*", "1 AS weight", "2 AS host", "3 AS _x")
    got = {r.page_id: (r.n_strict, r.n_soft, r.weight, r.verdict) for r in url_vocabulary.verdicts(d, terms=terms, threshold=2.5).collect()}
    assert got == {0: (1, 0, 3.0, "block"), 1: (0, 1, 1.5, "allow"), 2: (0, 1, 1.5, "allow"), 3: (0, 2, 2.5, "block"), 4: (0, 1, 1.0, "allow"), 5: (0, 0, 0.0, "allow"), 6: (1, 0, 3.0, "block")}
    assert url_vocabulary.verdicts(none.selectExpr("doc_id AS page_id", "text AS url")).collect() == []
    assert {r.verdict for r in url_vocabulary.verdicts(d, terms={}).collect()} == {"allow"}
    assert url_vocabulary.verdicts(d.select("page_id", F.col("url").alias("path")), url="path").count() == 7


# 9: preferences


def test_pairs_share_their_prompt(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "abcdef"), (1, 2, "user", "so?"), (2, 0, "user", None), (3, 0, None, "x"), (3, 0, None, "x"), (None, 1, "assistant", "é" * 5)]
    d = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    got = {r.pair_id: r for r in preferences.format_pairs(preferences.self_negatives(d)).collect()}
    one = got[1]
    assert one.n_shared == 1 and one.prompt == "<|user|>\nhi<|end|>\n" and not one.identical
    assert one.chosen == "<|assistant|>\nabcdef<|end|>\n<|user|>\nso?<|end|>\n" and one.rejected.startswith("<|assistant|>\nabc<|end|>")
    for text, mask in ((one.chosen, one.chosen_mask), (one.rejected, one.rejected_mask)):
        assert sum(int(x.split(":")[1]) for x in mask.split(",")) == len(text)
    assert got[2].identical and got[2].chosen == got[2].chosen_mask == ""
    assert got[3].prompt.count("x") == 2 and got[None].n_shared == 0


def test_pairs_of_odd_tables(spark, none):
    turns = none.selectExpr("doc_id AS conv_id", "doc_id AS turn", "lang AS role", "text")
    assert preferences.format_pairs(preferences.self_negatives(turns)).collect() == []
    d = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i} " * 500) for i in range(300)], "conv_id bigint, turn bigint, role string, text string")
    r = preferences.format_pairs(preferences.self_negatives(d.selectExpr("*", "1 AS turns", "2 AS chosen"))).first()
    assert r.n_shared == 299 and r.chosen.endswith("<|end|>\n") and len(r.rejected) < len(r.chosen)


# 10: quality rules


def test_measurements_are_the_plain_ones(docs, none):
    for r in quality_rules.ledger(docs.withColumn("bits", F.lit("clash"))).collect():
        text = r.text or ""
        w, lines = re.findall(SPACES, text), [x for x in text.split("\n") if re.search(SPACES, x)]
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == want
        assert bool(r.bits & 3) == (len(w) < 20 or 100 * len(again) > 30 * len(w))
    assert quality_rules.ledger(none).collect() == []


def test_ablations_count_what_a_rule_alone_costs(docs):
    rows = quality_rules.ledger(docs).cache()
    bits = [r.bits for r in rows.collect()]
    for r in quality_rules.ablations(rows).collect():
        every, one = quality_rules.mask(quality_rules.POLICIES[r.policy]), quality_rules.mask([r.rule])
        assert r.kept == sum(not b & every for b in bits)
        assert r.kept_without == sum(not b & every & ~one for b in bits)
        assert r.failed_alone == sum(b & every == one for b in bits)
    assert quality_rules.RULES == [name for name, _ in quality_rules._rules()]
