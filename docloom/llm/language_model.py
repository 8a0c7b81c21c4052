"""Language-model scoring: prediction by partial matching over bytes.

A trie of byte contexts holds how often each byte followed each context of up to ``order``
bytes (five in the query) in the training texts. A byte is predicted by the longest context; one that never
followed it there is reached by an escape (method C: as likely as the context has distinct
followers) to the next shorter context, where the bytes that the longer one has are
excluded. The score of a text is its log10 probability. ``adaptive`` scores texts one by
one with a trie that starts empty and learns from the text itself.

Beside it stands a base score of words with additive smoothing. Both need counts over the
whole training corpus, which Spark sums after each task has added up its own. A trie of two
bytes has at most 2 ** 24 counts, whatever the corpus, so it can be broadcast. A longer one
grows with the corpus: joins between its orders give the log10 probability of every gram (a
context and the byte after it) that any document has. Words with at least one in
``FREQUENT`` of all tokens and grams with one in ``COMMON`` of all bytes are broadcast, of
which there are at most as many; all others are joined to the documents that have them.

Nulls, ties and odd tables: null texts count as empty: one token, the end. A null id is hashed
as the empty string. Rows are scored one by one, also those with repeated ids, and equal texts
get equal scores. Without rows to learn from, N and V are 0 and every byte costs what one of 256
equal ones costs. Long texts are scored in slices. An empty table gives no rows. Other columns
are left aside, so their names can't clash.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import SPACE, beside, packed, slices, staged, text_bytes, words

FREQUENT = 1 << 20
#: Longer words, in bytes, are always joined: this bounds what is broadcast.
LONGEST = 64
#: As ``FREQUENT``, for grams of contexts over two bytes.
COMMON = 1 << 22
#: Distinct grams of which a task keeps the sum before it passes them on.
GATHER_GRAMS = 1 << 21
#: Bytes of context in the query; a gram of one more has to fit a code.
ORDER = 5
#: Distinct words of which a task keeps the sum before it passes them on.
GATHER = 250_000
#: Bytes of text that are counted or scored at a time: grams take some fifty bytes for each.
TEXT_BYTES = 1 << 20

WORD, END, GRAM, HELD = 0, 1, 2, 3  # kinds of keys; HELD: grams of rows that aren't trained on

#: First byte of grams where they stand among words, which have no white space.
MARK = 9

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def grams(data: np.ndarray, off: np.ndarray, order: int = 2) -> np.ndarray:
    """Of each byte: the ``order`` before it in its text (zeros at the start) and itself, as one number."""
    code = data.astype(np.int64)
    place = np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))
    out = code.copy()
    for k in range(1, order + 1):
        before = np.zeros(len(data), np.int64)
        before[k:] = code[:-k]
        before[place < k] = 0
        out |= before << (8 * k)
    return out


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of all parts, in order, and the sums of their counts."""
    code, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
    return code[first], np.add.reduceat(n[order], first) if len(first) else n


def _lower_words(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    is_word = ~SPACE[data]
    starts, _, row = words(data, off, is_word)
    return packed(LOWER[data], is_word, starts), row


def training_counts(docs: DataFrame, order: int = 2) -> DataFrame:
    """(kind, key, code, n) of words and ends over the rows with ``train`` set, and of byte grams (by code) over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, tables, parts = 0, [], {GRAM: [], HELD: []}

        def flush() -> pa.Table:
            return pa.concat_tables(tables).group_by("key").aggregate([("n", "sum")]).select(["key", "n_sum"]).rename_columns(["key", "n"])

        def out(kind: int, keys, n) -> Iterator[pa.RecordBatch]:
            table = pa.table({"kind": pa.array(np.full(len(n), kind), pa.int32()), "key": pa.chunked_array([keys]).cast(pa.binary()) if isinstance(keys, pa.Array) else keys.cast(pa.binary()), "code": pa.array(np.zeros(len(n), np.int64)), "n": n})
            yield from table.to_batches(max_chunksize=50_000)

        def out_grams(kind: int) -> Iterator[pa.RecordBatch]:
            code, n = parts[kind].pop()
            for a in range(0, len(code), 50_000):
                some = code[a : a + 50_000]
                columns = [pa.array(np.full(len(some), kind), pa.int32()), pa.array([b""], pa.binary()).take(pa.array(np.zeros(len(some), np.int64))), pa.array(some), pa.array(n[a : a + 50_000])]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "key", "code", "n"])

        for part in slices(batches, most=TEXT_BYTES):
            for kind in (GRAM, HELD):
                train = part.column("train")
                data, off = text_bytes(part.filter(train if kind == GRAM else pc.invert(train)).column("text"))
                code, n = np.unique(grams(data, off, order), return_counts=True)
                parts[kind].append((code, n.astype(np.int64)))
                if sum(len(c) for c, _ in parts[kind]) > GATHER_GRAMS:
                    parts[kind] = [summed(parts[kind])]
                    if len(parts[kind][0][0]) > GATHER_GRAMS // 2:
                        yield from out_grams(kind)
            part = part.filter(part.column("train"))
            data, off = text_bytes(part.column("text"))
            ends += part.num_rows
            got = _lower_words(data, off)[0].value_counts()
            tables.append(pa.table({"key": got.field("values"), "n": got.field("counts")}))
            if sum(t.num_rows for t in tables) > GATHER:
                tables = [flush()]
                if tables[0].num_rows > GATHER // 2:
                    yield from out(WORD, tables[0]["key"], tables[0]["n"])
                    tables = []
        if tables:
            table = flush()
            yield from out(WORD, table["key"], table["n"])
        for kind in (GRAM, HELD):
            if parts[kind]:
                parts[kind] = [summed(parts[kind])]
                yield from out_grams(kind)
        if ends:
            yield from out(END, pa.array([b""], pa.binary()), pa.array([ends], pa.int64()))

    return docs.select("text", "train").mapInArrow(run, "kind int, key binary, code bigint, n bigint").groupBy("kind", "key", "code").agg(F.sum("n").alias("n"))


def gram_logs(counts: DataFrame, order: int) -> DataFrame:
    """(code, everywhere, log): of each gram of ``training_counts`` how often it occurs in all rows, and its log10 probability.

    Followers of a context also follow its shorter ones, so what an order excludes is what the next longer context
    has: its total less E, the counts that those have in it, and its distinct ones less theirs. A trained gram
    ends at the longest order; the others go down from order to order.
    """
    mask = lambda k: F.col("code").bitwiseAND(F.lit((1 << (8 * k + 8)) - 1))
    trained = F.sum(F.when(F.col("kind") == GRAM, F.col("n")).otherwise(0))
    found = staged(counts.filter(F.col("kind").isin(GRAM, HELD)).groupBy("code").agg(trained.alias("n"), F.sum("n").alias("everywhere")), "lm-grams")
    levels = {order: found.filter("n > 0").select("code", "n")}
    for k in range(order - 1, -1, -1):
        levels[k] = staged(levels[k + 1].groupBy(mask(k).alias("code")).agg(F.sum("n").alias("n")), f"lm-level{k}")

    def contexts(k: int) -> DataFrame:
        rows = levels[k].select("code", "n", mask(k - 1).alias("shorter") if k else F.lit(0).alias("shorter"))
        up = rows.join(levels[k - 1].select(F.col("code").alias("shorter"), F.col("n").alias("up")), "shorter") if k else rows.withColumn("up", F.lit(0))
        return up.groupBy(F.shiftright("code", 8).alias("context")).agg(F.sum("n").alias("t"), F.count("*").alias("d"), F.sum("up").alias("e"))

    stats = {k: staged(contexts(k), f"lm-contexts{k}") for k in range(order + 1)}
    end = found.withColumn("context", F.shiftright("code", 8))
    seen = end.filter("n > 0").join(stats[order], "context").select("code", "everywhere", F.log10(F.col("n") / (F.col("t") + F.col("d"))).alias("log"))
    zero = F.lit(0).cast("bigint")
    rows = found.filter("n = 0").select("code", "everywhere", F.lit(0.0).alias("left"), F.lit(None).cast("double").alias("log"), zero.alias("de"), zero.alias("ee"))
    for k in range(order, -1, -1):
        own = levels[k].select(F.col("code").alias("gram"), "n")
        rows = rows.withColumn("gram", mask(k)).withColumn("context", F.shiftright("gram", 8))
        rows = rows.join(stats[k], "context", "left").join(own, "gram", "left").na.fill(0, ["t", "d", "e"])
        new = F.col("d") - F.col("de")
        total = F.col("t") - F.col("ee") + new
        rows = rows.select(
            "code",
            "everywhere",
            F.when(new > 0, F.col("left") + F.log10(F.try_divide(new, total))).otherwise(F.col("left")).alias("left"),
            F.coalesce("log", F.when(F.col("n").isNotNull(), F.col("left") + F.log10(F.try_divide("n", total)))).alias("log"),
            F.col("d").alias("de"),
            F.col("e").alias("ee"),
        )
    rest = F.col("left") - F.log10((F.lit(256) - F.col("de")).cast("double"))
    return staged(seen.unionByName(rows.select("code", "everywhere", F.coalesce("log", rest).alias("log"))), "lm-logs")


def table_of(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 probability of each byte after each two, from gram counts, by escapes with exclusion."""
    out = np.zeros((256, 256, 256), np.float32)  # counts, of which each second byte's are replaced in turn
    out.reshape(-1)[codes] = n
    pair = np.bincount(codes & 0xFFFF, weights=n, minlength=1 << 16).reshape(256, 256)
    single = pair.sum(axis=0)
    for b in range(256):
        left = np.ones((256, 1))  # what the escapes so far leave
        p = np.zeros((256, 256))
        open_ = np.ones((256, 256), bool)  # not excluded
        for counts in (out[:, b], np.broadcast_to(pair[b], (256, 256)), np.broadcast_to(single, (256, 256))):
            own = np.where(open_, counts, 0).astype(np.float64)
            distinct = (own > 0).sum(axis=1, keepdims=True)
            total = own.sum(axis=1, keepdims=True) + distinct
            with np.errstate(invalid="ignore", divide="ignore"):
                p = np.where(own > 0, left * own / total, p)
                left = np.where(distinct > 0, left * distinct / total, left)
            open_ &= ~(own > 0)
        p = np.where(open_, left / np.maximum(1, open_.sum(axis=1, keepdims=True)), p)
        out[:, b] = np.log10(p)
    return out.reshape(-1)


class Trie:
    """Counts by context for texts one by one; of any order, slowly."""

    def __init__(self, order: int = 2):
        self.order, self.counts = order, defaultdict(lambda: defaultdict(int))

    def learn(self, before: bytes, byte: int) -> None:
        for k in range(self.order + 1):
            self.counts[before[len(before) - k :] if k else b""][byte] += 1

    def probability(self, before: bytes, byte: int) -> float:
        left, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            own = {s: n for s, n in self.counts.get(before[len(before) - k :] if k else b"", {}).items() if s not in excluded}
            if own:
                total = sum(own.values()) + len(own)
                if byte in own:
                    return left * own[byte] / total
                left *= len(own) / total
                excluded |= own.keys()
        return left / (256 - len(excluded))

    def score(self, text: bytes, learn: bool) -> float:
        """log10 probability; contexts before the start are zeros."""
        padded, total = bytes(self.order) + text, 0.0
        for i in range(self.order, len(padded)):
            before = padded[i - self.order : i]
            total += math.log10(self.probability(before, padded[i]))
            if learn:
                self.learn(before, padded[i])
        return total


def adaptive(docs: DataFrame, text: str = "text", order: int = 2) -> DataFrame:
    """The rows with ``adaptive_score``: log10 probability under a trie that learns from the text as it goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for batch in batches:
            yield batch, [pa.array([Trie(order).score((t or "").encode(), True) for t in batch.column("judged").to_pylist()], pa.float64())]

    return beside(docs, text, {"adaptive_score": DoubleType()}, run)


#: A worker's table of the model that it has used last.
_TABLES: dict[str, np.ndarray] = {}


def score(docs: DataFrame, held_out: F.Column | None = None, order: int = 2) -> DataFrame:
    """Scores of all ``docs`` (doc_id, text), learnt from those that aren't held out, by contexts of ``order`` (2 to 6) bytes."""
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0 if held_out is None else held_out
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    counts = staged(training_counts(rows.withColumn("train", ~F.col("held_out")), order), "lm-counts")
    tokens = counts.filter(F.col("kind").isin(WORD, END))
    n, v = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    end = counts.filter(F.col("kind") == END).select("n").first()
    common = (F.col("kind") == WORD) & (F.length("key") <= LONGEST) & (F.col("n") * FREQUENT >= n)
    known = counts.filter(common).select("key", "n").toArrow()
    if order == 2:
        gram = counts.filter(F.col("kind") == GRAM).select("code", "n").toArrow()
    else:
        logs = gram_logs(counts, order)
        every = logs.agg(F.coalesce(F.sum("everywhere"), F.lit(0))).first()[0]
        often = F.col("everywhere") * COMMON >= every
        gram = logs.filter(often).select("code", F.col("log").alias("n")).toArrow().sort_by("code")
    denominator = n + 0.1 * (v + 1)
    shared = spark.sparkContext.broadcast(
        (known["key"].combine_chunks(), known["n"].to_numpy(), gram["code"].to_numpy(), gram["n"].to_numpy(), denominator, end[0] if end else 0)
    )

    this = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, c, code, many, below, ends = shared.value
        if order == 2 and this not in _TABLES:
            _TABLES.clear()
            _TABLES[this] = table_of(code, many)
        table, keys = _TABLES.get(this), keys.cast(pa.large_binary())
        logs = np.log10((np.append(c, 0) + 0.1) / below)
        for part in slices(batches, most=TEXT_BYTES):
            data, off = text_bytes(part.column("text"))
            size = part.num_rows
            upto = np.zeros(len(data) + 1)
            here = grams(data, off, order)
            if order == 2:
                own, far = table[here], np.zeros(0, np.int64)
            else:
                at = np.minimum(np.searchsorted(code, here), max(0, len(code) - 1))
                same = code[at] == here if len(code) else np.zeros(len(here), bool)
                own, far = np.where(same, many[at], 0.0) if len(code) else np.zeros(len(here)), np.flatnonzero(~same)
            np.cumsum(own, out=upto[1:], dtype=np.float64)
            found, row = _lower_words(data, off)
            coded = found.dictionary_encode()
            place = pc.fill_null(pc.index_in(coded.dictionary, keys), -1).to_numpy(zero_copy_only=False)
            idx = coded.indices.to_numpy(zero_copy_only=False)
            at = place[idx] if len(idx) else np.zeros(0, np.int64)
            hit = at >= 0
            base = np.bincount(row[hit], weights=logs[at[hit]], minlength=size) + math.log10((ends + 0.1) / below)
            out = {
                "row": part.column("row"),
                "doc_id": part.column("doc_id"),
                "held_out": part.column("held_out"),
                "token": pa.array([b" %d" % r for r in part.column("row").to_pylist()], pa.binary()),
                "tf": pa.array(np.zeros(size, np.int64)),
                "n_tokens": pa.array(np.bincount(row, minlength=size) + 1, pa.int64()),
                "n_known": pa.array(np.bincount(row[hit], minlength=size) + int(ends > 0), pa.int64()),
                "base": pa.array(base),
                "score": pa.array(upto[off[1:]] - upto[off[:-1]]),
            }
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
            distinct, which_gram = np.unique(here[far], return_inverse=True)
            raw = np.concatenate([np.full((len(distinct), 1), MARK, np.uint8), distinct.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 7 - order :]], axis=1)
            far_grams = pa.Array.from_buffers(pa.binary(order + 2), len(distinct), [None, pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())
            for names, of_row, of_name in ((coded.dictionary, row[~hit], idx[~hit]), (far_grams, np.searchsorted(off, far, "right") - 1, which_gram)):
                which, tf = np.unique(of_row * max(1, len(names)) + of_name, return_counts=True)
                for a in range(0, len(which), 50_000):
                    some = which[a : a + 50_000]
                    of = pa.array(some // len(names))
                    nulls = lambda kind: pa.nulls(len(of), kind)  # noqa: B023, E731
                    rest = [part.column("row").take(of), nulls(part.column("doc_id").type), nulls(pa.bool_()), names.take(pa.array(some % len(names))).cast(pa.binary())]
                    rest += [pa.array(tf[a : a + 50_000], pa.int64()), nulls(pa.int64()), nulls(pa.int64()), nulls(pa.float64()), nulls(pa.float64())]
                    yield pa.RecordBatch.from_arrays(rest, names=list(out))

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        run, f"row bigint, doc_id {kind}, held_out boolean, token binary, tf bigint, n_tokens bigint, n_known bigint, base double, score double"
    )
    rare = counts.filter((F.col("kind") == WORD) & ~common).select(F.col("key").alias("token"), "n", F.lit(None).cast("double").alias("log"))
    if order > 2:
        token = F.unhex(F.concat(F.lit(f"{MARK:02x}"), F.lpad(F.hex("code"), 2 * order + 2, "0")))
        rare = rare.unionByName(logs.filter(~often).select(token.alias("token"), F.lit(None).cast("bigint").alias("n"), "log"))
    joined = scored.join(rare, "token", "left")
    of_gram = F.substring("token", 1, 1) == F.unhex(F.lit(f"{MARK:02x}"))
    own = F.when((F.col("tf") > 0) & ~of_gram, F.col("tf") * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(denominator)))
    out = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0))).alias("n_known"),
        (F.max("base") + F.coalesce(F.sum(own), F.lit(0.0))).alias("base_score"),
        (F.max("score") + F.coalesce(F.sum(F.when(of_gram, F.col("tf") * F.col("log"))), F.lit(0.0))).alias("score"),
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), order=ORDER)
