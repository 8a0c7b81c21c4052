"""Exact removal of repeated passages: prefix-free parsing and suffix arrays.

Every string of ``WIDTH`` bytes that also starts earlier in the corpus is removed.
Documents are parsed into phrases at the triggers of a rolling hash: in each window of
WIDTH bytes the smallest hash of ``GRAM`` bytes is a trigger, so equal windows have equal
triggers at equal places. A phrase is all that the windows of one trigger cover, so every
window lies inside one phrase.

The corpus is dealt into blocks of documents. Each block sends its distinct phrases (its
dictionary) as trigger, fingerprint and first place; by trigger it is then known, of each
phrase, which block has its first place in the corpus (the parse). A phrase anywhere else
is repeated as a whole. A trigger of one phrase only needs no more. Where a trigger has
several phrases, each one's text is sent once, by the block of its first place, to the
bucket of the trigger; there the suffix array of this part of the dictionary gives the
order of all windows, and with the parse, which says where each phrase stands first, the
first place of every window in corpus order. A suffix array of the parse itself would
order windows that go on beyond a phrase, and there are none.

A trigger with more than ``most_kinds`` phrases (a hot one) isn't gathered: its windows
are dealt out by 128 bits of hashes of their bytes. Phrases are equal if 128 bits of
hashes are; windows of all other triggers are compared by bytes.

Nulls, ties and odd tables: null texts are empty. Ids are integers of any width (else
TypeError); null ids come last. Documents of equal ids are in a fixed order, by a hash of
all that is taken of the row, so nothing hangs on how files were split or on which executor
was lost. Rows that are equal in everything are copies like any others. An empty table gives
no rows. A text is parsed in pieces and cut by its spans, so beside a block a task holds a
few bytes for each byte of its longest text. Carried columns may have any names; the
operator's own results take the place of carried columns of their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructField, StructType

from .bag_minhash import BASE, mix, powers
from .common import text_bytes, tidy

WIDTH = 100
GRAM = 32
LAST_ID = np.int64((1 << 63) - 1)


@dataclass(frozen=True)
class Limits:
    """Bytes of text in a block and for each bucket, bytes that are parsed or sorted at a time, phrases of one trigger that are gathered."""

    block: int = 1 << 20
    bucket: int = 4 << 20
    piece: int = 256 << 10
    most_kinds: int = 1024


Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _hashes(data: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Sums of hashed bytes times powers, and the inverse powers: any range's hash is a difference times one of them."""
    upto = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(np.arange(seed, seed + 256, dtype=np.uint64))[data] * powers(len(data)), out=upto[1:])
    return upto, powers(len(data) + 1, True)


def _range(upto: np.ndarray, inverse: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((upto[b] - upto[a]) * inverse[a] + (b - a).astype(np.uint64))


def pieces(off: np.ndarray, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Parts of the data: their bounds, the offsets of texts in them, and what row each text is.

    A text of more than ``most`` bytes comes in pieces that overlap by a window less a byte.
    """
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        lo, hi = int(off[i]), int(off[j])
        if j > i + 1 or hi - lo <= most:
            yield lo, hi, off[i : j + 1] - lo, np.arange(i, j)
        else:
            for at in range(lo, max(lo + 1, hi - WIDTH + 1), most):
                end = min(hi, at + most + WIDTH - 1)
                yield at, end, np.array([0, end - at]), np.array([i])
        i = j


def _triggers(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last window, trigger and fingerprint of each phrase, as positions in the data; and its text."""
    n, none = len(data) - WIDTH + 1, np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none
    upto, inverse = _hashes(data)
    h = mix((upto[GRAM:] - upto[:-GRAM]) * inverse[: len(data) - GRAM + 1])
    low, span, wide = h & np.uint64(0xFFFFFFFFFFFFFF80), WIDTH - GRAM + 1, 1
    while 2 * wide <= span:  # smallest hash of so many, and in the low bits how far on it is
        low = np.minimum(low[:-wide], low[wide:] + np.uint64(wide))
        wide *= 2
    if span > wide:
        low = np.minimum(low[: wide - span], low[span - wide :] + np.uint64(span - wide))
    ok = np.zeros(len(data) + 1, np.int32)
    whole = np.diff(off) >= WIDTH
    np.add.at(ok, off[:-1][whole], 1)
    np.add.at(ok, off[1:][whole] - WIDTH + 1, -1)
    ok = np.cumsum(ok)[:n] > 0
    at = np.arange(n) + (low & np.uint64(127)).astype(np.int64)
    new, end = ok.copy(), ok.copy()
    same = ok[1:] & ok[:-1] & (at[1:] == at[:-1])
    new[1:] &= ~same
    end[:-1] &= ~same
    first, last = np.flatnonzero(new), np.flatnonzero(end)
    f = _range(upto, inverse, first, last + WIDTH)
    f = mix(f + (at[first] - first).astype(np.uint64) * BASE) | np.uint64(1)
    return first, last, h[at[first]], f, np.searchsorted(off, first, "right") - 1


def parse(data: np.ndarray, off: np.ndarray, piece: int) -> Runs:
    """Row, first and last window (positions in the row), trigger and fingerprint of every phrase, in corpus order."""
    out = [[], [], [], [], []]
    for lo, hi, cuts, rows in pieces(off, piece):
        first, last, h, f, text = _triggers(data[lo:hi], cuts)
        row = rows[text]
        for part, x in zip(out, (row, first + lo - off[row], last + lo - off[row], h, f)):
            part.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def dictionary_of(runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """The order by trigger, fingerprint and place, and which of these are the first of their kind."""
    row, first, _, h, f = runs
    by = np.lexsort((first, row, f, h))
    fresh = np.ones(len(by), bool)
    fresh[1:] = (h[by[1:]] != h[by[:-1]]) | (f[by[1:]] != f[by[:-1]])
    return by, fresh


def suffix_classes(data: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Ranks of the windows at ``starts`` in the order of the dictionary's suffixes, equal for equal windows."""
    padded = np.concatenate([data, np.zeros(width + 8, np.uint8)])
    key = np.zeros(len(data) + width, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + len(key)]
    rank, have = np.unique(key, return_inverse=True)[1], 8
    while have < width:  # suffixes by twice as many bytes, at last by all
        step = min(have, width - have)
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        if have + step == width:
            pair = pair[starts]
        rank, have = np.unique(pair, return_inverse=True)[1], have + step
    return rank


def _ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A block's documents in corpus order: table, ids, bytes and offsets."""
    ids = table.column("doc_id").cast(pa.int64()).fill_null(int(LAST_ID)).to_numpy()
    by = np.lexsort((table.column("tie").to_numpy(), table.column("doc_id").is_null().to_numpy(), ids))
    table = table.take(pa.array(by)).combine_chunks()
    text = table.column("text").cast(pa.large_binary()).combine_chunks()
    return table, ids[by], *text_bytes(text)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, by planes of bytes: those of small numbers are mostly zeros, which Spark's shuffle compresses."""
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)


def _unpack(raw: bytes, n: int) -> list[np.ndarray]:
    planes = np.frombuffer(raw, np.uint8).reshape(n, 8, -1)
    return [np.ascontiguousarray(p.T).view(np.uint64).reshape(-1) for p in planes]


def _steps(ids: np.ndarray) -> np.ndarray:
    """Ascending numbers as the first and the differences, which are small."""
    return np.diff(ids, prepend=0)


def _all(payloads: list[bytes], n: int, steps: int | None = None) -> list[np.ndarray]:
    """The columns of all payloads; the one in place ``steps`` was passed through ``_steps``."""
    parts = [_unpack(p, n) for p in payloads]
    if steps is not None:
        for p in parts:
            p[steps] = np.cumsum(p[steps])
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.uint64)] * n


def _runs_of(x: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    at = np.flatnonzero(np.diff(x, prepend=x[0] - 1)) if len(x) else x
    return list(zip(at.tolist(), np.append(at[1:], len(x)).tolist()))


MOVED = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary()), ("phrases", pa.binary())])
MOVED_DDL = "bucket bigint, block bigint, kind int, payload binary, phrases binary"
FIRST, TOLD, SPANS, PHRASES, WINDOWS = range(5)  # kinds of rows that are moved
COPY, COMPARE, HOT = 1, 2, 3  # what is told of a phrase

Row = tuple[int, int, int, bytes, bytes]


def _moved(rows: list[Row]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(MOVED.types)], schema=MOVED)


def _deal(key: np.ndarray, buckets: int, block: int, kind: int, ids: np.ndarray, *columns: np.ndarray) -> Iterator[Row]:
    """Rows of ids, in their order, and other columns, dealt out by a hash."""
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    for a, b in _runs_of(bucket[by]):
        yield int(bucket[by[a]]), block, kind, _pack(_steps(ids[by[a:b]]), *(c[by[a:b]] for c in columns)), b""


def _own(table: pa.Table, kind: int, n: int) -> tuple[np.ndarray, list[np.ndarray], list[bytes]]:
    """Of the rows of one kind: the block of each number, the columns of numbers, and the phrases."""
    mine = table.filter(pc.equal(table.column("kind"), kind))
    payloads = mine.column("payload").to_pylist()
    block = np.repeat(mine.column("block").to_numpy(), [len(p) // (8 * n) for p in payloads])
    return block, _all(payloads, n, 0), mine.column("phrases").to_pylist()


def send_phrases(table: pa.Table, buckets: int, limits: Limits) -> pa.Table:
    """A block's dictionary: each distinct phrase's trigger, fingerprint and first place."""
    table, ids, data, off = _ordered(table)
    runs = parse(data, off, limits.piece)
    by, fresh = dictionary_of(runs)
    one = np.sort(by[fresh])  # in corpus order
    out = _moved(list(_deal(runs[3][one], buckets, int(table.column("block")[0].as_py()), FIRST, ids[runs[0][one]], runs[3][one], runs[4][one], runs[1][one], runs[0][one])))
    tidy()
    return out


def judge_phrases(table: pa.Table, most_kinds: int) -> pa.Table:
    """For each block, its phrases that stand earlier elsewhere, and those whose windows must be compared."""
    block, (ids, h, f, at, of), _ = _own(table, FIRST, 5)
    by = np.lexsort((at, of, block, ids.view(np.int64), f, h))
    h, f, block = h[by], f[by], block[by]
    head = np.ones(len(h), bool)
    head[1:] = h[1:] != h[:-1]
    fresh = head.copy()
    fresh[1:] |= f[1:] != f[:-1]
    group = np.cumsum(head) - 1
    kinds = np.bincount(group, weights=fresh)[group] if len(h) else np.zeros(0)
    verdict = np.where(~fresh, COPY, np.where(kinds > most_kinds, HOT, np.where(kinds > 1, COMPARE, 0))).astype(np.uint64)
    told = np.flatnonzero(verdict)
    told = told[np.argsort(block[told], kind="stable")]
    out = [(0, int(block[told[a]]), TOLD, _pack(h[told[a:b]], f[told[a:b]], verdict[told[a:b]]), b"") for a, b in _runs_of(block[told])]
    tidy()
    return _moved(out)


def _verdicts(told: pa.Table, h: np.ndarray, f: np.ndarray) -> np.ndarray:
    """What is told of each phrase; 0 of those that aren't named."""
    kh, kf, verdict = _all(told.column("payload").to_pylist(), 3)
    key, want = mix(kh + kf * BASE), mix(h + f * BASE)
    by = np.argsort(key)
    key, kh, kf, verdict = key[by], kh[by], kf[by], verdict[by].astype(np.int64)
    if not len(key):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(key, want), len(key) - 1)
    return np.where((kh[at] == h) & (kf[at] == f), verdict[at], 0)


def send_windows(table: pa.Table, told: pa.Table, buckets: int, limits: Limits) -> pa.Table:
    """What a block knows to be repeated, the texts of phrases to compare, and windows of hot triggers."""
    table, ids, data, off = _ordered(table)
    block = int(table.column("block")[0].as_py())
    runs = parse(data, off, limits.piece)
    row, first, last, h, f = runs
    by, fresh = dictionary_of(runs)
    says = np.full(len(h), COPY)
    says[by[fresh]] = _verdicts(told, h[by[fresh]], f[by[fresh]])
    done = says == COPY
    spans = merged(row[done], first[done], last[done] + WIDTH)
    sent = [(block % buckets, block, SPANS, _pack(*spans), b"")] if len(spans[0]) else []
    one = np.flatnonzero(says == COMPARE)
    bucket = (h[one] % np.uint64(buckets)).astype(np.int64)
    o = np.argsort(bucket, kind="stable")
    one, bucket = one[o], bucket[o]
    for a, b in _runs_of(bucket):
        mine = one[a:b]
        size = last[mine] - first[mine] + WIDTH
        text = _gather(data, off[row[mine]] + first[mine], size).tobytes()
        sent.append((int(bucket[a]), block, PHRASES, _pack(_steps(ids[row[mine]]), h[mine], row[mine], first[mine], size), text))
    hot = np.flatnonzero(says == HOT)
    size = last[hot] - first[hot] + WIDTH
    for a, b in groups(size, np.arange(len(hot)), limits.piece):
        text, which, pos = _windows(data, off[row[hot[a:b]]] + first[hot[a:b]], size[a:b])
        keys = [_range(*_hashes(text, seed), pos, pos + WIDTH) for seed in (1, 1001)]
        mine, at = hot[a:b][which], pos - (np.cumsum(size[a:b]) - size[a:b])[which] + first[hot[a:b]][which]
        sent.extend(_deal(keys[0], buckets, block, WINDOWS, ids[row[mine]], *keys, row[mine], at))
    tidy()
    return _moved(sent)


def _gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Some ranges' bytes one after the other."""
    return data[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _windows(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some phrases' bytes one after the other; of each window in them, the phrase and the place there."""
    cut, many = np.cumsum(size) - size, size - WIDTH + 1
    which = np.repeat(np.arange(len(size)), many)
    return _gather(data, begin, size), which, cut[which] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def groups(size: np.ndarray, kind: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of phrases that together have about ``most`` bytes; those of one kind stay together."""
    starts = np.append(np.flatnonzero(np.diff(kind, prepend=-1)), len(kind)) if len(kind) else np.zeros(1, np.int64)
    total = np.append(0, np.cumsum(size))[starts]
    i = 0
    while i < len(starts) - 1:
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        yield int(starts[i]), int(starts[j])
        i = j


def merged(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal spans from overlapping or touching ones."""
    if not len(row):
        return row, a, b
    by = np.lexsort((a, row))
    row, a, b = row[by], a[by], b[by]
    far = np.int64(1) << 40
    end = np.maximum.accumulate(b + row * far)
    new = np.ones(len(row), bool)
    new[1:] = a[1:] + row[1:] * far > end[:-1]
    at = np.flatnonzero(new)
    return row[at], a[at], end[np.append(at[1:], len(row)) - 1] - row[at] * far


def judge_windows(table: pa.Table, limits: Limits) -> pa.Table:
    """For each block, the windows of its phrases that stand earlier; what blocks know themselves is passed on."""
    out = [(0, b, SPANS, p, b"") for k, b, p in zip(*(table.column(c).to_pylist() for c in ("kind", "block", "payload"))) if k == SPANS]
    found = []  # block, row and place of windows

    block, (ids, h, of, first, size), texts = _own(table, PHRASES, 5)
    if len(h):
        data = np.frombuffer(b"".join(texts), np.uint8)
        of, first, size, ids = (x.view(np.int64) for x in (of, first, size, ids))
        begin = np.cumsum(size) - size
        by = np.lexsort((first, of, block, ids, h))  # by trigger, then in corpus order
        h, block, ids, of, first, size, begin = (x[by] for x in (h, block, ids, of, first, size, begin))
        for a, b in groups(size, np.cumsum(np.diff(h, prepend=h[0]) != 0), limits.piece):
            text, which, pos = _windows(data, begin[a:b], size[a:b])
            rank = suffix_classes(text, pos)
            place = pos - (np.cumsum(size[a:b]) - size[a:b])[which] + first[a:b][which]
            o = np.lexsort((place, of[a:b][which], block[a:b][which], ids[a:b][which], rank))
            again = o[1:][rank[o[1:]] == rank[o[:-1]]]
            found.append((block[a:b][which[again]], of[a:b][which[again]], place[again]))

    block, (ids, key, other, of, at), _ = _own(table, WINDOWS, 5)
    if len(key):
        of, at = of.view(np.int64), at.view(np.int64)
        by = np.lexsort((at, of, block, ids.view(np.int64), other, key))
        again = by[1:][(key[by[1:]] == key[by[:-1]]) & (other[by[1:]] == other[by[:-1]])]
        found.append((block[again], of[again], at[again]))

    if found:
        block, of, at = (np.concatenate(x) for x in zip(*found))
        o = np.argsort(block, kind="stable")
        for a, b in _runs_of(block[o]):
            mine = o[a:b]
            out.append((0, int(block[mine[0]]), SPANS, _pack(*merged(of[mine], at[mine], at[mine] + WIDTH)), b""))
    tidy()
    return _moved(out)


def remove(table: pa.Table, told: pa.Table, keep: bool | str) -> pa.Table:
    """The documents of a block without what is repeated: each is cut by its own spans."""
    table, _, data, off = _ordered(table)
    row, a, b = merged(*(x.view(np.int64) for x in _all(told.column("payload").to_pylist(), 3)))
    n, n_spans = np.diff(off), np.bincount(row, minlength=table.num_rows)
    n_removed = np.bincount(row, weights=b - a, minlength=table.num_rows).astype(np.int64)
    upto, digests, kept = np.append(0, np.cumsum(n_spans)), [], []
    view = memoryview(np.ascontiguousarray(data))
    for i in range(table.num_rows):
        mine = slice(upto[i], upto[i + 1])
        parts = [view[off[i] + x : off[i] + y] for x, y in zip([0, *b[mine].tolist()], [*a[mine].tolist(), int(n[i])])]
        digest = hashlib.sha256()
        for part in parts:
            digest.update(part)
        digests.append(digest.hexdigest())
        if keep:
            whole = b"".join(parts)
            kept.append(whole.decode(errors="ignore") if keep == TEXT else whole)
    columns = [table.column("doc_id"), table.column("carried"), pa.array(n, pa.int64()), pa.array(n_removed), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())]
    if keep:
        columns.append(pa.array(kept, pa.string() if keep == TEXT else pa.binary()))
    out = pa.Table.from_arrays(columns, names=["doc_id", "carried", *results(keep)])
    tidy()
    return out


TEXT = "text"


def results(keep: bool | str) -> list[str]:
    return ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ([TEXT if keep == TEXT else "kept"] if keep else [])


def dedup(docs: DataFrame, keep: bool | str = False, carry: tuple[str, ...] = (), limits: Limits = Limits()) -> DataFrame:
    """doc_id and ``carry`` columns of all documents with bytes, bytes removed, spans removed and a digest of the rest.

    With ``keep`` also ``kept``, the bytes that remain; with ``keep="text"`` instead ``text``, the characters that
    are whole in them (a passage may begin or end inside a character). Other columns of ``docs`` are left aside.
    """
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"doc_id must be of an integer type, not {kind.simpleString()}")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, m = (max(8, -(-total // most)) for most in (limits.block, limits.bucket))
    columns = [c for c in carry if c not in ("doc_id", "text", *results(keep))]
    carried = F.struct(F.lit(0).alias("c"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns))).alias("carried")
    hashed = [F.col(f"`{c}`") for c in ("doc_id", "text", *columns) if "map<" not in docs.schema[c].dataType.simpleString()]  # Spark hashes no maps
    rows = docs.select("doc_id", "text", carried, F.xxhash64(*hashed).alias("tie")).withColumn("block", F.pmod(F.xxhash64("tie"), F.lit(n)))
    by_block = rows.groupBy("block")
    sent = by_block.applyInArrow(lambda t: send_phrases(t, m, limits), MOVED_DDL)
    told = sent.groupBy("bucket").applyInArrow(lambda t: judge_phrases(t, limits.most_kinds), MOVED_DDL)
    found = by_block.cogroup(told.groupBy("block")).applyInArrow(lambda t, u: send_windows(t, u, m, limits), MOVED_DDL)
    spans = found.groupBy("bucket").applyInArrow(lambda t: judge_windows(t, limits), MOVED_DDL)
    schema = StructType([StructField("doc_id", kind), rows.schema["carried"]]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    if keep:
        schema = schema.add(results(keep)[-1], "string" if keep == TEXT else "binary")
    out = by_block.cogroup(spans.groupBy("block")).applyInArrow(lambda t, u: remove(t, u, keep), schema)
    return out.select("doc_id", *(F.col(f"carried.c{i}").alias(c) for i, c in enumerate(columns)), *results(keep))


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
