"""SentencePiece encoding and decoding by matching against suffix arrays.

Texts of a batch are cut where a blank follows another character, and around ASCII
characters that no piece has. No piece crosses such a place (checked when a model is
loaded), so the distinct chunks stand for the texts. The
chunks are concatenated and their suffixes sorted. Every piece is found by binary search as a range of suffixes; each occurrence is an
edge from its first to its last byte. Edges are sorted by their ends and relaxed: the
encoding of a prefix ends with the longest edge whose piece may follow the last piece of
the encoding of what is before it. Two pieces may follow each other if merging by the
model's priorities wouldn't join them across their border, which gives exactly the
result of merging the best pair again and again.

Nulls, ties and odd tables: null texts give a null encoding, empty ones an empty encoding.
Very long chunks are relaxed one by one, in windows, so a text of any length fits. Of edges
that end together the longest that may follow is taken. Rows are encoded each for itself, so
repeated rows are repeated, and an empty table gives no rows. Other columns pass through, but
for those of the operator's own names, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType

from .common import beside, binary_array, lookup, slices, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"

#: Texts of one suffix array, in bytes before chunks are made distinct.
BATCH_BYTES = 2 << 20
#: Bytes of chunks whose edges are made at a time.
PART_BYTES = 128 << 10
#: Bytes by which suffixes are sorted; few pieces are longer.
DEPTH = 16
#: Chunks longer than this are relaxed one by one.
LONG = 512
#: Distinct chunks whose encodings a task keeps from batch to batch.
KEPT = 600_000

NONE = np.int64(1) << 40  # no merge


@dataclass
class Vocabulary:
    """Pieces by rank: single characters first, then merges from the best to the last."""

    ids: np.ndarray  # the model's id of each rank
    raw: list[bytes]  # the bytes of each rank, blanks as blanks
    left: np.ndarray  # the last merge of each rank; a rank itself where there is none
    right: np.ndarray
    pairs: np.ndarray  # sorted left * n + right of every merge, and what it gives
    merged: np.ndarray
    byte_ids: np.ndarray  # the id of each byte
    out: list[bytes]  # for decoding: the bytes of each id of the model
    order: list[int]  # ranks that are found in texts

    def __post_init__(self) -> None:
        heads = [self.raw[r][:8] for r in self.order]
        self.least = np.array([int.from_bytes(x.ljust(8, b"\0"), "big") for x in heads], np.uint64)
        self.most = np.array([int.from_bytes(x.ljust(8, b"\xff"), "big") for x in heads], np.uint64)

    @property
    def unknown(self) -> int:
        """The rank that stands for one character that isn't a piece."""
        return len(self.raw)


def load(path: str = MODEL) -> Vocabulary:
    """Read a byte-pair model that has byte pieces, no text normalisation, and no blank inside pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    out, byte_ids, normal = [b""] * n, np.zeros(256, np.int64), []
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            out[i] = bytes([int(piece[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            text = piece.replace("▁", " ")
            if " " in text.lstrip(" "):
                raise ValueError("pieces with a blank after another character aren't supported")
            out[i] = text.encode()
            normal.append((len(text) > 1, -model.get_score(i), i, text))
    normal.sort()
    rank = {t: r for r, (_, _, _, t) in enumerate(normal)}
    left, right = np.arange(len(normal) + 1), np.arange(len(normal) + 1)
    keys, merged, reach = [], [], []
    for r, (longer, _, _, text) in enumerate(normal):
        for cut in range(1, len(text)):
            if (a := rank.get(text[:cut])) is not None and (b := rank.get(text[cut:])) is not None:
                keys.append(a * (len(normal) + 1) + b)
                merged.append(r)
        if not longer:
            reach.append(r)
            continue
        parts = [rank.get(c) for c in text]
        while None not in parts and len(parts) > 1:  # the merges that lead to this piece
            best = min(((rank.get(normal[a][3] + normal[b][3], n), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(n, 0))
            if best[0] == n:
                break
            if len(parts) == 2 and best[0] == r:
                left[r], right[r] = parts
                reach.append(r)
            parts[best[1] : best[1] + 2] = [best[0]]
    by = np.argsort(keys)
    return Vocabulary(
        np.array([x[2] for x in normal]), [x[3].encode() for x in normal], left, right, np.array(keys, np.int64)[by], np.array(merged, np.int64)[by], byte_ids, out, reach
    )


def merges(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    key = a * (len(v.raw) + 1) + b
    at = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
    return np.where(v.pairs[at] == key, v.merged[at], NONE)


def may_follow(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging leaves the border between pieces ``a`` and ``b`` (ranks) alone.

    Undoes the merges of both pieces from the last to the first; the border holds if no
    merge across it would have come before the one undone last.
    """
    ok = np.ones(len(a), bool)
    live, a, b, limit = np.arange(len(a)), a.copy(), b.copy(), np.full(len(a), NONE)
    while len(live):
        crossed = merges(v, a, b) < limit
        ok[live[crossed]] = False
        first = a > b  # the left piece was merged later; equal ones: the left pair goes first
        limit_a, limit_b = a, b + 1
        whole_a, whole_b = v.right[a] == a, v.left[b] == b
        turn = np.where(first, ~whole_a, whole_b & ~whole_a)  # undo the left piece
        done = crossed | (whole_a & whole_b)
        a, b, limit = np.where(turn, v.right[a], a), np.where(turn, b, v.left[b]), np.where(turn, limit_a, limit_b)
        keep = ~done
        live, a, b, limit = live[keep], a[keep], b[keep], limit[keep]
    return ok


def suffixes(data: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions sorted by their next ``depth`` bytes, and these bytes as sorted keys of 8 bytes each."""
    padded = np.concatenate([data, np.zeros(depth + 8, np.uint8)])
    keys = []
    for at in range(0, depth, 8):
        key = np.zeros(len(data), np.uint64)
        for i in range(8):
            key = (key << np.uint64(8)) | padded[at + i : at + i + len(data)]
        keys.append(key)
    order = np.lexsort(keys[::-1])
    return order, [k[order] for k in keys]


def occurrences(keys: list[np.ndarray], piece: bytes, lo: int, hi: int) -> tuple[int, int]:
    """The range of suffixes in [lo, hi) that go on with these bytes, by binary search."""
    for key in keys:
        part, piece = piece[:8], piece[8:]
        least = int.from_bytes(part.ljust(8, b"\0"), "big")
        most = int.from_bytes(part.ljust(8, b"\xff"), "big")
        found = key[lo:hi]
        lo, hi = lo + int(np.searchsorted(found, np.uint64(least), "left")), lo + int(np.searchsorted(found, np.uint64(most), "right"))
        if not piece or lo == hi:
            break
    return lo, hi


def edges(v: Vocabulary, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, piece and chunk of every occurrence of a piece inside a chunk."""
    sizes = np.array([len(v.raw[r]) for r in v.order])
    order, keys = suffixes(data, DEPTH)
    lo, hi = np.searchsorted(keys[0], v.least, "left"), np.searchsorted(keys[0], v.most, "right")
    for i in np.flatnonzero((sizes > 8) & (hi > lo)):  # further bytes, where the first eight stand at all
        lo[i], hi[i] = occurrences(keys[1:], v.raw[v.order[i]][8:], lo[i], hi[i])
    count = hi - lo
    at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
    start = order[at]
    end = start + np.repeat(sizes, count)
    chunk = np.repeat(np.arange(len(off) - 1), np.diff(off))[start]
    inside = end <= off[chunk + 1]
    first = np.cumsum(count) - count
    for i in np.flatnonzero((sizes > DEPTH) & (count > 0)):  # the rest of the longest pieces is compared as it is
        rest, lo_, n = np.frombuffer(v.raw[v.order[i]][DEPTH:], np.uint8), first[i], count[i]
        own = np.arange(lo_, lo_ + n)[inside[lo_ : lo_ + n]]
        inside[own] = (data[start[own][:, None] + DEPTH + np.arange(len(rest))] == rest).all(axis=1)
    return start[inside], end[inside], np.repeat(np.array(v.order), count)[inside], chunk[inside]


def candidates(v: Vocabulary, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges of pieces, and of the single characters that are no pieces."""
    start, end, piece, chunk = edges(v, data, off)
    head = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(head, len(data)))
    width = np.zeros(len(data), np.int64)
    width[head] = size
    known = np.zeros(len(data), bool)
    known[start[end - start == width[start]]] = True
    lone = ~known[head]
    start, end = np.concatenate([start, head[lone]]), np.concatenate([end, head[lone] + size[lone]])
    piece = np.concatenate([piece, np.full(int(lone.sum()), v.unknown)])
    return start, end, piece, np.concatenate([chunk, np.searchsorted(off, head[lone], "right") - 1])


def encode_chunks(v: Vocabulary, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks one after the other, and the offsets of each chunk's.

    ``last`` and ``since`` hold, by a prefix's last byte, the last piece of its encoding and where it begins.
    """
    last, since = np.full(len(data), -1, np.int64), np.zeros(len(data), np.int64)
    sizes = np.diff(off)
    a = 0
    while a < len(sizes):  # as many chunks at a time as bound the edges
        b = max(a + 1, int(np.searchsorted(off, off[a] + PART_BYTES, "right")) - 1)
        lo, hi = int(off[a]), int(off[b])
        if hi - lo > PART_BYTES:
            _relax_huge(v, data[lo:hi], last[lo:hi], since[lo:hi])
        elif hi > lo:
            _relax(v, data[lo:hi], off[a : b + 1] - lo, last[lo:hi], since[lo:hi])
        since[lo:hi] += lo
        a = b
    return trace(v, data, off, last, since)


def _relax(v: Vocabulary, data: np.ndarray, off: np.ndarray, last: np.ndarray, since: np.ndarray) -> None:
    """All chunks side by side, in the order of the edges' ends and from the longest; long chunks edge by edge."""
    start, end, piece, chunk = candidates(v, data, off)
    begin = off[chunk]
    key = ((end - begin) << 8) | (255 - np.minimum(end - start, 255))
    long = np.diff(off)[chunk] > LONG
    if long.any():
        idx = np.flatnonzero(long)
        idx = idx[np.lexsort((key[idx], chunk[idx]))]
        _relax_long(v, start[idx], end[idx], piece[idx], begin[idx], last, since)
    idx = np.flatnonzero(~long)
    idx = idx[np.argsort(key[idx])]
    s, e, p, first = start[idx], end[idx], piece[idx], start[idx] == begin[idx]
    cuts = np.flatnonzero(np.diff(key[idx])) + 1
    for a, b in zip(np.append(0, cuts), np.append(cuts, len(idx))):  # one end and length: one edge a chunk
        todo = a + np.flatnonzero(last[e[a:b] - 1] < 0)
        todo = todo[first[todo] | (last[s[todo] - 1] >= 0)]
        if len(todo):
            todo = todo[first[todo] | may_follow(v, np.where(first[todo], 0, last[s[todo] - 1]), p[todo])]
            last[e[todo] - 1], since[e[todo] - 1] = p[todo], s[todo]


def _relax_huge(v: Vocabulary, data: np.ndarray, last: np.ndarray, since: np.ndarray) -> None:
    """One chunk in windows of bytes; each finds the edges that end in it."""
    depth = max(max(len(v.raw[r]) for r in v.order), 4)
    for w in range(0, len(data), PART_BYTES):
        lo, hi = max(0, w - depth), min(len(data), w + PART_BYTES + 4)
        start, end, piece, _ = candidates(v, data[lo:hi], np.array([0, hi - lo]))
        own = (end + lo > w) & (end + lo <= w + PART_BYTES) & ((start > 0) | (lo == 0))
        start, end, piece = start[own] + lo, end[own] + lo, piece[own]
        idx = np.argsort((end << 8) | (255 - np.minimum(end - start, 255)))
        _relax_long(v, start[idx], end[idx], piece[idx], np.zeros(len(idx), np.int64), last, since)


def trace(v: Vocabulary, data: np.ndarray, off: np.ndarray, last: np.ndarray, since: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets, back from the chunks' ends."""
    pos, out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    here = off[1:][np.diff(off) > 0]
    begin = off[:-1][np.diff(off) > 0]
    while len(here):
        pos.append(since[here - 1])
        out.append(last[here - 1])
        here = pos[-1]
        live = here > begin
        here, begin = here[live], begin[live]
    pos, out = np.concatenate(pos), np.concatenate(out)
    by = np.argsort(pos)
    pos, out = pos[by], out[by]
    unknown = out == v.unknown
    wide = np.where(unknown, np.diff(np.append(pos, len(data))), 1)
    ids = np.repeat(np.append(v.ids, 0)[out], wide)
    at = np.repeat(pos - (np.cumsum(wide) - wide), wide) + np.arange(len(ids))
    as_bytes = np.repeat(unknown, wide)
    ids[as_bytes] = v.byte_ids[data[at[as_bytes]]]
    many = np.bincount(np.searchsorted(off, pos, "right") - 1, weights=wide, minlength=len(off) - 1).astype(np.int64)
    return ids, np.concatenate([[0], np.cumsum(many)])


def _relax_long(v: Vocabulary, start, end, piece, begin, last, since) -> None:
    known: dict[tuple[int, int], bool] = {}
    for s, e, p, b in zip(start.tolist(), end.tolist(), piece.tolist(), begin.tolist()):
        if last[e - 1] >= 0 or s != b and last[s - 1] < 0:
            continue
        if s != b:
            pair = (int(last[s - 1]), p)
            if pair not in known:
                known[pair] = bool(may_follow(v, np.array([pair[0]]), np.array([p]))[0])
            if not known[pair]:
                continue
        last[e - 1], since[e - 1] = p, s


class Encoder:
    """Encodes batches of texts; keeps what it has found for a bounded number of chunks."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.alone = ~lookup(b"".join(vocabulary.raw)) & (np.arange(256) < 128)
        self.chunks = pa.array([], pa.large_binary())
        self.ids = pa.array([], pa.large_list(pa.int32()))

    def __call__(self, texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_string())
        data, off = text_bytes(pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.replace_substring(texts, "▁", " "), pa.scalar("", pa.large_string()))))
        blank = data == 32
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        cut |= self.alone[data]  # bytes that no piece has stand alone
        cut[1:] |= self.alone[data[:-1]]
        cut[off[:-1][off[:-1] < len(data)]] = True
        at = np.flatnonzero(cut)
        coded = binary_array(data, np.append(at, len(data))).dictionary_encode()
        place = pc.fill_null(pc.index_in(coded.dictionary, self.chunks), -1).to_numpy().copy()
        missing = place < 0
        if len(self.chunks) + missing.sum() > KEPT:  # begin anew, with this batch's chunks
            self.chunks, self.ids, missing = self.chunks[:0], self.ids[:0], np.ones(len(place), bool)
        place[missing] = len(self.chunks) + np.arange(missing.sum())
        new = coded.dictionary.filter(pa.array(missing))
        if len(new):
            ids, cuts = encode_chunks(self.v, *text_bytes(new))
            self.ids = pa.concat_arrays([self.ids, pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), pa.array(ids, pa.int32()))])
            self.chunks = pa.concat_arrays([self.chunks, new])
        each = self.ids.take(pa.array(place).take(coded.indices))
        total = np.zeros(len(each) + 1, np.int64)
        np.cumsum(pc.list_value_length(each).to_numpy(zero_copy_only=False), out=total[1:])
        bounds = total[np.searchsorted(at, off)]
        return pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), each.flatten())


def decode_ids(v: Vocabulary, column: pa.Array) -> list[str | None]:
    """Texts of arrays of ids. Bytes that are no UTF-8 become replacement characters."""
    table = pa.array(v.out, pa.large_binary())
    column = column.cast(pa.large_list(pa.int32()))
    raw, off = text_bytes(table.take(pc.list_flatten(column)))
    n = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))])
    cuts, data = off[n], raw.tobytes()
    out = []
    for a, b, null in zip(cuts, cuts[1:], column.is_null().to_pylist()):
        text = data[a:b]
        out.append(None if null else (text[1:] if text[:1] == b" " else text).decode(errors="replace"))
    return out


def _shared(spark: SparkSession, model: str):
    return spark.sparkContext.broadcast(load(model))  # a vocabulary: some tens of thousands of pieces


def encode(docs: DataFrame, text: str = "text", out: str = "ids", model: str = MODEL) -> DataFrame:
    """The rows of ``docs`` with ``out``, the ids of the text, and ``round_trip``: decoding gives the text again."""
    shared = _shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        coder = Encoder(shared.value)
        for part in slices(batches, "judged", BATCH_BYTES):
            texts = part.column("judged")
            ids = coder(pc.fill_null(texts, ""))
            back = pa.array(decode_ids(shared.value, ids), pa.large_string())
            same = pc.equal(back, pc.fill_null(texts, "").cast(pa.large_string()))
            ids = pc.if_else(texts.is_null(), pa.scalar(None, ids.type), ids)
            yield part, [ids.cast(pa.list_(pa.int32())), same]

    return beside(docs, text, {out: ArrayType(IntegerType()), "round_trip": BooleanType()}, run)


def decode(rows: DataFrame, ids: str = "ids", out: str = "text", model: str = MODEL) -> DataFrame:
    """The rows with ``out``, the text of the ids; null for null."""
    shared = _shared(rows.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for batch in batches:
            yield batch, [pa.array(decode_ids(shared.value, batch.column("judged")), pa.string())]

    return beside(rows, ids, {out: StringType()}, run)


def query(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs).select("doc_id", F.size("ids").alias("n_pieces"), "ids", "round_trip")
