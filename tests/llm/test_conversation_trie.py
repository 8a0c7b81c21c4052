"""The prefix trie of conversations against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from docloom.llm import conversation_trie
from docloom.llm.conversation_trie import lengths, trie, turns_of

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def sequences(rows):
    """The turns of each conversation, in order; equal numbers by digest."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        name = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        by[c].append(((turn is not None, turn or 0, name), (role, text)))
    return {c: [t for _, t in sorted(own)] for c, own in by.items()}


def plain_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    least = lambda p: min((c for c in members[p] if c is not None), default=None)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, own in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in own if c is not None and len(convs[c]) == len(p)))
        out.append((least(p), len(p), least(p[:-1]) if p else None, len(own), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def plain_rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        if c is None:
            out[c] = turns
            continue
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    return out


def found(df):
    return sorted(repr(tuple(r)) for r in df.select(COLUMNS).collect())


def some_rows(seed, n=60, longest=30):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for i in range(r.choice([1, 2, 3, 8, 9, 16, longest])):
            rows.append((c, i, r.choice(["user", "assistant"]) if i else "user", r.choice(["a", "é", "yes", ""]) if i < 4 else f"{c % 4} {i}"))
    return rows


ODD = [
    (None, 1, "user", "a"),
    (None, 0, "user", "b"),
    (7, None, "user", "x"),
    (7, 0, None, "y"),
    (7, 0, None, "y"),
    (7, 1, "user", None),
    (8, 0, "user", "long " * 30_000),
    (9, 0, "user", "long " * 30_000),
    (10, 5, "us", "era"),
    (11, 5, "use", "ra"),
    (11, 6, "é", "\x00"),
]


@pytest.mark.parametrize("rows", [some_rows(1), some_rows(2, 40, 70), ODD, [(c, i, "user", "same") for c in range(50) for i in range(3)], [(1, i, "user", str(i % 2)) for i in range(200)]])
@pytest.mark.parametrize("block", [1, 8])
def test_same_as_plain(spark, monkeypatch, rows, block):
    monkeypatch.setattr(conversation_trie, "BLOCK", block)
    monkeypatch.setattr(conversation_trie, "RUN", 4)
    turns = turns_of(spark.createDataFrame(rows, SCHEMA).repartition(4))
    convs = lengths(turns).withColumnRenamed("n", "total")
    assert found(trie(turns, convs)) == plain_trie(sequences(rows))


@pytest.mark.parametrize("rows", [some_rows(3), [r for r in some_rows(4) if (r[0] or 0) % 10], [(c, 0, "user", "one") for c in range(40)], ODD])
def test_rebuilt_conversations(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).selectExpr("text", "role", "turn", "conv_id", "'x' AS key", "1 AS `a.b`").write.parquet(str(tmp_path / "conversations.parquet"))
    out = conversation_trie.query(spark, str(tmp_path))
    assert out.columns == COLUMNS
    assert found(out) == plain_trie(plain_rebuilt(sequences(rows)))


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert conversation_trie.query(spark, str(tmp_path)).collect() == []
