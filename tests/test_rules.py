"""Cases worked out by hand from the rules."""

from datetime import timezone

import pandas as pd
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import answers, conversation, evidence, ingest, monitor, retrieval, structure, texts
from docloom.sources import readers
from docloom.sources.tables import requests
from docloom.streaming import jobs


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_fusion(spark):
    def channel(*ids):
        return spark.createDataFrame([(1, ord(c), i + 1) for i, c in enumerate(ids)], "qid int, doc_id int, rank int")

    got = [(chr(r.doc_id), round(r.rrf, 6)) for r in retrieval.rrf([channel("a", "b"), channel("b", "c")]).orderBy("rrf_rank").collect()]
    assert got == [("b", 0.032522), ("a", 0.016393), ("c", 0.016129)]
    assert [chr(r.doc_id) for r in retrieval.rrf([channel("a"), channel("b")]).orderBy("rrf_rank").collect()] == ["a", "b"]
    kept = retrieval.distinct_channels([channel("a", "b"), channel("a", "b"), channel("c")])
    assert [chr(r.doc_id) for r in retrieval.rrf(kept).orderBy("rrf_rank").collect()] == ["a", "c", "b"]


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "c d d"), (4, "e")], "doc_id int, text string")
    ask = spark.createDataFrame([(1, "b d")], "qid int, text string")
    assert {r.doc_id: r.score for r in retrieval.bm25(docs, ask).collect()} == {1: 0.847298, 3: 1.042828}


def test_percentiles_and_rates(spark):
    log = spark.createDataFrame([(float(i), 1) for i in range(1, 21)], "duration_ms double, k int")
    r = monitor.percentiles(log).first()
    assert (r.p50, r.p95, r.p99) == (10, 19, 20)
    assert spark.range(1).select(monitor.rate(F.lit(1), F.lit(3)).alias("x")).first().x == 33.33


def test_timeline_has_empty_minutes(spark):
    log = spark.createDataFrame([(3_600_000, 200, "chat", 5.0)], "completed_at bigint, status_code int, category string, duration_ms double")
    rows = monitor.timeline(log).collect()
    assert len(rows) == 60 and sum(r.requests for r in rows) == 1


def test_resolution_and_cooldown(spark):
    votes = spark.createDataFrame([(1, "r", "solved", 1), (2, "r", "unsolved", 2), (3, "r", "transfer", 3)], "id int, request_id string, action string, created_at int")
    assert monitor.latest_resolution(votes).first().resolution == "unsolved"
    alerts = spark.createDataFrame([("k", m * 60_000) for m in (0, 4, 8, 12, 22)], "alert_key string, at bigint")
    assert sorted(r.fired_at // 60_000 for r in monitor.cooldown(alerts).collect()) == [0, 12, 22]


def test_request_paths(spark):
    for path, want in (("/api/chat", "chat"), ("/api/chunks/x", "knowledge_admin"), ("/livez", "health"), ("/page/x", "page"), ("/z", "other")):
        assert one(spark, path, monitor.path_category) == want
    assert one(spark, "abcdefgh", monitor.valid_request_id) == "abcdefgh" and len(one(spark, "x", monitor.valid_request_id)) == 36


def test_confidence(spark):
    def level(candidates):
        s, v = retrieval.confidence(F.lit(0.8), F.lit(0.7), F.lit(0.5), F.lit(1), F.lit(0.0), F.lit(candidates))
        return tuple(spark.range(1).select(s, v).first())

    assert level(1) == (73.0, "high") and level(2) == (71.0, "medium")


def test_budget(spark):
    rows = [(1, 1, 1, 1.0, 600, True), (1, 2, 2, 0.9, 500, False), (1, 3, 3, 0.5, 100, False), (1, 4, 4, 0.1, 300, False)]
    items = spark.createDataFrame(rows, "qid int, doc_id int, rank int, rrf double, chars int, core boolean")
    assert sorted(r.doc_id for r in retrieval.budget(items).filter("kept").collect()) == [1, 2, 3]


def test_text_rules(spark):
    assert one(spark, "x" * 200, lambda c: T.summary(c, 180)) == "x" * 177 + "..."
    assert one(spark, "安装电池安装电池", T.language) == "zh" and one(spark, "abc", T.language) == "en"
    assert one(spark, "see www.x.com/a, and www.x.com/a!", T.urls) == ["https://www.x.com/a"]
    assert [one(spark, q, T.first_n) for q in ("first three items", "前5条", "first")] == [3, 5, None]
    clean = one(spark, "call 13812345678 or a@b.cn, www.x.com", T.redact)
    assert not any(x in clean for x in ("138", "@", "www"))
    assert one(spark, "**a** `b`\n# c\n- d", T.strip_markdown) == "a b\nc\nd"
    assert one(spark, "abcd", T.trigrams) == ["abc", "bcd"] and one(spark, "ab", T.trigrams) == []
    assert one(spark, 'a/b: "c"', T.safe_name) == "a_b_ _c_"
    assert one(spark, "studies", T.stem) == "study"
    assert one(spark, "订单什么时候发货", texts.question_route) == "service" and one(spark, "如何安装滤网", texts.question_route) == "tech"
    assert one(spark, "https://u:p@x.com/", texts.public_url) is False and one(spark, "https://x.com/a", texts.public_url) is True
    assert one(spark, "x", lambda c: texts.cache_eligible(F.lit("see https://a.b"), F.lit(0), F.lit(False))) is False


def test_reviewed_answers(spark):
    def ask(question, stored, f):
        q = spark.createDataFrame([(1, question)], "qid int, question string")
        r = spark.createDataFrame([(7, stored)], "case_id int, question string")
        return [x.case_id for x in f(q, r).collect()]

    assert ask("  How do I\nclean it?  ", "How do I clean it?", answers.exact_answers) == [7]
    assert ask("How should I clean it?", "How do I clean it?", answers.exact_answers) == []
    assert ask("What is a VBeltHolder exactly", "What is a VBeltHoldr exactly", answers.fuzzy_answers) == [7]
    assert ask("How should I charge the battery?", "How do I remove the battery?", answers.fuzzy_answers) == []


def test_chunks_keep_all_text():
    o = ingest.Options()
    assert [c["kind"] for c in ingest.split_section("x" * 1100)] == ["whole"]
    long = ingest.split_section("中" * 2500)
    assert [len(c["text"]) for c in long] == [1100, 1100, 300]
    two = ingest.split_section("a" * 100 + "\n\n" + "b" * 1100)
    assert [len(c["text"]) for c in two] == [100, 1100]
    import random

    for seed in range(20):
        r = random.Random(seed)
        text = "\n\n".join(". ".join("w" * r.randint(1, 300) for _ in range(r.randint(1, 9))) for _ in range(12))
        chunks = ingest.split_section(text, o)
        assert all(len(c["text"]) <= o.most for c in chunks)
        covered = set()
        for c in chunks:
            covered.update(range(c["start"], c["end"]))
        assert all(i in covered for i, ch in enumerate(text) if not ch.isspace())


def test_light_chunks_and_math():
    got = ingest.light_chunks("# Doc\n## One\n" + "word " * 60 + "\n\n" + "more " * 60, target=320, overlap=12)
    assert [h for h, _ in got] == ["Doc / One"] * 2 and got[1][1].startswith("word word\n\nmore")
    assert ingest.light_chunks(None) == [] and ingest.light_chunks(" ") == []
    assert ingest.plain_math(r"press $\pmb{\bigtriangleup}$ at $40^{\circ}$C") == "press ▲ at 40^°C"
    assert ingest.plain_math("no 5$") == "no 5$" and ingest.plain_math(None) is None


def test_section_tree():
    text = "# Title\nintro\n## A\n![x](p1.png)body one\n### B\nbody [[PIC:p2]] two\n## C\nlast"
    got = [(s["section_id"], s["heading"], s["text"], [(a["pic_id"], a["offset"]) for a in s["anchors"]]) for s in ingest.parse_sections("m", text)]
    assert got == [(0, "Overview", "intro", []), (1, "A", "body one", [("p1.png", 0)]), (2, "A / B", "body  two", [("p2", 5)]), (3, "C", "last", [])]
    plain = ingest.parse_sections("m", "INSTALLATION\n\nput it in\n\n第二章 使用\n\n1) press\n2) wait")
    assert [s["heading"] for s in plain] == ["INSTALLATION", "第二章 使用"]  # lines such as 2) are steps, not headings


def test_chunk_tables(spark):
    manuals = spark.createDataFrame([("m", "## A\n![x](p1) warning: hot\n## B\nfine"), ("n", None)], "product string, text string")
    rows = ingest.chunks_of(ingest.sections_of(manuals)).orderBy("section_id").collect()
    assert [(r.heading, r.pics, r.tags) for r in rows] == [("A", ["p1"], ["warning", "has_pic"]), ("B", [], [])]


def test_span_pictures(spark):
    chunks = spark.createDataFrame([(1, 0, 0, 100, 2000)], "doc_id int, chunk int, start int, end int, text_len int")
    anchors = spark.createDataFrame([(1, "a", 0), (1, "b", 100), (1, "c", 101)], "doc_id int, pic_id string, offset int")
    assert structure.span_pics(chunks, anchors).first().pics == ["a", "b"]


def test_neighbours(spark):
    rows = spark.createDataFrame([(1, i) for i in (4, 5, 6, 9)], "doc_id int, section_id int")
    seeds = spark.createDataFrame([(1, 1, 5)], "qid int, doc_id int, section_id int")
    ids = lambda n: sorted(r.section_id for r in structure.neighbours(rows, seeds, n).collect())
    assert ids(1) == [4, 6] and ids(8) == [4, 6, 9]


def test_context_packet(spark):
    turns = spark.createDataFrame([(1, 0, "user", "型号 DCB112 怎么充电"), (1, 1, "assistant", "ok"), (1, 2, "user", "请读取型号。只根据图片回答；不要使用手册覆盖文字。"), (1, 3, "system", "x")], "conv_id int, turn int, role string, text string")
    import json

    p = json.loads(conversation.context_packet(turns).first().packet)
    assert p["model"] == "DCB112" and p["user_constraints"] == ["只根据图片回答", "不要使用手册覆盖文字"] and len(p["recent_turns"]) == 3


def test_audit_merge(spark):
    schema = "request_id string, path string, item_key string, value string"
    old = spark.createDataFrame([("r", "p", "a", "live"), ("r", "p", "b", "x")], schema)
    new = spark.createDataFrame([("r", "p", "a", ""), ("r", "p", "b", "y"), ("r", "p", "c", "z")], schema)
    assert {r.item_key: r.value for r in conversation.merged_traces(old, new).collect()} == {"a": "live", "b": "y", "c": "z"}


def test_clean_questions():
    got = ingest._clean(pd.Series(["a&amp;b \\u4e2d  x", "cafÃ©", "ＡＢ\tc", None])).tolist()
    assert got == ["a&b 中 x", "café", "AB c", None]


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("﻿标题".encode())
    (tmp_path / "b.txt").write_bytes("中文说明".encode("gb18030"))
    (tmp_path / "c.pdf").write_bytes(b"no")
    assert {r.product: r.text for r in readers.manuals(spark, str(tmp_path)).collect()} == {"a": "标题", "b": "中文说明"}
    (tmp_path / "q.csv").write_bytes("id,问题\n1,安装".encode("gb18030"))
    assert readers.csv_table(spark, str(tmp_path / "q.csv"), "gb18030").first().row == {"id": "1", "问题": "安装"}
    (tmp_path / "s.json").write_text('{"p|1": "text", "p|2": "__ERROR__ x"}')
    assert [r.key for r in readers.keyed_json(spark, str(tmp_path / "s.json"), "string").collect()] == ["p|1"]
    assert one(spark, 'event: token\ndata: x\n\nevent: done\ndata: {"a": 1}\n\n', readers.sse_done) == '{"a": 1}'
    t = {"rows": spark.range(3)}
    readers.publish(t, str(tmp_path / "pub"), 1)
    readers.publish({"rows": spark.range(5)}, str(tmp_path / "pub"), 2)
    assert readers.current(spark, str(tmp_path / "pub"), "rows").count() == 5


def test_streams(spark, tmp_path):
    """The same input in several batches gives the same rows."""
    src = tmp_path / "in"
    for i, minutes in enumerate(([0, 4], [8, 12], [22])):
        spark.createDataFrame([("k", m * 60_000, i, f"t{m}", 1) for m in minutes], "alert_key string, at_ms bigint, turn bigint, text string, session_id bigint").coalesce(1).write.mode("append").parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    assert sorted(r.fired_at // 60_000 for r in jobs.collected(jobs.alert_cooldown(stream(), ttl=False), "cool").collect()) == [0, 12, 22]
    memory = jobs.collected(jobs.session_memory(stream(), keep=2, ttl=False), "memory", "update").collect()
    assert max(r.turns for r in memory) == 2
    streaks = jobs.failure_streaks(stream().selectExpr("alert_key AS service", "at_ms", "at_ms > 700000 AS ok"), ttl=False)
    assert [r.critical_at for r in jobs.collected(streaks, "streaks").collect()] == [240_000]
    sink = jobs.upsert_sink(str(tmp_path / "up"), "alert_key", "at_ms")
    q = stream().writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = max((tmp_path / "up").iterdir(), key=lambda p: int(p.name[1:]))
    assert [r.at_ms for r in spark.read.parquet(str(last)).collect()] == [22 * 60_000]


def test_hashes_of_all_dimensions(spark):
    base = [1.0 if i * 7 % 3 else -1.0 for i in range(64)]
    turn = lambda *at: [-x if i in at else x for i, x in enumerate(base)]
    rows = [(1, base), (2, base), (3, turn(0, 63)), (4, turn(20, 30, 40)), (5, turn(*range(16, 64)))]
    h = spark.createDataFrame(rows, "id bigint, v array<double>").select("id", evidence.sign_hash(F.col("v")).alias("hash"))
    got = sorted((r.kind, r.a, r.b, r.similarity) for r in evidence.similar_members(h, 0.96).collect())
    assert got == [("member", 1, 2, 1.0), ("pair", 1, 3, 0.96875)]  # the last has the first 16 signs, and no other
    assert sorted(map(tuple, evidence.hash_members(h).collect())) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)]


def test_families_do_not_hang_on_the_tables_size(spark, tmp_path):
    from docloom.operators import catalogue

    def families(n):
        text = "Setup of it. One\nSetup again. Two\nCare. Three\n" + "Note. x\n" * 9
        docs = spark.createDataFrame([(97 * i, text, "en", "hot") for i in range(n)], "doc_id bigint, text string, lang string, source string")
        docs.write.mode("overwrite").parquet(f"{tmp_path}/{n}/documents.parquet")
        return catalogue.QUERIES["section_family_own"][0](spark, f"{tmp_path}/{n}").count()

    assert [families(n) for n in (1, 40)] == [4, 160]  # two of one family, seen from each; those of nine are no family


def test_stream_alerts_are_those_of_the_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    # users 13 and 26 are test clients; of chats (view) every second has a failed model (event_id % 11) and no evidence (event_id % 7)
    events = [(77 * k if k % 2 else 77 * k + 1, start + timedelta(seconds=20 * k), 1 + k % 3, "view", 10.0, "") for k in range(12)]
    events += [(10_000 + 77 * k, start + timedelta(seconds=7 * k), 13, "error", 90_000.0, "") for k in range(40)]
    events += [(77 * k + 1, start + timedelta(seconds=3 * k), 2, "signup", 10.0, "") for k in range(300, 380)]
    rows = spark.createDataFrame(events, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    schema = rows.schema
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/event*.parquet").withColumn("at", F.to_timestamp(F.col("ts").cast("timestamp")))
    got = jobs.collected(jobs.sliding_alerts(stream), "alerts", "complete").drop("alert")
    want = monitor.chat_alert_windows(requests(spark, str(tmp_path)))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    # plain sums over windows of five minutes that begin each minute
    log = [(int((at - start).total_seconds()), i, kind) for i, at, user, kind, _, _ in events if user % 13]
    for r in got.collect():
        begin = r.start // 1000 - int(start.replace(tzinfo=timezone.utc).timestamp())
        inside = [(i, kind) for at, i, kind in log if begin <= at < begin + 300]
        chats = [i for i, kind in inside if kind == "view"]
        assert (r.n, r.chats, r.error_rate) == (len(inside), len(chats), 0)
        failed = sum(i % 11 == 0 for i in chats) / len(chats) * 100 if chats else 0
        assert abs(r.model_failure - failed) < 0.01 and ("model_failure" in r.alerts) == (len(chats) >= 5 and failed >= 10)
        assert "p95" not in r.alerts and ("no_evidence" in r.alerts) == (len(chats) >= 5 and sum(i % 7 == 0 for i in chats) >= 0.4 * len(chats))
    assert got.filter("alerts = 'model_failure,no_evidence'").count() > 0


def test_long_and_chinese_aliases(spark):
    ask = spark.createDataFrame([(1, "my Ultra-Clean pro max home robot is loud"), (2, "我的吸尘器坏了"), (3, "the robotics kit"), (4, None), (5, "请问吸尘器 x200怎么充电")], "qid int, text string")
    known = [("ultra clean pro max home robot", "long"), ("robot", "short"), ("吸尘器", "vacuum"), ("尘", "dust"), ("吸尘器 X200", "vacuum200")]
    got = answers.alias_route(ask, spark.createDataFrame(known, "alias string, product string"))
    assert sorted(map(tuple, got.collect())) == [(1, "long", 30), (2, "vacuum", 3), (5, "vacuum200", 8)]
