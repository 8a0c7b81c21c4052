"""Routing by names, clauses and content: the catalogue's rules on small cases, and against plain versions."""

import random
import re

import pytest

from docloom.operators import routing as G

PRODUCTS = [("Camera", 0), ("Phone", 1), ("Air Fryer", 2), ("Boat", 3), ("空调手册", 4), ("Gas Grill", 5), ("Printer", 6), ("Vacuum", 7)]
FUNCTIONAL = [("Boat", "sound system", 0), ("Printer", "station id", 1)]
NICKNAMES = [("Boat", "watercraft", 3), ("Printer", "fax machine", 6), ("Camera", "instant camera", 0)]
ALIASES = [("Camera", "拍照", 0), ("Phone", "handset", 1), ("空调手册", "制冷", 4), ("空调手册", "遥控器", 4), ("Vacuum", "robot vacuum", 7), ("Air Fryer", "fryer basket", 2), ("Boat", "游艇", 3)]


@pytest.fixture(scope="module")
def terms(spark):
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    three = "product string, alias string, place long"
    return G.catalogue_terms(make(PRODUCTS, "product string, place long"), make(FUNCTIONAL, three), make(NICKNAMES, three), make(ALIASES, three)).cache()


def asked(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, text string")


def routes(df):
    return {r.qid: (r.products, r.confidence, r.reason) for r in df.collect()}


def test_the_first_matcher_that_hits_wins(spark, terms):
    texts = [
        "How do I clean the CAMERA?", "airfryer does not heat", "my cameras", "空调不制冷", "on my phone the sound system is mute", "the sound system", "my phone is lost, it is cordless", "phone line of the cell phone",
        "use the watercraft", "a watercrafts", "fryer basket is hot", "遥控器", "instant camera film", "nothing here", None, "", "gas grill and boat",
    ]
    got = routes(G.name_route(asked(spark, texts), terms))
    high, medium = "high", "medium"
    assert got == {
        0: (["Camera"], high, "explicit_product_name"),
        1: (["Air Fryer"], high, "explicit_product_name"),
        2: (["Camera"], high, "alias_or_name_match"),
        3: (["空调手册"], high, "explicit_product_name"),
        4: (["Boat"], medium, "functional_alias"),  # a phone that is the user's own is no product
        5: (["Boat"], medium, "functional_alias"),
        6: (["Phone"], high, "explicit_product_name"),
        7: (["Phone"], high, "alias_or_name_match"),
        8: (["Boat"], high, "explicit_product_nickname"),
        9: ([], "none", "no_name"),
        10: (["Air Fryer"], high, "alias_or_name_match"),
        11: ([], "none", "no_name"),
        12: (["Camera"], high, "explicit_product_nickname"),
        13: ([], "none", "no_name"),
        14: ([], "none", "no_name"),
        15: ([], "none", "no_name"),
        16: (["Gas Grill"], high, "explicit_product_name"),
    }
    both = routes(G.name_route(asked(spark, ["the printer has a sound system"]), terms))
    assert both == {0: (["Printer", "Boat"], medium, "display_vs_functional_divergence")}


def test_several_products(spark, terms):
    texts = ["boat or vacuum or camera?", "clean the camera; then dry the watercraft", "the boat。 the boat！", "the camera; Chapter about filters", "the camera", "vacuum；Chapter about filters also"]
    heads = spark.createDataFrame([("Vacuum", "Chapter about filters"), ("Boat", "Common heading"), ("Camera", "common  heading")], "product string, heading string")
    questions = asked(spark, texts)
    evidence = G.heading_evidence(G.clauses_of(questions), heads)
    got = {r.qid: (r.products, r.reason) for r in G.clause_route(questions, terms, evidence).collect()}
    assert got == {0: (["Boat", "Vacuum", "Camera"], "explicit_multi_product"), 1: (["Camera", "Boat"], "clause_multi_product"), 3: (["Camera", "Vacuum"], "clause_multi_product")}


def test_headings_meet_clauses_without_an_automaton(spark):
    r = random.Random(8)
    say = lambda n: "".join(r.choice(["ab", "é", " ", "-", "7", "热", "Ab "]) for _ in range(n))
    clauses = [(i // 3, i % 3, say(r.randint(0, 30))) for i in range(60)] + [(99, 0, None)]
    heads = [(f"p{i % 4}", c[2][k : k + r.randint(2, 9)]) for i in range(6) for c in clauses[:-1] for k in (0, 2, 5)] + [("p0", None)]
    terms, want = {}, {}
    for p, h in heads:
        if h is not None and 3 <= len(t := re.sub(r"[ ]+", " ", h).strip(" ").lower()) <= 6:
            terms.setdefault(t, set()).add(p)
    for q, c, text in clauses:
        low = re.sub(r"[ ]+", " ", text or "").lower()
        found = {min(ps) for t, ps in terms.items() if len(ps) == 1 and re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", low)}
        if len(found) == 1:
            want[q, c] = min(found)
    out = G.heading_evidence(spark.createDataFrame(clauses, "qid long, clause int, text string"), spark.createDataFrame(heads, "product string, heading string"), 3, 6)
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(x.qid, x.clause): x.product for x in out.collect()} == want and len(want) > 5


def test_one_name_of_the_catalogue(spark):
    names = spark.createDataFrame([("吸尘器",), ("吸尘器滤网",), ("Oven",), ("Steam Oven",)], "name string")
    got = {r.qid: (r.product, r.ambiguous) for r in G.named_product(asked(spark, ["我的吸尘器滤网", "steam oven", "吸尘器 oven", None, "OVENS", "吸尘器滤网与吸尘器"]), names).collect()}
    assert got == {0: ("吸尘器滤网", False), 1: ("Steam Oven", False), 2: (None, True), 3: (None, False), 4: ("Oven", False), 5: ("吸尘器滤网", False)}


def test_hits_are_those_of_a_search_in_any_number_of_passes(spark):
    r = random.Random(1)
    words = ["".join(r.choice("ab é") for _ in range(r.randint(1, 5))) for _ in range(60)]
    texts = ["".join(r.choice("ab éAB-") for _ in range(r.randint(0, 60))) for _ in range(80)]
    terms = spark.createDataFrame([(w, "alias", f"p{i % 7}", i) for i, w in enumerate(words)], "term string, kind string, product string, place long")
    want = set()
    for q, text in enumerate(texts):
        for i, w in enumerate(words):
            term, low = w.strip(" ").lower(), text.lower()
            ends = [k for k in range(len(low)) if term and low.startswith(term, k)]
            inner = lambda k: 0 <= k < len(low) and low[k].isascii() and low[k].isalnum()  # noqa: B023, E731
            free = [k for k in ends if not inner(k - 1) and not inner(k + len(term))]
            if ends:
                want.add((q, f"p{i % 7}", i, term, ends[0], free[0] if free else None))
    for most in (1 << 20, 700):
        got = {(x.qid, x.product, x.place, x.term, x.at, x.word_at) for x in G.name_hits(asked(spark, texts), terms, most).collect()}
        assert got == want


def test_votes_of_sections(spark):
    rows = [(1, "a", 1, 1), (1, "a", 1, 2), (1, "b", 1, 2), (1, "b", 2, 3), (1, "c", 1, 9), (1, "a", 2, 31)] + [(2, "x", i, i) for i in range(1, 20)] + [(2, "y", i, i + 18) for i in range(1, 9)]
    votes = G.weighted_vote(spark.createDataFrame(rows, "qid long, product string, section long, rank long"))
    assert sorted((r.qid, r.product, r.votes, r.place) for r in votes.collect()) == [(1, "a", 4, 2), (1, "b", 6, 1), (1, "c", 1, 3), (2, "x", 4 + 3 * 2 + 2 * 5 + 10, 1)]


def test_the_last_resort(spark):
    docs = G.alias_documents(spark.createDataFrame([(f"prod{i}",) for i in range(12)], "product string"), spark.createDataFrame([(f"prod{i}", f"only{i}") for i in range(12)] + [("prod1", "shared"), ("prod2", "shared")], "product string, alias string"))
    got = routes(G.last_resort(asked(spark, ["only3 please", "shared", "zz", "??", "only4 only4 only5 only5", "only6 only7"]), docs))
    assert got[0] == (["prod3"], "high", "bm25_router") and got[2] == ([], "none", "no_positive_score") and got[3] == ([], "none", "no_query_tokens")
    assert got[4] == (["prod4", "prod5"], "medium", "bm25_router") and got[5] == ([], "none", "ambiguous_top3_low_score") and got[1][2] == "ambiguous_top3_low_score"


def test_names_against_content(spark, terms):
    texts = ["制冷 problem", "拍照 problem", "nothing", " ", "my phones", "处理器单元坏了", "制冷 again", "fryer basket"]
    votes = [(0, "空调手册", 1), (0, "Boat", 2), (1, "Boat", 1), (1, "Vacuum", 2), (1, "Phone", 3), (2, "Boat", 1), (4, "Boat", 1), (4, "Phone", 2), (5, "Boat", 1), (6, "Boat", 1), (6, "Vacuum", 2), (6, "空调手册", 3)]
    docs = spark.createDataFrame([("Vacuum", "这里有处理器单元的说明"), ("Boat", "别的文字")], "product string, text string")
    names = G.alias_documents(spark.createDataFrame(PRODUCTS, "product string, place long"), spark.createDataFrame(ALIASES, "product string, alias string, place long"))
    got = routes(G.fused_route(asked(spark, texts), terms, spark.createDataFrame(votes, "qid long, product string, place long"), docs, names))
    assert got[0] == (["空调手册"], "high", "name_and_content_agree") and got[6] == (["空调手册"], "high", "name_and_content_agree")
    assert got[1] == (["Camera", "Boat", "Vacuum"], "medium", "name_vs_content_divergence")
    assert got[2] == (["Boat"], "medium", "content_vote_only") and got[3] == ([], "none", "empty_question")
    assert got[4] == (["Phone", "Boat"], "medium", "generic_alias_agree") and got[5] == (["Vacuum"], "high", "phrase_grep_unique")
    assert got[7] == (["Air Fryer"], "high", "alias_or_name_match")


def test_empty_tables(spark, terms):
    none = asked(spark, ["x"]).limit(0)
    assert G.name_route(none, terms).count() == 0 and G.clause_route(none, terms).count() == 0
    assert routes(G.name_route(asked(spark, ["boat"]), terms.limit(0))) == {0: ([], "none", "no_name")}
