"""Pictures of answers against plain versions on small random cases."""

import random
import re

import pytest

from docloom.operators import pictures as P


def test_pictures_are_bound_once_in_source_order(spark):
    r = random.Random(2)
    vocabulary = "turn the valve open close pump filter dry clean 滤网 清洁 <x>".split()
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    answers = [(q, say(12) if q else None) for q in range(12)]
    results = [(q, k, say(9) if k % 4 else " ", [r.choice(["a", "b", "c", " ", "d"]) for _ in range(3)]) for q in range(12) for k in range(6)]

    flat = lambda x: "".join(c for c in x.lower() if c.isalnum())
    grams = lambda x: {flat(x)[i : i + 3] for i in range(len(flat(x)) - 2)}
    tokens = lambda x: {w for w in re.split(r"[^\w]+|_", x.lower()) if len(w) >= 2}
    want = set()
    for q, answer in answers:
        ranked = []
        for _, k, text, pics in (x for x in results if x[0] == q and answer and x[2].strip()):
            g, t = len(grams(answer) & grams(text)), len(tokens(answer) & tokens(text))
            if g or t:
                score = round(0.58 * g / max(1, len(grams(text))) + 0.27 * g / max(1, len(grams(answer))) + 0.15 * t / max(1, len(tokens(text))), 8)
                ranked += [(-score, k, i, p) for i, p in enumerate(pics) if p.strip()]
        seen, kept = set(), []
        for row in sorted(ranked):
            if row[3] not in seen and len(kept) < 3:
                kept.append(row)
            seen.add(row[3])
        want |= {(q, row[3], n + 1) for n, row in enumerate(sorted(kept, key=lambda x: x[1:]))}
    got = P.bound_pictures(spark.createDataFrame(answers, "qid long, answer string"), spark.createDataFrame(results, "qid long, rank long, text string, pics array<string>"), 3)
    assert {(x.qid, x.pic, x.place) for x in got.collect()} == want and want


def test_a_picture_goes_to_its_owner(spark):
    chunks = spark.createDataFrame([(5, "a", ["P1"], ["p2"]), (3, "b", ["p2"], ["P1", None]), (2, "b", None, ["p1", "p3"]), (9, "c", ["p3"], []), (1, "c", [], ["p4"]), (4, "a", [], ["p4"])], "chunk_id long, product string, direct_pics array<string>, linked_pics array<string>")
    asked = spark.createDataFrame([(1, p) for p in ("p1", "P2", "p3", "p4", "p5", " ", None)] + [(2, "p4"), (2, "p4")], "qid long, pic string")
    liked = spark.createDataFrame([(1, "a"), (1, "a")], "qid long, product string")
    got = {(r.qid, r.pic): (r.chunk_id, r.direct) for r in P.picture_owners(asked, chunks, liked).collect()}
    assert got == {(1, "p1"): (5, True), (1, "P2"): (3, True), (1, "p3"): (9, True), (1, "p4"): (4, False), (1, "p5"): (None, None), (2, "p4"): (1, False)}


def test_figures_between_subheadings(spark):
    text = "intro <PIC> more <PIC>\n## Next part\nx <PIC> #no <PIC>\n  # Last\n<PIC>"
    rows = [("p", "s", "h", text, ["a", "b", "c", "d", "e"]), ("p", "t", "h", "# first <PIC>", ["x", "y"]), ("p", "u", "h", None, ["z"]), ("p", "v", "h", "<PIC>", None), ("p", "w", "h", "\n# t\n<PIC>", ["q"])]
    got = P.figure_ranges(spark.createDataFrame(rows, "product string, passage string, heading string, text string, pics array<string>")).collect()
    assert {(r.passage, r.pic, r.spot, r.group) for r in got} == {("s", "a", 0, 0), ("s", "b", 1, 0), ("s", "c", 2, 1), ("s", "d", 3, 1), ("s", "e", 4, 2), ("t", "x", 0, 0), ("t", "y", 1, 0), ("u", "z", 0, 0), ("w", "q", 0, 0)}


@pytest.mark.parametrize("wide", [False, True])
def test_candidates_in_three_hops(spark, wide):
    figures = [(f"{p}{i}", p, i, [p, f"part{i // 6}", f"leaf{i}"], 0) for p in "ab" for i in range(24)]
    groups = [(p, f"{p}{i // 3}", "h", f"{p}{i}", i % 3, 0) for p in "ab" for i in range(24)]
    kind = ("pic string, product string, section_order long, parts array<string>, image_order int", "product string, passage string, heading string, pic string, spot int, group int")
    questions = spark.createDataFrame([(1, "How to clean it" if wide else "clean it"), (2, None)], "qid long, text string")
    seeds = spark.createDataFrame([(1, "a7", 1), (1, "a7", 3), (1, "b23", 2), (1, "nowhere", 0), (2, "b0", 1)], "qid long, pic string, rank long")
    run = lambda most, routed=None: {(r.qid, r.pic): (r.origin, r.place) for r in P.figure_candidates(questions, seeds, spark.createDataFrame(figures, kind[0]), spark.createDataFrame(groups, kind[1]), routed, most).collect()}
    got = run(48)
    assert got[1, "a7"] == ("retrieved", 1) and got[1, "b23"] == ("retrieved", 2) and got[2, "b0"] == ("retrieved", 1)
    assert {p for (q, p), v in got.items() if q == 1 and v[0] == "source_group"} == {"a6", "a8", "b21", "b22"}
    near = {p for (q, p), v in got.items() if q == 1 and v[0] == "structural_neighbor"}
    first, last = set(range(6, 12)), set(range(18, 24))
    if wide:
        assert near == ({f"a{i}" for i in first | {5}} | {f"b{i}" for i in last}) - {"a6", "a7", "a8", "b21", "b22", "b23"}
    else:
        assert near == {"a9", "b20"}
    routed = spark.createDataFrame([(1, "a"), (2, "b")], "qid long, product string")
    assert not {p for (q, p), v in run(48, routed).items() if q == 1 and v[0] == "structural_neighbor" and p[0] == "b"}
    few = run(3)
    assert {p for q, p in few if q == 1} == {"a7", "b23", "a6"} and max(v[1] for v in few.values()) == 3


def test_groups_are_completed_as_a_whole_or_not_at_all(spark):
    card = lambda q, g, title, pics, heads: [(q, g, title, "", p, i, h) for i, (p, h) in enumerate(zip(pics, heads, strict=True))]
    rows = (
        card(1, "g1", "Filter cleaning", "abc", ["Care / Filter"] * 3)
        + card(1, "g2", "Other thing", "de", ["X", "Y"])
        + card(2, "g1", "Filter cleaning", "abc", ["Care / Filter", "care > filter", "Care / Filter"])
        + card(3, "g1", "Filter cleaning", "abcde", ["Care"] * 5)
        + card(4, "g1", "Filter cleaning", "ab", ["Care filter"] * 2)
        + card(5, "g1", "冷藏室温度调节", "ab", ["h"] * 2)
        + card(6, "g1", "Filter cleaning", "abc", ["Care", "Other", "Care"])
    )
    cards = spark.createDataFrame(rows, "qid long, group string, group_heading string, context string, pic string, spot int, heading string")
    questions = spark.createDataFrame([(1, "cleaning of the filters"), (2, "only the first filter cleaning"), (3, "filter cleaning"), (4, "How to care"), (5, "冷藏室温度 温度调节 How to h"), (6, "filter cleaning")], "qid long, text string")
    chosen = spark.createDataFrame([(1, "a"), (1, "d"), (2, "a"), (3, "a"), (4, "b"), (5, "a"), (6, "a"), (1, "a")], "qid long, pic string")
    got = {(r.qid, r.pic) for r in P.completed_groups(questions, cards, chosen).collect()}
    assert got == {(1, "b"), (1, "c"), (4, "a")}
    assert P.completed_groups(questions, cards.limit(0), chosen).count() == 0
