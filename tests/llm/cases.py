"""Documents that every operator must take: nulls, empty and long texts, ties, repeated rows, odd characters."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioustrnlé") for _ in range(r.randint(1, 9))) for _ in range(n))


def documents() -> list[tuple]:
    base, shared = words(120, 1), words(60, 2)
    near = base.split()
    near[50] = "other"
    texts = [
        base,
        base,
        " ".join(near),
        words(40, 3) + "\n" + shared + "\n" + words(30, 4),
        words(20, 5) + "\n" + shared,
        words(3000, 6),
        "",
        " \n\t ",
        "one two",
        "line a\nline a\nline a\nline b",
        "Released under the MIT License, or Apache License. cc by, Gnu General  Public-License!",
        "licensed under the apache licence version 2.0",
        "日本語のテキスト 😀 é\x00é ▁ x" * 20,
        "a" * 700,
        "### $$$ %%% &&& ||| <<< >>>",
        "the the the " * 40,
    ]
    rows = [(i, t, "en", "src0" if i % 2 else "src1", len(t)) for i, t in enumerate(texts)]
    return [*rows, (16, None, None, None, None), (None, base, "fr", "src2", 3), (3, texts[3], "en", "src1", 5), (3, texts[3], "en", "src1", 5)]
