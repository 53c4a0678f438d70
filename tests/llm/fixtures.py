"""Small tables with the cases that every operator must stand: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

SYLLABLES = {"en": ["the", "and", "th", "ing", "er", "on", "wh", "sh"], "de": ["sch", "ein", "ung", "der", "heit", "zu", "ü", "ß"]}


def prose(lang: str, n: int, seed: int) -> str:
    r = random.Random(f"{lang}{seed}")
    words = ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("\n" if r.random() < 0.08 else "") for w in words)


def documents() -> list[tuple]:
    rows = []
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        rows.append((i, prose(lang, 30 + 5 * i, i), lang, f"s{i % 4}", "clash"))
    base = prose("en", 200, 999)
    rows += [(100, base, "en", "s0", "x"), (101, base, "en", "s0", "x"), (101, base, "en", "s0", "x")]  # copies and a repeated row
    rows += [(102, base + " tail", "en", None, None), (103, " ".join(base.split()[:150]), None, "s1", "x")]
    rows += [(200, None, None, None, None), (201, "", "en", "s1", "x"), (202, " \n\t ", "de", "s2", "x"), (203, "12 34 !!", "en", "s2", "x"), (None, "the and ing", "en", "s3", "x")]
    rows += [(300, ("the same line of words\n" * 40) + prose("en", 50, 5), "en", "s3", "x"), (301, "word " * 3000, "en", "s3", "x"), (302, "ab", "en", "s3", "x")]
    rows += [(303, "\n".join(["A first line.", "A second line.", "A third line."]), "en", "s0", "x"), (304, "\n".join(["Other.", "A first line.", "A second line.", "", "A third line.", "End."]), "en", "s0", "x")]
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, kept string"


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
