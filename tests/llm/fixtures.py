"""Small tables with the odd cases: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, shard int, taken long, "
          "digest string, part long, place string, left long, row long")


def odd_rows() -> list[tuple]:
    rng = random.Random(7)
    words = ["the", "of", "Müller", "naïve", "x", "日本", "end.", "a,b", "$$", "CC", "BY", "all", "rights", "reserved"]
    prose = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(30)]
    texts = [None, "", "   ", "one", "a\nb\x0bc\x0cd\te\rf", "x\x1cy\x85z\xa0w", "line one\nline one\n\nline two\nline one", *prose, prose[0], prose[0],
             "Repeat me often " * 400, "<|endoftext|> <|ENDOFTEXT|> İstanbul ΣΑΣ é don't IT'S", "\n".join(prose) * 3]
    rows = [(k, t, "en", ["b", "a", None, "ä", "B"][k % 5], len(t or ""), 1, 2, 3, "z", 4, "p", 5, 6) for k, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, "no id at all", None, None, None, *rows[0][5:]), (None, None, None, "a", None, *rows[0][5:])]
    return rows


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
