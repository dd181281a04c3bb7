"""Odd documents that every operator has to bear."""

WORDS = "the and of to in a river stone light house garden window morning letter answer silver winter summer road field paper story music".split()


def sentence(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) & 0x7FFFFFFF
        out.append(WORDS[(x >> 8) % len(WORDS)])
    return " ".join(out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, lang_pred string, n_words long, _key string"


def frame(spark, rows):
    """Rows of (doc_id, text, lang, source) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None, 0.5, 1, "x", 2, "k") for i, t, lang, s in rows], SCHEMA)


ODD_ROWS = [
    (1, sentence(1, 120), "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "b"),
    (4, " \t\n ", "de", None),
    (5, sentence(1, 120), "en", "a"),
    (5, sentence(1, 120), "en", "a"),
    (None, sentence(2, 60), "en", "b"),
    (7, "x" * 300_000, "en", "b"),
    (8, sentence(3, 30_000), None, "c"),
    (9, "!!! 123 ???", "fr", "c"),
    (10, "日本語 🚀 é ▁ <|endoftext|> \x00", "de", None),
    (11, "one two", "es", "d"),
]
