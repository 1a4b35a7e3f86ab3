"""Small awkward inputs shared by the operator tests."""

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, key string, "
          "node long, size long, mark string, rows int")
EXTRA = (0.5, True, "k", 7, 9, "m", 3)


def docs_frame(spark, rows):
    """rows: (doc_id, text, lang, source); with extra columns whose names
    operators use inside."""
    return spark.createDataFrame([(i, t, g, s, None, *EXTRA) for i, t, g, s in rows], SCHEMA)


LONG_LINE = "the quick brown fox jumps over the lazy dog and runs"
ODD = [
    (1, None, None, None), (2, "", "en", None), (3, " \t\n ", "en", "b"), (4, "Hello World", "en", "a"),
    (5, "hello world", None, "a"), (6, "HELLO WORLD", "de", "c"), (6, "HELLO WORLD", "de", "c"),
    (7, "word " * 20000, "en", "a"), (8, "Ünïcödé ßtraße " * 30, "de", "b"), (8, "other text, same id", "de", "b"),
    (9, "\n".join([LONG_LINE] * 3), "en", "b"), (None, "no id here", "en", "b"), (10, "x" * 900, "fr", "d"),
    (11, "12 34 ... !!", "en", "d"), (12, "naïve\x1cfile\x85sep 'tis it's <|endoftext|> ok", "fr", None),
]
