"""Odd rows that every operator must take."""

LONG = "wort " * 300_000  # 1.5 MB


def documents(spark, extra=()):
    """(doc_id, text, lang, source) with nulls, empty and blank texts, ties, repeated rows and columns that clash with inner names."""
    rows = [(1, "the cat sat on the mat and the dog ran", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \n\t ", "de", "b"),
            (None, "no id here but some words", "en", "b"), (5, "der Hund und die Katze", "de", None), (5, "der Hund und die Katze", "de", None),
            (6, "einzeln", "de", "b"), (7, LONG, "en", "c"), (8, "the cat sat on the mat and the dog ran", "en", "c"), *extra]
    rows = [(*r, 1, "x", 2.0, "y", 3, "z") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id long, key string, n double, "
                                       "pattern string, size int, rest string")


def empty(spark):
    return documents(spark).limit(0)
