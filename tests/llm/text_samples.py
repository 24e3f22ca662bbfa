"""Small tables of odd documents."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
LONG = " ".join(f"wort{i % 977}x{i}" for i in range(60_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog today.\nAnother line of text is here.", "s1"),
    (2, "the QUICK brown fox jumps over the lazy dog today.\nAnother line of text is here.", "s1"),
    (3, None, "s2"),
    (4, "", None),
    (5, " \t\n\n ", "s2"),
    (6, "one", "s3"),
    (7, "one two three four", "s3"),
    (8, "one two three four", "s3"),
    (9, LONG, "s1"),
    (10, LONG + " tail", "s1"),
    (11, "é ß Ünï ☃ " * 30, None),
    (12, "password = abcdefgh1 and more", "s4"),
    (None, "a row without an id is a row too", "s4"),
    (None, None, None),
]


def documents(spark, rows=TEXTS):
    frame = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    return frame


def clashing(docs):
    """More columns, under names that operators use inside."""
    for name in ("_id", "_key", "_row", "node", "digest", "n", "size", "_gone", "keep_id", "component_id", "taken", "kept", "n_removed", "draws", "copies"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


