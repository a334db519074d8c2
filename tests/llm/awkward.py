"""Rows that every operator has to take: nulls, empty and long texts, ties, repeats, odd columns."""

from __future__ import annotations

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
NEAR = "the quick brown fox jumps over the lazy dog while seven wizards box with jugs of liquor today and a tired clerk counts every sheet of paper twice before the evening bell rings out".split()

DOCUMENTS = [
    (0, " ".join(NEAR), "en", "a", 1),
    (1, " ".join(NEAR), "en", "a", 1),
    (1, " ".join(NEAR), "en", "a", 1),
    (2, " ".join([*NEAR, "again"]), "en", "b", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n\x0b\x0c\r ", "en", "b", 7),
    (6, "one", "en", None, 3),
    (None, "a text without an id and with no source", "en", None, 0),
    (7, LONG, "xx", "c", len(LONG)),
    (8, "non\u00a0breaking \u2028 separators\x1c stay inside words", "en", "c", 0),
    (9, "é ü 日本語 \U0001f600 ﬁ ▁ <s> </s> <0x0A> <|endoftext|>  two  spaces ", "fr", "c", 0),
    (9, "the same id with another text", "fr", "c", 0),
    (10, "it's they'll 12,5 | a\r\nb", "en", "d", 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Columns that operators use inside.
CLASHES = (
    "size", "target", "taken", "position", "node", "class", "region", "component", "file", "block", "ids", "score",
    "kept", "label", "fingerprint", "_fingerprint", "_position", "_start", "_slice", "url_", "n", "path", "value",
)


def documents(spark, rows=DOCUMENTS):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(i).alias(name) for i, name in enumerate(CLASHES)])
