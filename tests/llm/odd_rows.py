"""Rows that an operator has to bear: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} the of cat{i % 31}" for i in range(12_000))
TEXTS = [
    (1, "The cat of the house sat on a mat and the dog slept.", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, " \t\n ", "b"),
    (5, "The cat of the house sat on a mat and the dog slept.", "b"),
    (5, "The cat of the house sat on a mat and the dog slept.", "b"),
    (None, "x", "c"),
    (None, None, None),
    (7, LONG, "a"),
    (8, "###\x00 é́ \U0001f600 <|endoftext|> \x85   end", ""),
    (-9, "same\nsame\nsame\n\nsame", "c"),
    (9_000_000_000, "a b c d e a b c d e a b c d e", "c"),
]
CLASHES = "key size row shard mark part place source_size order spots score found host kept smallest text_crc32 slot n rate of range guest first".split()


def odd(spark):
    df = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


def none(spark):
    return odd(spark).where("false")
