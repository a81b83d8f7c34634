"""Small tables with the odd cases that every operator must take."""

from pyspark.sql import functions as F

DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
              "size long, row string, class string, start long, score double, host string, found string")
LONG = "word " * 40_000 + "end"


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf again"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, None, "en", "b"), (4, "", None, "b"),
        (5, LONG, "en", None), (6, "  \n\t ", "fr", "a"), (7, "été après noël garçon", "fr", "b"), (None, base + " tail", None, "c"),
        (None, None, None, None), (8, "!!! 123 ???", "en", "a"), (9, "one", "en", "c"), (10, "ONE", "en", "c"),
        (11, "x" * 5000, "en", "c"), (12, "\u0000 a b \U0001f600 <|endoftext|> it's we'll ¼ x́yz ΣΑΣ", "en", "a")]
    return spark.createDataFrame([(i, t, l, s, None, i, "r", None, 5, 0.5, "h", "f") for i, t, l, s in rows], DOC_SCHEMA)


def none_of(df):
    return df.where(F.lit(False))


def with_text(spark, rows, extra=()):
    return spark.createDataFrame([(i, t, *extra) for i, t in rows], "doc_id long, text string")


def table(spark, name, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")
