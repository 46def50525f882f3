"""Small corpora for the tests of the training-data operators."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD = ["", " ", None, "  two  spaces ", "\n", "a\nb\n\nc", "it's the dog's. <|endoftext|> a", "<s> x </s>", "日本語 テスト。 ok", "é É. Ünï", "ΑΣ. x", "x" * 3000, "word " * 3000, "... !? 12.5 a1b2", "▁ ▁x", "\tx\r\ny"]


def corpus(spark, texts=None, **columns):
    """One document for each text, doc_ids from 10 on, two rows equal, and extra columns with clashing names."""
    texts = ODD if texts is None else texts
    rows = [(10 + i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows[4:5], *rows[-1:]], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def crowded(df, *names):
    """`df` with extra columns of names that an operator may use itself."""
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("x").alias(n) for n in names))
