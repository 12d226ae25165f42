"""Small inputs with the awkward cases that every operator must take."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

AWKWARD = [
    None, "", "   \n\t ", "one", "One two THREE two", "a b c a b c a b c d", "línea Ä ß ñ 漢字 😀 end", "x" * 5000, "same text here", "same text here",
    "tail space ", "\n\nlines\nlines\n\nlines\n", "w " * 3000, "nul sp ace\u0085x", "<|endoftext|> mid<|endoftext|>", "it's we'll THEY'RE 123 45abc ***!!!  \n  x\t\ty",
    "".join(chr(97 + i * 7 % 26) for i in range(3000)), " " * 4000 + "z", "é" * 3000, "1234567890" * 400,
]


def documents(spark, texts, ids=None, langs=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, langs[k] if langs else "en", "s", len(t) if t is not None else None) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCUMENTS)


def awkward(spark):
    """Nulls in key columns, empty and long texts, ties, repeated rows."""
    n = len(AWKWARD)
    return documents(spark, [*AWKWARD, "same text here", None], [*range(n), 8, None])


def with_clashes(df):
    """Extra columns under names that an operator might use for its own."""
    from pyspark.sql import functions as F

    for c in (
        "fingerprint", "shard", "score", "n_words", "h", "key", "bucket", "words", "spans", "id", "row", "hash", "node", "root", "lead", "copies", "text_hash", "u", "v", "fp",
        "_kept", "_id", "_hash", "_row", "_trusted", "_clean", "_n_words", "_score", "_found", "_copy", "weights", "g", "t", "f",
    ):
        df = df.withColumn(c, F.lit("clash"))
    return df
