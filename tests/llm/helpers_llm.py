"""Small frames for the operators' tests."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, first=0):
    """A documents table with ids in order; texts may be None."""
    rows = [(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


def save(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
