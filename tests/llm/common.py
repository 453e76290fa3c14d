"""Rows that every operator must take: nulls anywhere, empty and long texts, repeats, clashing extra columns."""

LONG = "word and more, words again. " * 20_000


def odd_documents(spark):
    rows = [(1, None, "en", None, None), (2, "", None, "web", 0), (3, LONG, "en", "web", 1), (4, "tie one two three four five", "en", "web", 1), (4, "tie one two three four five", "en", "web", 1), (5, "tie one two three four five", "en", "web", 1), (None, "no id here", "en", "web", 1), (None, None, None, None, None), (6, "Ünï cödé 😀 text\r\nline\ttwo", "en", "web", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: df.n_chars for c in ("node", "component", "posting", "length", "rank", "score", "shard", "email", "start", "value", "grp", "task_id", "toxic", "rest", "host", "ids")}
    return df.withColumns(extra)
