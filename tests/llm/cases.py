"""Small tables that every operator must survive: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1] or "")) for r in rows], SCHEMA)


def hard(spark):
    long = " ".join(f"w{i % 997}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, long, "en", "a"), (5, long, "en", "a"), (6, "ein Wort", "de", None), (7, "x" * 50000, None, "b"), (None, "no id at all", "en", "b"), (8, "naïve Ünïcode 日本語   \x85 end", "fr", "a"), (9, "same same same", "en", "a"), (9, "same same same", "en", "a"), (10, "the other text of ten", None, "a"), (10, "another text of ten", None, "b")]
    return docs(spark, rows).selectExpr("*", "1 as size", "'z' as node", "2.5 as score", "array(1) as names", "'k' as component_id", "7 as h", "'t' as target")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
