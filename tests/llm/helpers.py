DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, n string, h string, kept string"


def make_docs(spark, rows):
    """rows of (doc_id, text[, source[, lang]]), with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s",
                                   None, "x", None, "h", "k") for r in rows], DOC_SCHEMA)
