from __future__ import annotations

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, n_words string"


def documents(spark, rows):
    """Rows (doc_id, text, source) as a documents table with extra columns of clashing names."""
    return spark.createDataFrame(
        [(i, t, None, s, None if t is None else len(t), "x", "y") for i, t, s in rows], DOCS)


def stored_documents(spark, tmp_path, rows):
    """The same as stored files, for operators that read a table more than once."""
    location = str(tmp_path / "documents.parquet")
    documents(spark, rows).write.parquet(location)
    return spark.read.parquet(location)
