"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Rows (doc_id, text, lang, source)."""
    return spark.createDataFrame([(i, t, g, s, len(t) if t is not None else None) for i, t, g, s in rows], DOCS)


def awkward(spark):
    long = " ".join(f"word{i % 97}" for i in range(30_000))
    return docs(spark, [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog", "en", "a"),
        (3, None, None, None), (4, "", "en", "b"), (5, "  \n\t ", None, ""), (6, "12 34 %%", "de", "b"),
        (7, long, "en", "c"), (8, "one", "en", None), (9, "one two", "fr", "c"), (None, "no id here at all", "en", "a"),
        (10, "😀 emoji ▁ and  spaces ", "en", "b"), (11, "password=531ccd051a92ebcb68 x", "en", "docs/test/a")])


def clashing(df):
    """The table with more columns that bear the names of results and helpers."""
    from pyspark.sql import functions as F

    names = ["size", "fp", "fingerprint", "component_id", "k", "h", "key", "score", "hits", "gaps", "new", "taken", "y", "lang_pred", "label", "last"]
    return df.select("*", *[F.lit("clash").alias(n) for n in names])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
