"""Words and the documents that have them."""

from millrace.operators import analytics as A


def test_words_of_documents_that_share_an_id_or_have_none(spark):
    rows = [(1, "a A b"), (2, "b"), (2, "b c"), (None, "a"), (3, None), (4, "")]
    got = A.lexeme_counts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.select("lexeme", "n", "docs").collect())) == [("a", 3, 1), ("b", 3, 2), ("c", 1, 1)]
