"""Texts are tokenised once: their term rows are written as they are dealt out."""

from collections import Counter

from pyspark.sql import functions as F

from tallyfold.functions.textx import word_count
from tallyfold.operators import terms as T
from tallyfold.session import Scratch

ROWS = [
    (1, "walk walks walked zebra"), (2, "walking zebra"), (2, "walk lone"), (3, "walks talks"), (4, "talk"), (5, "talking lone"),
    (6, None), (None, "lone zebra"),
]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_counts_do_not_move_again(spark):
    counts = T.token_counts(spark.createDataFrame(ROWS, "doc_id long, text string").repartition(2))
    written = Scratch(spark).cut_by(counts, "doc_id", 5)
    assert Counter(map(tuple, written.collect())) == Counter(map(tuple, counts.collect()))
    idf = Scratch(spark).cut(T.smoothed_idf(T.vocabulary(written, 2), 6))
    assert "Exchange hashpartitioning" not in _plan(T.tfidf(written, idf))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("tallyfold_")]


def test_stem_vocabulary_is_the_vocabulary_of_stems(spark, monkeypatch):
    counts = T.token_counts(spark.createDataFrame(ROWS, "doc_id long, text string"))
    written = Scratch(spark).cut_by(counts, "doc_id", 5)
    for rows in (T.LOOKUP_ROWS, 0):
        monkeypatch.setattr(T, "LOOKUP_ROWS", rows)
        for min_df in (1, 2, 3):
            want = T.vocabulary(T.stem_counts(counts), min_df)
            assert {tuple(r) for r in T.stem_vocabulary(written, min_df).collect()} == {tuple(r) for r in want.collect()}
    # walk, walks, walked and walking are one stem of three documents
    assert T.stem_vocabulary(written, 3).filter("term = 'walk'").first()["df"] == 3


def test_word_count_white_space(spark):
    rows = [("",), (" \t\n ",), ("a",), ("  a\x0bb\f c\r\nd ",), ("  x",), (None,)]
    got = spark.createDataFrame(rows, "text string").select(F.col("text"), word_count("text").alias("n")).collect()
    assert [r.n for r in got] == [0, 0, 1, 4, 2, None]
