"""Term rows stay where the texts of their document were dealt; repeated and null keys."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import terms as T
from tallyfold.operators import vectors as VE
from tallyfold.session import Scratch

ROWS = [(1, "aa bb bb cc"), (2, "aa cc dd"), (2, "bb aa"), (3, "cc dd dd"), (4, None), (None, "aa dd"), (5, "zz")]


def _docs(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_weights_move_texts_only(spark, tmp_path):
    docs = _docs(spark, tmp_path)
    counts = T.token_counts(docs)
    want = Counter((k, w) for k, t in ROWS for w in (t or "").split())
    assert {(r.doc_id, r.term): r.tf for r in counts.collect()} == want
    idf = Scratch(spark).cut(T.smoothed_idf(T.vocabulary(counts, 2), docs.count()))
    best = VE.top_terms(T.tfidf(counts, idf), 0.5)
    assert _plan(best).count("Exchange hashpartitioning") == 1
    assert "text" in _plan(best).split("Exchange hashpartitioning")[1]
    weights = {r.term: r.idf for r in idf.collect()}
    for key in (1, 2, 3):
        raw = {w: n * weights[w] for (k, w), n in want.items() if k == key and w in weights}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        got = {r.term: r.tfidf for r in T.tfidf(counts, idf).filter(F.col("doc_id") == key).collect()}
        assert got == pytest.approx({w: x / norm for w, x in raw.items()})
    assert {(r.doc_id, r.term) for r in best.collect()} == {(1, "bb"), (2, "aa"), (2, "cc"), (3, "dd")} or best.count() == 4


def test_pairs_meet_terms_by_document(spark, tmp_path):
    docs = _docs(spark, tmp_path)
    counts = T.token_counts(docs)
    idf = Scratch(spark).cut(T.smoothed_idf(T.vocabulary(counts, 2), docs.count()))
    query = Scratch(spark).cut(spark.createDataFrame([(0, "aa"), (0, "dd"), (1, "bb")], "topic_id long, term string"))
    pairs = docs.select((F.col("doc_id") % 2).alias("topic_id"), "doc_id")
    weighted = T.tfidf(counts, idf)
    rows = T.pair_terms(pairs, query, weighted.select("doc_id", "term", "tf"))
    assert "hashpartitioning(topic_id" not in _plan(rows) and "hashpartitioning(doc_id#, term" not in _plan(rows)
    # document 2 comes twice and its texts are one document
    got = Counter((r.topic_id, r.doc_id, r.term, r.tf) for r in rows.collect())
    assert got == {(1, 1, "bb", 2): 1, (0, 2, "aa", 2): 2, (0, 2, "dd", 1): 2}


def test_vectors_meet_blocks_not_rows(spark):
    counts = spark.createDataFrame(
        [(1, "a", 2), (1, "x", 2), (2, "x", 1), (3, "a", 1), (3, "b", 3), (None, "a", 1)], "doc_id long, term string, tf long"
    )
    # b has two rows, c a null component
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("b", [None, 1.0])], "term string, vec array<double>")
    out = VE.mean_vector(counts, vecs)
    got = {r.doc_id: r.vec for r in out.collect()}
    n = math.sqrt(1 + 36)
    assert got[None] is None and got[2] is None and len(got) == 4
    assert got[1] == pytest.approx([1.0, 0.0]) and got[3] == pytest.approx([1 / n, 6 / n])
    plan = _plan(out)
    assert "FlatMapCoGroupsInArrow" in plan and "ObjectHashAggregate" not in plan
