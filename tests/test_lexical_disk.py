"""Term tables of the lexical features: written once, dealt out, and deleted when read."""

import os

import pytest

from tallyfold.operators import features as FE
from tallyfold.operators import terms as T
from tallyfold.session import Scratch


@pytest.mark.parametrize("stem", [False, True])
def test_term_rows_are_written_once_and_leave(spark, monkeypatch, stem):
    written, real_cut, real_by = [], Scratch.cut, Scratch.cut_by

    def cut(self, df, name="table"):
        out = real_cut(self, df, name)
        written.append((name, out._tallyfold_path))
        return out

    def cut_by(self, df, key, parts, name="table"):
        out = real_by(self, df, key, parts, name)
        written.append((name, out._tallyfold_path))
        return out

    monkeypatch.setattr(Scratch, "cut", cut)
    monkeypatch.setattr(Scratch, "cut_by", cut_by)
    docs = spark.createDataFrame([(i, f"walking dogs run w{i % 3} walks") for i in range(9)], "doc_id long, text string")
    topics = spark.createDataFrame([(0, "walk dogs"), (1, "run w1")], "topic_id long, text string")
    pairs = spark.createDataFrame([(i % 2, i) for i in range(9)], "topic_id long, doc_id long")
    vecs = spark.createDataFrame([("walk", [1.0, 0.0]), ("dogs", [1.0, 2.0]), ("run", [0.0, 1.0])], "term string, vec array<float>")
    out = FE.lexical_features(pairs, topics, docs, vecs, min_df=1, stem=stem)
    assert out.count() == 9 and all(len(r.lexical) == 8 for r in out.collect())
    names = [n for n, _ in written]
    big = ["tokens", "doc-tfidf"] + (["doc-terms"] if stem else [])
    assert all(names.count(n) == 1 for n in big) and ("doc-terms" in names) == stem
    assert not [n for n, where in written if n in big and os.path.exists(where)]


def test_stems_meet_dealt_rows_in_place(spark):
    counts = T.token_counts(spark.createDataFrame([(1, "walks walk dogs"), (2, "dog of")], "doc_id long, text string"))
    stems = T.stem_counts(Scratch(spark).cut_by(counts, "doc_id", 4))
    assert {tuple(r) for r in stems.collect()} == {(1, "walk", 2), (1, "dog", 1), (2, "dog", 1), (2, "of", 1)}
    assert "Exchange hashpartitioning" not in stems._jdf.queryExecution().executedPlan().toString()
