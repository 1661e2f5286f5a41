"""Corpora of packed files."""

import os

import pyarrow as pa
import pyarrow.parquet as pq


def test_any_text_comes_back(spark, tmp_path):
    from tallyfold.sources import packed, readers

    rows = [("1", "one\ntwo\r\n"), ("2", ""), ("3", "\u0001a\u0002b\u0003c\u0001"), ("4", "\u0003"), ("4", "\u0002 x"), ("a\u0002b", "y")]
    packed.write_packed(spark.createDataFrame(rows, "doc_id string, text string"), str(tmp_path / "p"))
    got = readers.read_corpus(spark, str(tmp_path / "p"), packed=True).collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_corpus_query_writes_no_file_per_document(spark, tmp_path, monkeypatch):
    from tallyfold.plans import tables

    n = 300
    docs = pa.table({"doc_id": list(range(n)), "text": [f"text {i}\n" for i in range(n - 1)] + [None]})
    pq.write_table(docs, tmp_path / "documents.parquet")
    made = str(tmp_path / "corpus")
    monkeypatch.setattr(tables.Scratch, "path", lambda self, name: made)
    got = sorted((int(r.doc_id), r.text) for r in tables.a04(spark, str(tmp_path)).collect())
    assert got == [(i, f"text {i}\n" if i < n - 1 else "") for i in range(n)]
    assert sum(len(names) for _, _, names in os.walk(made)) < 100
