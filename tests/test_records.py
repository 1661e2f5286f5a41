"""Files read by byte ranges give the records of a whole read."""

import gzip
import io
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfold.sources import readers
from tallyfold.sources.records import read_marked, records

MARK = b"<num>"


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.sampled_from([b"<num>", b"<nu", b"m>", b"<", b"text", "ä".encode(), b"\n", b"<num"]), max_size=40),
    st.integers(1, 30),
    st.integers(1, 9),
)
def test_every_record_comes_once(pieces, step, chunk):
    data = b"".join(pieces)
    want = [(m.start(), m.group()) for m in re.finditer(rb"(?s)<num>.*?(?=<num>|\Z)", data)]
    got = []
    for start in range(0, len(data), step):
        stream = io.BytesIO(data)
        stream.seek(start)
        got += records(stream, MARK, start, min(start + step, len(data)), chunk)
    assert got == want


def test_one_file_many_tasks(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    blocks = [f"<num> Number: {i}\n<title> öffentlich {i}\n<desc> Description:\nline {'x' * (i % 50)}\n</top>\n<top>\n" for i in range(400)]
    text = "junk <title> before\n<top>\n" + "".join(blocks)
    (folder / "topics.txt").write_text(text)
    whole = readers.read_tagged_topics(spark, str(folder / "topics.txt"))
    ranges = readers.read_tagged_topics(spark, str(folder / "topics.txt"), split_bytes=1000)
    assert ranges.rdd.getNumPartitions() > 20
    assert sorted(map(tuple, ranges.collect())) == sorted(map(tuple, whole.collect()))
    (folder / "_SUCCESS").write_text("<num> hidden")
    (folder / "sub" / "more.txt.gz").write_bytes(gzip.compress(b"<num> a <num> b"))
    (folder / "empty.txt").write_text("")
    got = read_marked(spark, str(folder), "<num>", 512).collect()
    assert len(got) == 402 and {r.value for r in got if r.file.endswith(".gz")} == {"<num> a ", "<num> b"}
    assert len(read_marked(spark, f"file://{folder}", "<num>", 512).collect()) == 402


def test_documents_of_one_file(spark, tmp_path):
    path = tmp_path / "docs.txt"
    path.write_text("head\n" + "".join(f"<DOC>\n<DOCNO> d{i} </DOCNO>\nbody {i}\n" for i in range(50)))
    got = {r.doc_id: r.text for r in readers.read_corpus_records(spark, str(path), split_bytes=64).collect()}
    assert got == {f"d{i}": f"body {i}" for i in range(50)}
    path.write_text("<DOC>\nno id\n")
    with pytest.raises(Exception, match="document without id"):
        readers.read_corpus_records(spark, str(path)).collect()


def test_marker_that_overlaps_itself_is_an_error(spark, tmp_path):
    (tmp_path / "f").write_text("aaa")
    with pytest.raises(Exception, match="overlap"):
        read_marked(spark, str(tmp_path / "f"), "aa").collect()
