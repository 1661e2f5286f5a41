"""A fit goes on where a dead driver left it."""

import pytest
from pyspark.sql import functions as F

from tallyfold.models import em
from tallyfold.models.workers import dawid_skene, mace, one_coin


@pytest.fixture(scope="module")
def ann(spark):
    rows = [(f"t{i}", w, int((i + (w * i % 7 == 3)) % 3)) for i in range(40) for w in range(6) if (i * w) % 5 != 1]
    return spark.createDataFrame(rows, "task_id string, worker_id int, label int").persist()


def values(fit):
    labels = sorted((r.task_id, r.label, tuple(r.p)) for r in fit.labels.collect())
    return labels, sorted(map(tuple, fit.workers.collect()), key=repr), fit.trace_rows, fit.prior


def assert_same(a, b):
    for got, want in zip(a[:2], b[:2]):
        assert len(got) == len(want)
        for x, y in zip(got, want):
            flat = [v for c in x for v in (c if isinstance(c, (tuple, list)) else [c])]
            other = [v for c in y for v in (c if isinstance(c, (tuple, list)) else [c])]
            assert flat == pytest.approx(other, abs=1e-12) if not isinstance(flat[0], str) else flat[1:] == pytest.approx(other[1:], abs=1e-12)
    assert [(t, m) for t, m, _ in a[2]] == [(t, m) for t, m, _ in b[2]]
    assert [v for *_, v in a[2]] == pytest.approx([v for *_, v in b[2]], abs=1e-9)
    assert a[3] == pytest.approx(b[3], abs=1e-12)


FITS = {
    "ds": lambda ann, **kw: dawid_skene(ann, threshold=None, **kw),
    "zc": lambda ann, **kw: one_coin(ann, threshold=None, **kw),
    "mace": lambda ann, **kw: mace(ann, **kw),
}


@pytest.mark.parametrize("name", FITS)
def test_killed_fit_resumes_to_the_same_tables(spark, ann, tmp_path, monkeypatch, name):
    fit, folder = FITS[name], str(tmp_path / "fit")
    want = values(fit(ann, rounds=4))
    read, calls = em.read_totals, []

    def dies(params, k):
        calls.append(k)
        if len(calls) == 3:
            raise RuntimeError("driver lost")
        return read(params, k)

    monkeypatch.setattr(em, "read_totals", dies)
    with pytest.raises(RuntimeError, match="driver lost"):
        fit(ann, rounds=4, resume_dir=folder)
    # the parameters of round 3 are written but not committed
    assert (tmp_path / "fit/round-000003/params").exists() and not (tmp_path / "fit/round-000003/state").exists()
    assert_same(values(fit(ann, rounds=4, resume_dir=folder)), want)
    total = 4 + (name == "zc")
    assert len(calls) == 3 + total - 2
    # a finished fit only takes its last evidence pass again
    assert_same(values(fit(ann, rounds=4, resume_dir=folder)), want)
    assert len(calls) == 3 + total - 2
    kept = sorted(p.parent.name for p in tmp_path.glob("fit/*/params"))
    assert kept == [f"round-{t:06d}" for t in (total - 1, total)]


def test_more_rounds_and_other_fits(spark, ann, tmp_path):
    folder = str(tmp_path / "fit")
    dawid_skene(ann, rounds=2, threshold=None, resume_dir=folder)
    want = values(dawid_skene(ann, rounds=5, threshold=None))
    assert_same(values(dawid_skene(ann, rounds=5, threshold=None, resume_dir=folder)), want)
    with pytest.raises(ValueError, match="more than"):
        dawid_skene(ann, rounds=3, threshold=None, resume_dir=folder)
    with pytest.raises(ValueError, match="another fit"):
        dawid_skene(ann.filter(F.col("worker_id") > 0), rounds=6, threshold=None, resume_dir=folder)
    with pytest.raises(ValueError, match="another fit"):
        dawid_skene(ann, init_quality=0.6, rounds=6, threshold=None, resume_dir=folder)
