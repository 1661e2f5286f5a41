"""Block labels on sites that the network was not trained on."""

import os
import sys

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from held_out_pages import PAGES  # noqa: E402

from tallyfold.llm import htmlblocks  # noqa: E402


@pytest.fixture(scope="module")
def judge():
    htmls = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column("html").to_pylist()
    model = htmlblocks._fit(pa.table({"h": htmls}), epochs=6, copies=2, made=100, sites=4)

    def run(blocks):
        x, _ = htmlblocks.padded([htmlblocks.vectors(blocks, {})])
        return htmlblocks.forward(x, np.ones(x.shape[:2], np.float32), model)[:, 0] > 0

    return run


def f1(hit, false, lost):
    return 2 * hit / max(1, 2 * hit + false + lost)


@pytest.mark.parametrize("name, page, want", PAGES, ids=[p[0] for p in PAGES])
def test_pages_of_other_sites(judge, name, page, want):
    blocks = htmlblocks.leaves(page)
    got = [b[0] for b, yes in zip(blocks, judge(blocks), strict=True) if yes]
    hit = sum(t in want for t in got)
    assert f1(hit, len(got) - hit, len(want) - hit) >= (0.8 if name == "unknown names" else 0.99), got


def test_made_up_sites_with_other_draws(judge):
    rng, words = np.random.default_rng(2024), "alle neuen häuser stehen am rand der alten stadt und kosten viel geld".split()
    hit = false = lost = 0
    for _ in range(200):
        blocks, good = htmlblocks.site(rng, words)
        yes = judge(blocks)
        hit += int((yes & (good > 0)).sum())
        false += int((yes & (good == 0)).sum())
        lost += int((~yes & (good > 0)).sum())
    print("block F1", f1(hit, false, lost))
    assert f1(hit, false, lost) > 0.9


def test_header_of_an_article_is_not_furniture():
    assert htmlblocks.teacher(("html", "body", "article", "header", "h1"), "A title", 0.0)
    assert not htmlblocks.teacher(("html", "body", "header", "h1"), "A title", 0.0)
    assert not htmlblocks.teacher(("html", "body", "article", "footer", "p"), "Tags of it", 0.0)
