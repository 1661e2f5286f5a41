"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window is 13 consecutive words of an item (the whole item if it is shorter).  Containment of a window
asks for all of its word shingles, so in an order by rarity the necessary prefix is the one rarest
shingle: a text that lacks it cannot hold the window.  The shingle counts come from all documents.

1. Items become windows (Spark); windows go in blocks of at most ``block_windows``, so what a task holds
   of the benchmark is bounded however large the benchmark grows; blocks are chained passes.
2. One pass counts the block's shingles over all documents; each window keeps its rarest one.
3. One pass looks every document shingle up among the prefixes.  The offset of the prefix inside its
   window fixes the only possible place; places that would leave the text are dropped (position and
   length bound), the rest are compared word for word.

Null or wordless texts have no words: no hits, the digest of the empty string, not contaminated.
Null or wordless items have no window.  Items with equal ids count once; a null item id reads ''.
Ties in rarity go to the smaller hash and then the earlier place.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.rows import column, map_rows, slices, text_bytes
from tallyfold.llm.tokens import ALNUM, LOWER, U64, covered, ngrams, per_text, prefix_hash, range_hash, runs
from tallyfold.session import Scratch

SHINGLE = 3
FIELDS = [
    ("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"),
    ("contaminated", "boolean"),
]


def _words(text: pa.Array):
    raw, off = text_bytes(text)
    low = LOWER[raw]
    s, e, doc = runs(ALNUM[low], off)
    return low, s, e, doc, range_hash(prefix_hash(low), s, e), len(text)


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """One row per item and window: item (string), window (its words, one space between), n (words)."""

    def cut(text, item):
        low, s, e, doc, _, n = _words(text)
        out = [[] for _ in range(n)]
        for d in range(n):
            a, b = np.searchsorted(doc, [d, d + 1])
            w = [low[s[i] : e[i]].tobytes() for i in range(a, b)]
            size = min(window, len(w))
            if w:
                out[d] = [b" ".join(w[i : i + size]).decode() for i in range(len(w) - size + 1)]
        return [pa.array(out, pa.list_(pa.string())), item.fill_null("")]

    src = items.select(column(text_col).alias("t"), F.coalesce(column(id_col).cast("string"), F.lit("")).alias("k"))
    wins = map_rows(src, ["t", "k"], [("w", "array<string>"), ("item", "string")], cut)
    return wins.select("item", F.explode("w").alias("window")).distinct()


class Block:
    """Windows that one pass looks for; plain arrays, bounded by ``block_windows``."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.texts = sorted({w for _, w in rows})
        at = {w: i for i, w in enumerate(self.texts)}
        self.items: list[list[str]] = [[] for _ in self.texts]
        for item, w in rows:
            self.items[at[w]].append(item)
        text = pa.array([w for w in self.texts], pa.string())
        _, _, _, doc, h, n = _words(text)
        self.size = np.bincount(doc, minlength=n)
        self.first = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.words = h
        # every shingle of every window: hash, window, offset; a window below three words is one shingle
        parts = []
        for k in range(1, SHINGLE + 1):
            g, i = ngrams(h, doc, k)
            keep = (self.size[doc[i]] == k) if k < SHINGLE else np.ones(len(i), bool)
            parts.append((g[keep], doc[i][keep], i[keep] - self.first[doc[i][keep]], np.full(int(keep.sum()), k)))
        self.sh, self.sh_win, self.sh_off, self.sh_len = (np.concatenate(x) for x in zip(*parts))
        self.vocabulary = np.unique(self.sh)
        self.lengths = sorted(set(self.sh_len.tolist()))
        self.filter = _bitmap(self.vocabulary)

    def choose(self, counts: np.ndarray) -> None:
        """Keep each window's rarest shingle; ``counts`` follows ``vocabulary``."""
        rare = counts[np.searchsorted(self.vocabulary, self.sh)]
        order = np.lexsort((self.sh_off, self.sh, rare, self.sh_win))
        first = order[np.unique(self.sh_win[order], return_index=True)[1]]
        first = first[np.argsort(self.sh[first], kind="stable")]
        self.prefix, self.win, self.off = self.sh[first], self.sh_win[first], self.sh_off[first]
        self.lengths = sorted(set(self.sh_len[first].tolist()))
        self.filter = _bitmap(self.prefix)
        self.sh = self.sh_win = self.sh_off = self.sh_len = None


def _bitmap(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[keys & U64((1 << 20) - 1)] = True
    return out


def _hits(keys: np.ndarray, bitmap: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Places in g whose hash is among the sorted keys."""
    at = np.flatnonzero(bitmap[g & U64((1 << 20) - 1)])
    k = np.searchsorted(keys, g[at])
    return at[(k < len(keys)) & (keys[np.minimum(k, len(keys) - 1)] == g[at])] if len(keys) else at[:0]


def shingle_counts(docs: DataFrame, text_col: str, block: Block) -> np.ndarray:
    """Occurrences of the block's shingles over all documents."""
    vocab, bitmap, lengths = block.vocabulary, block.filter, block.lengths

    def run(batches):
        total = np.zeros(len(vocab), np.int64)
        for batch in batches:
            if batch.num_rows:
                for a, b in slices([batch.column(0)]):
                    _, _, _, doc, h, _ = _words(batch.column(0).slice(a, b - a))
                    for k in lengths:
                        g, _ = ngrams(h, doc, k)
                        found = g[_hits(vocab, bitmap, g)]
                        total += np.bincount(np.searchsorted(vocab, found), minlength=len(vocab))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["i", "n"])

    out = np.zeros(len(vocab), np.int64)
    part = docs.select(column(text_col).cast("string").alias("t")).mapInArrow(run, "i bigint, n bigint")
    for r in part.groupBy("i").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.i] = r.n
    return out


def _find(block: Block, low, s, e, doc, h):
    """(first word, window) of every occurrence of a window of the block."""
    starts, wins = [], []
    for k in block.lengths:
        g, at = ngrams(h, doc, k)
        hit = _hits(block.prefix, block.filter, g)
        lo, hi = np.searchsorted(block.prefix, g[hit], "left"), np.searchsorted(block.prefix, g[hit], "right")
        n = hi - lo
        idx = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        win = block.win[idx]
        start = np.repeat(at[hit], n) - block.off[idx]
        size = block.size[win]
        ok = (start >= 0) & (start + size <= len(h))
        start, win, size = start[ok], win[ok], size[ok]
        ok = doc[start] == doc[start + size - 1] if len(start) else np.zeros(0, bool)
        start, win, size = start[ok], win[ok], size[ok]
        for j in range(int(size.max()) if len(size) else 0):
            ok = (j >= size) | (h[np.minimum(start + j, len(h) - 1)] == block.words[np.minimum(block.first[win] + j, len(block.words) - 1)])
            start, win, size = start[ok], win[ok], size[ok]
        starts.append(start)
        wins.append(win)
    start, win = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, wins))
    ok = [
        b" ".join(low[s[i] : e[i]].tobytes() for i in range(a, a + block.size[w])).decode() == block.texts[w]
        for a, w in zip(start.tolist(), win.tolist())
    ]
    ok = np.array(ok, bool)
    return start[ok], win[ok]


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    carry: Sequence[str] = ("doc_id",),
    prefix: str = "",
    window: int = 13,
    min_share: int = 20,
    block_windows: int = 100_000,
) -> DataFrame:
    """``carry`` columns of every document with n_words, n_hit, n_items, items_sha256 and contaminated
    (a hit, and ``min_share`` * hits >= words)."""
    scratch = Scratch(docs.sparkSession)
    wins = scratch.cut(item_windows(items, item_id_col, item_text_col, window), "windows")
    n = wins.select("window").distinct().count()
    n_blocks = max(1, -(-n // block_windows))
    cur = docs.select(
        *[column(c).alias(f"c{i}") for i, c in enumerate(carry)], column(text_col).cast("string").alias("t"),
        F.lit(None).cast("array<bigint>").alias("spans"), F.lit(None).cast("array<string>").alias("found"),
    )
    kept = [f"c{i}" for i in range(len(carry))]
    for b in range(n_blocks):
        mine = wins.filter(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == b)
        block = Block([(r["item"], r["window"]) for r in mine.toLocalIterator()])
        block.choose(shingle_counts(docs, text_col, block))

        def look(text, spans, found, block=block):
            low, s, e, doc, h, n = _words(text)
            base = np.searchsorted(doc, np.arange(n))
            start, win = _find(block, low, s, e, doc, h)
            spans, found = spans.to_pylist(), found.to_pylist()
            spans, found = [x or [] for x in spans], [set(x or ()) for x in found]
            at = doc[start]
            for d, a, size in zip(at.tolist(), (start - base[at]).tolist(), block.size[win].tolist()):
                spans[d] += (a, size)
            # a window that occurs often in a text brings its items once
            for d, w in np.unique(np.stack([at, win], 1), axis=0).tolist():
                found[d].update(block.items[w])
            return [pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]

        if b < n_blocks - 1:
            cur = map_rows(cur, ["t", "spans", "found"], [("spans", "array<bigint>"), ("found", "array<string>")], look, carry=[*kept, "t"])
            if b % 4 == 3:
                cur = scratch.cut(cur, "pass")

    def finish(text, spans, found):
        spans, found = look(text, spans, found)
        _, s, _, doc, _, n = _words(text)
        base, words = np.searchsorted(doc, np.arange(n)), per_text(doc, n)
        at, size = [], []
        for d, x in enumerate(spans.to_pylist()):
            at += [int(base[d]) + p for p in x[::2]]
            size += x[1::2]
        hit = per_text(doc[covered(np.array(at, np.int64), np.array(size, np.int64), len(s))], n) if at else np.zeros(n, np.int64)
        found = found.to_pylist()
        return [
            words, hit, np.array([len(x) for x in found], np.int64),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in found], pa.string()),
            (hit > 0) & (min_share * hit >= words),
        ]

    out = map_rows(cur, ["t", "spans", "found"], FIELDS, finish, carry=kept, prefix=prefix)
    taken = {prefix + n for n, _ in FIELDS}
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry) if c.lower() not in taken], *[prefix + n for n, _ in FIELDS])
