"""Quality rules with a suffix-array test for repeated text.

The words of many texts are ranked together by prefix doubling; the text number is the first key, so
suffixes of different texts never tie.  The ranks of every doubling step give the longest common prefix
of neighbours by binary lifting.  A suffix's deepest prefix interval has the length m of its longer
neighbour prefix; it is maximal to the left unless the suffix before it has m + 1.  The spans of the
maximal repeats of ``min_repeat`` or more words are united; a text fails if they cover more than
``max_covered`` per cent of its words or if one is longer than ``max_longest`` words.  The base counts of repeated
three-word windows read the same prefixes.

Null or wordless text: all counts zero, base_failed, not kept.  A dup line is one equal to an earlier line
of the same text (whole line; lines without a word never count).  Repeated rows are judged alike; an empty
table gives an empty result.  Memory is a fixed multiple of one slice, or of the longest text.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from tallyfold.llm.rows import map_rows, text_bytes
from tallyfold.llm.tokens import NOT_SPACE, byte_table, covered, per_text, prefix_hash, range_hash, runs

SYMBOL = byte_table(b"#*$%&|<>")
FIELDS = [
    ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"),
    ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean"), ("n_covered", "bigint"),
    ("longest_repeat", "bigint"),
]


def suffix_ranks(word: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4 ... words inside a text, until all differ.

    A rank is the number of suffixes before its group, so a step only sorts the suffixes still tied.
    """
    n = len(word)
    order = np.lexsort((word, doc))
    new = np.ones(n, bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (word[order][1:] != word[order][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    size = np.bincount(first, minlength=n)
    levels, step = [rank.astype(np.int32)], 1
    tied = np.flatnonzero(size[rank] > 1)
    while len(tied):
        ahead = tied + step
        inside = ahead < n
        inside[inside] = doc[ahead[inside]] == doc[tied[inside]]
        second = np.full(len(tied), -1, np.int64)
        second[inside] = rank[ahead[inside]]
        key = rank[tied] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        t, key = tied[by], key[by]
        group = rank[t]
        idx = np.arange(len(t))
        g_new = np.ones(len(t), bool)
        g_new[1:] = group[1:] != group[:-1]
        k_new = np.ones(len(t), bool)
        k_new[1:] = key[1:] != key[:-1]
        g_at = np.maximum.accumulate(np.where(g_new, idx, 0))
        k_at = np.maximum.accumulate(np.where(k_new, idx, 0))
        fresh = group + k_at - g_at
        rank = rank.copy()
        rank[t] = fresh
        levels.append(rank.astype(np.int32))
        step *= 2
        tied = np.sort(t[np.bincount(k_at, minlength=len(t))[k_at] > 1])
    return levels


def longest_match(word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For every suffix, the words it shares with its closest neighbour in suffix order, same text."""
    n = len(word)
    if n < 2:
        return np.zeros(n, np.int64)
    levels = suffix_ranks(word, doc)
    array = np.empty(n, np.int64)
    array[levels[-1]] = np.arange(n)
    a, b = array[:-1], array[1:]
    same = doc[a] == doc[b]
    a, b = a[same], b[same]
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        pa_, pb = a + lcp, b + lcp
        room = np.maximum(pa_, pb) + (1 << k) <= n
        ok = room.copy()
        ok[room] = levels[k][pa_[room]] == levels[k][pb[room]]
        lcp[ok] += 1 << k
    out = np.zeros(n, np.int64)
    np.maximum.at(out, a, lcp)
    np.maximum.at(out, b, lcp)
    return out


def maximal_repeats(match: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of repeats of at least ``least`` words that the word before doesn't extend."""
    start = match >= least
    extended = np.zeros(len(match), bool)
    extended[1:] = (doc[1:] == doc[:-1]) & (match[:-1] == match[1:] + 1)
    at = np.flatnonzero(start & ~extended)
    return at, match[at]


def duplicate_lines(raw: np.ndarray, off: np.ndarray, pre: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    s, e, doc = runs(raw != 10, off)
    words = np.concatenate([[0], np.cumsum(NOT_SPACE[raw])])
    keep = words[e] > words[s]
    s, e, doc = s[keep], e[keep], doc[keep]
    h = range_hash(pre, s, e)
    order = np.lexsort((h, doc))
    again = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    return per_text(doc[order][1:][again], n)


def quality_rules(
    docs: DataFrame,
    text_col: str = "text",
    carry: Sequence[str] = ("doc_id",),
    prefix: str = "",
    min_repeat: int = 8,
    max_covered: int = 30,
    max_longest: int = 100,
) -> DataFrame:
    """``carry`` columns of every document with its counts and verdict."""

    def judge(texts):
        raw, off = text_bytes(texts)
        n = len(texts)
        s, e, doc = runs(NOT_SPACE[raw], off)
        pre = prefix_hash(raw)
        match = longest_match(range_hash(pre, s, e), doc)
        words = per_text(doc, n)

        def total(flag):
            run = np.concatenate([[0], np.cumsum(flag)])
            return run[off[1:]] - run[off[:-1]]

        threes = np.flatnonzero(match >= 3)
        repeat = per_text(doc[covered(threes, np.full(len(threes), 3), len(s))], n)
        at, size = maximal_repeats(match, doc, min_repeat)
        cover = per_text(doc[covered(at, size, len(s))], n)
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, doc[at], size)
        failed = (words < 50) | (100 * repeat > 50 * words)
        kept = ~failed & (100 * cover <= max_covered * words) & (longest <= max_longest)
        chars = total(NOT_SPACE[raw] & ((raw & 0xC0) != 0x80))
        return [words, chars, total(SYMBOL[raw]), duplicate_lines(raw, off, pre), repeat, failed, kept, cover, longest]

    return map_rows(docs, [text_col], FIELDS, judge, carry, prefix)
