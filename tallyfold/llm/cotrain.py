"""Quality classifier by co-training of two views.

View A reads the text content: the ``n_terms`` hashed words and symbol runs that best separate the labelled
rows (chi-square).  Telling terms, at least three times as frequent on one side, count by log-damped
occurrences; common ones by their rate in the text.  View B reads page metadata: source, language, stated size and
layout measures (lines, line lengths, shares of capitals, digits, symbols, words that repeat the one
before), never which words they are.  Each view is a
ridge logistic regression.  For ``rounds`` rounds each view labels the rows of an unlabelled pool it is
surest about (at least ``sure``) and hands them to the *other* view.  Afterwards each view is calibrated on
labelled rows set aside for that (Platt), and a logistic combination of the two calibrated log-odds and the lower
of them scores every document.

Training sees at most about ``max_labelled`` labelled and ``max_pool`` unlabelled rows, chosen by hash;
scoring reads all rows and whole texts.  A row is good if quality is 1 and toxic is not 1; a null quality is
no label; contradicting label rows count as not good.  Null or empty text has no content terms and zero
layout measures and is scored all the same.  Without labels of both classes everything is kept, score 0.5 of both views.
Score at or above ``threshold`` is kept.  Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.fitting import as_lists, below, fit_once, logistic, sparse
from tallyfold.llm.rows import column, map_rows, text_bytes
from tallyfold.llm.tokens import LOWER, NOT_SPACE, byte_table, per_text, prefix_hash, range_hash, runs

BITS = 18
WORD = byte_table([*range(0x61, 0x7B), *range(0x80, 0x100)])
UPPER = byte_table(range(0x41, 0x5B))
DIGIT = byte_table(range(0x30, 0x3A))
SYMBOL = ~(WORD | UPPER | DIGIT | ~NOT_SPACE)
N_SOURCE, N_LANG = 32, 16
LEAST_CHI = 20.0
FIELDS = [("p_content", "double"), ("p_metadata", "double"), ("score", "double"), ("kept", "boolean")]


def content_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Text number and bucket of every word and symbol run."""
    raw, off = text_bytes(texts)
    low = LOWER[raw]
    pre = prefix_hash(low)
    docs, keys = [], []
    for flag in (WORD[low], SYMBOL[raw]):
        s, e, doc = runs(flag, off)
        docs.append(doc)
        keys.append((range_hash(pre, s, e) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(keys), len(texts)


def _bucket(values: pa.Array, n: int) -> np.ndarray:
    """Hash bucket of each value; null has bucket 0."""
    raw, off = text_bytes(values)
    h = (range_hash(prefix_hash(raw), off[:-1], off[1:]) % np.uint64(n - 1)).astype(np.int64) + 1
    return np.where(np.asarray(values.is_null()), 0, h)


def metadata(texts: pa.Array, source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> np.ndarray:
    raw, off = text_bytes(texts)
    n = len(texts)

    def total(flag):
        run = np.concatenate([[0], np.cumsum(flag)])
        return run[off[1:]] - run[off[:-1]]

    size = np.maximum(np.diff(off), 1)
    s, e, doc = runs(raw != 10, off)
    lines = np.maximum(per_text(doc, n), 1)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, e - s)
    ws, we, wdoc = runs(NOT_SPACE[raw], off)
    words = np.maximum(per_text(wdoc, n), 1)
    h = range_hash(prefix_hash(raw), ws, we)
    echo = per_text(wdoc[1:][(h[1:] == h[:-1]) & (wdoc[1:] == wdoc[:-1])], n)
    given = np.asarray(n_chars.fill_null(0).cast(pa.float64(), safe=False))
    layout = [
        np.log1p(np.maximum(given, 0)), np.asarray(n_chars.is_null()), np.log1p(lines), np.log1p(size / lines), np.log1p(longest),
        np.log1p(size / words), total(UPPER[raw]) / size, total(DIGIT[raw]) / size, total(SYMBOL[raw]) / size, np.log1p(words),
        np.minimum(total(SYMBOL[raw]) / words, 3), echo / words, echo > 0.1 * words, words < 20,
    ]
    out = np.zeros((n, len(layout) + N_SOURCE + N_LANG), np.float32)
    out[:, : len(layout)] = np.stack([np.asarray(x, np.float32) for x in layout], 1)
    out[np.arange(n), len(layout) + _bucket(source, N_SOURCE)] = 1
    out[np.arange(n), len(layout) + N_SOURCE + _bucket(lang, N_LANG)] = 1
    return out


def _features(texts, source, lang, n_chars):
    idx, val = as_lists(*content_terms(texts))
    meta = metadata(texts, source, lang, n_chars)
    off = pa.array(np.arange(0, meta.size + 1, meta.shape[1], dtype=np.int32))
    return [idx, val, pa.ListArray.from_arrays(off, pa.array(meta.ravel()))]


def _joint(odds: np.ndarray) -> np.ndarray:
    """Both calibrated log-odds and the lower one: a row is bad if either view has a reason."""
    return np.column_stack([odds, odds.min(1)])


def _value(count: np.ndarray, size: np.ndarray, telling: np.ndarray) -> np.ndarray:
    """Log-damped count of a telling term, rate per ten terms of a common one."""
    return np.where(telling, 1 + np.log(np.maximum(count, 1)), 10 * count / np.maximum(size, 1))


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _fit(table: pa.Table, n_terms: int, rounds: int, per_round: float, sure: float):
    table = table.take(pa.array(np.argsort(table.column("k").to_numpy(), kind="stable")))
    n = table.num_rows
    y = table.column("good").to_numpy(zero_copy_only=False).astype(float)
    row, idx, val = sparse(table, "idx", "val")
    named = ~np.isnan(y)
    if not (y[named] == 1).any() or not (y[named] == 0).any():
        return None
    fold = np.zeros(n, bool)
    fold[np.flatnonzero(named)[::5]] = True
    learn = named & ~fold
    if fold.sum() < 20 or len(np.unique(y[fold])) < 2 or len(np.unique(y[learn])) < 2:
        fold, learn = named, named
    # chi-square of presence against the label picks the content terms
    good, bad = learn & (y == 1), learn & (y == 0)
    a = np.bincount(idx[good[row]], minlength=1 << BITS).astype(float)
    b = np.bincount(idx[bad[row]], minlength=1 << BITS).astype(float)
    n_a, n_b = good.sum(), bad.sum()
    share = (a + b) / (n_a + n_b)
    chi = ((a - n_a * share) ** 2 / n_a + (b - n_b * share) ** 2 / n_b) / np.maximum(share * (1 - share), 1e-9)
    lean = np.abs(np.log((a + 0.5) / (n_a + 1)) - np.log((b + 0.5) / (n_b + 1)))
    n_telling = min(n_terms * 7 // 8, int(((lean >= np.log(3)) & (chi > LEAST_CHI)).sum()))
    telling = np.where(lean >= np.log(3), chi, 0)
    common = np.where(lean < np.log(3), chi, 0)
    terms = np.concatenate([np.argsort(-telling, kind="stable")[:n_telling], np.argsort(-common, kind="stable")[: n_terms // 8]])
    terms = terms[chi[terms] > LEAST_CHI]
    place = np.full(1 << BITS, -1, np.int32)
    place[terms] = np.arange(len(terms))
    keep = place[idx] >= 0
    xa = np.zeros((n, len(terms)), np.float32)
    xa[row[keep], place[idx[keep]]] = _value(val, np.bincount(row, weights=val, minlength=n)[row], place[idx] < n_telling)[keep]
    xb = table.column("meta").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    mean, dev = xb.mean(0), np.maximum(xb.std(0), 1e-3)
    xb = (xb - mean) / dev
    views, l2 = [xa, xb], 0.1
    sets = [(np.flatnonzero(learn), y[learn])] * 2
    free = ~named
    weights = [logistic(x[i], t, l2) for x, (i, t) in zip(views, sets)]
    for _ in range(rounds):
        take = max(1, int(per_round * free.sum())) if free.any() else 0
        new = []
        for x, w in zip(views, weights):
            at = np.flatnonzero(free)
            z = _odds(x[at], w)
            by = np.argsort(z, kind="stable")
            need = np.log(sure / (1 - sure))
            low, high = at[by[:take]][z[by[:take]] < -need], at[by[len(at) - take :]][z[by[len(at) - take :]] > need] if take else at[:0]
            new.append((np.concatenate([low, high]), np.concatenate([np.zeros(len(low)), np.ones(len(high))])))
        # what one view is sure of teaches the other
        sets = [tuple(np.concatenate(p) for p in zip(sets[v], new[1 - v])) for v in (0, 1)]
        for at, _ in new:
            free[at] = False
        weights = [logistic(x[i], t, l2) for x, (i, t) in zip(views, sets)]
    platt = [logistic(_odds(x[fold], w)[:, None], y[fold], 1e-2) for x, w in zip(views, weights)]
    odds = np.stack([_odds(_odds(x[fold], w)[:, None], p) for x, w, p in zip(views, weights, platt)], 1)
    both = logistic(_joint(odds), y[fold], 1e-2)
    return place, weights, mean, dev, platt, both, len(terms), n_telling


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    size_col: str = "n_chars",
    key_col: str = "doc_id",
    label_cols: Sequence[str] = ("doc_id", "quality", "toxic"),
    carry: Sequence[str] = ("doc_id",),
    prefix: str = "",
    max_labelled: int = 8000,
    max_pool: int = 4000,
    n_terms: int = 512,
    rounds: int = 3,
    per_round: float = 0.05,
    sure: float = 0.95,
    threshold: float = 0.6,
) -> DataFrame:
    """``carry`` columns of every document with the views' probabilities, the joint score and kept."""
    key, quality, toxic = (column(c) for c in label_cols)
    named = (
        labels.filter(quality.isNotNull() & key.isNotNull())
        .groupBy(key.alias("lk"))
        .agg(F.min(F.when((quality == 1) & (F.coalesce(toxic, F.lit(0)) != 1), 1.0).otherwise(0.0)).alias("good"))
    )
    n_named, n_docs = named.count(), docs.count()
    model = None
    if n_named and n_docs:
        chosen = named.filter(below(F.col("lk"), max_labelled / n_named, 1))
        inputs = docs.select(
            column(key_col).alias("k0"), column(text_col).alias("t"), column(source_col).cast("string").alias("s"),
            column(lang_col).cast("string").alias("l"), column(size_col).cast("bigint").alias("c"),
        )
        taught = inputs.join(chosen, F.col("k0") == F.col("lk"), "inner").drop("lk")
        pool = inputs.filter(below(F.col("k0"), max_pool / n_docs, 2)).join(named, F.col("k0") == F.col("lk"), "left_anti")
        both = taught.unionByName(pool.withColumn("good", F.lit(None).cast("double"))).withColumn("k", F.xxhash64("k0"))
        sample = map_rows(
            both, ["t", "s", "l", "c"], [("idx", "array<int>"), ("val", "array<float>"), ("meta", "array<float>")],
            _features, ["k", "good"],
        )
        model = fit_once(sample.dropDuplicates(["k"]), lambda t: _fit(t, n_terms, rounds, per_round, sure))

    def score(texts, source, lang, n_chars):
        n = len(texts)
        if model is None:
            return [np.full(n, 0.5)] * 3 + [np.ones(n, bool)]
        place, weights, mean, dev, platt, both, width, n_telling = model
        doc, key, _ = content_terms(texts)
        size = np.bincount(doc, minlength=n)
        at = place[key]
        doc, at = doc[at >= 0], at[at >= 0]
        pair, count = np.unique(doc * width + at, return_counts=True)
        who, term = pair // max(1, width), pair % max(1, width)
        part = _value(count, size[who], term < n_telling) * weights[0][term]
        z = [np.bincount(who, weights=part, minlength=n) + weights[0][-1]]
        z.append(_odds((metadata(texts, source, lang, n_chars) - mean) / dev, weights[1]))
        z = np.stack([_odds(v[:, None], p) for v, p in zip(z, platt)], 1)
        joint = 1 / (1 + np.exp(-_odds(_joint(z), both)))
        p = 1 / (1 + np.exp(-z))
        return [p[:, 0], p[:, 1], joint, joint >= threshold]

    inputs = [text_col, column(source_col).cast("string"), column(lang_col).cast("string"), column(size_col).cast("bigint")]
    return map_rows(docs, inputs, FIELDS, score, carry, prefix)
