"""Language identification: averaged hashed subword embeddings with a linear softmax.

A subword is a run of three or four bytes of the lower-cased text, every non-letter read as a space, whose
inner bytes are letters.  The embeddings of all subwords of the whole text are averaged and go through one
linear softmax layer; both are trained by stochastic gradient descent in numpy on at most about
``train_rows`` rows.  Part of the sample is set aside to calibrate: a temperature for the score, and a
rejection threshold, the score that all but ``reject_share`` of its rightly predicted rows reach.
Embedding and layer are linear, so scoring reads one table of class sums per subword.

``und`` with score 0 if the text is null or has no letter, or if there is nothing to learn from.  Equal
scores go to the first language in order.  A null id counts as the empty text in the split.  Languages are
limited to ``max_languages`` (an error beyond it).  Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.fitting import as_lists, below, fit_once, sparse
from tallyfold.llm.rows import column, map_rows, text_bytes
from tallyfold.llm.tokens import LOWER, byte_table

BITS = 14
LETTER = byte_table([*range(0x61, 0x7B), *range(0x80, 0x100)])
FIELDS = [("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")]


def subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Text number and bucket of every subword."""
    raw, off = text_bytes(texts)
    n = len(texts)
    low = LOWER[raw]
    size = np.diff(off)
    at = np.arange(len(raw)) + np.repeat(2 * np.arange(n) + 1, size)
    x = np.full(len(raw) + 2 * n, 0x20, np.uint32)
    x[at] = np.where(LETTER[low], low, 0x20)
    letter = np.zeros(len(x), bool)
    letter[at] = LETTER[low]
    doc = np.repeat(np.arange(n, dtype=np.int32), size + 2)
    docs, keys = [], []
    code = x[:-2] << 16 | x[1:-1] << 8 | x[2:] if len(x) > 2 else x[:0]
    three = np.flatnonzero(letter[1:-1])
    four = three[:-1][letter[three[:-1] + 2] & (np.diff(three) == 1)] if len(three) > 1 else three[:0]
    for at, c in ((three, code[three]), (four, (code[four] << 8 | x[np.minimum(four + 3, len(x) - 1)]) + np.uint32(77))):
        docs.append(doc[at])
        keys.append((c * np.uint32(2654435761)) >> np.uint32(32 - BITS))
    return np.concatenate(docs), np.concatenate(keys).astype(np.int64), n


def _fit(table: pa.Table, langs: list[str], dim: int, epochs: int, rate: float, reject_share: float):
    """(class sums per bucket, temperature, rejection threshold)."""
    order = np.argsort(table.column("k").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    row, idx, val = sparse(table, "idx", "val")
    n, k = table.num_rows, len(langs)
    val = (val / np.maximum(np.bincount(row, weights=val, minlength=n), 1e-9)[row]).astype(np.float32)
    y = np.searchsorted(langs, table.column("lang").to_pylist())
    start = np.searchsorted(row, np.arange(n + 1))
    rng = np.random.default_rng(7)
    emb = rng.normal(0, 0.1, (1 << BITS, dim)).astype(np.float32)
    out = np.zeros((dim, k), np.float32)
    held = np.arange(n) % 8 == 0 if n >= 16 else np.zeros(n, bool)
    train = np.flatnonzero(~held)
    steps = epochs * -(-len(train) // 16)
    done = 0
    for _ in range(epochs):
        rng.shuffle(train)
        for a in range(0, len(train), 16):
            pick = train[a : a + 16]
            at = np.concatenate([np.arange(start[i], start[i + 1]) for i in pick])
            if not len(at):
                continue
            of = np.repeat(np.arange(len(pick)), start[pick + 1] - start[pick])
            v = val[at][:, None]
            mean = np.zeros((len(pick), dim), np.float32)
            np.add.at(mean, of, emb[idx[at]] * v)
            z = mean @ out
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            lr = rate * (1 - done / steps)
            back = p @ out.T
            out -= lr * (mean.T @ p)
            np.subtract.at(emb, idx[at], lr * v * back[of])
            done += 1
    sums = (emb @ out).astype(np.float32)
    pick = held if held.any() else ~held
    z = np.zeros((n, k))
    np.add.at(z, row, sums[idx] * val[:, None])
    z, y = z[pick], y[pick]
    best = (np.inf, 1.0)
    for t in np.geomspace(0.2, 5, 40):
        s = z * t
        lse = np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1)
        best = min(best, (float((lse - s[np.arange(len(y)), y]).mean()), float(t)))
    s = z * best[1]
    p = np.exp(s - s.max(1, keepdims=True))
    p = (p / p.sum(1, keepdims=True)).max(1)
    right = p[z.argmax(1) == y]
    return sums, best[1], float(np.quantile(right, reject_share)) if len(right) else 0.0


def _features(texts):
    doc, key, n = subwords(texts)
    return as_lists(doc, key, n)


def identify_language(
    docs: DataFrame,
    learn: Column,
    text_col: str = "text",
    lang_col: str = "lang",
    key_col: str = "doc_id",
    carry: Sequence[str] = ("doc_id",),
    prefix: str = "",
    train_rows: int = 8000,
    dim: int = 16,
    epochs: int = 5,
    rate: float = 0.8,
    reject_share: float = 0.01,
    max_languages: int = 500,
) -> DataFrame:
    """``carry`` columns of every document with lang_pred, score and rejected; rows with ``learn`` teach."""
    seen = docs.filter(learn & column(lang_col).isNotNull() & column(text_col).rlike(r"\p{L}"))
    counts = seen.groupBy(column(lang_col).alias("lang")).count().limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    langs = sorted(r["lang"] for r in counts)
    total = sum(r["count"] for r in counts)
    model = None
    if total:
        sample = seen.filter(below(F.xxhash64(column(key_col), column(text_col)), train_rows / total, 9)).select(
            column(text_col).alias("t"), column(lang_col).alias("lang"), F.xxhash64(column(key_col), column(text_col)).alias("k")
        )
        sample = map_rows(sample, ["t"], [("idx", "array<int>"), ("val", "array<float>")], _features, ["lang", "k"])
        sample = sample.dropDuplicates(["k"])
        model = fit_once(sample, lambda t: _fit(t, langs, dim, epochs, rate, reject_share))
    sums, temp, least = model or (np.zeros((1 << BITS, max(1, len(langs))), np.float32), 1.0, 0.0)
    names = np.array([*langs, "und"], object)
    per_class = [np.ascontiguousarray(sums[:, k]) for k in range(sums.shape[1])]
    unknown = model is None

    def predict(texts):
        doc, key, n = subwords(texts)
        size = np.maximum(np.bincount(doc, minlength=n), 1)
        z = np.stack([np.bincount(doc, weights=c[key], minlength=n) / size for c in per_class], 1) * temp
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = z.argmax(1)
        score = p[np.arange(n), best]
        raw, off = text_bytes(texts)
        ascii_letter = np.concatenate([[0], np.cumsum(LETTER[LOWER[raw]] & (raw < 0x80))])
        sure = ascii_letter[off[1:]] > ascii_letter[off[:-1]]
        for i in np.flatnonzero(~sure):
            t = texts[int(i)].as_py()
            sure[i] = bool(t) and any(c.isalpha() for c in t)
        sure &= not unknown
        best = np.where(sure, best, len(names) - 1)
        score = np.where(sure, score, 0.0)
        return [pa.array(names[best].tolist(), pa.string()), score, ~sure | (score < least)]

    return map_rows(docs, [text_col], FIELDS, predict, carry, prefix)
