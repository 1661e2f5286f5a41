"""Language-model scores from a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing: P(w | h) = (c(hw) + mu * P(w | h')) / (c(h) + mu),
h' being h without its first word, down to P(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)), which leaves 0.5 for
an unknown word.  As an automaton, every seen history is a state, every seen n-gram an arc with its log
probability, and every state has a failure arc of weight log(mu / (c(h) + mu)) to its shorter history.
A text is read once from left to right: the state is carried, failure arcs are followed until the word has
an arc, and the weights add up.

Counts come from every training row, and none is sent to the driver:

1. Rows are dealt to parts of about ``part_mb`` MB by hash.  Each part sorts its distinct n-grams (64-bit
   hashes) and sends them, cut by hash range into blocks of delta-coded bytes, to the range's task.
2. A range adds up the training counts of all parts and answers every part with the totals in the order
   it asked.  Frequent n-grams arrive once per part, so no word makes a hot task.
3. Each part, joined with its answers, builds the automaton of its own n-grams (all that its texts can
   reach) and walks its texts from left to right in step, one word per text (a long one: per lane) and round.

Null text: only the end token.  Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.  A null
id reads '' in the split.  Repeated rows count each; where they would crowd one part (``hot_mb``) they are
replaced by one row of their summed weight, whose scores all of them get.  With no training rows N = V = 0
and every token is unknown.  64-bit hashes stand for n-grams; two of 10^9 differ by chance 3 in 100.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.llm.rows import column, text_bytes
from tallyfold.llm.tokens import LOWER, NOT_SPACE, U64, mix, prefix_hash, range_hash, runs
from tallyfold.session import Scratch

END, START = U64(0x9AE16A3B2F90404F), U64(0xC2B2AE3D27D4EB4F)
_STEP = U64(0x9E3779B97F4A7C15)
RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
PIECE = 1 << 20
LANE = 256


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, end tokens included, and the text number of each."""
    hashes, docs = [], []
    raw_all, off_all = text_bytes(texts)
    n = len(texts)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off_all, off_all[a] + PIECE, "right")) - 1)
        raw, off = LOWER[raw_all[off_all[a] : off_all[b]]], off_all[a : b + 1] - off_all[a]
        s, e, doc = runs(NOT_SPACE[raw], off)
        h = range_hash(prefix_hash(raw), s, e)
        hashes.append(np.insert(h, np.searchsorted(doc, np.arange(b - a), "right"), END))
        docs.append(np.insert(doc, np.searchsorted(doc, np.arange(b - a), "right"), np.arange(b - a)) + a)
        a = b
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(docs)


def history_hashes(h: np.ndarray, doc: np.ndarray, order: int) -> list[np.ndarray]:
    """g[k][i]: hash of the n-gram of k + 1 tokens that ends in token i.

    A start mark stands before the first token; an n-gram that would begin before the mark has hash 0.
    """
    first = np.ones(len(h), bool)
    first[1:] = doc[1:] != doc[:-1]
    where = np.arange(len(h)) - np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    out = [h]
    for k in range(1, order):
        before = np.full(len(h), START)
        before[1:] = np.where(first[1:], START, out[-1][:-1]) if k == 1 else np.where(first[1:], U64(0), out[-1][:-1])
        if k > 1:
            before[:1] = 0
        g = mix(before * _STEP + h + U64(k))
        out.append(np.where((where >= k - 1) & (before != 0), g, U64(0)))
    return out


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as first key, width and fixed-width differences."""
    if not len(keys):
        return b""
    step = np.diff(keys)
    width = max(1, (int(step.max()).bit_length() + 7) // 8) if len(step) else 1
    body = step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return int(keys[0]).to_bytes(8, "little") + bytes([width]) + body


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, U64)
    width = blob[8]
    body = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(body) + 1, 8), np.uint8)
    wide[0] = np.frombuffer(blob, np.uint8, 8)
    wide[1:, :width] = body
    return np.cumsum(wide.view("<u8")[:, 0], dtype=U64)


def pack_counts(n: np.ndarray) -> bytes:
    width = next(w for w in (1, 2, 4, 8) if not len(n) or int(n.max()) < 1 << (8 * w - 1))
    return bytes([width]) + n.astype(f"<i{width}").tobytes()


def unpack_counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<i{blob[0]}", offset=1).astype(np.int64)


def _ranges(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the non-empty ones of n equal hash ranges, and the cuts of the ascending keys."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    number = ((keys >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(keys)]])
    return number[cuts[:-1]], cuts


def _grams(texts: pa.Array, order: int):
    """Per order k: distinct n-grams ascending, and for every token the place of its n-gram (-1: none)."""
    h, doc = token_hashes(texts)
    grams = history_hashes(h, doc, order)
    out = []
    for g in grams:
        keys, place = np.unique(g, return_inverse=True)
        if len(keys) and keys[0] == 0:
            keys, place = keys[1:], place - 1
        out.append((keys, place))
    return doc, out


def _walk(doc, grams, counts, n_texts, n_starts, total, distinct, mu):
    """Log10 probability of every text by one left-to-right traversal of the part's automaton."""
    order = len(grams)
    n = len(doc)
    z = np.log10(total + 0.5 * (distinct + 1))
    c1 = counts[0]
    # states
    n_states = 2
    state_of = []
    for k in range(order - 1):
        ids = np.full(len(counts[k]) + 1, -1, np.int64)
        known = np.flatnonzero(counts[k] > 0)
        ids[known] = n_states + np.arange(len(known))
        n_states += len(known)
        state_of.append(ids)
    fail = np.zeros(n_states, np.int64)
    fail_w = np.zeros(n_states)
    fail_w[1] = np.log10(mu / (n_starts + mu))
    # one example place per distinct n-gram gives its parts: history, shorter n-gram, last token
    example = []
    for keys, place in grams:
        ex = np.zeros(len(keys), np.int64)
        at = np.flatnonzero(place >= 0)
        ex[place[at]] = at
        example.append(ex)
    first = np.ones(n, bool)
    first[1:] = doc[1:] != doc[:-1]
    weight_prev = np.where(c1 > 0, np.log10(np.maximum(c1, 1) + 0.5) - z, 0.0)
    prob_prev = np.where(c1 > 0, (c1 + 0.5), 0.5) / (total + 0.5 * (distinct + 1))
    # arcs are addressed by n-gram: the arc of a state of depth d for a token is the n-gram of d + 1 tokens
    # that ends there; weight NaN: no such arc
    known = counts[0] > 0
    depth = np.zeros(n_states, np.int64)
    weights = [np.where(known, weight_prev, np.nan)]
    targets = [np.where(known, state_of[0][:-1], 0) if order > 1 else np.zeros(len(known), np.int64)]
    if order > 1:
        depth[1] = 1
        depth[state_of[0][:-1][known]] = 1
        fail_w[state_of[0][:-1][known]] = np.log10(mu / (counts[0][known] + mu))
    for k in range(1, order):
        ex = example[k]
        at_start = first[ex]
        before = np.where(at_start, 0, ex - 1)
        hist = grams[k - 1][1][before]
        c_hist = np.where(at_start, n_starts if k == 1 else 0, counts[k - 1][np.maximum(hist, 0)] if len(counts[k - 1]) else 0)
        shorter = grams[k - 1][1][ex]
        prob = (counts[k] + mu * prob_prev[shorter]) / (c_hist + mu)
        known = counts[k] > 0
        short_state = np.maximum(state_of[k - 1][shorter], 0)
        if k < order - 1:
            own = state_of[k][:-1][known]
            depth[own] = k + 1
            fail_w[own] = np.log10(mu / (counts[k][known] + mu))
            fail[own] = short_state[known]
            targets.append(np.where(known, state_of[k][:-1], 0))
        else:
            targets.append(np.where(known, short_state, 0))
        weights.append(np.where(known, np.log10(prob), np.nan))
        prob_prev = prob
    base = np.concatenate([[0], np.cumsum([len(w) + 1 for w in weights])])[:-1]
    weight = np.concatenate([np.append(w, np.nan) for w in weights])
    target = np.concatenate([np.append(t, 0) for t in targets])
    arc = np.stack([base[k] + np.where(grams[k][1] >= 0, grams[k][1], len(grams[k][0])) for k in range(order)])
    unknown = np.log10(0.5) - z

    def step(s, at):
        """Log probability and next state of the tokens ``at`` read in the states ``s``."""
        gain, to = np.zeros(len(s)), np.zeros(len(s), np.int64)
        todo = np.arange(len(s))
        for _ in range(order + 1):
            a = arc[depth[s[todo]], at[todo]]
            w = weight[a]
            hit = ~np.isnan(w)
            got = todo[hit]
            gain[got] += w[hit]
            to[got] = target[a[hit]]
            todo = todo[~hit]
            root = s[todo] == 0
            gain[todo[root]] += unknown
            todo = todo[~root]
            if not len(todo):
                break
            gain[todo] += fail_w[s[todo]]
            s = s.copy()
            s[todo] = fail[s[todo]]
        return gain, to

    # Texts are walked in lanes of LANE tokens, one token of each lane per round.  A later lane starts in the
    # state its text is in there: reading the order - 1 tokens before it from the empty history finds it.
    start = np.searchsorted(doc, np.arange(n_texts + 1))
    size = np.diff(start)
    per = -(-size // LANE)
    text = np.repeat(np.arange(n_texts), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    begin = start[:-1][text] + nth * LANE
    length = np.minimum(start[1:][text] - begin, LANE)
    line = np.argsort(-length, kind="stable")
    text, nth, begin, length = text[line], nth[line], begin[line], length[line]
    state = np.where(nth == 0, 1 if order > 1 else 0, 0)
    later = np.flatnonzero(nth > 0)
    for back in range(order - 1, 0, -1):
        _, state[later] = step(state[later], begin[later] - back)
    score = np.zeros(len(text))
    for t in range(int(length.max()) if len(length) else 0):
        m = int(np.searchsorted(-length, -t, "left"))
        gain, state[:m] = step(state[:m], begin[:m] + t)
        score[:m] += gain
    return np.bincount(text, weights=score, minlength=n_texts)


def score_texts(
    docs: DataFrame,
    learn: Column,
    text_col: str = "text",
    key_col: str = "doc_id",
    carry: Sequence[str] = ("doc_id",),
    order: int = 2,
    mu: float = 100.0,
    part_mb: int = 6,
    hot_mb: float = 3,
) -> DataFrame:
    """``carry`` columns of every document with n_tokens, n_known, train_tokens, base_score and score.

    Rows of equal key and text meet in one part.  Where they hold more than ``hot_mb`` MB together, one row with
    their learning weight stands for all of them, and its scores are joined back to each.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    scratch = Scratch(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(column(text_col).cast("string")))).first()[0] or 0
    n_parts = max(1, -(-size // (part_mb << 20)))
    n_ranges = n_parts
    text = column(text_col).cast("string")
    part = F.pmod(F.xxhash64(column(key_col), text), F.lit(n_parts)).alias("part")
    names = [f"c{i}" for i in range(len(carry))]
    same = [column(key_col).isNull(), text.isNull(), column(key_col), text]
    every = docs.select(
        part, text.alias("t"), F.coalesce(learn, F.lit(False)).cast("bigint").alias("weight"),
        F.xxhash64(*same).alias("h1"), F.xxhash64(F.lit(1), *same).alias("h2"), *[column(c).alias(n) for c, n in zip(carry, names)],
    )
    held = F.count("*") * (F.coalesce(F.max(F.octet_length("t")), F.lit(0)) + 16)
    hot = every.groupBy("h1", "h2").agg(held.alias("held"), F.count("*").alias("n"))
    hot = scratch.cut(hot.filter((F.col("n") > 1) & (F.col("held") > F.lit(hot_mb * (1 << 20)))).select("h1", "h2"), "hot")
    repeated = not hot.isEmpty()
    full = every.select("part", "t", "weight", *names)
    if repeated:
        once = every.join(hot, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.max("t").alias("t"), F.sum("weight").alias("weight"))
        once = scratch.cut(once.withColumn("part", F.pmod("h1", F.lit(n_parts))), "once")
        cold = every.join(hot, ["h1", "h2"], "left_anti")
        full = cold.select("part", "t", "weight", *names, *[F.lit(None).cast("bigint").alias(h) for h in ("h1", "h2")])
        full = full.unionByName(once, allowMissingColumns=True)
    rows = full.select("part", "t", "weight")

    def ask(key, group):
        texts, taught = group.column("t").combine_chunks(), group.column("weight").to_numpy()
        doc, grams = _grams(texts, order)
        weight = taught[doc]
        out = {"part": [], "k": [], "range": [], "keys": [], "n": []}
        for k, (keys, place) in enumerate(grams):
            at = (weight > 0) & (place >= 0)
            n = np.bincount(place[at], weights=weight[at], minlength=len(keys)).astype(np.int64)
            numbers, cuts = _ranges(keys, n_ranges)
            for r, a, b in zip(numbers.tolist(), cuts[:-1], cuts[1:]):
                for name, v in zip(out, (key[0].as_py(), k, r, pack_sorted(keys[a:b]), pack_counts(n[a:b]))):
                    out[name].append(v)
        return pa.table(out, schema=pa.schema([("part", pa.int64()), ("k", pa.int32()), ("range", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())]))

    def answer(key, group):
        keys = [unpack_sorted(b) for b in group.column("keys").to_pylist()]
        counts = [unpack_counts(b) for b in group.column("n").to_pylist()]
        every = np.unique(np.concatenate(keys))
        total = np.zeros(len(every), np.int64)
        places = []
        for ks, n in zip(keys, counts):
            at = np.searchsorted(every, ks)
            total[at] += n
            places.append(at.astype(np.int32))
        stats = (int(total.sum()), int((total > 0).sum()))
        return pa.table(
            {
                "part": group.column("part"), "k": group.column("k"), "range": group.column("range"),
                "n": pa.array([pack_counts(total[p]) for p in places], pa.binary()),
                "tokens": pa.array([stats[0]] + [0] * (len(keys) - 1), pa.int64()),
                "kinds": pa.array([stats[1]] + [0] * (len(keys) - 1), pa.int64()),
            }
        )

    asked = rows.groupBy("part").applyInArrow(ask, "part bigint, k int, range int, keys binary, n binary")
    answers = asked.groupBy("k", "range").applyInArrow(
        answer, "part bigint, k int, range int, n binary, tokens bigint, kinds bigint"
    )
    answers = scratch.cut(answers, "totals")
    stats = answers.filter("k = 0").agg(F.sum("tokens").alias("n"), F.sum("kinds").alias("v")).first()
    total, distinct = stats["n"] or 0, stats["v"] or 0
    n_starts = docs.filter(F.coalesce(learn, F.lit(False))).count()
    z = np.log10(total + 0.5 * (distinct + 1))
    kept = [c for c in full.columns if c not in ("part", "t", "weight")]

    def walk(key, texts, told):
        col = texts.column("t").combine_chunks()
        n = len(col)
        if n:
            doc, grams = _grams(col, order)
            counts = [[] for _ in range(order)]
            for k, r, b in sorted(zip(told.column("k").to_pylist(), told.column("range").to_pylist(), told.column("n").to_pylist()), key=lambda x: x[:2]):
                counts[k].append(unpack_counts(b))
            counts = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in counts]
            c = counts[0][grams[0][1]]
            tokens = np.bincount(doc, minlength=n)
            known = np.bincount(doc, weights=c > 0, minlength=n).astype(np.int64)
            base = np.bincount(doc, weights=np.log10(c + 0.5), minlength=n) - tokens * z
            score = _walk(doc, grams, counts, n, n_starts, total, distinct, mu)
        else:
            tokens = known = np.zeros(0, np.int64)
            base = score = np.zeros(0)
        arrays = [texts.column(c) for c in kept]
        arrays += [pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(n, total), pa.int64()), pa.array(base), pa.array(score)]
        return pa.table(arrays, names=kept + list(RESULTS))

    schema = T.StructType(
        [T.StructField(c, every.schema[c].dataType) for c in kept]
        + T._parse_datatype_string("n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double").fields
    )
    told = answers.select("part", "k", "range", "n").groupBy("part")
    out = full.select("part", "t", *kept).groupBy("part").cogroup(told).applyInArrow(walk, schema)
    if repeated:
        out = scratch.cut(out, "scores")
        again = every.select("h1", "h2", *names).join(out.filter("h1 IS NOT NULL").select("h1", "h2", *RESULTS), ["h1", "h2"])
        out = out.filter("h1 IS NULL").select(*names, *RESULTS).unionByName(again.select(*names, *RESULTS))
    return out.select(*[F.col(n).alias(c) for c, n in zip(carry, names) if c.lower() not in RESULTS], *RESULTS)
