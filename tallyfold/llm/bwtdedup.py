"""Exact substring dedup by column-wise construction over many texts.

A byte goes if a ``length``-byte string that covers it also starts anywhere else.  Windows are judged on
the input; matches never cross texts.

1. Each window of ``length`` bytes selects an anchor: the place with the least hash of ``GRAM`` bytes in it
   (leftmost on ties).  The choice depends on the window's bytes alone, so equal windows select the same
   anchor at the same distance.  A window whose anchor occurs once in all texts is unique.  Equal texts are
   taken once; if there are several, all of their windows repeat.
2. For every anchor that occurs twice or more, each occurrence becomes a segment: the bytes of all windows
   that selected it.  Equal segments are taken once (they repeat as a whole).
3. The segments of one anchor, aligned at it, are a collection whose Burrows-Wheeler transform is built
   column by column from the right: each round puts one symbol in front of every segment's suffix, orders
   the suffixes by a stable sort of that column (the transform's column of the round before) and updates
   the common prefixes of neighbours: one more than the least of those between, if the symbols agree.
   Aligned segments can only match at equal columns, so only the last column has to be kept.  A window that
   shares ``length`` bytes with a neighbour repeats.  A task streams its anchors' segments in anchor order
   and holds one bounded batch, read once front to back.
4. An anchor with more than ``hot`` different segments is split: its windows are counted by hash one by one,
   combined before the shuffle, which is exact at any size.

Null text: zero bytes, nothing removed.  Texts shorter than ``length`` keep all.  An empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.rows import column, map_rows, slices, text_bytes
from tallyfold.llm.tokens import U64, covered, mix, per_text, prefix_hash, range_hash
from tallyfold.session import Scratch

GRAM = 40
BATCH_SEGMENTS = 8192


def select_anchors(raw: np.ndarray, off: np.ndarray, length: int):
    """(text, anchor place, first start, number of starts, anchor hash) of all runs of windows that share
    an anchor, and the running hash of the bytes."""
    n = len(raw)
    pre = prefix_hash(raw)
    size = np.diff(off)
    width = length - GRAM + 1
    if n < length or not (size >= length).any():
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, U64), pre
    at = np.arange(n - GRAM + 1)
    h = range_hash(pre, at, at + GRAM)
    key = (h >> U64(32) << U64(32)) | at.astype(U64)
    # least key of every window of `width` places: block minima from the left and from the right
    m = len(key)
    rows = -(-m // width)
    block = np.full(rows * width, np.iinfo(np.uint64).max, U64)
    block[:m] = key
    block = block.reshape(rows, width)
    left = np.minimum.accumulate(block, 1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    starts = np.arange(n - length + 1)
    best = np.minimum(right[starts], left[starts + width - 1])
    place = (best & U64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(size)), size)[: len(starts)]
    inside = starts + length <= off[doc + 1]
    starts, place, doc = starts[inside], place[inside], doc[inside]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    return doc[first], place[first], starts[first], count, h[place[first]], pre


def _anchor_lists(length: int):
    def run(texts):
        raw, off = text_bytes(texts)
        n = len(texts)
        doc, _, _, _, f, _ = select_anchors(raw, off, length)
        order = np.lexsort((f, doc))
        doc, f = doc[order], f[order]
        # an anchor that comes back in one text is listed twice, which is all that counting needs
        keep = np.ones(len(f), bool)
        keep[2:] = (f[2:] != f[:-2]) | (doc[2:] != doc[:-2])
        doc, f = doc[keep], f[keep]
        cuts = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
        return [pa.ListArray.from_arrays(cuts, pa.array(f.view(np.int64)))]

    return run


def _segments(batch_texts: pa.Array, seeds: pa.Array, length: int):
    """Segments of a slice of texts: text, start, number of starts, anchor, its distance, identity, bytes source."""
    raw, off = text_bytes(batch_texts)
    doc, place, start, count, f, pre = select_anchors(raw, off, length)
    wanted = np.unique(seeds.flatten().to_numpy(zero_copy_only=False).view(np.uint64)) if len(seeds) else np.zeros(0, U64)
    if len(wanted):
        k = np.minimum(np.searchsorted(wanted, f), len(wanted) - 1)
        keep = wanted[k] == f
    else:
        keep = np.zeros(len(f), bool)
    doc, place, start, count, f = doc[keep], place[keep], start[keep], count[keep], f[keep]
    end = start + count - 1 + length
    sid = mix(range_hash(pre, start, end) ^ ((place - start).astype(U64) * U64(0x9E3779B97F4A7C15)))
    return raw, off, doc, start, end, count, f, place - start, sid


def _occurrences(texts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices([batch.column(1)]) if batch.num_rows else ():
                part = batch.slice(a, b - a)
                _, off, doc, start, _, count, f, _, sid = _segments(part.column(1), part.column(2), length)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc)), pa.array(sid.view(np.int64)), pa.array(start - off[doc]), pa.array(count), pa.array(f.view(np.int64))],
                    names=["nid", "sid", "lo", "ns", "f"],
                )

    return texts.select("nid", "t", "seeds").mapInArrow(run, "nid bigint, sid bigint, lo bigint, ns bigint, f bigint")


def _distinct_segments(texts: DataFrame, length: int) -> DataFrame:
    """(f, sid, shift, ns, body): every segment at least once, and once per task if memory allows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b in slices([batch.column(0)]) if batch.num_rows else ():
                part = batch.slice(a, b - a)
                raw, _, _, start, end, count, f, shift, sid = _segments(part.column(0), part.column(1), length)
                _, at = np.unique(sid, return_index=True)
                fresh = [i for i in at.tolist() if int(sid[i]) not in seen]
                if len(seen) > 400_000:
                    seen.clear()
                seen.update(int(sid[i]) for i in fresh)
                at = np.array(fresh, np.int64)
                data = raw.tobytes()
                body = [data[s:e] for s, e in zip(start[at].tolist(), end[at].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(f[at].view(np.int64)), pa.array(sid[at].view(np.int64)), pa.array(shift[at].astype(np.int32)),
                        pa.array(count[at].astype(np.int32)), pa.array(body, pa.binary()),
                    ],
                    names=["f", "sid", "shift", "ns", "body"],
                )

    return texts.select("t", "seeds").mapInArrow(run, "f bigint, sid bigint, shift int, ns int, body binary")


def column_wise(group: np.ndarray, shift: np.ndarray, bodies: list[bytes], length: int) -> np.ndarray:
    """hit[s, j]: does the window that starts j bytes after the leftmost column of segment s repeat in its
    group?  ``group`` ascends; ``shift`` is the distance from a segment's start to its anchor."""
    m = len(bodies)
    before = length - GRAM
    n_cols = before + length
    size = np.fromiter((len(b) for b in bodies), np.int64, m)
    symbol = np.zeros((n_cols, m), np.int16)
    flat = np.frombuffer(b"".join(bodies), np.uint8)
    row = np.repeat(np.arange(m), size)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + (before - shift)[row]
    symbol[col, row] = flat.astype(np.int16) + 1  # 0: no symbol there
    hit = np.zeros((m, before + 1), bool)
    order = np.arange(m)
    lcp = np.zeros(m + 1, np.int16)
    of = group.astype(np.int64) * 257
    for c in range(n_cols - 1, -1, -1):
        s = symbol[c][order]
        key = of[order] + s
        if (key[1:] >= key[:-1]).all():
            same = np.zeros(m + 1, bool)
            same[1:m] = (key[1:] == key[:-1]) & (s[1:] != 0)
            lcp = np.where(same, lcp + 1, 0).astype(np.int16)
        else:
            perm = np.argsort(key, kind="stable")
            key = key[perm]
            p, q = perm[:-1], perm[1:]
            same = (key[1:] == key[:-1]) & (s[perm][1:] != 0)
            new = np.zeros(m + 1, np.int16)
            at = np.flatnonzero(same & (q == p + 1))
            new[at + 1] = lcp[q[at]] + 1
            far = np.flatnonzero(same & (q != p + 1))
            if len(far):
                edges = np.stack([p[far] + 1, q[far] + 1], 1).ravel()
                new[far + 1] = np.minimum.reduceat(lcp, edges)[::2] + 1
            lcp, order = new, order[perm]
        if c <= before:
            hit[order, c] = np.maximum(lcp[:-1], lcp[1:]) >= length
    return hit


def _runs_of(hit: np.ndarray) -> list[list[int]]:
    """[start, count, start, count, ...] of the True runs of every row."""
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    up, down = np.argwhere(edge == 1), np.argwhere(edge == -1)
    out: list[list[int]] = [[] for _ in range(len(hit))]
    for (r, a), (_, b) in zip(up.tolist(), down.tolist()):
        out[r] += [a, b - a]
    return out


def _repeats(segments: DataFrame, length: int, n_parts: int) -> DataFrame:
    """(sid, runs): window starts of a segment that repeat in another segment of its anchor."""

    def flush(held: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(held)
        f, sid = t.column("f").to_numpy(), t.column("sid").to_numpy()
        first = np.ones(len(f), bool)
        first[1:] = (f[1:] != f[:-1]) | (sid[1:] != sid[:-1])
        t = t.filter(pa.array(first))
        f, sid = f[first], sid[first]
        group = np.concatenate([[0], np.cumsum(f[1:] != f[:-1])])
        several = np.bincount(group)[group] > 1
        t, group, sid = t.filter(pa.array(several)), group[several], sid[several]
        ids, runs = [], []
        if len(sid):
            shift = t.column("shift").to_numpy().astype(np.int64)
            hit = column_wise(group, shift, t.column("body").to_pylist(), length)
            some = np.flatnonzero(hit.any(1))
            skip = (length - GRAM) - shift
            ids = sid[some]
            runs = [[v - skip[i] if j % 2 == 0 else v for j, v in enumerate(r)] for i, r in zip(some.tolist(), _runs_of(hit[some]))]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(runs, pa.list_(pa.int64()))], names=["sid", "runs"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            while batch.num_rows:
                part = pa.Table.from_batches([batch.slice(0, BATCH_SEGMENTS)])
                batch = batch.slice(part.num_rows)
                if rows + part.num_rows > BATCH_SEGMENTS:
                    # anchors end at a change of f; the last one may go on
                    f = part.column("f").to_numpy()
                    cut = int(np.searchsorted(f, f[-1]))
                    if cut or (held and held[-1].column("f")[-1].as_py() != int(f[0])):
                        held.append(part.slice(0, cut))
                        part = part.slice(cut)
                        yield flush(held)
                        held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield flush(held)

    return (
        segments.repartition(n_parts, "f").sortWithinPartitions("f", "sid").mapInArrow(run, "sid bigint, runs array<bigint>")
    )


def _hot_repeats(segments: DataFrame, length: int) -> DataFrame:
    """The same for anchors with too many segments, by counting every window's hash."""

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                bodies = part.column(2).to_pylist()
                ns = np.asarray(part.column(1), np.int64)
                size = np.fromiter((len(b) for b in bodies), np.int64, len(bodies))
                base = np.cumsum(size) - size
                pre = prefix_hash(np.frombuffer(b"".join(bodies), np.uint8))
                row = np.repeat(np.arange(len(bodies)), ns)
                j = np.arange(len(row)) - np.repeat(np.cumsum(ns) - ns, ns)
                at = base[row] + j
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(j), pa.array(range_hash(pre, at, at + length).view(np.int64))],
                    names=["sid", "j", "w"],
                )

    wins = segments.dropDuplicates(["f", "sid"]).select("sid", "ns", "body").mapInArrow(windows, "sid bigint, j bigint, w bigint")
    twice = wins.groupBy("w").count().filter("count > 1").select("w")
    return wins.join(twice, "w").groupBy("sid").agg(F.flatten(F.collect_list(F.array(F.col("j"), F.lit(1).cast("bigint")))).alias("runs"))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, hot: int = 20_000
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``."""
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    src = docs.select(column(id_col).alias("id"), text.alias("t")).withColumn("sha", F.unhex(F.sha2("t", 256)))
    listed = scratch.cut(map_rows(src.withColumn("n", F.octet_length("t").cast("bigint")), ["t"], [("f", "array<bigint>")], _anchor_lists(length), ["id", "n", "sha"]), "anchors")
    texts = scratch.cut(
        listed.filter(F.col("n") >= length).groupBy("sha").agg(F.count("*").alias("copies"), F.first("f").alias("f"))
        .withColumn("nid", F.monotonically_increasing_id()),
        "texts",
    )
    anchors = texts.select("nid", F.explode("f").alias("f"))
    seeds = anchors.groupBy("f").count().filter("count > 1").select("f")
    mine = anchors.join(seeds, "f").groupBy("nid").agg(F.collect_set("f").alias("seeds"))
    mine = mine.join(texts.select("nid", "sha"), "nid")
    held = src.join(mine, "sha").select("nid", "seeds", "t").dropDuplicates(["nid"])
    held = scratch.cut(held, "seeded")
    occ = scratch.cut(_occurrences(held, length), "occurrences")
    segments = _distinct_segments(held, length)
    crowd = occ.select("f", "sid").distinct().groupBy("f").count().filter(F.col("count") > hot)
    crowd = scratch.cut(crowd.select("f"), "crowded")
    if crowd.isEmpty():
        repeats = _repeats(segments, length, n_parts)
    else:
        repeats = _repeats(segments.join(crowd, "f", "left_anti"), length, n_parts).unionByName(
            _hot_repeats(segments.join(crowd, "f", "left_semi"), length)
        )
    whole = occ.groupBy("sid").agg(F.count("*").alias("c"), F.first("ns").alias("ns")).filter("c > 1")
    whole = whole.select("sid", F.array(F.lit(0).cast("bigint"), F.col("ns")).alias("runs"))
    repeats = scratch.cut(repeats.unionByName(whole), "repeats")
    found = occ.join(repeats, "sid").select(
        "nid", F.transform("runs", lambda v, i: F.when(i % 2 == 0, v + F.col("lo")).otherwise(v)).alias("runs")
    )
    found = found.groupBy("nid").agg(F.flatten(F.collect_list("runs")).alias("runs"))

    def strike(texts_, runs):
        removed, spans, digest = [], [], []
        for t, r in zip(texts_.to_pylist(), runs.to_pylist()):
            raw = np.frombuffer((t or "").encode(), np.uint8)
            r = np.array(r or [], np.int64).reshape(-1, 2)
            gone = covered(r[:, 0], r[:, 1] + length - 1, len(raw)) if len(r) else np.zeros(len(raw), bool)
            removed.append(int(gone.sum()))
            spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            digest.append(hashlib.sha256(raw[~gone].tobytes()).hexdigest())
        return [pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())]

    struck = map_rows(
        held.select("nid", "t").join(found, "nid"), ["t", "runs"],
        [("removed", "bigint"), ("spans", "bigint"), ("digest", "string")], strike, ["nid"],
    )
    told = texts.select("nid", "sha", "copies").join(struck, "nid", "left").filter("copies > 1 OR removed > 0").drop("nid")
    told = scratch.cut(told, "struck")
    out = listed.select("id", "n", "sha").join(told, "sha", "left")
    copied = F.coalesce(F.col("copies"), F.lit(0)) > 1
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_bytes"),
        F.when(copied, F.col("n")).otherwise(F.coalesce("removed", F.lit(0).cast("bigint"))).alias("n_removed"),
        F.when(copied, F.lit(1).cast("bigint")).otherwise(F.coalesce("spans", F.lit(0).cast("bigint"))).alias("n_spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("digest", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )
