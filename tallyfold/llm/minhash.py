"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass makes, per text, the fingerprint of its set of distinct word shingles, ``bands`` * ``rows``
   minimum hashes (one byte of each is kept for comparing) and the band keys.  Equal sets are one node.
2. Star rounds: in a band bucket all nodes are compared with one centre, the node that meets most others,
   and each node only with the centre it shares most buckets with.  That is linear in the bucket and joins
   most of a large group, whose least edited member is its natural centre.
3. Exhaustive round: in buckets that still hold several components, the nodes outside the bucket's largest
   component are compared with all nodes of other components, block by block, so a bucket of any size is
   spread over tasks and no list of all pairs is ever made.  Here ``more`` further minimum hashes of the
   nodes concerned make the test sharp enough to leave few pairs below the threshold.
4. Comparing reads the signatures in batches.  After each batch the posterior of the similarity (uniform
   prior) is looked up, and a pair is dropped once the chance of the threshold is below ``miss``.
5. Survivors are verified on the full shingle sets of their whole texts.  Links within a component found
   earlier need no proof: they cannot change the answer.

A pair at the threshold 0.85 shares a band but for (1 - 0.85**5)**32 = 7e-9; a batch drops it with a chance below ``miss``.  Null or wordless texts are
linked with nothing and are their own component.  Every row is judged by its own text, so all rows of the
smallest id of a component are kept; a null id loses to any other.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.components import components
from tallyfold.llm.rows import column, map_rows, text_bytes
from tallyfold.llm.tokens import LOWER, NOT_SPACE, U64, mix, ngrams, per_text, prefix_hash, range_hash, runs
from tallyfold.session import Scratch

BLOCK_ROWS = 1000
BATCH = 32


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, shingle hash) of all texts, ascending."""
    raw, off = text_bytes(texts)
    low = LOWER[raw]
    s, e, doc = runs(NOT_SPACE[low], off)
    h = range_hash(prefix_hash(low), s, e)
    g, at = ngrams(h, doc, size)
    hashes, docs = [g], [doc[at]]
    words = per_text(doc, len(texts))
    for k in range(1, size):
        g, at = ngrams(h, doc, k)
        short = words[doc[at]] == k
        hashes.append(mix(g[short] + U64(k)))
        docs.append(doc[at][short])
    g, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    return d[new], g[new]


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest of n equal hashes for which P(similarity >= threshold) is at least ``miss``."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def survivors(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, needed: list[int]) -> np.ndarray:
    """Which pairs (left[a], right[b]) of one-byte signatures pass every batch."""
    alive = np.arange(len(a))
    same = np.zeros(len(a), np.int32)
    for k, need in enumerate(needed):
        cols = slice(k * BATCH, (k + 1) * BATCH)
        same = same + (left[a[alive], cols] == right[b[alive], cols]).sum(1, dtype=np.int32)
        ok = same >= need
        alive, same = alive[ok], same[ok]
    return alive


def _minima(n: int, count: np.ndarray, g: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k minimum hashes of each of n sets, given one after the other; an empty set has zeros."""
    mult = np.random.default_rng(seed).integers(1, 1 << 32, (2, k), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    full = np.flatnonzero(count)
    start = (np.cumsum(count) - count)[full]
    sig = np.zeros((n, k), np.uint32)
    if len(full):
        lo, hi = g.astype(np.uint32), (g >> U64(32)).astype(np.uint32)
        for j in range(k):
            sig[full, j] = np.minimum.reduceat(lo * mult[0, j] + hi * mult[1, j], start)
    return sig


def _lengthener(size: int, k: int):
    def sign(texts):
        doc, g = shingle_sets(texts, size)
        n = len(texts)
        return [pa.array([bytes(x) for x in _minima(n, per_text(doc, n), g, k, 4).astype(np.uint8)], pa.binary())]

    return sign


def _signer(size: int, bands: int, rows: int):
    def sign(texts):
        n = len(texts)
        doc, g = shingle_sets(texts, size)
        count = per_text(doc, n)
        full = np.flatnonzero(count)
        start = (np.cumsum(count) - count)[full]
        sig = _minima(n, count, g, bands * rows, 3)
        keys = np.zeros((n, bands), U64)
        for r in range(rows):
            keys = mix(keys * U64(0x9E3779B97F4A7C15) + sig[:, r::rows].astype(U64) + np.arange(bands, dtype=U64))
        one, two = np.zeros(n, U64), np.zeros(n, U64)
        if len(full):
            one[full] = np.add.reduceat(mix(g), start)
            two[full] = np.add.reduceat(mix(g ^ U64(0x5851F42D4C957F2D)), start)
        ids = np.stack([one, two], 1).view(np.uint8).reshape(n, 16)
        some = count > 0
        small = sig.astype(np.uint8)
        return [
            pa.array(count, pa.int64()),
            pa.array([bytes(x) if ok else None for x, ok in zip(ids, some)], pa.binary()),
            pa.array([bytes(x) if ok else None for x, ok in zip(small, some)], pa.binary()),
            pa.ListArray.from_arrays(np.arange(0, n * bands + 1, bands, dtype=np.int32), pa.array(keys.view(np.int64).ravel())),
        ]

    return sign


def _stack(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1) if len(col) else np.zeros((0, 1), np.uint8)


def _plain(col) -> np.ndarray:
    """A column as numpy: one row of bytes or of list items per value, or one value."""
    if pa.types.is_binary(col.type):
        return _stack(col)
    if pa.types.is_list(col.type):
        return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)
    return col.to_numpy(zero_copy_only=False)


def _compare_pairs(pairs: DataFrame, nodes: DataFrame, needed: list[int]) -> DataFrame:
    """Pairs (a, b) that pass the sequential test."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                idx = np.arange(batch.num_rows)
                ok = survivors(idx, idx, _stack(batch.column(2)), _stack(batch.column(3)), needed)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), batch.column(1).take(pa.array(ok))], names=["a", "b"])

    left = nodes.select(F.col("nid").alias("a"), F.col("sig").alias("sa"))
    right = nodes.select(F.col("nid").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _blocks(live: DataFrame, needed: list[int]) -> DataFrame:
    """Surviving pairs of different components within the buckets of ``live`` (key, nid, root, sig, keys).

    A pair is reported once: in the first bucket that its nodes share, and by its smaller node if both are
    outside the bucket's largest component.
    """
    parts = live.groupBy("key", "root").count()
    sizes = parts.groupBy("key").agg(
        F.sum("count").alias("n"), F.max(F.struct("count", "root")).alias("big")
    ).select("key", "n", F.col("big.root").alias("big"), (F.col("n") - F.col("big.count")).alias("n_left"))
    rows = live.join(sizes, "key")
    lefts = F.ceil(F.col("n_left") / BLOCK_ROWS).cast("int")
    rights = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    right = rows.select(
        "key", F.explode(F.sequence(F.lit(0), lefts - 1)).alias("lb"), F.pmod(F.xxhash64("nid"), rights).cast("int").alias("rb"),
        "nid", "root", "sig", "keys", F.lit(False).alias("is_left"), (F.col("root") != F.col("big")).alias("outside"),
    )
    left = rows.filter("root <> big").select(
        "key", F.pmod(F.xxhash64("nid"), lefts).cast("int").alias("lb"), F.explode(F.sequence(F.lit(0), rights - 1)).alias("rb"),
        "nid", "root", "sig", "keys", F.lit(True).alias("is_left"), F.lit(True).alias("outside"),
    )

    def flush(group: dict[str, list]) -> pa.RecordBatch:
        code, key, nid, root, sig, keys, is_left, outside = (np.concatenate(group[c]) for c in columns)
        edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]]))
        out_a, out_b = [], []
        for lo, hi in zip(edge[:-1], edge[1:]):
            l, r = lo + np.flatnonzero(is_left[lo:hi]), lo + np.flatnonzero(~is_left[lo:hi])
            for at in range(0, len(l), max(1, 200_000 // max(1, len(r)))):
                some = l[at : at + max(1, 200_000 // max(1, len(r)))]
                a, b = np.repeat(some, len(r)), np.tile(r, len(some))
                ok = (root[a] != root[b]) & ~(outside[b] & (nid[b] < nid[a]))
                a, b = a[ok], b[ok]
                ok = survivors(a, b, sig, sig, needed)
                a, b = a[ok], b[ok]
                same = keys[a] == keys[b]
                ok = keys[a, same.argmax(1)] == key[a] if len(a) else np.zeros(0, bool)
                out_a.append(np.minimum(nid[a[ok]], nid[b[ok]]))
                out_b.append(np.maximum(nid[a[ok]], nid[b[ok]]))
        pair = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], 1), axis=0) if out_a else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0], pa.int64()), pa.array(pair[:, 1], pa.int64())], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows arrive ordered by block; the last block of a batch may go on in the next
        held: dict[str, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {c: _plain(batch.column(i)) for i, c in enumerate(columns)}
            cut = int(np.searchsorted(col["code"], col["code"][-1]))
            for k, v in col.items():
                held.setdefault(k, []).append(v[:cut])
            if cut:
                yield flush(held)
                held = {k: [] for k in col}
            for k, v in col.items():
                held[k].append(v[cut:])
        if held:
            yield flush(held)

    columns = ["code", "key", "nid", "root", "sig", "keys", "is_left", "outside"]
    both = left.unionByName(right).withColumn("code", F.xxhash64("key", "lb", "rb"))
    n = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        both.select(*columns).repartition(n, "code").sortWithinPartitions("code")
        .mapInArrow(run, "a bigint, b bigint").distinct()
    )


def _verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b): pairs whose full shingle sets reach the similarity."""

    def judge(left, right):
        n = len(left)
        da, ga = shingle_sets(left, size)
        db, gb = shingle_sets(right, size)
        g, d = np.concatenate([ga, gb]), np.concatenate([da, db])
        order = np.lexsort((g, d))
        g, d = g[order], d[order]
        both = per_text(d[1:][(g[1:] == g[:-1]) & (d[1:] == d[:-1])], n)
        union = per_text(d, n) - both
        return [(100 * both >= percent * union) & (union > 0)]

    left = texts.select(F.col("nid").alias("a"), F.col("t").alias("ta"))
    right = texts.select(F.col("nid").alias("b"), F.col("t").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")
    return map_rows(both, ["ta", "tb"], [("linked", "boolean")], judge, ["a", "b"], texts=2).filter("linked").select("a", "b")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 3,
    percent: int = 85,
    bands: int = 32,
    rows: int = 5,
    more: int = 512,
    miss: float = 1e-7,
    star_rounds: int = 2,
    mark: bool = False,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``; ``mark`` adds th, a text hash."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    needed = [least_matches(k, percent / 100, miss) for k in range(BATCH, bands * rows + 1, BATCH)]
    src = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("t")).withColumn("th", F.xxhash64("t"))
    signed = scratch.cut(
        map_rows(src, ["t"], [("n", "bigint"), ("sid", "binary"), ("sig", "binary"), ("keys", "array<bigint>")], _signer(size, bands, rows), ["id", "th"]),
        "signatures",
    )
    full = signed.filter("sid IS NOT NULL")
    nodes = scratch.cut(
        full.groupBy("sid").agg(F.min("id").alias("low"), F.max(F.struct("id", "th")).alias("rep"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
        .withColumn("nid", F.monotonically_increasing_id()),
        "nodes",
    )
    banded = nodes.select("nid", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("nid").alias("lo"), F.max("nid").alias("hi")).filter("lo < hi").select("key")
    live = scratch.cut(banded.join(shared, "key"), "buckets")
    wanted = live.select("nid").distinct().join(nodes.select("nid", "rep"), "nid")
    texts = scratch.cut(_texts(src, wanted), "texts")
    # how many nodes a node meets in its buckets: the best of a bucket is its centre
    size_of = live.groupBy("key").count()
    met = live.join(size_of, "key").groupBy("nid").agg(F.sum("count").alias("met"))
    live = scratch.cut(live.join(met, "nid").select("key", "nid", "met"), "met")
    links = tried = None
    for turn in range(star_rounds + 1):
        if turn:
            live = scratch.cut(_undecided(live, scratch.cut(components(links, scratch), "roots")), "undecided")
        else:
            live = live.withColumn("root", F.col("nid"))
        if live.isEmpty():
            break
        if turn < star_rounds:
            centre = live.groupBy("key").agg(F.max(F.struct("met", "nid", "root")).alias("c"))
            star = live.join(centre, "key").filter("root <> c.root").select(F.col("c.nid").alias("a"), F.col("nid").alias("b"))
            star = star.groupBy("a", "b").count()
            if tried is not None:
                star = star.join(tried, ["a", "b"], "left_anti")
            best = star.groupBy("b").agg(F.max(F.struct("count", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
            best = scratch.cut(best, "star")
            tried = best if tried is None else tried.unionByName(best)
            pairs = _compare_pairs(best, nodes.select("nid", "sig"), needed)
        else:
            held = texts.join(live.select("nid").distinct(), "nid", "left_semi")
            longer = map_rows(held, ["t"], [("rest", "binary")], _lengthener(size, more), ["nid"])
            longer = longer.join(nodes.select("nid", "sig", "keys"), "nid").select("nid", F.concat("sig", "rest").alias("sig"), "keys")
            sharp = [least_matches(k, percent / 100, miss) for k in range(BATCH, bands * rows + more + 1, BATCH)]
            pairs = _blocks(live.join(scratch.cut(longer, "longer"), "nid"), sharp)
        pairs = scratch.cut(pairs, "survivors")
        found = scratch.cut(_verify(pairs, texts, size, percent), "verified")
        links = found if links is None else scratch.cut(links.unionByName(found).distinct(), "links")
    named = nodes.select("nid", "sid", "low")
    if links is not None:
        named = named.join(components(links, scratch).withColumnRenamed("node", "nid"), "nid", "left")
        named = named.select("sid", "low", F.coalesce("root", "nid").alias("root"))
    else:
        named = named.withColumnRenamed("nid", "root")
    first = named.groupBy("root").agg(F.min("low").alias("component_id"))
    member = scratch.cut(named.join(first, "root").select("sid", "component_id"), "members")
    out = signed.select("id", F.col("n").alias("n_shingles"), "sid", "th").join(member, "sid", "left")
    component = F.when(F.col("sid").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"),
        *(["th"] if mark else []),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that ``near_duplicates`` does not keep.

    Rows are matched by id and text, so rows with a null or repeated id are judged by their own text.
    """
    judged = near_duplicates(docs, id_col, text_col, mark=True, **options)
    gone = judged.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone_id"), F.col("th").alias("_gone_th")).distinct()
    same = column(id_col).eqNullSafe(F.col("_gone_id")) & (F.xxhash64(column(text_col).cast("string")) == F.col("_gone_th"))
    return docs.join(gone, same, "left_anti")


def _texts(src: DataFrame, wanted: DataFrame) -> DataFrame:
    """(nid, t): one text of every wanted node."""
    same = src["id"].eqNullSafe(wanted["rep.id"]) & (src["th"] == wanted["rep.th"])
    found = src.join(wanted, same).select("nid", "t")
    return found.dropDuplicates(["nid"])


def _undecided(live: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the buckets that still hold several components, with their roots."""
    live = live.drop("root").join(roots.withColumnRenamed("node", "nid"), "nid", "left")
    live = live.select("key", "nid", "met", F.coalesce("root", "nid").alias("root"))
    mixed = live.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    return live.join(mixed, "key")
