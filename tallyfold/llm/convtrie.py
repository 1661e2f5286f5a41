"""Prefix trie of conversations, screened by a count-min sketch of prefix digests.

1. Turns are reduced to two 64-bit digests (of a SHA-256 of role and text) and a word count; texts do not travel.
   Places within a conversation come from range slices and offsets, so one conversation may own most rows.
2. The key of a prefix is the exclusive or of hashes of (place, digest) of its turns: a running total, taken over
   runs of ``run`` turns, with the totals of earlier runs added to conversations longer than that.
3. A count-min sketch counts all keys.  It never counts too low, so an estimate of one proves that a prefix belongs
   to one conversation, and so do all longer ones: its tail.  Tails become nodes where they are.
4. Only prefixes before a tail are grouped.  Groups are combined before the shuffle; values that go back from a node
   to its children use joins that split hot nodes (``operators/skew.py``).
5. Sums over subtrees need no walk by depth: the smallest member of a node is also that of its chain of
   descendants down to where another conversation is smaller, so each such conversation adds the sums of its own
   nodes to all nodes on its path.
6. Members that end at a node are packed in texts of up to ``ID_RANGE`` ids in the shuffle; one task per node then
   streams the texts through SHA-256, which cannot be cut.

Null role or text counts as empty.  Rows without a conversation id belong to no conversation.  Equal turn numbers are
ordered by digest, null ones come first; repeated rows are turns of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfold.llm.rows import column
from tallyfold.llm.screens import counters, table_size
from tallyfold.llm.tokens import U64, mix
from tallyfold.operators import skew
from tallyfold.operators.ranking import row_numbers
from tallyfold.session import Scratch, shuffle_partitions

RUN = 1024
ID_RANGE = 8192
WORDS = r"[^\x20\x09-\x0D]+"
SKETCH_ROWS = 2
NO_IDS = hashlib.sha256(b"").hexdigest()


def turn_digests(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, pos, a, b, words)``: the turns of each conversation, numbered from 1."""
    role, text = (F.coalesce(column(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(
        column(conv_col).cast("long").alias("conv_id"),
        column(turn_col).alias("turn"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("sha"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    ).filter("conv_id IS NOT NULL")
    rows = rows.select("conv_id", "turn", F.xxhash64("sha").alias("a"), F.xxhash64("sha", F.lit(1)).alias("b"), "words")
    # equal rows are interchangeable; their numbers only let the slices part them
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b"), F.col("_row")]
    return row_numbers(rows, ["conv_id"], order, "pos").select("conv_id", "pos", "a", "b", "words")


def _part_rows(rows: DataFrame) -> int:
    """Rows of one key that a task may take: a quarter of an even share."""
    return max(1000, rows.count() // (4 * shuffle_partitions(rows.sparkSession)))


def rebuild(turns: DataFrame, shared: Column, base: Column, scratch: Scratch, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``shared`` turns are those of conversation ``base``.

    ``turns`` as from :func:`turn_digests`; ``shared`` (at most ``most``) and ``base`` are expressions of ``conv_id``.
    Returns ``(conv_id, depth, len, a, b, words)`` and ``(conv_id, len)`` with the conversations left without a turn.
    """
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumns({"h": shared, "base": base})
    convs = scratch.cut(convs, "conversations")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least(F.col("h"), F.coalesce("n_base", F.lit(0)))
    convs = convs.join(bases, "base", "left").withColumn("taken", taken)
    convs = scratch.cut(convs.withColumn("len", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "rebuilt")
    hot = scratch.cut(skew.hot_from_counts(convs, "conv_id", "n", _part_rows(turns)), "long")
    own = skew.skew_safe_join(turns, convs.select("conv_id", "h", "taken", "len"), "conv_id", "pos", hot=hot)
    own = own.filter("pos > h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "len", "a", "b", "words")
    first = turns.filter(F.col("pos") <= most).withColumnRenamed("conv_id", "base")
    lent = first.join(convs.filter("taken > 0").select("conv_id", "base", "taken", "len"), "base").filter("pos <= taken")
    lent = lent.select("conv_id", F.col("pos").alias("depth"), "len", "a", "b", "words")
    return own.unionByName(lent), convs.select("conv_id", "len")


def _running(rows: DataFrame, totals: dict[str, tuple[str, str]], scratch: Scratch, run: int, down: bool = True) -> DataFrame:
    """Running totals along each conversation: ``{new column: (SQL aggregate, column)}``, from the first turn on or,
    with ``down=False``, from the last turn back.  ``rows`` is a written table."""
    number = F.floor(F.col("depth") / run) * (1 if down else -1)
    rows = rows.withColumn("_run", number)
    place = F.col("depth") if down else F.col("depth").desc()
    local = Window.partitionBy("conv_id", "_run").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", *[F.expr(f"{f}({c})").over(local).alias(o) for o, (f, c) in totals.items()])
    if (rows.agg(F.max("depth")).first()[0] or 0) < run:
        return out.drop("_run")
    per_run = rows.groupBy("conv_id", "_run").agg(*[F.expr(f"{f}({c})").alias(o) for o, (f, c) in totals.items()])
    earlier = Window.partitionBy("conv_id").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_run.select("conv_id", "_run", *[F.expr(f"{f}({o})").over(earlier).alias(f"_{o}") for o, (f, _) in totals.items()])
    carry = scratch.cut(carry.filter(" OR ".join(f"_{o} IS NOT NULL" for o in totals)), "carry")

    def add(o: str, f: str) -> Column:
        before = F.coalesce(F.col(f"_{o}"), F.lit(0))
        return (F.col(o).bitwiseXOR(before) if f == "bit_xor" else F.col(o) + before).alias(o)

    kept = [c for c in out.columns if c not in totals and c != "_run"]
    return out.join(carry, ["conv_id", "_run"], "left").select(*kept, *[add(o, f) for o, (f, _) in totals.items()])


def _sketch_places(size: int):
    def places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The counters of each key, one per row of the sketch."""
        a, b = a.view(U64), b.view(U64)
        per_row = size // SKETCH_ROWS
        return np.stack([(mix(a ^ mix(b + U64(i))) & U64(per_row - 1)).astype(np.int64) + i * per_row for i in range(SKETCH_ROWS)])

    return places


def _key(name: str = "k", a: str = "k1", b: str = "k2") -> Column:
    return F.struct(F.col(a).alias("k1"), F.col(b).alias("k2")).alias(name)


def prefix_trie(turns: DataFrame, convs: DataFrame, scratch: Scratch, sketch: int | None = None, run: int = RUN, id_range: int = ID_RANGE) -> DataFrame:
    """Nodes of the trie: ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``.

    ``turns(conv_id, depth, len, a, b, words)`` numbers the turns of a conversation 1 .. len; ``convs(conv_id, len)`` lists
    all conversations, also those without a turn.  ``sketch`` is the number of counters, by default from the rows.
    """
    z1, z2 = F.xxhash64("depth", "a", "b").alias("z1"), F.xxhash64("b", "a", "depth").alias("z2")
    placed = scratch.cut(turns.select("conv_id", F.col("depth").cast("long").alias("depth"), "len", "words", z1, z2), "turns")
    keyed = _running(placed, {"k1": ("bit_xor", "z1"), "k2": ("bit_xor", "z2")}, scratch, run)
    up = [F.col(f"k{i}").bitwiseXOR(F.col(f"z{i}")).alias(f"u{i}") for i in (1, 2)]
    keyed = scratch.cut(keyed.select("conv_id", "depth", "len", "words", "k1", "k2", *up), "keys")

    size = sketch or table_size(16 * keyed.count())
    places = _sketch_places(size)

    def both(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]

    table = counters(keyed.select("k1", "k2"), lambda batch: places(*both(batch)).reshape(-1), size)
    shared = turns.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("int")
    def proven(a: pa.Array, b: pa.Array) -> pa.Array:
        at = places(a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False))
        return pa.array((shared.value[at].min(0) == 1).astype(np.int32))

    judged = scratch.cut(keyed.withColumn("alone", proven("k1", "k2")), "judged")
    split = scratch.cut(_running(judged, {"n_alone": ("sum", "alone")}, scratch, run), "split")
    tail = split.filter("n_alone > 0")
    heads = tail.filter("n_alone = 1 AND alone = 1")
    root = convs.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), "len", F.lit(0).cast("long").alias("words"),
        *[F.lit(0).cast("long").alias(c) for c in ("k1", "k2")], *[F.lit(None).cast("long").alias(c) for c in ("u1", "u2")],
    )
    open_ = root.unionByName(split.filter("n_alone = 0").select(*root.columns))

    nodes = open_.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("words").alias("words"), F.count("*").alias("n_convs"),
        F.max("u1").alias("u1"), F.max("u2").alias("u2"),
    )
    nodes = scratch.cut(nodes, "groups")
    under = nodes.filter("depth > 0").select("u1", "u2", F.lit(0).alias("tail"))
    under = under.unionByName(heads.select("u1", "u2", F.lit(1).alias("tail")))
    under = under.groupBy("u1", "u2").agg(F.count("*").alias("n_children"), F.sum("tail").alias("n_tails"))
    under = under.select(F.col("u1").alias("k1"), F.col("u2").alias("k2"), "n_children", "n_tails")
    nodes = nodes.join(under, ["k1", "k2"], "left").fillna(0, ["n_children", "n_tails"])
    nodes = scratch.cut(nodes.withColumn("k", _key()), "nodes")

    # what each node adds to itself and to all above it, at the place of its smallest member
    own = nodes.select(
        "conv_id", "depth", (F.col("n_tails") + (F.col("n_children") == 0).cast("long")).alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    least = nodes.select("conv_id").distinct()
    hot = scratch.cut(skew.hot_from_counts(convs, "conv_id", "len", _part_rows(split)), "long")
    path = skew.skew_safe_join(open_.select("conv_id", "depth", "k1", "k2"), least, "conv_id", "depth", hot=hot)
    path = path.join(own, ["conv_id", "depth"], "left").fillna(0, ["leaves", "saved"])
    sums = _running(scratch.cut(path, "paths"), {"n_leaves": ("sum", "leaves"), "saved_tokens": ("sum", "saved")}, scratch, run, down=False)
    sums = sums.groupBy("k1", "k2").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = _ends(open_.filter("depth = len").select("k1", "k2", "conv_id"), id_range)
    grouped = nodes.join(sums, ["k1", "k2"], "left").join(ends, ["k1", "k2"], "left").select(
        "conv_id", "depth", _key("u", "u1", "u2"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"),
    )

    alone = tail.select(
        "conv_id", "depth", _key("u", "u1", "u2"), F.lit(1).cast("long").alias("n_convs"), (F.col("depth") < F.col("len")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("depth") == F.col("len"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NO_IDS)).alias("ends_sha256"),
        ((F.col("n_alone") == 1) & (F.col("alone") == 1)).alias("head"),
    )
    busy = scratch.cut(skew.hot_from_counts(nodes, "k", "n_children", _part_rows(nodes)).withColumnRenamed("k", "u"), "busy")
    parents = nodes.select(F.col("k").alias("u"), F.col("conv_id").alias("parent_conv_id"))
    children = grouped.unionByName(alone.filter("head").drop("head"))
    joined = skew.skew_safe_join(children, parents, "u", "conv_id", how="left", hot=busy).withColumn(
        "parent_conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id"))
    )
    rest = alone.filter("NOT head").drop("head").withColumn("parent_conv_id", F.col("conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return joined.select(*out).unionByName(rest.select(*out))


def _ends(members: DataFrame, id_range: int) -> DataFrame:
    """``(k1, k2, ends_sha256)``: digest of the ids of each node, ascending, comma-joined."""
    # ids of a conversation are distinct, so a text holds at most ``id_range`` of them
    texts = members.groupBy("k1", "k2", F.floor(F.col("conv_id") / id_range).alias("part")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def out(done: list) -> pa.RecordBatch:
            keys = [pa.array([k[i] for k, _ in done], pa.int64()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*keys, pa.array([d for _, d in done], pa.string())], names=["k1", "k2", "ends_sha256"])

        for batch in batches:
            done = []
            for k1, k2, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (k1, k2) != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield out(done)
        if state is not None:
            yield out([(now, state.hexdigest())])

    dealt = texts.repartition(shuffle_partitions(members.sparkSession), "k1", "k2").sortWithinPartitions("k1", "k2", "part")
    return dealt.select("k1", "k2", "ids").mapInArrow(run, "k1 long, k2 long, ends_sha256 string")
