"""Feature tables per (topic, document): scaling, ranks, assembly, kernel layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import terms as T
from tallyfold.operators import vectors as V

MAX_RUNS = 10_000

LEXICAL = ("tf", "idf", "tfidf", "cosine", "w2v", "w2v_top", "bm25", "lm_jm")


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation per column; a constant column becomes 0.

    All moments come from one aggregate that returns a single row.
    """
    exprs = []
    for c in cols:
        exprs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = df.agg(*exprs).first()
    out = df
    for c in cols:
        mean, std = row[f"m_{c}"], row[f"s_{c}"]
        if mean is None:
            continue
        # a constant column can leave a rounding-size deviation
        scale = std if std and std > 1e-12 * max(1.0, abs(mean)) else 1.0
        out = out.withColumn(c, (F.col(c) - F.lit(float(mean))) / F.lit(float(scale)))
    return out


def run_ranks(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """``(run, topic_id, doc_id, rank)`` of the judged pairs."""
    return runs.select("run", "topic_id", "doc_id", "rank").join(
        pairs.select("topic_id", "doc_id").distinct(), ["topic_id", "doc_id"]
    )


def rank_sum(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """Sum of ranks over runs (a missing rank adds nothing), standardised."""
    keys = ["topic_id", "doc_id"]
    sums = run_ranks(pairs, runs).groupBy(*keys).agg(F.sum("rank").alias("rank_sum"))
    every = pairs.select(*keys).distinct().join(sums, keys, "left")
    filled = every.select(*keys, F.coalesce(F.col("rank_sum"), F.lit(0)).cast("double").alias("rank_sum"))
    return standardise(filled, ["rank_sum"])


def rank_slots(pairs: DataFrame, runs: DataFrame) -> tuple[DataFrame, list[str]]:
    """One row per pair with a map run -> rank, and the sorted run names."""
    names = sorted(r[0] for r in runs.select("run").distinct().limit(MAX_RUNS + 1).collect())
    if len(names) > MAX_RUNS:
        raise ValueError("too many runs for one feature vector")
    keys = ["topic_id", "doc_id"]
    found = (
        run_ranks(pairs, runs)
        .groupBy(*keys, "run")
        .agg(F.max("rank").alias("rank"))
        .groupBy(*keys)
        # one entry per run
        .agg(F.map_from_entries(F.collect_list(F.struct("run", "rank"))).alias("ranks"))
    )
    return pairs.select(*keys).distinct().join(found, keys, "left"), names


def rank_vector(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """``(topic_id, doc_id, ranks)``: one standardised value per run, runs in name order.

    A missing rank is the largest rank seen anywhere.
    """
    slots, names = rank_slots(pairs, runs)
    top = run_ranks(pairs, runs).agg(F.max("rank")).first()[0] or 0
    filled = slots.select(
        "topic_id",
        "doc_id",
        *[
            F.coalesce(F.try_element_at("ranks", F.lit(n)), F.lit(top)).cast("double").alias(f"r{i}")
            for i, n in enumerate(names)
        ],
    )
    scaled = standardise(filled, [f"r{i}" for i in range(len(names))])
    return scaled.select("topic_id", "doc_id", F.array(*[F.col(f"r{i}") for i in range(len(names))]).alias("ranks"))


def rank_coverage(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: #pairs, #runs, #slots, #slots without a rank."""
    from tallyfold.operators.profile import one_row

    keys = ["topic_id", "doc_id"]
    ranked = run_ranks(pairs, runs).select(*keys, "run").distinct().agg(F.count("*").alias("ranked"))
    n_pairs = pairs.select(*keys).distinct().agg(F.count("*").alias("pairs"))
    n_runs = runs.agg(F.countDistinct("run").alias("runs"))
    merged = one_row(n_pairs, n_runs, ranked)
    slots = F.col("pairs") * F.col("runs")
    return merged.select("pairs", "runs", slots.alias("slots"), (slots - F.col("ranked")).alias("empty_slots"))


def lexical_features(
    pairs: DataFrame,
    topics: DataFrame,
    docs: DataFrame,
    token_vectors: DataFrame,
    min_df: int = T.MIN_DF,
    stem: bool = True,
    stop_words: Sequence[str] | DataFrame | None = None,
    fraction: float = 0.2,
    scale: bool = True,
    cut=None,
) -> DataFrame:
    """The eight text-matching features per pair, standardised.

    ``topics(topic_id, text)``, ``docs(doc_id, text)``.  ``cut`` materialises the
    tables that several scores read.  Without it they are in the shared scratch folder: the
    term tables are written as they are dealt out by document, so term rows do not move again, and leave the folder
    when the last score has read them.
    """
    from tallyfold.session import Scratch

    scratch = Scratch(pairs.sparkSession)
    parts = T.text_parts(docs)
    deal = cut or (lambda df, name: scratch.cut_by(df, "doc_id", parts, name))
    drop = scratch.drop if cut is None else (lambda df: None)
    cut = cut or scratch.cut
    unstopped = (lambda df: T.drop_stop_words(df, stop_words)) if stop_words is not None else (lambda df: df)
    raw = deal(T.token_counts(docs), "tokens")
    # mean vectors are of the words themselves; they are packed here
    raw_query = T.token_counts(topics, "topic_id")
    mean_query = V.mean_vector(unstopped(raw_query), token_vectors, "topic_id")
    mean_doc = V.mean_vector(unstopped(raw), token_vectors, blocks=parts)
    changed = stem or stop_words is not None
    doc_counts = deal(unstopped(T.stem_counts(raw) if stem else raw), "doc-terms") if changed else raw
    if changed:
        drop(raw)
    n_docs = docs.count()
    idf = cut(T.smoothed_idf(T.vocabulary(doc_counts, min_df), n_docs), "idf")
    corpus_tf = cut(T.corpus_frequencies(T.in_vocabulary(doc_counts, idf)), "corpus")
    doc_tfidf = deal(T.tfidf(doc_counts, idf).drop("idf"), "doc-tfidf")
    drop(doc_counts)
    query = unstopped(T.stem_counts(raw_query, "topic_id") if stem else raw_query)
    query_tfidf = cut(T.tfidf(query, idf, "topic_id"), "query-tfidf")
    scores = T.match_scores(pairs, query_tfidf, doc_tfidf, corpus_tf, cut(T.doc_lengths(docs), "lengths"))
    scores = V.pair_distance(scores, mean_query, mean_doc, "w2v")
    scores = V.pair_distance(
        scores,
        V.weighted_vector(query_tfidf, token_vectors, fraction, "topic_id"),
        V.weighted_vector(doc_tfidf, token_vectors, fraction, blocks=parts),
        "w2v_top",
    )
    scores = cut(scores.withColumn("cosine", F.coalesce(F.col("cosine"), F.lit(0.0))), "scores")
    drop(doc_tfidf)
    scaled = standardise(scores, LEXICAL) if scale else scores
    return scaled.select("topic_id", "doc_id", F.array(*[F.col(c) for c in LEXICAL]).alias("lexical"))


def attach_features(
    tasks: DataFrame,
    sets: Sequence[tuple[str, DataFrame]],
    keys: Sequence[str] = ("topic_id", "doc_id"),
    on_missing: str = "error",
) -> tuple[DataFrame, dict[str, list[int]]]:
    """Concatenate feature sets per task; also the index list of each kernel.

    ``sets`` are ``(name, table)`` with one array column per table besides the
    keys.  ``on_missing``: ``error``, ``zeros`` or ``drop``.
    """
    keys = list(keys)
    out = tasks
    dims: dict[str, list[int]] = {}
    offset = 0
    parts = []
    for position, (name, table) in enumerate(sets):
        value = next(c for c in table.columns if c not in keys)
        sizes = table.agg(F.min(F.size(value)), F.max(F.size(value))).first()
        if sizes[0] != sizes[1]:
            raise ValueError(f"feature set {name!r} has rows of {sizes[0]} to {sizes[1]} values")
        width = int(sizes[0] or 0)
        col = f"_set{position}"
        out = out.join(table.select(*keys, F.col(value).cast("array<double>").alias(col)), keys, "left")
        dims.setdefault(kernel_of(name), []).extend(range(offset, offset + width))
        offset += width
        if on_missing == "zeros":
            parts.append(F.coalesce(F.col(col), F.array_repeat(F.lit(0.0), width)))
        elif on_missing == "drop":
            out = out.filter(F.col(col).isNotNull())
            parts.append(F.col(col))
        elif on_missing == "error":
            missing = F.raise_error(F.concat(F.lit(f"no {name} features for "), F.concat_ws(",", *keys)))
            parts.append(F.when(F.col(col).isNotNull(), F.col(col)).otherwise(missing))
        else:
            raise ValueError(f"unknown on_missing {on_missing!r}")
    return out.select(*tasks.columns, F.concat(*parts).alias("features")), dims


def kernel_of(name: str) -> str:
    """Lexical and rank features use the RBF kernel, embedding vectors the linear one."""
    if "lexical" in name or "rank" in name or "rbf" in name:
        return "rbf"
    if "bert" in name or "linear" in name:
        return "linear"
    raise ValueError(f"no kernel is assigned to feature set {name!r}")


# The named feature-set combinations.
FEATURE_SETS = {
    "lexical": ["lexical"],
    "rank.onehot": ["rank.onehot"],
    "clueweb09.bert": ["clueweb09.bert"],
    "lexical.rank.onehot": ["lexical", "rank.onehot"],
    "lexical.clueweb09.bert": ["lexical", "clueweb09.bert"],
    "rank.onehot.clueweb09.bert": ["rank.onehot", "clueweb09.bert"],
    "lexical.rank.onehot.clueweb09.bert": ["lexical", "rank.onehot", "clueweb09.bert"],
}
