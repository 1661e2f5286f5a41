"""Term statistics and query-document matching scores over long-form tables.

``doc_terms(doc_id, term, tf)`` and ``query_terms(topic_id, term)`` are the
sparse vectors; a dot product is an equi-join on term followed by a sum.  Texts are
dealt out by document once and a document's terms are made, weighted and matched
with its pairs' queries there, so term rows do not move and no frequent term
gathers the pairs of all documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfold.functions.textx import porter_steps, tokens, word_count
from tallyfold.session import Scratch, shuffle_partitions

MIN_DF = 3
MAX_STOP_WORDS = 100_000
# a table of at most so many short rows goes to every executor (some 50 MB)
LOOKUP_ROWS = 500_000


def widen(docs: DataFrame, key: str) -> DataFrame:
    """Spread a small input over all cores before heavy per-row work.

    Only when the scan has fewer splits than the cluster has slots (one small
    file, say); a large input already has more splits and is left alone.
    """
    slots = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(slots, key) if docs.rdd.getNumPartitions() < slots else docs


def token_rows(docs: DataFrame, key: str = "doc_id", lower: bool = True) -> DataFrame:
    """One row per token: ``(key, term)``."""
    return widen(docs, key).select(key, F.explode(tokens("text", lower)).alias("term"))


def text_parts(docs: DataFrame) -> int:
    """Partitions for the texts of a scan: never fewer than for any shuffle, and small enough to count terms in memory."""
    return max(shuffle_partitions(docs.sparkSession), 8 * docs.rdd.getNumPartitions())


def token_counts(docs: DataFrame, key: str = "doc_id", lower: bool = True) -> DataFrame:
    """``(key, term, tf)``, dealt out by key.

    The texts move once; term rows are made and counted where all texts of a key are, so neither they nor what is
    computed from them per key moves again.
    """
    texts = docs.select(key, "text").repartition(text_parts(docs), key)
    rows = texts.select(key, F.explode(tokens("text", lower)).alias("term"))
    return rows.groupBy(key, "term").agg(F.count("*").alias("tf"))


def lookup(table: DataFrame) -> DataFrame:
    """A written table for a join by term: on every executor if it is small, else Spark decides."""
    return F.broadcast(table) if table.count() <= LOOKUP_ROWS else table


def stem_words(words: DataFrame, word: str = "term") -> DataFrame:
    """``(word, stem)`` for every distinct word; words of two letters or fewer stay.

    Each step is its own projection.  The result is written once: were a filter
    on ``stem`` pushed through the projections, the optimizer would substitute
    every step into the next and the expression would grow exponentially.
    """
    out = words.select(word).distinct().withColumn("stem", F.lower(F.col(word)))
    for step in porter_steps():
        out = out.withColumn(
            "stem", F.when(F.length(word) > 2, step(F.col("stem"))).otherwise(F.col("stem"))
        )
    return Scratch(words.sparkSession).cut(out, "stems")


def stem_counts(counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Merge term counts by stem; the stemmer runs once per distinct word, and only words that it changes are looked up."""
    changed = lookup(stem_words(counts).filter(F.col("stem") != F.col("term")))
    return (
        counts.filter(F.col("term").isNotNull())
        .join(changed, "term", "left")
        .groupBy(key, F.coalesce("stem", "term").alias("term"))
        .agg(F.sum("tf").alias("tf"))
    )


def english_stop_words(spark) -> list[str]:
    """Default English list shipped with Spark."""
    from pyspark.ml.feature import StopWordsRemover

    return list(StopWordsRemover.loadDefaultStopWords("english"))


def drop_stop_words(terms: DataFrame, stop_words: Sequence[str] | DataFrame) -> DataFrame:
    """Anti-join with a stop list (a list, or a table with a ``term`` column)."""
    if not isinstance(stop_words, DataFrame):
        if len(stop_words) > MAX_STOP_WORDS:
            raise ValueError("stop list too long to broadcast; pass a table")
        spark = terms.sparkSession
        stop_words = F.broadcast(spark.createDataFrame([(w,) for w in stop_words], "term string"))
    return terms.join(stop_words, "term", "left_anti")


def analyse(
    docs: DataFrame,
    key: str = "doc_id",
    stem: bool = True,
    stop_words: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """The full chain: tokenise, stem, lower, drop stop words -> ``(key, term, tf)``."""
    counts = token_counts(docs, key)
    if stem:
        counts = stem_counts(counts, key)
    if stop_words is not None:
        counts = drop_stop_words(counts, stop_words)
    return counts


def vocabulary(doc_terms: DataFrame, min_df: int = MIN_DF) -> DataFrame:
    """``(term, df)`` of the terms found in at least ``min_df`` documents."""
    return doc_terms.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df)


def stem_vocabulary(counts: DataFrame, min_df: int = MIN_DF, key: str = "doc_id") -> DataFrame:
    """``vocabulary(stem_counts(counts))`` without moving ``counts``, a written table dealt out by key.

    A stem of one word has that word's documents; only rows of words that share a stem are merged, key by key.
    """
    words = Scratch(counts.sparkSession).cut(counts.groupBy("term").agg(F.count("*").alias("df")), "words")
    stems = stem_words(words).withColumnRenamed("stem", "_stem")
    sizes = stems.groupBy("_stem").agg(F.count("*").alias("_words"))
    sized = Scratch(counts.sparkSession).cut(stems.join(sizes, "_stem"), "sized-stems")
    alone = words.join(sized.filter("_words = 1"), "term").select(F.col("_stem").alias("term"), "df")
    several = counts.join(lookup(sized.filter("_words > 1").select("term", "_stem")), "term")
    merged = several.groupBy(key, F.col("_stem").alias("term")).agg(F.sum("tf").alias("tf"))
    return alone.unionByName(merged.groupBy("term").agg(F.count("*").alias("df"))).filter(F.col("df") >= min_df)


def in_vocabulary(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Restrict term rows to a written vocabulary (if large, frequent terms are split by the adaptive skew join)."""
    return terms.join(lookup(vocab.select("term")), "term", "left_semi")


def term_frequencies(
    docs: DataFrame,
    vocab: DataFrame,
    key: str = "doc_id",
    stem: bool = True,
    stop_words: Sequence[str] | DataFrame | None = None,
    analyze_query_raw: bool = False,
) -> DataFrame:
    """Term counts restricted to ``vocab``.

    ``analyze_query_raw`` counts raw tokens only (neither stemmed nor stopped), so
    just the tokens that happen to equal a vocabulary term remain.
    """
    counts = token_counts(docs, key) if analyze_query_raw else analyse(docs, key, stem, stop_words)
    return in_vocabulary(counts, vocab)


def corpus_frequencies(doc_terms: DataFrame) -> DataFrame:
    return doc_terms.groupBy("term").agg(F.sum("tf").alias("cf"))


def doc_lengths(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(key, word_count("text").cast("long").alias("doc_len"))


def average_length(docs: DataFrame) -> DataFrame:
    return doc_lengths(docs).agg(F.avg("doc_len").alias("avg_len"))


def smoothed_idf(vocab: DataFrame, n_docs: int) -> DataFrame:
    """``(term, df, idf)`` with idf = ln((1 + n) / (1 + df)) + 1."""
    ratio = F.lit(float(1 + n_docs)) / (F.col("df") + F.lit(1.0))
    return vocab.withColumn("idf", F.ln(ratio) + F.lit(1.0))


def tfidf(terms: DataFrame, idf: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, term, tf, idf, tfidf)`` with unit L2 norm per key."""
    weighted = terms.filter(F.col(key).isNotNull()).join(lookup(idf.select("term", "idf")), "term").withColumn(
        "raw", F.col("tf").cast("double") * F.col("idf")
    )
    # terms of a key are distinct, so a key has no more rows than the vocabulary
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return weighted.withColumn("norm", norm).select(
        key, "term", "tf", "idf", (F.col("raw") / F.col("norm")).alias("tfidf")
    )


def pair_terms(pairs: DataFrame, query_terms: DataFrame, doc_side: DataFrame) -> DataFrame:
    """Candidate pairs x terms that the query and the document share.

    The document side meets its pairs by document, as it is dealt out already; ``query_terms`` is a written table.
    """
    return doc_side.join(pairs, "doc_id").join(lookup(query_terms), ["topic_id", "term"])


def _per_pair(pairs: DataFrame, scored: DataFrame, value, name: str) -> DataFrame:
    sums = scored.groupBy("topic_id", "doc_id").agg(F.sum(value).alias(name))
    return pairs.join(sums, ["topic_id", "doc_id"], "left").select(
        "topic_id", "doc_id", F.coalesce(F.col(name), F.lit(0.0)).alias(name)
    )


def match_scores(
    pairs: DataFrame,
    query_tfidf: DataFrame,
    doc_tfidf: DataFrame,
    corpus_tf: DataFrame,
    lengths: DataFrame,
    k1: float = 1.2,
    b: float = 0.75,
    lam: float = 0.5,
) -> DataFrame:
    """All term-matching scores of every pair in one pass.

    ``tf``, ``idf``, ``tfidf``: sums over the query's terms; ``cosine``: NULL when
    either vector is empty; ``bm25``; ``lm_jm``: sum of
    ln(1 + lam * tf / len_d + (1 - lam) * cf / len_C), lengths in vocabulary terms.
    """
    total = corpus_tf.agg(F.sum("cf")).first()[0]
    avg_len = lengths.agg(F.avg("doc_len")).first()[0]
    total, avg_len = float(total or 1), float(avg_len or 1)
    query = Scratch(pairs.sparkSession).cut(
        query_tfidf.join(corpus_tf, "term").select(
            "topic_id", "term", F.col("idf"), F.col("tfidf").alias("q_weight"), (F.lit((1 - lam) / total) * F.col("cf")).alias("c")
        ),
        "query",
    )
    # what a query's terms add to any document: a sum per topic
    per_topic = query.groupBy("topic_id").agg(F.sum("idf").alias("idf"), F.sum(F.log1p("c")).alias("lm_base"))
    sized = pairs.join(lengths, "doc_id")
    of_query = sized.join(per_topic, "topic_id").groupBy("topic_id", "doc_id").agg(
        F.sum("idf").alias("idf"), F.sum("lm_base").alias("lm_base")
    )
    # what shared terms add
    doc = doc_tfidf.select(
        "doc_id", "term", "tf", F.col("tfidf").alias("d_weight"), F.sum("tf").over(Window.partitionBy("doc_id")).alias("vocab_len")
    )
    rows = doc.join(sized, "doc_id").join(lookup(query), ["topic_id", "term"], "left")
    tf = F.col("tf").cast("double")
    saturation = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("doc_len") / F.lit(avg_len))
    bm25 = F.when(tf > 0, F.col("idf") * tf * F.lit(k1 + 1) / (tf + saturation)).otherwise(F.lit(0.0))
    share = F.coalesce(F.try_divide(tf, F.col("vocab_len").cast("double")), F.lit(0.0))
    lm = F.log1p(F.lit(lam) * share + F.col("c")) - F.log1p("c")
    shared = F.col("c").isNotNull()
    of_shared = rows.groupBy("topic_id", "doc_id").agg(
        *[
            F.coalesce(F.sum(F.when(shared, value)), F.lit(0.0)).alias(name)
            for name, value in (
                ("tf", tf),
                ("tfidf", F.col("d_weight")),
                # both sides have unit norm, so the dot product is the cosine
                ("cosine", F.col("q_weight") * F.col("d_weight")),
                ("bm25", bm25),
                ("lm_more", lm),
            )
        ]
    )
    sums = of_query.join(of_shared, ["topic_id", "doc_id"], "left").withColumn(
        "lm_jm", F.col("lm_base") + F.coalesce("lm_more", F.lit(0.0))
    )
    zero = F.lit(0.0)
    return pairs.join(sums, ["topic_id", "doc_id"], "left").select(
        "topic_id",
        "doc_id",
        *[F.coalesce(F.col(c), zero).alias(c) for c in ("tf", "idf", "tfidf")],
        "cosine",
        *[F.coalesce(F.col(c), zero).alias(c) for c in ("bm25", "lm_jm")],
    )


def query_idf(pairs: DataFrame, query_terms: DataFrame, idf: DataFrame) -> DataFrame:
    """Sum of the query's idf per pair, from the query side only."""
    per_topic = query_terms.join(idf, "term").groupBy("topic_id").agg(F.sum("idf").alias("idf"))
    return pairs.join(per_topic, "topic_id", "left").select(
        "topic_id", "doc_id", F.coalesce(F.col("idf"), F.lit(0.0)).alias("idf")
    )


def query_tf(pairs: DataFrame, query_terms: DataFrame, doc_terms: DataFrame) -> DataFrame:
    """Sum of the document's counts over the query's terms."""
    rows = pair_terms(pairs, query_terms.select("topic_id", "term"), doc_terms)
    return _per_pair(pairs, rows, F.col("tf").cast("double"), "tf")
