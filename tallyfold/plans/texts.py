"""Text, vector and rank features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.functions import textx
from tallyfold.operators import features as FE
from tallyfold.operators import terms as T
from tallyfold.operators import vectors as VE
from tallyfold.plans import views as V
from tallyfold.plans.fragments import DOC_TERMS, RERANKED, TEXT_CTES, TOKEN, VECTOR_CTES
from tallyfold.plans.registry import query
from tallyfold.plans.tables import FEATURE_ROWS, JUDGED, _exploded, _feature_sets, _judged_pairs, _ranked
from tallyfold.session import Scratch


class TextTables:
    """The term tables several text queries read.

    ``doc_counts`` is written as it is dealt out, by document, so texts are tokenised once and ``doc_tfidf`` goes on to the
    next step without moving.
    """

    def __init__(self, spark, d):
        self.scratch = Scratch(spark)
        cut = self.scratch.cut
        self.pairs = V.pairs(spark, d)
        self.docs = V.documents(spark, d)
        self.doc_counts = self.scratch.cut_by(T.token_counts(self.docs), "doc_id", T.text_parts(self.docs), "doc-terms")
        self.query_counts = cut(T.token_counts(V.topics(spark, d), "topic_id"), "query-terms")
        self.idf = cut(T.smoothed_idf(T.vocabulary(self.doc_counts), self.docs.count()), "idf")
        self.doc_tfidf = T.tfidf(self.doc_counts, self.idf)
        self.query_tfidf = cut(T.tfidf(self.query_counts, self.idf, "topic_id"), "query-tfidf")

    def scores(self):
        cf = self.scratch.cut(T.corpus_frequencies(T.in_vocabulary(self.doc_counts, self.idf)), "corpus")
        lengths = self.scratch.cut(T.doc_lengths(self.docs), "lengths")
        return T.match_scores(self.pairs, self.query_tfidf, self.doc_tfidf, cf, lengths)


def _one_score(name: str):
    def run(spark, d):
        return TextTables(spark, d).scores().select("topic_id", "doc_id", F.round(name, 6).alias(name))

    return run


@query(
    "d14_document_lengths",
    f"WITH {TEXT_CTES} SELECT doc_id, CAST(doc_len AS BIGINT) AS doc_len, (SELECT round(avg(doc_len), 6) FROM len) AS avg_len FROM len",
)
def d14(spark, d):
    docs = V.documents(spark, d)
    avg_len = T.average_length(docs).first()[0]
    return T.doc_lengths(docs).withColumn("avg_len", F.round(F.lit(float(avg_len)), 6))


@query("d15_corpus_frequency", f"SELECT term, CAST(sum(tf) AS BIGINT) AS cf FROM ({DOC_TERMS}) AS t GROUP BY 1")
def d15(spark, d):
    return T.corpus_frequencies(T.token_counts(V.documents(spark, d)))


@query("d16_vocabulary", f"SELECT term, count(*) AS df FROM ({DOC_TERMS}) AS t GROUP BY 1 HAVING count(*) >= 3")
def d16(spark, d):
    return T.vocabulary(T.token_counts(V.documents(spark, d)))


@query("f01_tokenise", DOC_TERMS)
def f01(spark, d):
    return T.token_counts(V.documents(spark, d))


def _stem_sql(words: str, column: str = "term") -> str:
    """The suffix tables and word shapes as nested SQL selects."""
    cut = lambda s: f"left(w, length(w) - {len(s)})"
    m = lambda e, pat: f"regexp_matches({e}, '{pat}')"

    def swap(table: str, pat: str) -> str:
        whens = []
        for suffix, new in textx.suffix_table(table):
            ok = m(cut(suffix), pat)
            if pat == textx.MEASURE_GT_1 and suffix == "ion":
                ok += f" AND {m(cut(suffix), '[st]$')}"
            whens.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {ok} THEN {cut(suffix)} || '{new}' ELSE w END")
        return "CASE " + " ".join(whens) + " ELSE w END"

    last = "right(left(w, length(w) - 1), 1)"
    before = "right(left(w, length(w) - 2), 1)"
    gt0, eq1, gt1 = textx.MEASURE_GT_0, textx.MEASURE_EQ_1, textx.MEASURE_GT_1
    steps = [
        "CASE WHEN left(w, 1) = 'y' THEN 'Y' || substr(w, 2) ELSE w END",
        "CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN left(w, length(w) - 2) "
        "WHEN ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END",
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {m(cut('eed'), gt0)} THEN left(w, length(w) - 1) ELSE w END "
        f"WHEN ends_with(w, 'ed') AND {m(cut('ed'), textx.HAS_VOWEL)} THEN {cut('ed')} || '|' "
        f"WHEN ends_with(w, 'ing') AND {m(cut('ing'), textx.HAS_VOWEL)} THEN {cut('ing')} || '|' ELSE w END",
        f"CASE WHEN NOT ends_with(w, '|') THEN w WHEN {m(cut('|'), '(at|bl|iz)$')} THEN {cut('|')} || 'e' "
        f"WHEN length(w) > 2 AND {last} = {before} AND {m(last, '^[^aeiouylsz]$')} THEN left(w, length(w) - 2) "
        f"WHEN {m(cut('|'), textx.ENDS_CVC)} THEN {cut('|')} || 'e' ELSE {cut('|')} END",
        f"CASE WHEN ends_with(w, 'y') AND {m(cut('y'), textx.HAS_VOWEL)} THEN {cut('y')} || 'i' ELSE w END",
        swap(textx.STEP2, gt0),
        swap(textx.STEP3, gt0),
        swap(textx.STEP4, gt1),
        f"CASE WHEN ends_with(w, 'e') AND ({m(cut('e'), gt1)} OR ({m(cut('e'), eq1)} AND NOT {m(cut('e'), textx.ENDS_CVC)})) "
        f"THEN {cut('e')} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {m('w', gt1)} THEN left(w, length(w) - 1) ELSE w END",
    ]
    q = f"SELECT DISTINCT {column} AS word, lower({column}) AS w FROM ({words}) AS src"
    for step in steps:
        q = f"SELECT word, CASE WHEN length(word) > 2 THEN {step} ELSE w END AS w FROM ({q}) AS s"
    return f"SELECT word AS {column}, lower(w) AS stem FROM ({q}) AS s"


STEMS = _stem_sql(DOC_TERMS)


@query("f02_porter_stem", STEMS)
def f02(spark, d):
    return T.stem_words(T.token_rows(V.documents(spark, d)))


@query(
    "f03_stop_words",
    f"""SELECT t.doc_id, t.term, t.tf FROM ({DOC_TERMS}) AS t WHERE t.term NOT IN (
      SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{TOKEN}')) FROM benchmark)""",
)
def f03(spark, d):
    # stop list given as a table: every word of the query texts
    stop = T.token_rows(V.topics(spark, d), "topic_id").select("term").distinct()
    return T.drop_stop_words(T.token_counts(V.documents(spark, d)), stop).select("doc_id", "term", "tf")


@query("f03_default_stop_words")
def f03b(spark, d):
    counts = T.token_counts(V.documents(spark, d))
    return T.drop_stop_words(counts, T.english_stop_words(spark)).select("doc_id", "term", "tf")


STEMMED = f"""SELECT doc_id, stem AS term, CAST(sum(tf) AS BIGINT) AS tf FROM dt JOIN stems USING (term) GROUP BY 1, 2"""
STEM_CTES = f"dt AS MATERIALIZED ({DOC_TERMS}), stems AS MATERIALIZED ({_stem_sql('SELECT term FROM dt')}), sc AS MATERIALIZED ({STEMMED})"


@query(
    "f04_term_counts",
    f"WITH {STEM_CTES} SELECT doc_id, term, tf FROM sc WHERE term IN (SELECT term FROM sc GROUP BY term HAVING count(*) >= 3)",
)
def f04(spark, d):
    docs = V.documents(spark, d)
    cut = Scratch(spark).cut
    counts = cut(T.analyse(docs), "stem-counts")
    return T.in_vocabulary(counts, cut(T.vocabulary(counts), "vocab")).select("doc_id", "term", "tf")


@query(
    "f04_raw_term_counts",
    f"WITH {STEM_CTES} SELECT doc_id, term, tf FROM dt WHERE term IN (SELECT term FROM sc GROUP BY term HAVING count(*) >= 3)",
)
def f04b(spark, d):
    docs = V.documents(spark, d)
    scratch = Scratch(spark)
    counts = scratch.cut_by(T.token_counts(docs), "doc_id", T.text_parts(docs), "doc-terms")
    vocab = scratch.cut(T.stem_vocabulary(counts), "vocab")
    return T.in_vocabulary(counts, vocab).select("doc_id", "term", "tf")


@query("f05_smoothed_idf", f"WITH {TEXT_CTES} SELECT term, df, round(idf, 6) AS idf FROM idf")
def f05(spark, d):
    docs = V.documents(spark, d)
    idf = T.smoothed_idf(T.vocabulary(T.token_counts(docs)), docs.count())
    return idf.select("term", "df", F.round("idf", 6).alias("idf"))


@query("f06_tfidf", f"WITH {TEXT_CTES} SELECT doc_id, term, round(tfidf, 6) AS tfidf FROM dtfidf")
def f06(spark, d):
    docs = V.documents(spark, d)
    counts = T.token_counts(docs)
    idf = Scratch(spark).cut(T.smoothed_idf(T.vocabulary(counts), docs.count()), "idf")
    return T.tfidf(counts, idf).select("doc_id", "term", F.round("tfidf", 6).alias("tfidf"))


@query(
    "c07_pair_terms",
    f"WITH {TEXT_CTES} SELECT topic_id, doc_id, term, CAST(tf AS BIGINT) AS tf FROM scored WHERE tf > 0",
)
def c07(spark, d):
    t = TextTables(spark, d)
    return T.pair_terms(
        t.pairs, t.query_tfidf.select("topic_id", "term"), t.doc_tfidf.select("doc_id", "term", "tf")
    ).select("topic_id", "doc_id", "term", "tf")


for _id, _name in (("f07", "tf"), ("f09", "tfidf"), ("f10", "cosine"), ("f11", "bm25"), ("f12", "lm_jm")):
    query(
        f"{_id}_{_name}_score", f"WITH {TEXT_CTES} SELECT topic_id, doc_id, round({_name}, 6) AS {_name} FROM scores"
    )(_one_score(_name))


@query("f07_query_tf", f"WITH {TEXT_CTES} SELECT topic_id, doc_id, tf FROM scores")
def f07b(spark, d):
    t = TextTables(spark, d)
    return T.query_tf(t.pairs, t.query_tfidf, t.doc_tfidf.select("doc_id", "term", "tf"))


@query("f08_idf_score", f"WITH {TEXT_CTES} SELECT topic_id, doc_id, round(idf, 6) AS idf FROM scores")
def f08(spark, d):
    t = TextTables(spark, d)
    out = T.query_idf(t.pairs, t.query_tfidf.select("topic_id", "term"), t.idf.select("term", "idf"))
    return out.select("topic_id", "doc_id", F.round("idf", 6).alias("idf"))


def _vector_rows(vec, key="doc_id"):
    return vec.filter(F.col("vec").isNotNull()).select(key, F.posexplode("vec").alias("dim", "x")).select(
        key, F.col("dim").cast("long").alias("dim"), F.round("x", 5).alias("x")
    )


@query(
    "f13_mean_vector",
    f"WITH {TEXT_CTES}, {VECTOR_CTES} SELECT doc_id, dim - 1 AS dim, "
    f"round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 5) AS x FROM dvec",
)
def f13(spark, d):
    docs = V.documents(spark, d)
    return _vector_rows(VE.mean_vector(T.token_counts(docs), V.token_vectors(spark, d), blocks=T.text_parts(docs)))


@query("e02_top_terms", f"WITH {TEXT_CTES}, {VECTOR_CTES} SELECT doc_id, term FROM dtop")
def e02(spark, d):
    return VE.top_terms(TextTables(spark, d).doc_tfidf).select("doc_id", "term")


@query(
    "f14_weighted_vector",
    f"WITH {TEXT_CTES}, {VECTOR_CTES} SELECT doc_id, dim - 1 AS dim, "
    f"round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 5) AS x FROM dtopvec",
)
def f14(spark, d):
    t = TextTables(spark, d)
    return _vector_rows(VE.weighted_vector(t.doc_tfidf, V.token_vectors(spark, d), blocks=T.text_parts(t.docs)))


@query(
    "f15_cosine_distance",
    f"WITH {TEXT_CTES}, {VECTOR_CTES} SELECT topic_id, doc_id, round(distance, 6) AS distance FROM w2v",
)
def f15(spark, d):
    tv = V.token_vectors(spark, d)
    q = VE.mean_vector(T.token_counts(V.topics(spark, d), "topic_id"), tv, "topic_id")
    texts = V.documents(spark, d)
    docs = VE.mean_vector(T.token_counts(texts), tv, blocks=T.text_parts(texts))
    out = VE.pair_distance(V.pairs(spark, d), q, docs)
    return out.select("topic_id", "doc_id", F.round("distance", 6).alias("distance"))


@query(
    "f16_standardise",
    """SELECT doc_id, round((n_chars - avg(n_chars) OVER ()) / stddev_pop(n_chars) OVER (), 6) AS a,
      round((length(lang) - avg(length(lang)) OVER ()) / coalesce(nullif(stddev_pop(length(lang)) OVER (), 0), 1), 6) AS b
    FROM documents""",
)
def f16(spark, d):
    docs = V.table(spark, d, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("a"), F.length("lang").cast("double").alias("b")
    )
    out = FE.standardise(docs, ["a", "b"])
    return out.select("doc_id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


RANK_CTES = f"""r AS MATERIALIZED ({RERANKED}), p AS MATERIALIZED (SELECT DISTINCT topic_id, doc_id FROM ({JUDGED}) AS j),
  hit AS MATERIALIZED (SELECT r.* FROM r JOIN p ON p.topic_id = r.topic_id AND p.doc_id = r.doc_id)"""


@query(
    "f17_rank_sum",
    f"""WITH {RANK_CTES}, s AS (SELECT p.topic_id, p.doc_id, coalesce(sum(hit.rank), 0) AS v FROM p
      LEFT JOIN hit ON hit.topic_id = p.topic_id AND hit.doc_id = p.doc_id GROUP BY 1, 2)
    SELECT topic_id, doc_id, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 6) AS rank_sum FROM s""",
)
def f17(spark, d):
    out = FE.rank_sum(_judged_pairs(spark, d), _ranked(spark, d))
    return out.select("topic_id", "doc_id", F.round("rank_sum", 6).alias("rank_sum"))


@query(
    "f18_rank_vector",
    f"""WITH {RANK_CTES}, slots AS (SELECT p.topic_id, p.doc_id, n.run, n.pos,
        coalesce(hit.rank, (SELECT max(rank) FROM hit)) AS v
      FROM p CROSS JOIN (SELECT run, row_number() OVER (ORDER BY run) - 1 AS pos FROM (SELECT DISTINCT run FROM r) x) n
      LEFT JOIN hit ON hit.topic_id = p.topic_id AND hit.doc_id = p.doc_id AND hit.run = n.run)
    SELECT topic_id, doc_id, pos, round((v - avg(v) OVER (PARTITION BY run)) /
      coalesce(nullif(stddev_pop(v) OVER (PARTITION BY run), 0), 1), 6) AS x FROM slots""",
)
def f18(spark, d):
    out = FE.rank_vector(_judged_pairs(spark, d), _ranked(spark, d))
    return out.select("topic_id", "doc_id", F.posexplode("ranks").alias("pos", "x")).select(
        "topic_id", "doc_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x")
    )


LEX_RAW = """SELECT s.topic_id, s.doc_id, s.tf, s.idf, s.tfidf, coalesce(s.cosine, 0) AS cosine, a.distance AS w2v,
  b.distance AS w2v_top, s.bm25, s.lm_jm FROM scores s JOIN w2v a ON a.topic_id = s.topic_id AND a.doc_id = s.doc_id
  JOIN w2vtop b ON b.topic_id = s.topic_id AND b.doc_id = s.doc_id"""
LEX_COLS = ("tf", "idf", "tfidf", "cosine", "w2v", "w2v_top", "bm25", "lm_jm")
LEX_SQL = f"WITH {TEXT_CTES}, {VECTOR_CTES}, lex AS MATERIALIZED ({LEX_RAW}) SELECT topic_id, doc_id, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 4) AS {c}" for c in LEX_COLS
) + " FROM lex"


@query("f19_lexical_features", LEX_SQL)
def f19(spark, d):
    out = FE.lexical_features(
        V.pairs(spark, d), V.topics(spark, d), V.documents(spark, d), V.token_vectors(spark, d), stem=False
    )
    return out.select("topic_id", "doc_id", *[F.round(F.col("lexical")[i], 4).alias(c) for i, c in enumerate(LEX_COLS)])


@query("f19_lexical_features_stemmed")
def f19b(spark, d):
    out = FE.lexical_features(
        V.pairs(spark, d), V.topics(spark, d), V.documents(spark, d), V.token_vectors(spark, d),
        stem=True, stop_words=T.english_stop_words(spark),
    )
    return out.select("topic_id", "doc_id", *[F.round(F.col("lexical")[i], 4).alias(c) for i, c in enumerate(LEX_COLS)])


@query(
    "f20_kernel_layout",
    f"SELECT doc_id, CASE WHEN dim < 2 THEN 'rbf' ELSE 'linear' END AS kernel, round(sum(x), 4) AS total FROM ({FEATURE_ROWS}) AS f GROUP BY 1, 2",
)
def f20(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id")
    joined, dims = FE.attach_features(docs, _feature_sets(spark, d), ["doc_id"])
    kernel = F.when(F.col("dim").isin(dims["rbf"]), "rbf").otherwise("linear")
    rows = _exploded(joined).withColumn("kernel", kernel)
    return rows.groupBy("doc_id", "kernel").agg(F.round(F.sum("x"), 4).alias("total"))
