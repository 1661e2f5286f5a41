"""SQL text of the views, for the comparison queries."""

V1 = """
SELECT d.source AS topic_id, l.doc_id, w.worker_id, CAST(l.quality AS INT) AS gold,
  CAST(CASE WHEN (l.doc_id*31 + w.worker_id*17 + l.doc_id*w.worker_id*7) % 100 < 5 + 6*w.worker_id
            THEN 1 - l.quality ELSE l.quality END AS INT) AS label
FROM labels l JOIN documents d ON d.doc_id = l.doc_id
CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6)) AS w(worker_id)
WHERE w.worker_id = 0 OR (l.doc_id*13 + w.worker_id*29) % 10 < 6
"""

T1 = f"""
SELECT topic_id || '--' || CAST(doc_id AS VARCHAR) AS task_id, worker_id, gold, label FROM ({V1}) AS v
"""

V2 = """
SELECT l_partkey AS task_id, l_suppkey AS worker_id, CAST(p_size % 2 AS INT) AS gold,
  CAST(CASE WHEN (l_orderkey*7 + l_linenumber*3 + l_suppkey) % 100 < 10 + l_suppkey % 30
       THEN 1 - p_size % 2 ELSE p_size % 2 END AS INT) AS label
FROM lineitem JOIN part ON p_partkey = l_partkey
"""

V3 = """
SELECT l_partkey AS task_id, l_suppkey AS worker_id, CAST(p_size % 3 AS INT) AS gold,
  CAST(CASE WHEN (l_orderkey*7 + l_linenumber*3 + l_suppkey) % 100 < 10 + l_suppkey % 30
       THEN (p_size + 1 + l_linenumber % 2) % 3 ELSE p_size % 3 END AS INT) AS label
FROM lineitem JOIN part ON p_partkey = l_partkey
"""

GRADED = """
SELECT CAST(l_orderkey % 100 AS VARCHAR) AS topic_id, CAST(l_suppkey AS VARCHAR) AS worker_id,
  CAST(l_partkey AS VARCHAR) AS doc_id, CAST(p_size % 4 - 1 AS INT) AS gold,
  CAST(l_linenumber - 2 AS INT) AS label
FROM lineitem JOIN part ON p_partkey = l_partkey
"""

PAIRS = "SELECT doc_id % (SELECT count(*) FROM benchmark) AS topic_id, doc_id FROM documents"

RUNS = """
SELECT event_type AS run, user_id AS topic_id, CAST(floor(value / 5) AS BIGINT) AS doc_id,
  max(value) AS score, CAST(min(event_id) AS INT) AS rank
FROM events GROUP BY 1, 2, 3
"""

RERANKED = f"""
SELECT run, topic_id, doc_id, score,
  row_number() OVER (PARTITION BY run, topic_id ORDER BY score DESC, rank, doc_id) AS rank
FROM ({RUNS}) AS r
"""

TOKEN = r"[\p{L}\p{N}_]{2,}"

DOC_TERMS = f"""
SELECT doc_id, term, count(*) AS tf FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM documents) AS t
GROUP BY 1, 2
"""

QUERY_TERMS = f"""
SELECT topic_id, term, count(*) AS tf FROM (
  SELECT item_id AS topic_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM benchmark) AS t
GROUP BY 1, 2
"""

TOKEN_VECTORS = f"""
SELECT t.term, e.embedding AS vec FROM (
  SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM (
    SELECT text FROM benchmark UNION ALL SELECT text FROM documents) AS b) AS t
JOIN embeddings e ON e.vec_id = (ascii(t.term)*31 + length(t.term)*7) % (SELECT count(*) FROM embeddings)
"""

PRED = f"""
SELECT task_id, max(gold) AS gold, CASE WHEN sum(label) * 2 >= count(*) THEN 1 ELSE 0 END AS pred,
  avg(CAST(label AS DOUBLE)) AS score
FROM ({V2}) AS v GROUP BY task_id
"""

# Terms of the vocabulary (document frequency >= 3) with smoothed idf, and unit-length tf-idf.
TEXT_CTES = f"""
dt AS MATERIALIZED ({DOC_TERMS}),
qt AS MATERIALIZED ({QUERY_TERMS}),
vocab AS MATERIALIZED (SELECT term, count(*) AS df FROM dt GROUP BY term HAVING count(*) >= 3),
idf AS MATERIALIZED (SELECT term, df,
  ln((1e0 + (SELECT count(*) FROM documents)) / (1e0 + df)) + 1 AS idf FROM vocab),
dw AS (SELECT doc_id, term, tf, idf, tf * idf AS raw FROM dt JOIN idf USING (term)),
dtfidf AS MATERIALIZED (SELECT doc_id, term, tf, idf,
  raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS tfidf FROM dw),
qw AS (SELECT topic_id, term, tf, idf, tf * idf AS raw FROM qt JOIN idf USING (term)),
qtfidf AS MATERIALIZED (SELECT topic_id, term, tf, idf,
  raw / sqrt(sum(raw * raw) OVER (PARTITION BY topic_id)) AS tfidf FROM qw),
pairs AS MATERIALIZED ({PAIRS}),
cf AS (SELECT term, sum(tf) AS cf FROM dt JOIN vocab USING (term) GROUP BY term),
len AS (SELECT doc_id, CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) = 0 THEN 0
  ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS doc_len FROM documents),
vlen AS (SELECT doc_id, sum(tf) AS vocab_len FROM dtfidf GROUP BY doc_id),
scored AS MATERIALIZED (
  SELECT p.topic_id, p.doc_id, q.term, q.idf, q.tfidf AS q_weight, coalesce(d.tf, 0) AS tf,
    coalesce(d.tfidf, 0e0) AS d_weight, len.doc_len, v.vocab_len, cf.cf,
    (SELECT avg(doc_len) FROM len) AS avg_len, (SELECT sum(cf) FROM cf) AS total
  FROM pairs p JOIN qtfidf q ON q.topic_id = p.topic_id
  LEFT JOIN dtfidf d ON d.doc_id = p.doc_id AND d.term = q.term
  JOIN len ON len.doc_id = p.doc_id LEFT JOIN vlen v ON v.doc_id = p.doc_id
  JOIN cf ON cf.term = q.term),
scores AS MATERIALIZED (
  SELECT p.topic_id, p.doc_id, coalesce(s.tf, 0) AS tf, coalesce(s.idf, 0) AS idf,
    coalesce(s.tfidf, 0) AS tfidf, s.cosine, coalesce(s.bm25, 0) AS bm25, coalesce(s.lm_jm, 0) AS lm_jm
  FROM pairs p LEFT JOIN (
    SELECT topic_id, doc_id, CAST(sum(tf) AS DOUBLE) AS tf, sum(idf) AS idf, sum(d_weight) AS tfidf,
      CASE WHEN max(vocab_len) IS NOT NULL THEN sum(q_weight * d_weight) END AS cosine,
      sum(CASE WHEN tf > 0 THEN idf * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * doc_len / avg_len))
          ELSE 0 END) AS bm25,
      sum(ln(1e0 + 0.5e0 * coalesce(tf / vocab_len, 0) + 0.5e0 * cf / total)) AS lm_jm
    FROM scored GROUP BY 1, 2) s ON s.topic_id = p.topic_id AND s.doc_id = p.doc_id)
"""

VECTOR_CTES = f"""
tv AS MATERIALIZED ({TOKEN_VECTORS}),
tvd AS MATERIALIZED (SELECT term, unnest(generate_series(1, len(vec))) AS dim, unnest(vec) AS x FROM tv),
dvec AS MATERIALIZED (
  SELECT doc_id, dim, sum(tf * CAST(x AS DOUBLE)) / any_value(n) AS x FROM (
    SELECT doc_id, term, tf, sum(tf) OVER (PARTITION BY doc_id) AS n FROM dt) t JOIN tvd USING (term) GROUP BY 1, 2),
qvec AS MATERIALIZED (
  SELECT topic_id, dim, sum(tf * CAST(x AS DOUBLE)) / any_value(n) AS x FROM (
    SELECT topic_id, term, tf, sum(tf) OVER (PARTITION BY topic_id) AS n FROM qt) t JOIN tvd USING (term) GROUP BY 1, 2),
dtop AS MATERIALIZED (SELECT doc_id, term, tf, tfidf FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(tfidf, 12) DESC, term) AS rn,
    floor(0.2e0 * count(*) OVER (PARTITION BY doc_id)) AS keep FROM dtfidf) t WHERE rn <= keep),
qtop AS MATERIALIZED (SELECT topic_id, term, tf, tfidf FROM (
  SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY round(tfidf, 12) DESC, term) AS rn,
    floor(0.2e0 * count(*) OVER (PARTITION BY topic_id)) AS keep FROM qtfidf) t WHERE rn <= keep),
dtopvec AS MATERIALIZED (SELECT doc_id, dim, sum(tf * tfidf * CAST(x AS DOUBLE)) AS x
  FROM dtop JOIN tvd USING (term) GROUP BY 1, 2),
qtopvec AS MATERIALIZED (SELECT topic_id, dim, sum(tf * tfidf * CAST(x AS DOUBLE)) AS x
  FROM qtop JOIN tvd USING (term) GROUP BY 1, 2),
w2v AS (SELECT p.topic_id, p.doc_id, CASE WHEN max(dn.n) > 0 AND max(qn.n) > 0
    THEN 1 - sum(d.x * q.x) / (max(dn.n) * max(qn.n)) ELSE 1 END AS distance
  FROM pairs p LEFT JOIN qvec q ON q.topic_id = p.topic_id LEFT JOIN dvec d ON d.doc_id = p.doc_id AND d.dim = q.dim
  LEFT JOIN (SELECT doc_id, sqrt(sum(x*x)) AS n FROM dvec GROUP BY 1) dn ON dn.doc_id = p.doc_id
  LEFT JOIN (SELECT topic_id, sqrt(sum(x*x)) AS n FROM qvec GROUP BY 1) qn ON qn.topic_id = p.topic_id GROUP BY 1, 2),
w2vtop AS (SELECT p.topic_id, p.doc_id, CASE WHEN max(dn.n) > 0 AND max(qn.n) > 0
    THEN 1 - sum(d.x * q.x) / (max(dn.n) * max(qn.n)) ELSE 1 END AS distance
  FROM pairs p LEFT JOIN qtopvec q ON q.topic_id = p.topic_id
  LEFT JOIN dtopvec d ON d.doc_id = p.doc_id AND d.dim = q.dim
  LEFT JOIN (SELECT doc_id, sqrt(sum(x*x)) AS n FROM dtopvec GROUP BY 1) dn ON dn.doc_id = p.doc_id
  LEFT JOIN (SELECT topic_id, sqrt(sum(x*x)) AS n FROM qtopvec GROUP BY 1) qn ON qn.topic_id = p.topic_id GROUP BY 1, 2)
"""
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def cdf(x: str) -> str:
    """Standard normal CDF as SQL (same published polynomial as the Column form)."""
    z = f"(({x}) / sqrt(2e0))"
    t = f"(1e0 / (1e0 + {ERF_P}e0 * abs({z})))"
    poly = "0e0"
    for a in reversed(ERF_A):
        poly = f"(({poly}) + ({a}e0)) * {t}"
    return f"(0.5e0 * (1e0 + sign({z}) * (1e0 - ({poly}) * exp(-{z} * {z}))))"


def pdf(x: str) -> str:
    return f"(exp(-0.5e0 * ({x}) * ({x})) / sqrt(2e0 * pi()))"


def link(x: str) -> str:
    return f"({cdf(x)} * (1e0 - 2e-6) + 1e-6)"
