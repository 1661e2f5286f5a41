"""Named queries of the text operators over the driver tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
     b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, list_filter(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
     win AS (SELECT DISTINCT item, least(13, len(w)) AS n,
               array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
             FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
     pos AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
             FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win)
                   WHERE len(w) >= n)),
     hit AS (SELECT DISTINCT r, i, pos.n AS n, item FROM pos JOIN win ON pos.g = win.g AND pos.n = win.n),
     words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hit) GROUP BY r),
     items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS found
               FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(found, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


@query("op4_decontaminate", OP4_SQL)
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfold.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_scan_secrets")
def op6_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfold.llm.credentials import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     pos AS (SELECT r, k, i, md5(array_to_string(w[i:i + k - 1], ' ')) AS g
             FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i
                   FROM d, (VALUES (3), (8), (101)) AS ks(k) WHERE len(w) >= k)),
     rep AS (SELECT r, k, i FROM (SELECT *, count(*) OVER (PARTITION BY r, k, g) AS c FROM pos) WHERE c > 1),
     cov AS (SELECT r, k, count(DISTINCT j) AS n FROM (SELECT r, k, unnest(range(i, i + k)) AS j FROM rep) GROUP BY r, k),
     lines AS (SELECT r, sum(n - 1) AS n_dup FROM (
                 SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
                 WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) GROUP BY r),
     m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup, 0) AS n_dup_lines,
             coalesce((SELECT n FROM cov WHERE cov.r = d.r AND k = 3), 0) AS n3,
             coalesce((SELECT n FROM cov WHERE cov.r = d.r AND k = 8), 0) AS n8,
             coalesce((SELECT n FROM cov WHERE cov.r = d.r AND k = 101), 0) AS n101
           FROM d LEFT JOIN lines USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n3 AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * n3 > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n3 > 50 * n_words) AND 100 * n8 <= 30 * n_words AND n101 = 0 AS kept,
       CAST(n8 AS BIGINT) AS n_covered
FROM m
"""


@query("op7_quality_rules", OP7_SQL)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfold.llm.repetition import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


@query("op1_classify_quality")
def op1_classify_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfold.llm.cotrain import classify_quality

    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_identify_language")
def op9_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tallyfold.llm.language import identify_language

    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    out = identify_language(docs, ~F.col("held_out"), carry=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query("op5_pack_buckets")
def op5_pack_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfold.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


@query("op2_extract_html")
def op2_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfold.llm.htmlblocks import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


@query("op3_score_texts")
def op3_score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tallyfold.llm.ngramlm import score_texts

    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 1
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    return score_texts(docs, ~F.col("held_out"), carry=("doc_id", "held_out"))


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     sh AS (SELECT DISTINCT r, array_to_string(w[i:i + 2], ' ') AS g
            FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
     n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
     both_ AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
     link AS (SELECT a, b FROM both_ JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
     reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
     least_ AS (SELECT reach.a AS r, min(d.doc_id) AS low FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM d LEFT JOIN n USING (r) LEFT JOIN least_ USING (r)
"""


@query("op8_near_duplicates", OP8_SQL)
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfold.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_remove_repeats")
def op10_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfold.llm.bwtdedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
             AND list_bool_or(list_transform(embedding, lambda x: coalesce(x, 0) <> 0))),
     s AS (SELECT q.r AS q, q.vec_id AS query_id, c.vec_id, c.r, list_inner_product(q.v, c.v) AS score
           FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS FIRST, r) AS rank FROM s) WHERE rank <= 20
"""


@query("op13_nearest_vectors", OP13_SQL)
def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tallyfold.llm.blockjoin import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


CRC_TABLE_SQL = """SELECT list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
       lambda s, o: xor(s >> 1, (s & 1) * CAST(3988292384 AS BIGINT))) AS v, i FROM range(256) AS t(i)"""


def crc32_sql(text: str) -> str:
    """crc32 of a string by its bytes; needs a joined ``crc`` with the list ``v`` of the 256 remainders."""
    codes = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substring(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return (
        f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}),"
        " lambda s, b: xor(s >> 8, crc.v[(xor(s, b) & 255) + 1])), CAST(4294967295 AS BIGINT))"
    )


OP12_SQL = rf"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS v FROM ({CRC_TABLE_SQL})),
     runs AS (SELECT doc_id, run, count(*) AS n FROM (
                SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
              WHERE length(run) >= 7 GROUP BY ALL),
     hashed AS (SELECT run, n, {crc32_sql("doc_id || ':' || run")} AS h FROM runs, crc),
     vocab AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
                 SELECT n, CASE WHEN h % 31 = 0 THEN substring(run, 1, CAST(h % length(run) AS INT))
                     || substring(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed)
               WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
     gone AS (SELECT word, i, substring(word, 1, i) || substring(word, i + 2) AS rest
              FROM (SELECT word, CAST(unnest(range(length(word))) AS INT) AS i FROM vocab)),
     near AS (SELECT a.word, b.word AS near FROM gone a JOIN gone b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
              UNION SELECT g.word, v.word FROM gone g JOIN vocab v ON g.rest = v.word
              UNION SELECT v.word, g.word FROM gone g JOIN vocab v ON g.rest = v.word),
     best AS (SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, encode(near)) AS near, max(m) AS m
              FROM (SELECT near.word, near, v.n AS m FROM near JOIN vocab v ON v.word = near.near) GROUP BY word),
     forms AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN near END AS form,
                 CASE WHEN m >= 10 * n THEN m END AS form_n FROM vocab v LEFT JOIN best USING (word)),
     chain(word, up, d) AS (SELECT word, form, 1 FROM forms WHERE form IS NOT NULL
              UNION ALL SELECT chain.word, forms.form, d + 1 FROM chain JOIN forms ON forms.word = chain.up WHERE forms.form IS NOT NULL),
     ends AS (SELECT word, last(up ORDER BY d) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM forms LEFT JOIN ends USING (word)
"""


@query("op12_spelling_variants", OP12_SQL)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfold.llm.spelling import drop_letter, spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"), slip=drop_letter(31))


OP11_SQL = rf"""
WITH crc AS (SELECT list(v ORDER BY i) AS v FROM ({CRC_TABLE_SQL})),
     own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS t
             FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
     hs AS (SELECT conv_id, t, conv_id - conv_id % 20 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM own, crc),
     conv AS (SELECT hs.conv_id AS c, list_concat(coalesce(b.t, [])[1:hs.h], hs.t[hs.h + 1:]) AS t FROM hs LEFT JOIN own b ON b.conv_id = hs.base),
     step AS (SELECT c, len(t) AS n, d, t[1:d] AS p, t[d].text AS last FROM (SELECT c, t, unnest(range(len(t) + 1)) AS d FROM conv)),
     node AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN n = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends,
                max(len(list_filter(regexp_split_to_array(coalesce(last, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS words FROM step GROUP BY d, p),
     kid AS (SELECT node.*, (SELECT count(*) FROM node k WHERE k.d = node.d + 1 AND k.p[1:node.d] = node.p) AS n_children,
               (SELECT u.conv_id FROM node u WHERE u.d = node.d - 1 AND node.p[1:u.d] = u.p) AS parent_conv_id FROM node),
     sub AS (SELECT v.d, v.p, sum(CAST(w.n_children = 0 AS BIGINT)) AS n_leaves, sum((w.n_convs - 1) * w.words) AS saved
             FROM (SELECT kid.*, unnest(range(d + 1)) AS e FROM kid) w JOIN node v ON v.d = w.e AND v.p = w.p[1:w.e] GROUP BY v.d, v.p)
SELECT conv_id, kid.d AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(ends, '')) AS ends_sha256
FROM kid JOIN sub ON sub.d = kid.d AND sub.p = kid.p
"""


@query("op11_conversation_trie", OP11_SQL)
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tallyfold.llm.convtrie import prefix_trie, rebuild, turn_digests
    from tallyfold.session import Scratch

    scratch = Scratch(spark)
    conv = F.col("conv_id")
    turns = turn_digests(table(spark, sf_dir, "conversations"))
    rebuilt, convs = rebuild(scratch.cut(turns, "turns"), F.crc32(conv.cast("string")) % 4, conv - conv % 20, scratch, most=3)
    return prefix_trie(rebuilt, convs, scratch)
