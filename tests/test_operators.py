"""Hand-computed tables for the other operators."""

import math
import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfold.functions import mathx, textx
from tallyfold.functions.vectorx import cosine_distance, l2_normalise
from tallyfold.operators import annotations as A
from tallyfold.operators import evaluation as E
from tallyfold.operators import features as FE
from tallyfold.operators import profile as P
from tallyfold.operators import ranking as R
from tallyfold.operators import skew
from tallyfold.operators import terms as T
from tallyfold.operators.joins import topic_texts
from tallyfold.sources import readers, writers


def pred(spark, rows):
    return spark.createDataFrame(rows, "gold int, pred int, score double")


def test_auc_ties_and_blocks(spark):
    tied = pred(spark, [(1, 1, 0.5), (0, 1, 0.5), (1, 1, 0.5)])
    assert E.auc(tied).first()["auc"] == 0.5
    rows = [(i % 3 == 0, 1, float((i * 37) % 17)) for i in range(200)]
    df = pred(spark, [(int(g), p, s) for g, p, s in rows])
    pos, neg = [s for g, _, s in rows if g], [s for g, _, s in rows if not g]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert math.isclose(E.auc(df).first()["auc"], want)


def test_undefined_scores_are_zero(spark):
    row = E.class_scores(pred(spark, [(0, 0, 0.1), (0, 0, 0.2)])).first()
    assert (row["posi_p"], row["posi_r"], row["posi_f1"], row["nega_f1"]) == (0, 0, 0, 1)


@pytest.mark.parametrize("blocks", [1, 3, 8])
def test_kendall_tau_matches_all_pairs(spark, blocks):
    pts = [((i * 7) % 11, (i * i) % 13) for i in range(120)] + [(3, i) for i in range(40)]
    sign = lambda v: (v > 0) - (v < 0)
    num = nx = ny = 0
    for i, (x1, y1) in enumerate(pts):
        for x2, y2 in pts[:i]:
            num += sign(x1 - x2) * sign(y1 - y2)
            nx += x1 != x2
            ny += y1 != y2
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "ref double, est double")
    assert math.isclose(E.kendall_tau(df, blocks=blocks).first()["tau"], num / math.sqrt(nx * ny), rel_tol=1e-12)


def test_row_numbers_agree_when_groups_are_cut(spark):
    df = spark.range(500).select(F.when(F.col("id") < 350, 0).otherwise(F.col("id") % 5).alias("k"), "id")
    order = [(F.col("id") * 7919 % 503).desc(), F.col("id")]
    window = Window.partitionBy("k").orderBy(*order)
    whole = {tuple(r) for r in df.withColumn("rn", F.row_number().over(window)).select("k", "id", "rn").collect()}
    cut = {tuple(r) for r in R.row_numbers(df, ["k"], order).select("k", "id", "rn").collect()}
    assert whole == cut and len(cut) == 500


def test_rows_with_null_keys_stay(spark):
    df = spark.range(40).select(F.when(F.col("id") % 2 == 0, F.col("id") % 4).alias("k"), "id")
    got = R.row_numbers(df, ["k"], [F.col("id")]).collect()
    assert len(got) == 40 and sorted(r["rn"] for r in got if r["k"] is None) == list(range(1, 21))
    assert R.row_numbers(df, [], [F.col("id")]).agg(F.max("rn")).first()[0] == 40
    half = R.top_fraction(df, ["k"], [F.col("id")], 0.5).collect()
    assert len(half) == 20 and sum(r["k"] is None for r in half) == 10
    small = spark.createDataFrame([(0, "a"), (2, "b"), (None, "n")], "k long, x string")
    joined = skew.skew_safe_join(df, small, "k", "id", rows_per_part=5)
    assert joined.count() == 40 and joined.filter("x = 'n'").count() == 20


def test_heavy_points_in_kendall_tau(spark):
    """Products of weights beyond 2**53 stay exact."""
    import numpy as np

    weight = np.array([2**31 + 1, 2**31 + 3], dtype="int64")
    assert E._weighted_inversions(np.array([1, 0]), weight) == (2**31 + 1) * (2**31 + 3)


def test_skew_safe_join_equals_join(spark):
    big = spark.range(400).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 9).alias("k"), F.col("id").alias("v"))
    small = spark.range(9).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("x"))
    big = big.withColumn("k", F.col("k").cast("int"))
    want = {tuple(r) for r in big.join(small, "k").select("k", "v", "x").collect()}
    got = skew.skew_safe_join(big, small, "k", "v", rows_per_part=30).select("k", "v", "x").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_clean_text_and_tokens(spark):
    df = spark.createDataFrame([("a[1]-b,c.d\n\t e^f|g~h: it's\\ok",), ("",)], "text string")
    got = [r[0] for r in df.select(textx.clean_text("text")).collect()]
    assert got == ["a 1 b c d e f g h: it's\\ok", ""]
    assert [r[0] for r in df.select(textx.word_count("text")).collect()][1] == 0


def test_porter_examples(spark):
    # Examples printed with the published algorithm.
    known = dict(
        item.split(":")
        for item in (
            "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster bled:bled "
            "motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall "
            "hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit "
            "rational:ration valenci:valenc digitizer:digit vietnamization:vietnam operator:oper feudalism:feudal "
            "triplicate:triplic formative:form electrical:electr hopeful:hope goodness:good revival:reviv "
            "adjustment:adjust adoption:adopt homologous:homolog effective:effect probate:probat rate:rate cease:ceas "
            "controll:control roll:roll"
        ).split()
    )
    words = spark.createDataFrame([(w,) for w in known], "term string")
    assert {r["term"]: r["stem"] for r in T.stem_words(words).collect()} == known


def test_normal_cdf_and_digamma(spark):
    row = spark.range(1).select(
        mathx.norm_cdf(F.lit(1.96)).alias("c"), mathx.norm_cdf(F.lit(-1.96)).alias("d"), mathx.digamma(F.lit(0.5)).alias("e")
    ).first()
    assert abs(row["c"] - 0.9750021) < 1e-6 and abs(row["d"] - 0.0249979) < 1e-6
    assert abs(row["e"] + 1.9635100260214235) < 1e-8


def test_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    got = [tuple(r) for r in df.select(cosine_distance(F.col("a"), F.col("b")), l2_normalise(F.col("a"))).collect()]
    assert got[0] == (1.0, [0.0, 0.0])
    assert abs(got[1][0]) < 1e-12 and got[1][1] == [0.6, 0.8]


def test_constant_column_standardises_to_zero(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0), (3.0, 3.0)], "x double, y double")
    got = FE.standardise(df, ["x", "y"]).collect()
    assert [r["x"] for r in got] == [0.0, 0.0, 0.0]
    assert math.isclose(got[0]["y"], -math.sqrt(1.5))


def test_missing_features(spark):
    tasks = spark.createDataFrame([("t", "a"), ("t", "b")], "topic_id string, doc_id string")
    feats = spark.createDataFrame([("t", "a", [1.0, 2.0])], "topic_id string, doc_id string, v array<double>")
    zeros, dims = FE.attach_features(tasks, [("lexical", feats)], on_missing="zeros")
    assert {r["doc_id"]: r["features"] for r in zeros.collect()} == {"a": [1.0, 2.0], "b": [0.0, 0.0]}
    assert dims == {"rbf": [0, 1]}
    assert FE.attach_features(tasks, [("lexical", feats)], on_missing="drop")[0].count() == 1
    with pytest.raises(Exception, match="no lexical features"):
        FE.attach_features(tasks, [("lexical", feats)])[0].collect()


def test_topic_without_text_is_an_error(spark):
    topics = spark.createDataFrame([("1",), ("2",)], "topic_id string")
    texts = spark.createDataFrame([("1", "x")], "topic_id string, text string")
    with pytest.raises(Exception, match="no text for topic 2"):
        topic_texts(topics, texts).collect()
    assert topic_texts(topics, texts, "drop").count() == 1


def test_profile_filter_uses_unfiltered_statistics(spark):
    rows = [("a", 1, 1, 1), ("a", 2, 1, 0), ("b", 1, 0, 0), ("b", 2, 0, 0)]
    df = spark.createDataFrame(rows, "task_id string, worker_id int, gold int, label int")
    kept = P.profile_filter(df, task_acc=(0.5, 1.0), worker_acc=(0.5, 2.0))
    assert {(r["task_id"], r["worker_id"]) for r in kept.collect()} == {("a", 1), ("a", 2)}


def test_profile_with_split_keys(spark):
    rows = [(i % 4 if i < 60 else 9, i % 7, i % 2, (i * 3) % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "task_id int, worker_id int, gold int, label int")
    cols = ("task_id", "worker_id", "task_acc", "task_anno_num", "worker_acc", "worker_anno_num")
    whole = sorted(tuple(r) for r in P.with_profile(df).select(*cols).collect())
    split = sorted(tuple(r) for r in P.with_profile(df, rows_per_part=10).select(*cols).collect())
    assert whole == split and len(split) == 200


def test_folds(spark):
    topics = spark.createDataFrame([(str(i),) for i in range(7)], "topic_id string")
    fold = {r[0]: r[1] for r in A.topic_fold(topics, 1, 3).collect()}
    assert sorted(t for t, p in fold.items() if p == "train") == ["2", "3"]
    given = {r[0]: r[1] for r in A.topic_fold(topics, 0, 2, topic_order=["5", "3", "1", "0"]).collect()}
    assert given == {"5": "train", "3": "train", "1": "test", "0": "test"}
    with pytest.raises(ValueError):
        A.topic_fold(topics, 3, 3)


def test_readers(spark, tmp_path):
    (tmp_path / "j10").write_text("topic worker doc gold label\n1 w d1 2 0\n 1  w2 d2 -1 1\n\n")
    rows = readers.read_judgements_2010(spark, str(tmp_path / "j10")).collect()
    assert [(r["worker_id"], r["gold"], r["label"]) for r in rows] == [("w", 2, 0), ("w2", -1, 1)]
    (tmp_path / "wide").write_text("1 w d1 123456 1\n")
    assert readers.read_judgements_2010(spark, str(tmp_path / "wide")).first()["gold"] == 123456
    for n, line in enumerate(("1 w d1 2 high\n", "1 w d1 2\n")):
        (tmp_path / f"bad{n}").write_text(line)
        with pytest.raises(Exception, match="not an integer|fewer than 5 fields"):
            readers.read_judgements_2010(spark, str(tmp_path / f"bad{n}")).collect()
    (tmp_path / "j11").write_text("1 s1 w d1 2 0\n")
    assert readers.read_judgements_2011(spark, str(tmp_path / "j11")).first()["assignment_id"] == "s1"
    corpus = tmp_path / "corpus" / "x"
    os.makedirs(corpus)
    (corpus / "d1.txt").write_text("one\ntwo")
    (corpus / ".hidden").write_text("no")
    assert [tuple(r) for r in readers.read_corpus(spark, str(tmp_path / "corpus")).collect()] == [("d1", "one\ntwo")]
    (tmp_path / "topics").write_bytes("7:x:caf\xe9 bar\n".encode("latin-1"))
    assert tuple(readers.read_topics(spark, str(tmp_path / "topics")).first()) == ("7", "caf\xe9 bar")
    (tmp_path / "tagged").write_text(
        "<top>\n<num> Number: 1\n<title> red fox\n<desc> Description:\nabout foxes\n</top>\n"
        "<num> Number: 2\n<title> owl\n<desc>\nnight bird\n"
    )
    got = {tuple(r) for r in readers.read_tagged_topics(spark, str(tmp_path / "tagged")).collect()}
    assert got == {("1", "red fox about foxes"), ("2", "owl night bird")}
    (tmp_path / "runA").write_text("1 Q0 d1 1 0.5 t\n1 Q0 d2 2 10.0 t\n")
    runs = readers.read_runs(spark, str(tmp_path / "runA"))
    ranked = {r["doc_id"]: (r["run"], r["rank"]) for r in R.rerank_runs(runs).collect()}
    assert ranked == {"d2": ("runA", 1), "d1": ("runA", 2)}
    (tmp_path / "v.json").write_text('{"qid": " 1 ", "did": "d", "pooled_vector": [0.5, 1]}\n')
    assert tuple(readers.read_vectors(spark, str(tmp_path / "v.json")).first()) == ("1", "d", [0.5, 1.0])


def test_result_files(spark, tmp_path):
    from tallyfold.models.workers import one_coin

    ann = spark.createDataFrame(
        [(t, w, int(t in "ab")) for t in "abcd" for w in (1, 2)], "task_id string, worker_id int, label int"
    )
    gold = spark.createDataFrame([(t, int(t in "ab")) for t in "abcd"], "task_id string, gold int")
    fit = one_coin(ann, rounds=1, threshold=None, gold=gold, logging_freq=1)
    writers.write_results(fit, gold, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "eval")).first()["acc"] == 1.0
    assert spark.read.json(str(tmp_path / "out" / "trace")).filter("metric = 'acc'").count() >= 1
    assert len(spark.read.csv(str(tmp_path / "out" / "pred_labels")).collect()) == 4


def test_matrix_round_trip(spark):
    ann = spark.createDataFrame([("a", 1, 1), ("a", 2, 0), ("b", 2, 1)], "task_id string, worker_id int, label int")
    back = A.matrix_to_triples(A.crowd_matrix(ann))
    assert {tuple(r) for r in back.collect()} == {("a", "1", 1), ("a", "2", 0), ("b", "2", 1)}


class _Session:
    """As much of a session as the folder rule reads."""

    def __init__(self, master, folder=None):
        self.conf = self
        self.sparkContext = self
        self.master, self.folder = master, folder

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" else default

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return None


def test_scratch_uses_the_configured_folder():
    from tallyfold.session import shared_dir

    assert shared_dir(_Session("spark://host:1", "hdfs://x/shared/")) == "hdfs://x/shared"
    for master in ("spark://host:1", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(_Session(master))


def test_feature_sets_of_uneven_width_are_an_error(spark):
    tasks = spark.createDataFrame([("t", "d")], "topic_id string, doc_id string")
    ragged = spark.createDataFrame(
        [("t", "d", [1.0, 2.0]), ("t", "e", [1.0])], "topic_id string, doc_id string, v array<double>"
    )
    with pytest.raises(ValueError, match="1 to 2 values"):
        FE.attach_features(tasks, [("lexical", ragged)])


def test_feature_map_limit_holds_for_linear_layouts(spark):
    from tallyfold.models.probit import feature_map

    rows = spark.createDataFrame([("a", [0.0])], "task_id string, features array<double>")
    with pytest.raises(ValueError, match="the limit is 512"):
        feature_map(rows, {"linear": list(range(2000))})


def test_judgements_2010_skip_only_the_header(spark, tmp_path):
    (tmp_path / "named").write_text("topicID\tworkerID\tdocID\tgold\tlabel\n1 w d1 2 0\n")
    assert readers.read_judgements_2010(spark, str(tmp_path / "named")).count() == 1
    for n, line in enumerate(("20002 w7 doc3 NA NA", "1 w d1 ? ?")):
        (tmp_path / f"odd{n}").write_text(f"topicID workerID docID gold label\n1 w d1 2 0\n{line}\n")
        with pytest.raises(Exception, match="not an integer"):
            readers.read_judgements_2010(spark, str(tmp_path / f"odd{n}")).collect()


def test_strata_keep_tasks_and_workers_of_any_size(spark):
    rows = spark.range(100_001).select(
        F.lit("t").alias("task_id"), F.col("id").alias("worker_id"), F.lit(1).alias("gold"), F.lit(1).alias("label")
    )
    for df in (rows, rows.select(F.col("worker_id").alias("task_id"), F.lit("w").alias("worker_id"), "gold", "label")):
        out = P.count_strata(df).groupBy("t", "a").count().collect()
        assert [r["count"] for r in out] == [100_001] and {out[0]["t"], out[0]["a"]} == {0, 1}
    assert P.count_strata(rows, task_edges=(0, 5, 1e5)).count() == 0
