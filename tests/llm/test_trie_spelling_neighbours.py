"""Conversation trie, spelling variants and nearest neighbours against brute force on small, awkward tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import differences, duck
from tallyfold.llm import blockjoin, convtrie, spelling
from tallyfold.session import Scratch

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_spelling_variants", "op13_nearest_vectors"])
def test_query_matches_sql(spark, name):
    assert differences(spark, duck(SF), entry.queries()[name], entry.oracle_sql()[name], SF) is None


# ---- conversation trie


def ordered_turns(rows):
    """(role, text) lists by conversation, in the order the operator defines."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in by.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute_trie(convs):
    nodes = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = collections.defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)

    def total(p):
        words = len([w for w in re.split(r"[\x20\x09-\x0D]+", p[-1][1]) if w]) if p else 0
        leaves, saved = (0, 0) if kids[p] else (1, 0)
        saved += (len(nodes[p]) - 1) * words
        for k in kids[p]:
            a, b = total(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = set()
    for p, members in nodes.items():
        leaves, saved = total(p)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(p))
        up = min(nodes[p[:-1]]) if p else None
        out.add((min(members), len(p), up, len(members), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversation_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-25, 60), 1000, 1001, 1020, 10**12]:
        n = rng.choice([0, 1, 1, 2, 3, 5, 12])
        for t in range(n):
            rows.append((c, t if t else rng.choice([0, None]), rng.choice(["user", None, ""]), rng.choice(["hi there", "hi  there", "", None, "a b\tc d"])))
    for c in range(2000, 2040):  # copies, some of them cut short
        rows += [(c, t, "user", f"same turn {t}") for t in range(9 if c % 3 else 4)]
    return rows + [(None, 1, "user", "nobody")]


def trie(spark, rows, sketch=None, run=convtrie.RUN, id_range=convtrie.ID_RANGE):
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    df = df.withColumns({"depth": F.lit("x"), "k1": F.lit("x"), "pos": F.lit("x"), "len": F.lit("x")}).repartition(3)
    scratch = Scratch(spark)
    c = F.col("conv_id")
    turns, convs = convtrie.rebuild(scratch.cut(convtrie.turn_digests(df)), F.crc32(c.cast("string")) % 4, c - c % 20, scratch, most=3)
    return [tuple(r) for r in convtrie.prefix_trie(turns, convs, scratch, sketch, run, id_range).collect()]


@pytest.mark.parametrize(("sketch", "run", "id_range"), [(None, 1024, 8192), (2, 2, 3), (64, 3, 1), (1024, 5, 7)])
def test_trie_matches_brute_force(spark, sketch, run, id_range):
    rows = conversation_rows(7)
    got = trie(spark, rows, sketch, run, id_range)
    want = brute_trie(rebuilt(ordered_turns(rows)))
    assert len(got) == len(want)
    assert set(got) == want


def test_trie_of_long_conversation_repeated_rows_and_nothing(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "u", "x")]) == []
    long = [(5, t, "user", f"turn {t % 50}") for t in range(3000)] + [(7, t, "user", f"turn {t % 50}") for t in range(2500)]
    twice = [(9, 1, "u", "x y"), (9, 1, "u", "x y")]
    got = trie(spark, long + twice)
    convs = rebuilt(ordered_turns(long + twice))
    common = next(i for i, (a, b) in enumerate(zip(convs[5] + [None], convs[7] + [None])) if a != b)
    assert len(got) == 1 + len(convs[9]) + len(convs[5]) + len(convs[7]) - common
    root = [r for r in got if r[1] == 0]
    assert len(root) == 1 and root[0][:4] == (5, 0, None, 3)


# ---- spelling variants


def brute_words(rows, slip):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in run)
            if slip:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                if h % slip == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if c >= 2 and len(w) >= 7}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, slip):
    vocab = brute_words(rows, slip)
    form, out = {}, set()
    near = {w: [v for v in vocab if one_edit(w, v)] for w in vocab}
    for w, vs in near.items():
        if vs:
            best = min(vs, key=lambda v: (-vocab[v], v))
            if vocab[best] >= 10 * vocab[w]:
                form[w] = best
    for w in vocab:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, vocab[w], len(near[w]), vocab[form[w]] if w in form else None))
    return out


def spelling_rows():
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (None, "Straßenbahn straßenbahn ×÷Àÿéèê!"), (3, "ab1cdefgh-ijklmno Łódź")]
    base = ["".join(rng.choice("abeéß") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    for i in range(300):
        words = []
        for _ in range(30):
            w = rng.choice(base[: rng.choice([2, 8, 60])])
            if rng.random() < 0.3:
                p = rng.randrange(len(w))
                w = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("abx") + w[p + 1 :], w[:p] + "b" + w[p:]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i // 2, " ".join(words)))
    rows += [(5, "aaaaaaaaaaaaaaaaaaaa" * 400 + " " + "b" * 7 + ("," + "b" * 8) * 90)] * 2
    rows += [(7, "qqqqqqqa " * 2 + "qqqqqqqb " * 25), (8, "qqqqqqbb " * 300)]  # a chain of forms
    return rows + [(6, "zzzzzzz zzzzzzy " + "zzzzzzzz " * 20 + "zzzzzzz")]


@pytest.mark.parametrize(("slip", "symbols", "rows_per_part", "bits"), [(None, 4, 2000, None), (5, 1, 10, 1 << 16), (31, None, 3, 64), (5, 64, 2000, None)])
def test_variants_match_brute_force(spark, slip, symbols, rows_per_part, bits):
    rows = spelling_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("x"), "key": F.lit(1), "n": F.lit(1)}).repartition(4)
    rule = spelling.drop_letter(slip) if slip else None
    got = [tuple(r) for r in spelling.spelling_variants(df, slip=rule, symbols=symbols, rows_per_part=rows_per_part, bits=bits).collect()]
    want = brute_variants(rows, slip)
    assert len(got) == len(want) > 100
    assert set(got) == want
    assert slip or any(r[:3] == ("qqqqqqqa", "qqqqqqqb", "qqqqqqbb") for r in got)


def test_variants_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(empty).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (2, "short words")], "doc_id long, text string")).collect() == []


# ---- nearest neighbours


def brute_nearest(rows, k):
    good = [
        (r, i, v) for r, (i, v) in enumerate(rows)
        if v and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)
    ]
    out = []
    for r, i, v in good:
        if i is None or i % 20:
            continue
        scores = []
        for s, j, u in good:
            if s != r and len(u) == len(v):
                total = 0.0
                for x, y in zip(v, u):
                    total += x * y
                scores.append((-total, -math.inf if j is None else j, s, j))
        out += [(i, n + 1, j, -t) for n, (t, _, _, j) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def vector_rows():
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.25, -1.0, 2.0, 0.0, 1.0]) for i in range(200)]  # copies: ties everywhere
    rows += [(2000, None), (2020, []), (2040, [0.0] * 6), (2060, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2080, [float("nan")] + [1.0] * 5)]
    rows += [(2100, [float("inf")] + [1.0] * 5), (2120, [1.0, 2.0]), (2121, [3.0, 4.0]), (2140, [1e300, 1.0]), (2141, [1e-300, 1e-310])]
    rows += [(None, [1.0] * 6), (None, [9.0] * 6), (2160, [1e-5, 1e5, 0.0, 1.0, -1e-3, 2.0]), (20, [1.0, -1.0] * 3), (20, [1.0, -1.0] * 3)]
    return rows


@pytest.mark.parametrize(("k", "panel", "columns"), [(20, 4096, None), (3, 5, 2), (1000, 7, 3), (1, 1, 1)])
def test_nearest_match_brute_force(spark, k, panel, columns):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).withColumns({"r": F.lit("x"), "tile": F.lit(1), "score": F.lit(1)})
    got = blockjoin.nearest(df, F.col("vec_id") % 20 == 0, k, panel=panel, columns=columns)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute_nearest(rows, k)


def test_nearest_in_float_vectors_and_empty_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert blockjoin.nearest(empty, F.col("vec_id") % 20 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.5, 2.5])], "vec_id long, embedding array<float>")
    assert blockjoin.nearest(one, F.col("vec_id") % 20 == 0).collect() == []
    wide = [(i, [((i * 31 + j * j * 17) % 101 - 50) / 7.0 for j in range(2500)]) for i in range(60)]
    got = blockjoin.nearest(spark.createDataFrame(wide, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 5)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute_nearest(wide, 5)
