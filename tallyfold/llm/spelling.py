"""Spelling variants by neighbourhoods over a reduced alphabet.

1. Words and their counts.  A task counts its own words first, so a frequent word travels once per task.
2. Every letter is hashed to one of a few symbols (as many as keep words of the least length apart: ``symbols``).
   Of each reduced word all keys at one edit are generated: the word itself, each symbol left out, replaced or
   put in.  A bitmap of the reduced vocabulary, of bounded size, drops keys that no word has before the shuffle.
3. Keys join the reduced vocabulary.  One edit of a word is at most one edit of its reduced form, so every near
   pair meets; two words meet once, since a word asks for each key once and has one reduced form itself.  The join
   condition verifies the original strings: at distance one exactly.  A reduced form shared by many words is cut
   into parts by a hash of the word, and those that ask for it are repeated per part.
4. The form of a word is its most frequent near word if that is frequent enough; roots follow forms by pointer
   doubling, at most log2 of the longest chain of joins (a form is at least ten times as frequent as the word).

Null text has no words, a null id is written as an empty text in the slip rule; repeated rows count again; an
empty table gives an empty result.  Whole texts are read; ties between near words go to the smallest in
code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.rows import column
from tallyfold.llm.screens import counters, table_size
from tallyfold.llm.tokens import U64, mix
from tallyfold.operators import skew
from tallyfold.session import Scratch, shuffle_partitions

WORD = "[A-Za-zÀ-ÿ]"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FLUSH = 200_000
BASE = U64(0x9E3779B97F4A7C15 | 1)
CELLS = 1 << 21
Slip = Callable[[str, str], str]


def drop_letter(every: int) -> Slip:
    """Words whose crc32 of ``<id>:<word>`` is divisible by ``every`` lose the letter at crc32 modulo their length."""

    def slip(doc: str, word: str) -> str:
        h = zlib.crc32(f"{doc}:{word}".encode())
        if h % every:
            return word
        i = h % len(word)
        return word[:i] + word[i + 1 :]

    return slip


def word_counts(docs: DataFrame, id_col: str, text_col: str, least: int, slip: Slip | None = None) -> DataFrame:
    """``(word, n)`` of all runs of letters of at least ``least`` code points, after ``slip``."""
    # a run keeps at least its length less one
    pattern = re.compile(WORD + "{" + str(least) + ",}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out():
            words = pa.array(list(total), pa.string())
            batch = pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                found = Counter(pattern.findall((text.as_py() or "").translate(LOWER)))
                if slip is None:
                    total.update(found)
                else:
                    doc = doc.as_py() or ""
                    for word, n in found.items():
                        word = slip(doc, word)
                        if len(word) >= least:
                            total[word] += n
                if len(total) > FLUSH:
                    yield out()
        if total:
            yield out()

    src = docs.select(column(id_col).cast("string").alias("d"), column(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def alphabet(words: int, least: int) -> int:
    """Symbols that give words of the least length about as many reduced forms as there are words."""
    size = 4
    while size < 64 and size**least < words:
        size *= 2
    return size


def reduced(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For words of each length: their numbers, and their symbols (1 ..) as rows."""
    length = np.array([len(w) for w in words], np.int64)
    for n in np.unique(length):
        step = max(1, CELLS // (2 * (symbols + 1) * max(1, int(n))))
        at = np.flatnonzero(length == n)
        for a in range(0, len(at), step):
            some = at[a : a + step]
            points = np.frombuffer("".join(words[i] for i in some).encode("utf-32-le"), np.uint32).reshape(-1, int(n))
            yield some, mix(points.astype(U64) + U64(1)) % U64(symbols) + U64(1)


def _key(total: np.ndarray, n: int) -> np.ndarray:
    return mix(total + U64(n * 0xD1342543DE82EF95 % (1 << 64)))


def _weights(n: int) -> np.ndarray:
    out = np.full(n, BASE)
    out[:1] = 1
    return np.cumprod(out, dtype=U64)


def keys(sym: np.ndarray) -> np.ndarray:
    """One key per reduced word."""
    n = sym.shape[1]
    return _key((sym * _weights(n)).sum(1, dtype=U64), n)


def neighbour_keys(sym: np.ndarray, symbols: int) -> np.ndarray:
    """All keys at no more than one edit of each reduced word; a key may repeat in a row."""
    count, n = sym.shape
    w = _weights(n + 1)
    pre = np.zeros((count, n + 1), U64)
    np.cumsum(sym * w[:n], axis=1, out=pre[:, 1:])
    whole = pre[:, -1:]
    inverse = U64(pow(int(BASE), -1, 1 << 64))
    after = whole - pre  # symbols from place i on, at their own places
    gone = pre[:, :-1] + after[:, 1:] * inverse
    out = [_key(whole, n), _key(gone, n - 1)]
    for s in range(1, symbols + 1):
        out.append(_key(whole + (U64(s) - sym) * w[:n], n))
        out.append(_key(pre + U64(s) * w + after * BASE, n + 1))
    return np.concatenate(out, axis=1)


def _one_edit(vocabulary: DataFrame, symbols: int, scratch: Scratch, rows_per_part: int, bits: int | None) -> DataFrame:
    """``(word, near, near_n)``: all ordered pairs of words at distance one."""
    n_words = vocabulary.count()

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            key = np.zeros(len(words), U64)
            for at, sym in reduced(words, symbols):
                key[at] = keys(sym)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64))], names=["word", "n", "key"])

    coded = scratch.cut(vocabulary.select("word", "n").mapInArrow(code, "word string, n long, key long"), "reduced")
    size = bits or table_size(16 * n_words)

    def places(key: np.ndarray) -> np.ndarray:
        return (key & U64(size - 1)).astype(np.int64)

    filled = counters(
        coded.select("key"), lambda batch: places(batch.column(0).to_numpy(zero_copy_only=False).view(U64)), size, top=1
    )
    shared = vocabulary.sparkSession.sparkContext.broadcast(np.packbits(filled))

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            words = batch.column(0).to_pylist()
            for at, sym in reduced(words, symbols):
                key = neighbour_keys(sym, symbols)
                p = places(key)
                who, what = np.nonzero(bitmap[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1)
                found = key[who, what]
                order = np.lexsort((found, who))
                who, found = who[order], found[order]
                new = np.ones(len(who), bool)
                new[1:] = (who[1:] != who[:-1]) | (found[1:] != found[:-1])
                column_ = pa.array(words, pa.string()).take(pa.array(at[who[new]]))
                yield pa.RecordBatch.from_arrays([column_, pa.array(found[new].view(np.int64))], names=["word", "key"])

    asked = coded.select("word").mapInArrow(ask, "word string, key long")
    crowded = scratch.cut(skew.hot_keys(coded, "key", rows_per_part), "crowded")
    there = skew.spread(coded, "key", "word", crowded, "part").select("key", "part", F.col("word").alias("near"), F.col("n").alias("near_n"))
    here = skew.repeat(asked, "key", crowded, "part")
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.part") == F.col("b.part"))
    near = F.levenshtein("word", "near", 1) == 1
    return here.alias("a").join(there.alias("b"), same & near).select("word", "near", "near_n")


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = 7,
    least_count: int = 2,
    ratio: int = 10,
    slip: Slip | None = None,
    symbols: int | None = None,
    rows_per_part: int = 2000,
    bits: int | None = None,
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of the vocabulary.

    ``symbols`` is the size of the reduced alphabet and ``bits`` that of the bitmap, by default from the vocabulary.
    """
    scratch = Scratch(docs.sparkSession)
    counts = word_counts(docs, id_col, text_col, least_length, slip)
    vocabulary = scratch.cut(counts.filter(F.col("n") >= least_count), "vocabulary")
    symbols = symbols or alphabet(vocabulary.count(), least_length)
    near = _one_edit(vocabulary, symbols, scratch, rows_per_part, bits)
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("best")
    forms = scratch.cut(
        vocabulary.join(near.groupBy("word").agg(F.count("*").alias("n_near"), best), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(-F.col("best.m") >= F.col("n") * ratio, F.struct(F.col("best.near").alias("w"), (-F.col("best.m")).alias("n"))).alias("form"),
        ),
        "forms",
    )
    roots = _roots(forms.filter("form IS NOT NULL").select("word", F.col("form.w").alias("up")), scratch)
    return forms.join(roots, "word", "left").select(
        "word", F.col("form.w").alias("form"), F.coalesce("up", "word").alias("root"), "n", "n_near", F.col("form.n").alias("form_n")
    )


def _roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """The end of the chain of each word that has a form: ``up`` of ``up`` until nothing moves."""
    cur = scratch.cut(links, "links")
    while True:
        after = cur.select(F.col("word").alias("up"), F.col("up").alias("next"))
        moved = scratch.cut(cur.join(after, "up", "left").select("word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "links")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "up")
        scratch.drop(cur)
        cur = moved.select("word", "up")
