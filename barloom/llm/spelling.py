"""Groups of spelling variants: words one edit apart, and the common form each one leads to.

Two words one inserted, deleted or replaced code point apart agree outside a short window of the
shorter one. So for a length ``m`` and each window of ``m`` positions, words of ``m`` or ``m + 1`` code
points are keyed by what lies before and after the window; a pair that is one edit apart shares the
key of the window with the edit. Words of one key are cut into blocks; pairs of blocks are compared
as padded code-point matrices, and the lengths of common prefix and suffix that reach the longer
length minus one mark a single edit. Words of a key differ within the window only, so that keys stay
small however many words there are; crowded ones are spread over cells of two blocks. A cell tells
counts and the best form per word, never pairs.

Defined cases: null and empty texts hold no words; a null id counts as an empty one in the hash;
words of any length (windows grow with it); repeated rows count each; no words: no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import bounds, groups, small_batches, text_of
from barloom.llm.jaccard import in_cells
from barloom.session import durable

#: Runs of letters in UTF-8: A-Z, a-z and U+00C0 to U+00FF (fixed values).
RUN = re.compile(rb"(?:[A-Za-z]+|(?:\xC3[\x80-\xBF])+)+")
#: A run loses a code point where this divides its hash (fixed value).
LOSES = 97
#: Positions of a window; an eighth of the word, where that is more.
WINDOW = 3
#: Words of a block.
BLOCK = 256
#: Distinct words that a task holds before it passes their counts on.
HELD = 200_000
#: Cells of one comparison of code points.
CELLS = 1 << 22


def altered(word: bytes, seed: int) -> bytes:
    """A run as it counts: without one of its code points where the hash says so."""
    h = crc32(word, seed)
    if h % LOSES:
        return word
    s = word.decode()
    at = h % len(s)
    return (s[:at] + s[at + 1 :]).encode()


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n`` of all lower-cased (A-Z only), altered runs of letters."""

    def run(batches):
        counts: Counter[bytes] = Counter()

        def told():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                names=["_w", "_n"],
            )

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                seed = crc32(b"" if i is None else b"%d" % i)
                seed = crc32(b":", seed)
                words = RUN.findall(x.as_py().lower())
                counts.update(words)
                hashes = np.fromiter((crc32(w, seed) for w in words), dtype=np.int64, count=len(words))
                for at in np.flatnonzero(hashes % LOSES == 0):
                    counts[words[at]] -= 1
                    counts[altered(words[at], seed)] += 1
                if len(counts) > HELD:
                    yield told()
                    counts.clear()
        if counts:
            yield told()

    source = docs.select(F.col(key).cast("bigint"), text_of(text).cast("binary"))
    return (
        source.mapInArrow(run, "_w binary, _n bigint")
        .groupBy("_w")
        .agg(F.sum("_n").alias("n"))
        .where("n > 0")
        .select(F.col("_w").cast("string").alias("word"), "n")
    )


def _keys(window: int) -> Column:
    """Array of ``(m, j, key)`` of a word, one for each window of each length ``m`` it can pair at."""
    word, size = F.col("word"), F.length("word")

    def of_length(m: Column) -> Column:
        width = F.greatest(F.lit(window), F.ceil(m / 8).cast("int"))

        def of_window(j: Column) -> Column:
            after = F.greatest(m - (j + 1) * width, F.lit(0))
            before = F.substring(word, F.lit(1), j * width)
            key = F.xxhash64(m, j, before, F.substring(word, size - after + 1, after))
            return F.struct(m.alias("m"), j.alias("j"), key.alias("key"))

        return F.transform(F.sequence(F.lit(0), F.ceil(m / width).cast("int") - 1), of_window)

    return F.flatten(F.transform(F.array(size, size - 1), of_length))


def _pairs(at: np.ndarray, stop: np.ndarray, same: np.ndarray, block: np.ndarray):
    """Row numbers of all pairs of every cell, cells of one size and kind at a time."""
    size = stop - at
    for g in np.unique(size[same]):
        if g > 1:
            i, j = np.triu_indices(int(g), 1)
            first = at[same & (size == g)]
            per = max(1, CELLS // (64 * len(i)))
            for k in range(0, len(first), per):
                f = first[k : k + per, None]
                yield (f + i).ravel(), (f + j).ravel()
    for a, b in zip(at[~same], stop[~same]):
        one = block[a:b] == block[a]
        left, right = a + np.flatnonzero(one), a + np.flatnonzero(~one)
        if len(right):
            yield np.repeat(left, len(right)), np.tile(right, len(left))


def single_edits(
    codes: np.ndarray, ends: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows are one edit apart, and the length of their common prefix. ``codes`` are
    padded on the right, ``ends`` hold the same words from their last code point backwards."""
    width = codes.shape[1]
    differ = codes[i] != codes[j]
    head = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    head = np.minimum(head, np.minimum(size[i], size[j]))
    differ = ends[i] != ends[j]
    tail = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    tail = np.minimum(tail, np.minimum(size[i], size[j]))
    longer = np.maximum(size[i], size[j])
    equal = (head == longer) & (size[i] == size[j])
    return (head + tail >= longer - 1) & (abs(size[i] - size[j]) <= 1) & ~equal, head


def _tiles(batches, window: int):
    """Near words of every word of a cell: how many, and the best (largest count, then least word)."""
    for t in groups(batches, "_cell"):
        t = t.combine_chunks()
        held = t.column("word").to_pylist()
        size = np.array([len(w) for w in held])
        n, m = t.column("n").to_numpy(), t.column("m").to_numpy()
        window_no, same = t.column("j").to_numpy(), t.column("_same").to_numpy()
        block = t.column("_block").to_numpy()
        edge = bounds(t.column("_cell").to_numpy())
        found_i, found_j = [], []
        order = np.argsort(m[edge[:-1]], kind="stable")  # words of like lengths share a matrix
        lo = 0
        while lo < len(order):
            wide = int(m[edge[order[lo]]]) + 1
            hi, rows = lo, 0
            while hi < len(order):
                c = order[hi]
                wide = max(wide, int(m[edge[c]]) + 1)
                rows += int(edge[c + 1] - edge[c])
                if hi > lo and rows * wide > CELLS:
                    break
                hi += 1
            cells = order[lo:hi]
            lo = hi
            at = np.concatenate([np.arange(edge[c], edge[c + 1]) for c in cells])
            sizes = edge[cells + 1] - edge[cells]
            start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            local = size[at]
            width = int(local.max())
            codes = np.array([held[k] for k in at], dtype=f"U{width}").view(np.uint32).reshape(len(at), width)
            ends = np.array([held[k][::-1] for k in at], dtype=f"U{width}").view(np.uint32).reshape(len(at), width)
            for i, j in _pairs(start, start + sizes, same[edge[cells]], block[at]):
                step = max(1, CELLS // width)
                for k in range(0, len(i), step):
                    a, b = i[k : k + step], j[k : k + step]
                    of = m[at[a]]
                    use = np.minimum(local[a], local[b]) == of  # longer pairs meet at their own length
                    a, b, of = a[use], b[use], of[use]
                    near, head = single_edits(codes, ends, local, a, b)
                    w = np.maximum(window, -(-of // 8))
                    last = -(-of // w) - 1
                    near &= np.minimum(head // w, last) == window_no[at[a]]  # one of its keys tells a pair
                    found_i += [at[a[near]], at[b[near]]]
                    found_j += [at[b[near]], at[a[near]]]
        if not found_i or not sum(map(len, found_i)):
            continue
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        named = np.unique(j)
        rank = np.empty(len(named), dtype=np.int64)
        rank[sorted(range(len(named)), key=lambda k: held[named[k]])] = np.arange(len(named))
        best = np.lexsort((rank[np.searchsorted(named, j)], -n[j], i))
        i, j = i[best], j[best]
        first = bounds(i)
        told = i[first[:-1]]
        top = j[first[:-1]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([held[k] for k in told], pa.string()),
                pa.array(np.diff(first), pa.int64()),
                pa.array([held[k] for k in top], pa.string()),
                pa.array(n[top], pa.int64()),
            ],
            names=["word", "near", "form", "form_n"],
        )


def near_words(
    words: DataFrame, *, shortest: int = 1, window: int = WINDOW, block: int = BLOCK
) -> DataFrame:
    """``word``, ``n_near`` and the near word of largest count (``form``, ``form_n``; ties: the least) for
    every word that has near ones. ``words`` are distinct, with ``word`` and ``n``, and have ``shortest``
    code points or more."""
    keyed = words.select("word", "n", F.explode(_keys(window)).alias("_k"))
    keyed = keyed.select("word", "n", "_k.m", "_k.j", "_k.key").where(F.col("m") >= max(shortest, 1))
    shared = (
        keyed.groupBy("key")
        .agg(F.count("*").alias("_c"), F.count_if(F.length("word") == F.col("m")).alias("_short"))
        .where("_c > 1 AND _short > 0")
        .drop("_short")
    )
    cells = in_cells(keyed.join(shared, "key"), "key", "word", "_c", block)
    told = (
        cells.select("_cell", "_block", "_same", "word", "n", "m", "j")
        .repartition("_cell")
        .sortWithinPartitions("_cell")
        .mapInArrow(lambda it: _tiles(it, window), "word string, near bigint, form string, form_n bigint")
    )
    return (
        told.groupBy("word")
        .agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("c"), "form")).alias("_b"))
        .select("word", "n_near", F.col("_b.form").alias("form"), (-F.col("_b.c")).alias("form_n"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and the last form that follows from it. Counts at least double on the way, so the
    reach, doubled in each round, is at the end after a few."""
    known = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = durable(
            known.join(ahead, "root", "left").select(
                "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_on")
            )
        )
        known = step.select("word", "root")
        if step.where("_on").isEmpty():
            return known


def variants(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    least: int = 3,
    shortest: int = 5,
    factor: int = 2,
    window: int = WINDOW,
    block: int = BLOCK,
) -> DataFrame:
    """One row per word of at least ``shortest`` code points and ``least`` occurrences: ``word``,
    ``form`` (its near word of largest count, where that is at least ``factor`` times its own), ``root``,
    ``n``, ``n_near``, ``form_n``."""
    small_batches(docs.sparkSession)
    words = durable(word_counts(docs, key, text).where((F.col("n") >= least) & (F.length("word") >= shortest)))
    near = durable(near_words(words, shortest=shortest, window=window, block=block))
    all_words = words.join(near, "word", "left").withColumn("_ok", F.col("form_n") >= factor * F.col("n"))
    all_words = durable(
        all_words.select(
            "word",
            F.when(F.col("_ok"), F.col("form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(F.col("_ok"), F.col("form_n")).alias("form_n"),
        )
    )
    last = roots(all_words.where("form IS NOT NULL"))
    return all_words.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
