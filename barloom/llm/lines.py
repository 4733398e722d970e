"""Removal of line runs that repeat earlier text, found by winnowing over line hashes.

Lines are hashed. A window is a shortest stretch of lines with at least ``min_words`` words, one
counted forward from each line and one counted back from each line. The least line hash of a window
is its fingerprint, so two texts that share a run of that size share the fingerprint of every window
in it. Occurrences are joined on the fingerprint and the hash of the whole window; all but the first
occurrence in the corpus (by document id, then position) are repeats, and windows that touch or
overlap are merged, which extends a match both ways to the whole run. Each repeated run is removed;
its first occurrence stays.

Counting combines on the map side, and a window's first occurrence is one row, so a line that a third
of all documents hold costs one joined row per occurrence; no pair of occurrences is ever formed.

Defined cases: a null text counts as empty; empty lines alone are no run; rows that repeat both id
and text count as one document; a null id comes after all others; runs with fewer than ``min_words``
words stay; a text that repeats itself keeps its first copy. Other columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import in_slices, let_go, mix64, small_batches, text_of

MIN_WORDS = 5
_BASE = 0x9E3779B97F4A7C15 | 1


def windows_of(text: str, min_words: int) -> tuple[np.ndarray, ...]:
    """Start, end, fingerprint and content hash of every window of a text."""
    lines = text.split("\n")
    n = len(lines)
    h = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in lines), dtype=np.uint64, count=n)
    words = np.fromiter((len(x.split()) for x in lines), dtype=np.int64, count=n)
    upto = np.concatenate(([0], np.cumsum(words)))
    empty = np.zeros(0, dtype=np.int64)
    if upto[-1] < min_words:
        return empty, empty, empty, empty
    starts = np.arange(n)
    ends = np.searchsorted(upto, upto[:-1] + min_words, side="left")
    ok = ends <= n
    starts, ends = starts[ok], ends[ok]
    backs = np.arange(1, n + 1)
    froms = np.searchsorted(upto, upto[1:] - min_words, side="right") - 1
    ok = froms >= 0
    froms, backs = froms[ok], backs[ok]
    key = np.unique(np.concatenate((starts * (n + 1) + ends, froms * (n + 1) + backs)))
    s, e = key // (n + 1), key % (n + 1)
    # Content: polynomial of the line hashes, differences of prefix sums (arithmetic mod 2^64).
    power = np.ones(n + 1, dtype=np.uint64)
    power[1:] = np.cumprod(np.full(n, _BASE, dtype=np.uint64))
    back = np.cumsum((mix64(h) * power[n - 1 :: -1])[::-1])[::-1]  # sum of h[i] * B^(n-1-i), i >= k
    back = np.concatenate((back, np.zeros(1, dtype=np.uint64)))
    span = back[s] - back[e]
    content = mix64(span * _inverse_powers(n)[e] + (e - s).astype(np.uint64))
    ranked = np.where(words > 0, mix64(h), np.uint64(0xFFFFFFFFFFFFFFFF))
    low = range_minima(ranked, s, e)
    return s, e, low.view(np.int64), content.view(np.int64)


def range_minima(values: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Least of ``values[s:e]`` for many spans: two overlapping stretches of a power of two each."""
    level = np.frexp((e - s).astype(np.float64))[1] - 1
    out = np.empty(len(s), dtype=values.dtype)
    row = values
    for k in range(int(level.max()) + 1):
        if k:
            row = np.minimum(row[: -(1 << (k - 1))], row[1 << (k - 1) :])
        m = level == k
        out[m] = np.minimum(row[s[m]], row[e[m] - (1 << k)])
    return out


def _inverse_powers(n: int) -> np.ndarray:
    """Powers that shift a span ending at e to exponent zero: B^-(n-e)."""
    inverse = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    out = np.ones(n + 1, dtype=np.uint64)
    out[1:] = np.cumprod(inverse)
    return out[::-1]


def winnow(docs: DataFrame, text: str, key: str, min_words: int) -> DataFrame:
    """All windows: document, whether its id is null, text hash, start, end, fingerprint, content."""

    def run(batches):
        let_go()
        for b in batches:
            ids, digest = b.column("_d"), b.column("_h").to_numpy(zero_copy_only=False)
            rows, cols = [], ([], [], [], [])
            for i, t in enumerate(b.column("_t").to_pylist()):
                found = windows_of(t, min_words)
                if len(found[0]):
                    rows.append(np.full(len(found[0]), i))
                    for c, v in zip(cols, found):
                        c.append(v)
            if not rows:
                continue
            at = np.concatenate(rows)
            s, e, low, content = (np.concatenate(c) for c in cols)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(at)),
                    pa.array(digest[at]),
                    pa.array(s.astype(np.int32)),
                    pa.array(e.astype(np.int32)),
                    pa.array(low),
                    pa.array(content),
                ],
                names=["_d", "_h", "_s", "_e", "_f", "_c"],
            )

    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("_d"), digest_of(text).alias("_h"), text_of(text).alias("_t"))
    return source.mapInArrow(run, f"_d {kind}, _h bigint, _s int, _e int, _f bigint, _c bigint")


def digest_of(text: str) -> Column:
    return F.xxhash64(text_of(text))


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """Windows that are not the first of their content: document, text hash, start, end."""
    found = winnow(docs, text, key, min_words)
    place = F.struct(F.col("_d").isNull().alias("n"), "_d", "_h", "_s")
    firsts = (
        found.groupBy("_f", "_c")
        .agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    return found.join(firsts, ["_f", "_c"]).where(place != F.col("_first")).select("_d", "_h", "_s", "_e")


def dedup_lines(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    min_words: int = MIN_WORDS,
    into: str = "lines",
) -> DataFrame:
    """Replace ``text`` by the text without repeated runs and add a struct ``into``: ``total`` lines,
    ``removed`` lines and ``runs``, the removed stretches as ``start:end`` pairs of line numbers."""
    gone = (
        repeats(docs, text, key, min_words)
        .groupBy(F.col("_d").alias("__gone_id"), F.col("_h").alias("__gone_hash"))
        .agg(F.collect_list("_s").alias("__starts"), F.collect_list("_e").alias("__ends"))
    )
    here = docs.withColumn("__hash", digest_of(text))
    joined = here.join(
        gone,
        F.col(key).eqNullSafe(F.col("__gone_id")) & (F.col("__hash") == F.col("__gone_hash")),
        "left",
    )
    cut = F.arrow_udf(in_slices(_cut), "struct<text: string, total: int, removed: int, runs: string>")
    done = joined.withColumn("__cut", cut(text_of(text), F.col("__starts"), F.col("__ends")))
    kept = F.when(F.col(text).isNotNull(), F.col("__cut.text")).alias(text)
    columns = [kept if c == text else F.col(f"`{c}`") for c in docs.columns if c != into]
    info = F.struct("__cut.total", "__cut.removed", "__cut.runs").alias(into)
    return done.select(*columns, info)


def _cut(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    let_go()
    out = []
    for t, ss, es in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist()):
        lines = t.split("\n")
        if not ss:
            out.append({"text": t, "total": len(lines), "removed": 0, "runs": ""})
            continue
        edge = np.zeros(len(lines) + 1, dtype=np.int64)
        np.add.at(edge, ss, 1)
        np.add.at(edge, es, -1)
        gone = np.cumsum(edge)[:-1] > 0
        turn = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        out.append(
            {
                "text": "\n".join(x for x, g in zip(lines, gone) if not g),
                "total": len(lines),
                "removed": int(gone.sum()),
                "runs": ",".join(f"{a}:{b}" for a, b in turn.reshape(-1, 2)),
            }
        )
    return pa.array(
        out,
        pa.struct([("text", pa.string()), ("total", pa.int32()), ("removed", pa.int32()), ("runs", pa.string())]),
    )


def dedup_sql(table: str = "documents", min_words: int = MIN_WORDS) -> str:
    """The removed runs in plain SQL: every window is compared by its lines. Ids must be unique."""
    return rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {table}),
l AS (SELECT doc_id, i, ls[i] AS line, len(regexp_extract_all(ls[i], '\S+')) AS w
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l),
p AS (SELECT a.doc_id, a.i AS s, b.i AS e FROM c a JOIN c b
      ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.w >= {min_words}),
win AS (SELECT doc_id, s, min(e) AS e FROM p GROUP BY 1, 2 UNION SELECT doc_id, max(s), e FROM p GROUP BY doc_id, e),
named AS (SELECT win.*, array_to_string(ls[s:e], chr(10)) AS content FROM win JOIN d USING (doc_id)),
later AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM later),
runs AS (SELECT doc_id, min(i) - 1 AS a, max(i) AS b FROM (
      SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM gone) GROUP BY doc_id, g),
told AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, string_agg(a || ':' || b, ',' ORDER BY a) AS removed_runs
      FROM runs GROUP BY 1),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS text FROM l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY 1)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       coalesce(removed_runs, '') AS removed_runs, sha256(coalesce(kept.text, '')) AS text_sha256
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)"""
