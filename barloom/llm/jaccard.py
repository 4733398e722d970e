"""Join of texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Candidates come from a MinHash LSH forest. A text gets ``trees`` labels of ``max_depth`` minima each.
In a tree, texts with a common label prefix meet in the same node of the sorted trie; the matched
prefix is shortened from ``max_depth`` until a pair at the threshold meets in some tree with the
target probability. Nodes are cut into cells of two blocks, so a crowded node is many tasks and no
pair is written: a cell compares short signatures (the cut lies five deviations below the threshold)
and sends a spanning forest. Texts that hang together this way form groups, and groups, again in
cells, are verified exactly on whole shingle sets, all pairs of a group. A cell sends per text the
number of verified links and a spanning forest of them.

Texts with equal shingle sets are one class throughout, so copies are never paired.

Defined cases: words are runs of letters, digits and underscores, in lower case; a text of one to
four words has one shingle, all its words; a text without words (or null) links to nothing; rows that
repeat an id are one document (of several texts the one with the least set hash); rows with a null
id take part in nothing and come back once, with null class.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import bounds, groups, mix64, per_worker, small_batches, text_of
from barloom.llm.components import components
from barloom.session import durable

WORDS = 5
THRESHOLD = 0.8
TREES = 16
MAX_DEPTH = 5
RECALL = 0.9995
#: Texts of one block; a cell holds two.
BLOCK = 256
_WORD = re.compile(r"\w+")
_KNOWN = 150_000


class WordHashes(dict):
    """Hash of each word, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < _KNOWN:
            self[word] = h
        return h


def shingles(text: str, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    found = _WORD.findall(text.lower())
    n = len(found)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=n)
    size = min(WORDS, n)
    out = h[: n - size + 1].copy()
    for k in range(1, size):
        out = mix64(out) + h[k : n - size + 1 + k]
    return np.unique(mix64(out + np.uint64(size)))


@lru_cache(maxsize=2)
def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix64(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seed[:count] | np.uint64(1), seed[count:]


def minima(sets: np.ndarray, count: int, chunk: int = 1024) -> np.ndarray:
    """Least value of each of ``count`` hash functions over a set, upper 32 bits."""
    a, b = _functions(count)
    low = np.full(count, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(sets), chunk):
        part = np.multiply.outer(a, sets[at : at + chunk])
        part += b[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def prefix_length(trees: int, max_depth: int, threshold: float, recall: float) -> int:
    """Longest prefix with which a pair at the threshold meets in some tree as often as asked."""
    for depth in range(max_depth, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


def sketches(
    docs: DataFrame, text: str, key: str, trees: int, max_depth: int, depth: int
) -> DataFrame:
    """``_d`` id, ``_k`` set hash (null without words), ``_n`` set size, ``_s`` signature, ``_t`` trie
    nodes at the matched depth, one per tree."""

    def run(batches):
        words = per_worker(("words", 0), WordHashes)
        salt = np.arange(trees, dtype=np.uint64)
        for b in batches:
            keys, sizes, signs, nodes = [], [], [], []
            for t in b.column("_x").to_pylist():
                s = shingles(t, words)
                sizes.append(len(s))
                if not len(s):
                    keys.append(None)
                    signs.append(b"")
                    nodes.append(np.zeros(trees, dtype=np.int64))
                    continue
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                m = minima(s, trees * max_depth)
                signs.append(m.astype(np.uint8).tobytes())
                label = salt.copy()
                for k in range(depth):
                    label = mix64(label * np.uint64(0x9E3779B97F4A7C15) + m[k * trees : (k + 1) * trees])
                nodes.append(label.view(np.int64))
            flat = np.concatenate(nodes) if nodes else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("_d"),
                    pa.array(keys, pa.binary()),
                    pa.array(sizes, pa.int32()),
                    pa.array(signs, pa.binary()),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * trees), pa.array(flat)
                    ),
                ],
                names=["_d", "_k", "_n", "_s", "_t"],
            )

    source = docs.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("_d"), text_of(text).alias("_x")
    )
    return source.mapInArrow(run, "_d bigint, _k binary, _n int, _s binary, _t array<bigint>")


def in_cells(rows: DataFrame, by: str, node: str, count: str, block: int) -> DataFrame:
    """Spread the members of each ``by`` over blocks and pair blocks up: adds ``_cell``, ``_block``
    and ``_same`` (the cell's blocks are one). ``count`` is the size of the member's group."""
    n_blocks = F.ceil(F.col(count) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(node, F.lit(7)), n_blocks).cast("int")
    placed = rows.withColumn("_block", own)
    other = F.explode(F.sequence(F.lit(0), n_blocks - 1))
    return (
        placed.withColumn("_other", other)
        .withColumn(
            "_cell", F.xxhash64(by, F.least("_block", "_other"), F.greatest("_block", "_other"))
        )
        .withColumn("_same", F.col("_block") == F.col("_other"))
        .drop("_other")
    )


def _roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id that each row of a symmetric link matrix reaches."""
    low = ids.copy()
    while True:
        reach = np.where(linked, low[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(low, reach)
        if np.array_equal(new, low):
            return low
        low = new


def _similar(batches, cut: int):
    """Spanning forest, cell by cell, of pairs whose signatures agree in at least ``cut`` places."""
    for t in groups(batches, "_cell"):
        t = t.combine_chunks()
        cell = t.column("_cell").to_numpy()
        ids = t.column("_d").to_numpy()
        block = t.column("_block").to_numpy()
        same = t.column("_same").to_numpy()
        sign = np.frombuffer(b"".join(t.column("_s").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
        edge = bounds(cell)
        size = np.diff(edge)
        two = edge[:-1][size == 2]
        us, vs = [], []
        if len(two):
            ok = (sign[two] == sign[two + 1]).sum(axis=1) >= cut
            ok &= same[two] | (block[two] != block[two + 1])
            us.append(ids[two[ok]])
            vs.append(ids[two[ok] + 1])
        for a, b in zip(edge[:-1][size > 2], edge[1:][size > 2]):
            s, own = sign[a:b], ids[a:b]
            linked = np.zeros((b - a, b - a), dtype=bool)
            step = max(1, 4_000_000 // (s.size or 1))
            for i in range(0, b - a, step):
                linked[i : i + step] = (s[i : i + step, None, :] == s[None]).sum(axis=2) >= cut
            if not same[a]:
                linked &= block[a:b, None] != block[None, a:b]
            root = _roots(linked, own)
            m = root != own
            us.append(own[m])
            vs.append(root[m])
        if us:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"]
            )


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted distinct sets."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    rank = np.cumsum(shared) - 1
    keep = shared[at]
    owner, col = owner[keep], rank[at[keep]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    out = np.zeros((n, n), dtype=np.float32)
    for lo in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(col, [lo, lo + columns])
        m = np.zeros((n, min(columns, int(shared.sum()) - lo)), dtype=np.float32)
        m[owner[a:b], col[a:b] - lo] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _verify(batches, threshold: float):
    """Links and spanning forest per cell, on whole sets. Set sizes below 2^24: counts are exact."""
    for t in groups(batches, "_cell"):
        t = t.combine_chunks()
        cell, ids = t.column("_cell").to_numpy(), t.column("_d").to_numpy()
        block, same = t.column("_block").to_numpy(), t.column("_same").to_numpy()
        weight = t.column("_w").to_numpy()
        held = t.column("_set")
        edge = bounds(cell)
        out = ([], [], [])
        for a, b in zip(edge[:-1], edge[1:]):
            _, first = np.unique(ids[a:b], return_index=True)  # repeated rows of a document
            rows = a + first
            if len(rows) < 2:
                continue
            sets = [np.frombuffer(held[int(r)].as_py(), dtype=np.uint64) for r in rows]
            if len(sets) == 2:
                both = np.zeros((2, 2), dtype=np.int64)
                both[0, 1] = both[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
            else:
                both = overlaps(sets)
            size = np.array([len(s) for s in sets])
            linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
            np.fill_diagonal(linked, False)
            if not same[a]:
                linked &= block[rows, None] != block[None, rows]
            for c, v in zip(out, (ids[rows], linked @ weight[rows], _roots(linked, ids[rows]))):
                c.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["u", "links", "v"]
            )


def _sets(batches):
    words = per_worker(("words", 0), WordHashes)
    for b in batches:
        at = b.schema.get_field_index("_x")
        sets = [shingles(t, words) for t in b.column("_x").to_pylist()]
        same = [xxhash.xxh3_128_digest(s.tobytes()) == k for s, k in zip(sets, b.column("_k").to_pylist())]
        cols = [c for i, c in enumerate(b.columns) if i != at]
        names = [n for n in b.schema.names if n != "_x"]
        out = pa.RecordBatch.from_arrays(
            [*cols, pa.array([s.tobytes() for s in sets], pa.binary())], names=[*names, "_set"]
        )
        yield out.filter(pa.array(same, pa.bool_()))


def similar_groups(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    *,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    max_depth: int = MAX_DEPTH,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document id: ``key``, ``class_id`` (least id with the same shingle set),
    ``n_links`` (other documents at the threshold or above, copies included) and ``component_id``
    (least id reachable by links)."""
    small_batches(docs.sparkSession)
    count = trees * max_depth
    depth = prefix_length(trees, max_depth, threshold, recall)
    cut = int(np.floor(count * threshold - 5 * np.sqrt(count * threshold * (1 - threshold))))
    found = sketches(docs, text, key, trees, max_depth, depth)
    per_id = found.groupBy("_d").agg(F.min(F.struct("_k", "_n", "_s", "_t")).alias("_m"))
    docs_k = durable(per_id.select("_d", "_m.*"))
    classes = durable(
        docs_k.where(F.col("_k").isNotNull())
        .groupBy("_k")
        .agg(F.min("_d").alias("_d"), F.count("*").alias("_w"), F.min(F.struct("_s", "_t")).alias("_m"))
        .select("_k", "_d", "_w", "_m.*")
    )
    nodes = classes.select("_d", F.explode("_t").alias("_p"))
    crowded = nodes.groupBy("_p").agg(F.count("*").alias("_c")).where("_c > 1")
    cells = in_cells(nodes.join(crowded, "_p"), "_p", "_d", "_c", block).join(
        classes.select("_d", "_s"), "_d"
    )
    cells = cells.select("_cell", "_d", "_block", "_same", "_s")
    near = (
        cells.repartition("_cell")
        .sortWithinPartitions("_cell")
        .mapInArrow(lambda it: _similar(it, cut), "u bigint, v bigint")
    )
    member = components(near).select(F.col("node").alias("_d"), F.col("root").alias("_g"))
    sizes = member.groupBy("_g").agg(F.count("*").alias("_c"))
    member = durable(member.join(sizes, "_g").join(classes.select("_d", "_k", "_w"), "_d"))
    texts = docs.select(F.col(key).cast("bigint").alias("_d"), text_of(text).alias("_x"))
    sets = texts.join(member, "_d").mapInArrow(
        _sets, "_d bigint, _g bigint, _c bigint, _k binary, _w bigint, _set binary"
    )
    checked = durable(
        in_cells(sets, "_g", "_d", "_c", block)
        .select("_cell", "_d", "_block", "_same", "_w", "_set")
        .repartition("_cell")
        .sortWithinPartitions("_cell")
        .mapInArrow(lambda it: _verify(it, threshold), "u bigint, links bigint, v bigint")
    )
    links = checked.groupBy(F.col("u").alias("_d")).agg(F.sum("links").alias("_l"))
    roots = components(checked.select("u", "v")).select(F.col("node").alias("_d"), F.col("root").alias("_r"))
    told = (
        classes.select("_d", "_k", "_w")
        .join(links, "_d", "left")
        .join(roots, "_d", "left")
        .where("_w > 1 or _l > 0")
        .select(
            "_k",
            F.col("_d").alias("class_id"),
            (F.col("_w") - 1 + F.coalesce("_l", F.lit(0))).alias("n_links"),
            F.coalesce("_r", "_d").alias("component_id"),
        )
    )
    alone = F.col("_d")
    out = docs_k.select("_d", "_k").join(told, "_k", "left").select(
        alone.alias(key),
        F.coalesce("class_id", alone).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", alone).alias("component_id"),
    )
    null = F.lit(None).cast("bigint")
    lost = docs.where(F.col(key).isNull()).select(
        null.alias(key), null.alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), null.alias("component_id")
    )
    return out.unionByName(lost.distinct())
