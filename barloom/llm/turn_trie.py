"""Prefix trie of conversations: every distinct beginning is a node, with totals of its subtree.

Turns become 128-bit ids and a conversation a row of ids. Rows are range-partitioned by their ids (then
by conversation, so that a crowd of equal ones is spread) and sorted; tasks take them in shards of
bounded size. A shard is a padded matrix of turn ids, ordered by ``lexsort``. A row begins a new node at
a depth if it differs from the row before in any column up to there: change masks, accumulated by OR.
Every total of a node is a sum (or least value) over its rows, given what begins and ends at each:

- children: rows that begin a node one level below;
- leaves: rows that the next row does not continue or repeat;
- saved tokens: bytes of turns from that depth on that do not begin a node.

so ``reduceat`` gives all nodes of a depth at once, and nodes that a shard's first or last row belongs
to, which may go on in neighbours, add up by their prefix digest. Shards of one task hand the row at
their border on; between tasks, first and last rows are compared once all are known, and what was
counted twice is taken back.

Defined cases: null role or text is empty; a null turn comes first, equal turns follow their ids; rows
without a conversation id belong to none and add nothing; absent base conversations give no turns; no
rows: no nodes. A conversation is one row of 20 bytes a turn; its texts are never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import small_batches
from barloom.session import durable

#: Rows and cells of one shard; a longer conversation is a shard of its own.
ROWS = 4096
CELLS = 1 << 20
#: Digest of the node without turns.
TOP = bytes(16)
#: Conversations of one family and turns that its first one can hand on (fixed values).
FAMILY = 5
HANDED = 9

NODES = (
    "_kind int, conv_id bigint, depth int, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string, _ref bigint, _shard bigint, "
    "_node binary, _up binary, _ends string, _ids binary, _bytes binary"
)
_NAMES = [f.split()[0] for f in NODES.split(", ")]


def sequences(conversations: DataFrame) -> DataFrame:
    """``_c`` and ``_t``: the ids and text bytes of every conversation's turns, in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    ident = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("_c"),
        F.struct(
            F.col("turn").cast("bigint").alias("turn"), ident.alias("id"), F.octet_length(text).alias("n")
        ).alias("_t"),
    )
    ordered = turns.groupBy("_c").agg(F.sort_array(F.collect_list("_t")).alias("_t"))
    return ordered.select("_c", F.transform("_t", lambda t: F.struct(t["id"].alias("id"), t["n"].alias("n"))).alias("_t"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Every conversation with its first turns replaced by those of the first of its family."""
    own = durable(sequences(conversations))
    first = own.where(F.pmod("_c", F.lit(FAMILY)) == 0).select(
        F.col("_c").alias("_f"), F.slice("_t", 1, HANDED).alias("_head")
    )
    h = (F.crc32(F.col("_c").cast("string").cast("binary")) % HANDED).cast("int")
    family = own.withColumns({"_f": F.col("_c") - F.pmod("_c", F.lit(FAMILY)), "_h": h})
    turns = F.concat(
        F.slice(F.coalesce("_head", F.slice("_t", 1, 0)), F.lit(1), F.col("_h")),
        F.slice("_t", F.col("_h") + 1, F.greatest(F.size("_t") - F.col("_h"), F.lit(0))),
    )
    return family.join(first, "_f", "left").select("_c", turns.alias("_t"))


def _digests(ids: bytes, upto: int) -> list[bytes]:
    """Digest of each prefix of a row, the empty one first."""
    out = [TOP]
    for d in range(upto):
        out.append(hashlib.md5(out[-1] + ids[16 * d : 16 * d + 16]).digest())
    return out


def _common(a: bytes | None, b: bytes | None) -> int:
    """Turns that two rows share at their beginning; -1 where one is missing."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // 16
    x, y = np.frombuffer(a, "V16", n), np.frombuffer(b, "V16", n)
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else n


class Shard:
    """One run of sorted rows between its neighbours."""

    def __init__(self, convs: np.ndarray, ids: list[bytes], sizes: list[bytes]):
        lens = np.array([len(s) // 16 for s in ids])
        width = int(lens.max())
        flat = np.frombuffer(b"".join(ids), dtype=">u8").reshape(-1, 2)
        # Numbers of the ids that keep their order.
        order = np.lexsort((flat[:, 1], flat[:, 0]))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (flat[order[1:]] != flat[order[:-1]]).any(axis=1)
        number = np.empty(len(order), dtype=np.int32)
        number[order] = np.cumsum(new)
        inside = np.arange(width)[None, :] < lens[:, None]
        turns = np.zeros((len(lens), width), dtype=np.int32)
        turns[inside] = number
        weight = np.zeros((len(lens), width), dtype=np.int64)
        weight[inside] = np.frombuffer(b"".join(sizes), dtype="<i4")
        by = np.lexsort((convs, *turns.T[::-1]))
        self.convs, self.lens, self.turns, self.weight = convs[by], lens[by], turns[by], weight[by]
        self.inside = inside[by]
        self.ids = [ids[by[0]], ids[by[-1]]]
        self.sizes = [sizes[by[0]], sizes[by[-1]]]

    def nodes(self, before: int, after: int, shard: int) -> Iterator[pa.RecordBatch]:
        """All nodes, given the turns that the first row shares with the row before it and the last
        with the row after it (-1: no such row is known)."""
        n, width = self.turns.shape
        change = np.ones((n, width), dtype=bool)
        change[1:] = self.turns[1:] != self.turns[:-1]
        local = np.logical_or.accumulate(change, axis=1) & self.inside
        begins = local.copy()
        begins[0] &= np.arange(width) >= before
        # Turns shared with the next row: those before the first change.
        shared = np.full(n, after)
        if n > 1:
            step = np.logical_or.accumulate(change[1:], axis=1) | ~self.inside[1:]
            shared[:-1] = np.where(step.any(axis=1), step.argmax(axis=1), width) if width else 0
        leaf = shared < self.lens
        saved = np.zeros((n, width + 1), dtype=np.int64)
        if width:
            saved[:, :width] = np.cumsum((self.weight * (~begins & self.inside))[:, ::-1], axis=1)[:, ::-1]
        first = _digests(self.ids[0], len(self.ids[0]) // 16)
        last = _digests(self.ids[1], len(self.ids[1]) // 16)
        above = np.zeros(1, dtype=np.int64)
        for d in range(width + 1):
            member = self.inside[:, d - 1] if d else np.ones(n, dtype=bool)
            at = np.flatnonzero(local[:, d - 1]) if d else np.zeros(1, dtype=np.int64)
            if not len(at):
                break
            zero = np.zeros(n, dtype=np.int64)
            total = np.add.reduceat(np.where(member, 1, zero), at)
            least = np.minimum.reduceat(np.where(member, self.convs, np.iinfo(np.int64).max), at)
            below = np.add.reduceat(begins[:, d].astype(np.int64) if d < width else zero, at)
            leaves = np.add.reduceat((leaf & member).astype(np.int64), at)
            # A node's own turn is the one before its depth.
            held = np.add.reduceat(np.where(member, saved[:, d - 1], 0) if d else saved[:, 0], at)
            ends = np.add.reduceat((member & (self.lens == d)).astype(np.int64), at)
            open_first = (at == 0) & bool(member[0])
            open_last = np.zeros(len(at), dtype=bool)
            open_last[-1] = bool(member[-1])
            edge = open_first | open_last
            if not d:
                edge[:] = True
            text = [",".join(map(str, self.convs[a : a + k])) if k else "" for a, k in zip(at, ends)]
            up = np.searchsorted(above, at, side="right") - 1
            if d:
                parent, ref = upper[up], upper_ref[up]
            else:
                parent, ref = np.zeros(1, dtype=np.int64), np.full(1, -1, dtype=np.int64)
            refs = np.where(edge, 2 * d + np.where(open_first, 0, 1), -1)
            if not d:
                refs[:] = 0
            key = [None if not e else (first if r % 2 == 0 else last)[d] for e, r in zip(edge, refs)]
            above_key = [
                None if not e or not d else (first if r % 2 == 0 else last)[d - 1] for e, r in zip(edge, refs)
            ]
            inner_parent = ~edge & (ref < 0)
            k = len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.where(edge, 1, 0).astype(np.int32)),
                    pa.array(least),
                    pa.array(np.full(k, d, dtype=np.int32)),
                    pa.array(parent, mask=~inner_parent),
                    pa.array(total),
                    pa.array(below),
                    pa.array(leaves),
                    pa.array(held),
                    pa.array([None if e else hashlib.sha256(t.encode()).hexdigest() for e, t in zip(edge, text)], pa.string()),
                    pa.array(np.where(edge, refs, ref), mask=~edge & (ref < 0)),
                    pa.array(np.full(k, shard)),
                    pa.array(key, pa.binary()),
                    pa.array(above_key, pa.binary()),
                    pa.array([t if e and t else None for e, t in zip(edge, text)], pa.string()),
                    pa.nulls(k, pa.binary()),
                    pa.nulls(k, pa.binary()),
                ],
                names=_NAMES,
            )
            above, upper, upper_ref = at, least, refs


def _edge(which: int, ids: bytes, sizes: bytes, shard: int) -> pa.RecordBatch:
    """First (2) or last (3) row of a task."""
    row = {"_kind": which, "_shard": shard, "_ids": ids, "_bytes": sizes}
    kinds = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32()}
    fields = [f.split() for f in NODES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([row.get(n)], kinds[t]) for n, t in fields], names=_NAMES)


def _build(batches, rows: int, cells: int) -> Iterator[pa.RecordBatch]:
    """Nodes of one task's rows, shard by shard, and its first and last row."""
    part, done = TaskContext.get().partitionId(), 0
    waiting: Shard | None = None
    previous: bytes | None = None  # last row before the waiting shard
    convs, ids, sizes, wide = [], [], [], 0

    def close() -> Shard:
        return Shard(np.array(convs, dtype=np.int64), ids, sizes)

    def tell(after: int):
        yield from waiting.nodes(_common(previous, waiting.ids[0]), after, part << 32 | done)

    for batch in batches:
        for c, i, s in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            i, s = b"".join(i.as_py()), np.array(s.as_py(), dtype="<i4").tobytes()
            if convs and (len(convs) >= rows or (len(convs) + 1) * max(wide, len(i) // 16) > cells):
                shard = close()
                if waiting is None:
                    yield _edge(2, shard.ids[0], shard.sizes[0], part)
                else:
                    yield from tell(_common(waiting.ids[1], shard.ids[0]))
                    previous, done = waiting.ids[1], done + 1
                waiting = shard
                convs, ids, sizes, wide = [], [], [], 0
            convs.append(c)
            ids.append(i)
            sizes.append(s)
            wide = max(wide, len(i) // 16)
    if convs:
        shard = close()
        if waiting is None:
            yield _edge(2, shard.ids[0], shard.sizes[0], part)
        else:
            yield from tell(_common(waiting.ids[1], shard.ids[0]))
            previous, done = waiting.ids[1], done + 1
        waiting = shard
        yield from tell(-1)
        yield _edge(3, shard.ids[1], shard.sizes[1], part)


def _take_back(batches) -> Iterator[pa.RecordBatch]:
    """What tasks counted twice at their borders, as changes of nodes. Gets first and last rows of
    all tasks in order."""
    last: tuple[bytes, bytes] | None = None
    for batch in batches:
        node, depth, below, leaves, saved = [], [], [], [], []
        for kind, ids, sizes in zip(*(batch.column(c).to_pylist() for c in ("_kind", "_ids", "_bytes"))):
            if kind == 3:
                last = (ids, sizes)
                continue
            if last is None:
                continue
            common = _common(last[0], ids)
            key = _digests(ids, common)
            weight = np.frombuffer(sizes, dtype="<i4").astype(np.int64)[:common]
            # Nodes of the shared turns began before: their own turn and all below count as saved.
            more = np.concatenate((np.cumsum(weight[::-1])[::-1], [0]))
            goes_on = common == len(last[0]) // 16
            for d in range(common + 1):
                node.append(key[d])
                depth.append(d)
                below.append(-1 if d < common else 0)
                saved.append(int(more[d - 1]) if d else int(more[0]))
                leaves.append(-1 if goes_on else 0)
        if node:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(node, pa.binary()),
                    pa.array(depth, pa.int32()),
                    pa.array(below, pa.int64()),
                    pa.array(leaves, pa.int64()),
                    pa.array(saved, pa.int64()),
                ],
                names=["_node", "depth", "n_children", "n_leaves", "saved_tokens"],
            )


def _hash_ends(batches) -> Iterator[pa.RecordBatch]:
    """Digest of the ids that end at a node, from its pieces in order; a piece at a time."""
    node, depth, state = None, None, None

    def told():
        return pa.RecordBatch.from_arrays(
            [pa.array([node], pa.binary()), pa.array([depth], pa.int32()), pa.array([state.hexdigest()])],
            names=["_node", "depth", "_sha"],
        )

    for batch in batches:
        for k, d, text in zip(*(batch.column(c) for c in ("_node", "depth", "_ends"))):
            k, d, text = k.as_py(), d.as_py(), text.as_py()
            if (k, d) != (node, depth):
                if state is not None:
                    yield told()
                node, depth, state = k, d, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
    if state is not None:
        yield told()


def trie(conversations: DataFrame, *, parts: int | None = None, rows: int = ROWS, cells: int = CELLS) -> DataFrame:
    """All nodes of the trie of ``sequences``-like rows; see ``prefix_trie`` for the columns."""
    packed = conversations.select(
        "_c", F.transform("_t", lambda t: t["id"]).alias("_i"), F.transform("_t", lambda t: t["n"]).alias("_s")
    )
    spread = packed.repartitionByRange(parts, "_i", "_c") if parts else packed.repartitionByRange("_i", "_c")
    told = durable(spread.sortWithinPartitions("_i", "_c").mapInArrow(lambda it: _build(it, rows, cells), NODES))
    zero = F.lit(0).cast("bigint")
    edges = told.where("_kind >= 2").select("_shard", "_kind", "_ids", "_bytes")
    changes = (
        edges.repartition(1)
        .sortWithinPartitions("_shard", "_kind")
        .mapInArrow(
            _take_back, "_node binary, depth int, n_children bigint, n_leaves bigint, saved_tokens bigint"
        )
    )
    partial = told.where("_kind = 1")
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    null = F.lit(None)
    together = partial.select("_node", "_up", "depth", "conv_id", *sums).unionByName(
        changes.select(
            "_node",
            null.cast("binary").alias("_up"),
            "depth",
            null.cast("bigint").alias("conv_id"),
            zero.alias("n_convs"),
            *sums[1:],
        )
    )
    whole = durable(
        together.groupBy("_node", "depth").agg(
            F.min("conv_id").alias("conv_id"), F.max("_up").alias("_up"), *[F.sum(c).alias(c) for c in sums]
        )
    )
    ends = (
        partial.where("_ends IS NOT NULL")
        .select("_node", "depth", "_shard", "_ends")
        .repartition("_node", "depth")
        .sortWithinPartitions("_node", "depth", "_shard")
        .mapInArrow(_hash_ends, "_node binary, depth int, _sha string")
    )
    named = whole.select(
        F.col("_node").alias("_up"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id")
    )
    columns = ["conv_id", "depth", "parent_conv_id", *sums, "ends_sha256"]
    borders = (
        whole.join(named, ["_up", "depth"], "left")
        .join(ends, ["_node", "depth"], "left")
        .withColumn("ends_sha256", F.coalesce("_sha", F.sha2(F.lit("").cast("binary"), 256)))
        .select(*columns)
    )
    inner = told.where("_kind = 0")
    settled = inner.where("_ref IS NULL").select(*columns)
    # A crowded node has children in every shard: they look it up by shard and place, never by the node.
    places = partial.select("_shard", "_ref", "_node", "depth").join(
        whole.select("_node", "depth", F.col("conv_id").alias("_p")), ["_node", "depth"]
    )
    hanging = inner.where("_ref IS NOT NULL").drop("parent_conv_id").join(
        places.select("_shard", "_ref", F.col("_p").alias("parent_conv_id")), ["_shard", "_ref"]
    )
    return settled.unionByName(hanging.select(*columns)).unionByName(borders)


def prefix_trie(
    conversations: DataFrame, *, parts: int | None = None, rows: int = ROWS, cells: int = CELLS
) -> DataFrame:
    """One row per node of the rebuilt ``conversations`` (``conv_id``, ``turn``, ``role``, ``text``):
    ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``."""
    small_batches(conversations.sparkSession)
    found = trie(rebuilt(conversations), parts=parts, rows=rows, cells=cells)
    return found.select("conv_id", F.col("depth").cast("bigint").alias("depth"), *found.columns[2:])
