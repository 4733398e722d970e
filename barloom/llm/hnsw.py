"""Near-duplicate vectors by navigable small-world graphs, one per cell.

Distinct vectors are filed under the nearest of some centres (k-means on a bounded sample, the vectors
of least hash; their number follows the rows up to ``CELLS``); a crowded cell is cut into parts by a
hash. Each part builds a hierarchical graph: layer ``l`` holds the first ``n / 16^l`` vectors in hash
order, so layers are nested, and a new vector links to a diverse choice of the nearest ones found from
the layer above. Every vector then asks all parts of the cells nearest to it; the beam always expands
whatever lies within the threshold, so a dense cluster is followed to its end. Links are checked by the
exact cosine and sent as a spanning forest.

A bounded audit compares vectors of found components of every size class, lone ones too, with all
rows. Recall is the mean over audited vectors of the share of their true links that lie within their
component, for vectors with few, some and many links apart, so a dense cluster does not outweigh
pairs. While one class has less than asked, twice as many cells are asked if it is the cells that
links are lost by, in the end all of them; else the beam is doubled and the cells are asked again.
Components are then verified: all pairs of a component, cut into cells of two blocks, are compared exactly, which gives
the number of links. Such a cell sends counts, never pairs.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components link with nothing and are components of their own; equal vectors are one node with a
weight; rows with a null id come back with null component; an id that repeats is one node per
distinct vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import bounds, groups
from barloom.llm.components import components
from barloom.llm.jaccard import in_cells
from barloom.llm.vectors import cosine, dimension, matrix, unit, usable
from barloom.session import durable

LINKS = 12
STEP = 16
#: Least and largest number of cells, rows that a cell has on average until the largest number is reached.
SHARDS = 8
CELLS = 1024
CELL_ROWS = 2048
#: Vectors of the sample that centres are fitted on: so many for each, and in all.
FIT_ROWS = 64
SAMPLE = 16_384
#: Largest graph. Vectors that ask one are dealt to tasks by so many.
SHARD_ROWS = 65_536
CHUNK_ROWS = 8_192
#: First number of cells asked and first beam; audits widen them.
PROBES = 4
BEAM = 96
BUILD_BEAM = 48
#: Audited vectors of each size class of found components.
AUDIT = 512
RECALL = 0.99
#: Least sizes of the classes of components: lone vectors, small groups, larger ones, clusters.
CLASSES = (1, 2, 4, 32)
BLOCK = 512


def layer_sizes(n: int) -> list[int]:
    """Vectors in each layer, lowest first; the top one is small enough to look through."""
    out = [n]
    while out[-1] > 64:
        out.append(-(-out[-1] // STEP))
    return out


def beam_search(x, links, q, start, ef: int, within: float = 2.0, expand: int = 4):
    """For each row of ``q``: ids (-1: none) and similarities of the best found, best first. Kept are
    ``ef`` of them, and everything of similarity ``within`` or more. Rows that are done leave the
    batch, so one in a dense cluster does not widen the work of the others."""
    n = len(links)
    rows = np.arange(len(q))[:, None]
    seen = np.zeros((len(q), n), dtype=bool)
    last = np.zeros(len(q) * n, dtype=np.int32)
    ids = np.sort(start, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    sims = np.where(ids >= 0, np.einsum("qd,qed->qe", q, x[ids]), -np.inf).astype(np.float32)
    seen[rows, np.where(ids >= 0, ids, start[:, :1])] = True
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = ids[rows, order], sims[rows, order]
    done = ids < 0
    live = np.arange(len(q))  # which query each row of the state belongs to
    ready: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        over = done.all(axis=1)
        if over.all() or over.mean() > 0.3:
            ready.append((live[over], ids[over], sims[over]))
            live, ids, sims, done = live[~over], ids[~over], sims[~over], done[~over]
            if not len(live):
                return _together(ready, len(q))
            rows = np.arange(len(live))[:, None]
        pick = np.argsort(done, axis=1, kind="stable")[:, :expand]
        open_ = ~done[rows, pick]
        done[rows, pick] = True
        near = links[ids[rows, pick]]
        ok = open_[:, :, None] & (near >= 0)
        who = np.broadcast_to(rows[:, :, None], near.shape)[ok]
        got = near[ok]
        new = ~seen[live[who], got]
        who, got = who[new], got[new]
        if not len(who):
            continue
        # Of a node met twice in one step the last mention stays.
        spot = live[who] * n + got
        turn = np.arange(len(spot), dtype=np.int32)
        last[spot] = turn
        once = last[spot] == turn
        who, got = who[once], got[once]
        seen[live[who], got] = True
        s = np.einsum("ij,ij->i", q[live[who]], x[got])
        edge = np.searchsorted(who, np.arange(len(live) + 1))
        most = int(np.diff(edge).max())
        more_ids = np.full((len(live), most), -1, dtype=ids.dtype)
        more_sims = np.full((len(live), most), -np.inf, dtype=np.float32)
        at = np.arange(len(who)) - edge[who]
        more_ids[who, at], more_sims[who, at] = got, s
        ids = np.concatenate((ids, more_ids), axis=1)
        sims = np.concatenate((sims, more_sims), axis=1)
        done = np.concatenate((done, more_ids < 0), axis=1)
        keep = np.maximum(ef, (sims >= within).sum(axis=1) + ef // 2)  # of each row
        order = np.argsort(-sims, axis=1, kind="stable")[:, : keep.max()]
        ids, sims, done = ids[rows, order], sims[rows, order], done[rows, order]
        beyond = np.arange(ids.shape[1]) >= keep[:, None]
        ids[beyond], sims[beyond], done[beyond] = -1, -np.inf, True


def _together(parts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Finished rows in the order of the queries, padded to one width."""
    width = max(p[1].shape[1] for p in parts)
    ids = np.full((n, width), -1, dtype=parts[0][1].dtype)
    sims = np.full((n, width), -np.inf, dtype=np.float32)
    for at, i, s in parts:
        ids[at, : i.shape[1]], sims[at, : s.shape[1]] = i, s
    return ids, sims


def choose(x, own, cand, sims, most: int):
    """Of each row's candidates (best first, -1: none) up to ``most``: first those that no chosen one
    is nearer to than the row itself is, then the nearest of the others."""
    n, c = cand.shape
    v = x[cand]
    between = v @ v.transpose(0, 2, 1)
    valid = (cand >= 0) & (cand != own[:, None])
    taken = np.zeros((n, c), dtype=bool)
    for k in range(c):
        hidden = ((between[:, k, :] > sims[:, k, None]) & taken).any(axis=1)
        taken[:, k] = valid[:, k] & ~hidden & (taken.sum(axis=1) < most)
    order = np.argsort(np.where(taken, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
    rows = np.arange(n)[:, None]
    return np.where(valid[rows, order], cand[rows, order], -1)


def _best_first(x, own, cand):
    """Candidates without repeats, best first, with similarities."""
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    sims = np.where(cand >= 0, np.einsum("nd,ncd->nc", x[own], x[cand]), -np.inf).astype(np.float32)
    order = np.argsort(-sims, axis=1, kind="stable")
    rows = np.arange(len(own))[:, None]
    return cand[rows, order], sims[rows, order]


def _link(x, links, own, cand, width: int):
    """Choose links of new nodes and put them into the lists of what they link to."""
    chosen = choose(x, own, *_best_first(x, own, cand), width // 2)
    links[own, : chosen.shape[1]] = chosen
    src = np.repeat(own, chosen.shape[1])
    dst = chosen.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    edge = bounds(dst)
    for a in range(0, len(edge) - 1, 1024):
        part = edge[a : a + 1025]
        to = dst[part[:-1]]
        most = int(np.diff(part).max())
        back = np.full((len(to), most), -1, dtype=links.dtype)
        row = np.repeat(np.arange(len(to)), np.diff(part))
        back[row, np.arange(part[0], part[-1]) - part[:-1][row]] = src[part[0] : part[-1]]
        # Of many new ones the nearest suffice: the others have links of their own.
        cand, sims = _best_first(x, to, np.concatenate((links[to], back), axis=1))
        cand, sims = cand[:, : 3 * width], sims[:, : 3 * width]
        free = (cand >= 0).sum(axis=1) <= width
        out = np.full((len(to), width), -1, dtype=links.dtype)
        w = min(width, cand.shape[1])
        out[free, :w] = cand[free, :w]
        if (~free).any():
            out[~free] = choose(x, to[~free], cand[~free], sims[~free], width)
        links[to] = out


def build(x: np.ndarray) -> list[np.ndarray]:
    """Links of each layer, lowest first; -1 where a node has fewer."""
    sizes = layer_sizes(len(x))
    width = 2 * LINKS
    layers: list[np.ndarray] = []
    for size in reversed(sizes):
        links = np.full((size, width), -1, dtype=np.int32)
        ready = min(size, 128)
        own = np.arange(ready)
        everyone = np.tile(own, (ready, 1)).astype(np.int32)
        everyone[own, own] = -1
        _link(x, links, own, everyone, width)
        while ready < size:
            new = np.arange(ready, min(size, ready + min(ready, 512)))
            start = descend(x, layers, x[new]) if layers else np.zeros((len(new), 1), dtype=np.int32)
            start = np.where(start < ready, start, start % ready)  # the layer is still filling up
            found, _ = beam_search(x, links[:ready], x[new], start, BUILD_BEAM)
            among = x[new] @ x[new].T
            np.fill_diagonal(among, -np.inf)
            m = min(LINKS, len(new) - 1)
            peers = np.argpartition(-among, m - 1, axis=1)[:, :m] if m > 0 else np.zeros((len(new), 0), int)
            _link(x, links, new, np.concatenate((found, new[peers]), axis=1).astype(np.int32), width)
            ready += len(new)
        layers.insert(0, links)
    return layers


def descend(x, layers: list[np.ndarray], q) -> np.ndarray:
    """Start nodes for the layer below ``layers``: look through the top one, then narrow beams."""
    top = layers[-1]
    sims = q @ x[: len(top)].T
    m = min(4, len(top))
    start = np.argpartition(-sims, m - 1, axis=1)[:, :m].astype(np.int32)
    for links in reversed(layers[:-1]):
        start = beam_search(x, links, q, start, 16)[0][:, :4]
        start = np.where(start >= 0, start, start[:, :1])
    return start


def ask(x, layers, q, ef: int, within: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of q, node) of similarity ``within`` or more that the graph leads to."""
    start = descend(x, layers[1:], q) if len(layers) > 1 else None
    if start is None:
        start = np.tile(np.arange(len(x), dtype=np.int32), (len(q), 1))
    ids, sims = beam_search(x, layers[0], q, start, ef, within)
    who, at = np.nonzero((sims >= within) & (ids >= 0))
    return who, ids[who, at]


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least id) of the components that the edges form."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while True:
        before = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        low = low[low]
        if np.array_equal(before, low):
            m = low != np.arange(len(nodes))
            return nodes[m], nodes[low[m]]


def fit_centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Up to ``k`` unit centres of unit vectors, by spherical k-means; one that gets no vector goes."""
    c = x[np.random.default_rng(7).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        own, size = np.unique(near, return_counts=True)
        sums = np.add.reduceat(x[np.argsort(near, kind="stable")], np.cumsum(size) - size, axis=0)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(length > 0, sums / np.maximum(length, 1e-30), c[own])
    return c


def _centres(classes: DataFrame, dim: int, k: int) -> np.ndarray:
    rows = classes.orderBy(F.xxhash64("_id", F.lit(3)), "_id").limit(min(SAMPLE, k * FIT_ROWS))
    x = unit(matrix(rows.select("_v").toArrow().column("_v"), dim)).astype(np.float32)
    return fit_centres(x, k) if len(x) else np.zeros((1, max(dim, 1)), np.float32)


def _route(classes: DataFrame, dim: int, centres: np.ndarray, probes: int) -> DataFrame:
    """``_id``, ``_v`` and ``_near``: the nearest cells of each vector, nearest first."""
    m = min(probes, len(centres))

    def run(batches):
        for b in batches:
            sims = unit(matrix(b.column("_v"), dim)).astype(np.float32) @ centres.T
            near = np.argsort(-sims, axis=1, kind="stable")[:, :m].astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(0, near.size + 1, m, dtype=np.int32), near.ravel())
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_v"), lists], names=["_id", "_v", "_near"])

    return classes.select("_id", "_v").mapInArrow(run, "_id bigint, _v array<double>, _near array<int>")


def _graphs(routed: DataFrame, dim: int, shard_rows: int) -> DataFrame:
    """A graph for each part of a cell; a row for each vector."""
    home = routed.select(F.col("_near")[0].alias("_cell"), F.xxhash64("_id", F.lit(13)).alias("_o"), "_id", "_v")
    cut = home.groupBy("_cell").agg(F.ceil(F.count("*") / shard_rows).alias("_parts"))
    part = F.pmod(F.xxhash64("_id", F.lit(11)), F.col("_parts")).cast("int")
    return (
        home.join(F.broadcast(cut), "_cell")
        .select("_cell", part.alias("_part"), "_o", "_id", "_v")
        .groupBy("_cell", "_part")
        .applyInArrow(
            _build_shard(dim),
            "_cell int, _part int, _pos int, _id bigint, _v array<double>, _links array<binary>",
        )
    )


def _ask(routed: DataFrame, graph: DataFrame, first: int, dim: int, beam: int, threshold: float) -> DataFrame:
    """Links of every vector to those of its nearest cells, from its ``first`` one on. Only as many
    copies of a graph are made as the vectors that ask it need tasks."""
    asks = routed.select("_id", "_v", F.explode(F.expr(f"slice(_near, {first + 1}, size(_near))")).alias("_cell"))
    deal = durable(
        asks.groupBy("_cell")
        .agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("_chunks"))
        .join(graph.groupBy("_cell").agg((F.max("_part") + 1).alias("_parts")), "_cell")
    )
    left = graph.join(F.broadcast(deal), "_cell").withColumn("_ch", F.expr("explode(sequence(0, _chunks - 1))"))
    right = asks.join(F.broadcast(deal), "_cell").select(
        "_cell",
        F.expr("explode(sequence(0, _parts - 1))").alias("_part"),
        F.pmod(F.xxhash64("_id", F.lit(15)), F.col("_chunks")).cast("int").alias("_ch"),
        "_id",
        "_v",
    )
    return (
        left.drop("_chunks", "_parts")
        .groupBy("_cell", "_part", "_ch")
        .cogroup(right.groupBy("_cell", "_part", "_ch"))
        .applyInArrow(_ask_shard(dim, beam, threshold), "u bigint, v bigint")
    )


def _build_shard(dim: int):
    def run(key, t):
        t = t.sort_by([("_o", "ascending"), ("_id", "ascending")])
        layers = build(unit(matrix(t.column("_v"), dim)).astype(np.float32))
        held = [[] for _ in range(t.num_rows)]
        for links in layers:
            for i in range(len(links)):
                held[i].append(links[i].tobytes())
        return pa.table(
            {
                "_cell": t.column("_cell"),
                "_part": t.column("_part"),
                "_pos": pa.array(np.arange(t.num_rows, dtype=np.int32)),
                "_id": t.column("_id"),
                "_v": t.column("_v"),
                "_links": pa.array(held, pa.list_(pa.binary())),
            }
        )

    return run


def _layers(t: pa.Table) -> list[np.ndarray]:
    rows = t.column("_links").to_pylist()
    depth = max(map(len, rows), default=0)
    return [
        np.frombuffer(b"".join(r[k] for r in rows if len(r) > k), dtype=np.int32).reshape(-1, 2 * LINKS)
        for k in range(depth)
    ]


def _ask_shard(dim: int, ef: int, threshold: float, batch: int = 256):
    def run(key, graph, asked):
        out_u, out_v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if graph.num_rows and asked.num_rows:
            graph = graph.sort_by("_pos")
            whole, ids = matrix(graph.column("_v"), dim), graph.column("_id").to_numpy()
            x, layers = unit(whole).astype(np.float32), _layers(graph)
            mine, qids = matrix(asked.column("_v"), dim), asked.column("_id").to_numpy()
            q = unit(mine).astype(np.float32)
            us, vs, held = [], [], 0
            for i in range(0, len(q), batch):
                who, node = ask(x, layers, q[i : i + batch], ef, threshold - 1e-5)
                other = qids[i:][who] != ids[node]
                who, node = who[other] + i, node[other]
                ok = cosine(mine[who], whole[node]) >= threshold if len(who) else np.zeros(0, bool)
                us.append(qids[who[ok]])
                vs.append(ids[node[ok]])
                held += len(us[-1])
                if held > 500_000:
                    u, v = _forest(np.concatenate(us), np.concatenate(vs))
                    us, vs, held = [u], [v], len(u)
            u, v = np.concatenate(us), np.concatenate(vs)
            if len(u):
                out_u, out_v = _forest(u, v)
        return pa.table({"u": pa.array(out_u, pa.int64()), "v": pa.array(out_v, pa.int64())})

    return run


def _verify(batches, dim: int, threshold: float):
    for t in groups(batches, "_cell"):
        cell, ids = t.column("_cell").to_numpy(), t.column("_id").to_numpy()
        block, same = t.column("_block").to_numpy(), t.column("_same").to_numpy(zero_copy_only=False)
        weight, raw = t.column("_w").to_numpy(), matrix(t.column("_v"), dim)
        x = unit(raw)
        edge = bounds(cell)
        out = []
        for a, b in zip(edge[:-1], edge[1:]):
            near = x[a:b] @ x[a:b].T
            linked = near >= threshold + 1e-9
            i, j = np.nonzero(np.abs(near - threshold) < 1e-9)  # too near to call: exact sums decide
            if len(i):
                linked[i, j] = cosine(raw[a + i], raw[a + j]) >= threshold
            np.fill_diagonal(linked, False)
            if not same[a]:
                linked &= block[a:b, None] != block[None, a:b]
            out.append(linked @ weight[a:b])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(np.concatenate(out).astype(np.int64))], names=["_id", "_l"]
        )


def _true_links(probe: pa.Table, rows: DataFrame, dim: int, threshold: float) -> DataFrame:
    """For each of a bounded number of vectors: its links by comparing with every row, how many of them
    lie in its component ``_r``, and how many lie in a cell that one end was led to. A task sends sums,
    never pairs."""
    mine, qids = matrix(probe.column("_v"), dim), probe.column("_id").to_numpy()
    mine_r, q = probe.column("_r").to_numpy(), unit(mine)
    mine_near = _lists(probe.column("_near"))

    def run(batches):
        n, got, led = (np.zeros(len(q), np.int64) for _ in range(3))
        for b in batches:
            all_raw, all_ids, all_r = matrix(b.column("_v"), dim), b.column("_id").to_numpy(), b.column("_r").to_numpy()
            all_near = _lists(b.column("_near"))
            for at in range(0, len(all_raw), 1024):
                raw, ids, r, cells = (v[at : at + 1024] for v in (all_raw, all_ids, all_r, all_near))
                near = q @ unit(raw).T
                linked = near >= threshold + 1e-9
                i, j = np.nonzero(np.abs(near - threshold) < 1e-9)  # too near to call: exact sums decide
                if len(i):
                    linked[i, j] = cosine(mine[i], raw[j]) >= threshold
                linked &= qids[:, None] != ids[None, :]
                n += linked.sum(axis=1)
                got += (linked & (mine_r[:, None] == r[None, :])).sum(axis=1)
                i, j = np.nonzero(linked)
                for k in range(0, len(i), 65_536):
                    u, v = i[k : k + 65_536], j[k : k + 65_536]
                    met = (mine_near[u] == cells[v, :1]).any(axis=1) | (cells[v] == mine_near[u, :1]).any(axis=1)
                    led += np.bincount(u[met], minlength=len(led))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v) for v in (at, n[at], got[at], led[at])], names=["at", "n", "got", "led"]
        )

    sums = rows.select("_id", "_r", "_v", "_near").mapInArrow(run, "at bigint, n bigint, got bigint, led bigint")
    return sums.groupBy("at").agg(*(F.sum(c).alias(c) for c in ("n", "got", "led")))


def _lists(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1 if len(column) else 1)


def _class(size: Column) -> Column:
    """Index of the size class."""
    return sum((size >= least).cast("int") for least in CLASSES[1:])


def _audit(placed: DataFrame, dim: int, threshold: float, audit: int) -> dict[int, tuple[float, float]]:
    """Recall of the vectors whose true group is of each size class (by its least number of links), and the
    share of their links in cells that one end was led to. Vectors are drawn from each class of found
    components and stand for all of theirs."""
    drawn = [
        placed.where(F.col("_cl") == c).orderBy(F.xxhash64("_id", F.lit(17)), "_id").limit(audit)
        for c in range(len(CLASSES))
    ]
    of_class = {r["_cl"]: r["count"] for r in placed.groupBy("_cl").count().collect()}
    probe = pa.concat_tables([d.select("_id", "_r", "_v", "_near", "_cl").toArrow() for d in drawn])  # at most 4 * audit
    took = probe.column("_cl").to_numpy()
    weight = {c: n / max(1, int((took == c).sum())) for c, n in of_class.items()}
    total, held, led = (np.zeros(len(CLASSES)) for _ in range(3))
    for r in _true_links(probe, placed, dim, threshold).collect():
        c = int(np.searchsorted(CLASSES, r.n + 1, side="right")) - 1
        total[c] += weight[took[r.at]]
        held[c] += weight[took[r.at]] * r.got / r.n
        led[c] += weight[took[r.at]] * r.led / r.n
    return {CLASSES[c]: (float(held[c] / total[c]), float(led[c] / total[c])) for c in np.flatnonzero(total)}


def near_duplicates(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    *,
    threshold: float = 0.9,
    shards: int = SHARDS,
    cell_rows: int = CELL_ROWS,
    shard_rows: int = SHARD_ROWS,
    probes: int = PROBES,
    beam: int = BEAM,
    audit: int = AUDIT,
    recall: float = RECALL,
    block: int = BLOCK,
) -> tuple[DataFrame, list[dict]]:
    """``key, n_links, component_id, kept`` per row, and the audits: cells asked, beam, recall of each size
    class of each pass, and the least of them. ``shards`` is the least number of cells, ``shard_rows`` the
    largest graph."""
    dim = dimension(df, vector)
    rows = df.withColumn("_id", F.col(key).cast("bigint"))
    rows = rows.withColumn("_ok", usable(vector, dim) & F.col("_id").isNotNull() if dim else F.lit(False))
    rows = rows.select(
        "_id", "_ok", F.when(F.col("_ok"), F.col(vector).cast("array<double>")).alias("_v")
    ).withColumns({"_k": F.xxhash64("_v"), "_k2": F.xxhash64(F.lit(1), "_v")})
    classes = durable(
        rows.where("_ok")
        .groupBy("_k", "_k2")
        .agg(F.min("_id").alias("_id"), F.count("*").alias("_w"), F.first("_v").alias("_v"))
    )
    n = classes.count()
    centres = _centres(classes, dim, max(shards, min(CELLS, -(-n // cell_rows))))
    cells, asked, found, graph = len(centres), 0, None, None
    audits: list[dict] = []
    while True:
        routed = durable(_route(classes, dim, centres, probes))
        if graph is None:
            graph = durable(_graphs(routed, dim, shard_rows))
        more = durable(_ask(routed, graph, asked, dim, beam, threshold))
        found = more if found is None else found.unionByName(more)
        member = durable(components(found).select(F.col("node").alias("_id"), F.col("root").alias("_r")))
        sizes = member.groupBy("_r").agg(F.count("*").alias("_c"))
        sized = durable(member.join(sizes, "_r"))
        placed = durable(
            routed.join(sized, "_id", "left").select(
                "_id",
                "_v",
                "_near",
                F.coalesce("_r", "_id").alias("_r"),
                _class(F.coalesce("_c", F.lit(1))).alias("_cl"),
            )
        )
        by_size = _audit(placed, dim, threshold, audit)
        least, led = min(by_size.values(), default=(1.0, 1.0))
        audits.append(
            {"probes": probes, "beam": beam, "recall": least, "by_size": {c: r for c, (r, _) in by_size.items()}}
        )
        if least >= recall or (beam >= n and probes >= cells):
            break
        # More cells if at least half of what is missed is missed by them.
        if probes < cells and (1 - led >= (1 - least) / 2 or beam >= n):
            asked, probes = probes, 2 * probes
        else:
            asked, beam = 0, 2 * beam
    inside = sized.join(classes.select("_id", "_w", "_v"), "_id")
    links = (
        in_cells(inside, "_r", "_id", "_c", block)
        .select("_cell", "_id", "_block", "_same", "_w", "_v")
        .repartition("_cell")
        .sortWithinPartitions("_cell")
        .mapInArrow(lambda it: _verify(it, dim, threshold), "_id bigint, _l bigint")
        .groupBy("_id")
        .agg(F.sum("_l").alias("_l"))
    )
    told = (
        classes.select("_k", "_k2", "_id", "_w")
        .join(member, "_id", "left")
        .join(links, "_id", "left")
        .where("_w > 1 or _l > 0")
        .select(
            "_k",
            "_k2",
            (F.col("_w") - 1 + F.coalesce("_l", F.lit(0))).alias("n_links"),
            F.coalesce("_r", "_id").alias("component_id"),
        )
    )
    told = told.withColumn("_ok", F.lit(True))
    out = rows.drop("_v").join(told, ["_ok", "_k", "_k2"], "left")
    own = F.col("_id")
    component = F.coalesce("component_id", own)
    return (
        out.select(
            own.alias(key),
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            component.alias("component_id"),
            (own == component).alias("kept"),
        ),
        audits,
    )
