"""Nearest vectors and vector dedup against comparing all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import hnsw, kmeans_tree
from barloom.llm.components import components
from barloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def whole(df):
    rows = df.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    return np.array([r.vec_id for r in rows]), x / np.linalg.norm(x, axis=1)[:, None]


def test_nearest_recall(spark):
    ids, x = whole(spark.read.parquet(f"{SF}/embeddings.parquet"))
    got = QUERIES["op4_nearest_vectors"][0](spark, SF).toPandas()
    assert (got.groupby("query_id")["rank"].apply(list).map(lambda r: r == [1, 2, 3, 4, 5])).all()
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -2
        mine = got[got.query_id == ids[i]]
        assert np.allclose(mine.score, s[mine.vec_id], atol=1e-12)
        hits += len(set(ids[np.lexsort((ids, -s))[:5]]) & set(mine.vec_id))
        total += 5
    assert hits / total >= 0.9


@pytest.fixture(scope="module")
def odd(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(5)
    rows = [(0, [1.0, 0, 0]), (1, [1.0, 0, 0]), (2, [2.0, 0, 0]), (3, None), (4, [0.0, 0, 0]), (5, [nan, 1, 0]), (6, [inf, 1, 0]),
            (7, [1.0]), (8, [1.0, None, 0]), (None, [1.0, 0, 0]), (50, [0.0, 1, 0]), (51, [0.0, 1, 0.1]), (9, [1e-200, 0, 0])]
    rows += [(100 + i, [0.0, 1e-6 * i, 1.0]) for i in range(40)]
    rows += [(1000 + i, rng.normal(size=3).tolist()) for i in range(30)]
    rows = [(i, v if v is None else [x if x is None else float(x) for x in v]) for i, v in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS _id", "2 AS label", "3 AS _w")


def test_nearest_odd_rows(odd):
    got, _ = kmeans_tree.search(odd, F.col("vec_id") % 50 == 0, sample=64, part_rows=8)
    rows = got.orderBy("query_id", "rank").collect()
    first = [(r.vec_id, round(r.score, 9)) for r in rows if r.query_id == 0]
    assert first[:3] == [(1, 1.0), (2, 1.0), (9, 1.0)]
    assert {r.query_id for r in rows} == {0, 50, 100, 1000}
    few, _ = kmeans_tree.search(odd.where("vec_id in (0, 1, 3, 4)"), F.col("vec_id") % 50 == 0)
    assert [(r.query_id, r.vec_id) for r in few.collect()] == [(0, 1)]
    assert kmeans_tree.search(odd.limit(0), F.lit(True))[0].count() == 0
    assert kmeans_tree.search(odd.where("vec_id = 3"), F.lit(True))[0].count() == 0


def test_every_query_gets_its_neighbours(spark):
    """Far vectors in leaves of their own beside tight clusters that one visit answers."""
    rng = np.random.default_rng(6)
    tight = np.repeat(rng.normal(size=(40, 16)), 40, axis=0)
    tight += 1e-3 * rng.normal(size=tight.shape)
    x = np.concatenate([tight, rng.normal(size=(9, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = kmeans_tree.search(df, (F.col("vec_id") % 5 == 0) | (F.col("vec_id") >= len(tight)))[0].toPandas()
    asked = {i for i in range(len(x)) if i % 5 == 0 or i >= len(tight)}
    assert got.groupby("query_id").size().to_dict() == {i: 5 for i in asked}


def plain(ids, x, threshold=0.9):
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(near, low[None, :], 1 << 60).min(axis=1))
        if (new == low).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids, near.sum(axis=1), low)}
        low = new


@pytest.mark.parametrize("block", [4, 512])
def test_vector_dedup_clusters(spark, block):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([c + 0.15 * rng.normal(size=(n, 16)) for c, n in zip(centres, range(1, 31))] + [rng.normal(size=(300, 16))])
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, audits = hnsw.near_duplicates(df, shards=3, block=block)
    assert audits[-1]["recall"] >= 0.99
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == plain(*whole(df))


def test_small_groups_beside_a_large_cluster(spark, monkeypatch):
    """A first beam that finds one large cluster but no pair is widened."""
    rng = np.random.default_rng(4)
    hot = rng.normal(size=16) + 0.02 * rng.normal(size=(400, 16))
    pairs = np.repeat(rng.normal(size=(60, 16)), 2, axis=0)
    pairs += 0.05 * rng.normal(size=pairs.shape)
    x = np.concatenate([hot, pairs, rng.normal(size=(600, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    true_ask, n_hot = hnsw._ask_shard, len(hot)

    def ask_shard(dim, ef, *more):
        ask = true_ask(dim, ef, *more)

        def narrow(key, graph, asked):
            t = ask(key, graph, asked)
            return t.filter(np.asarray(t["u"]) < n_hot) if ef == 8 else t

        return narrow

    monkeypatch.setattr(hnsw, "_ask_shard", ask_shard)
    got, audits = hnsw.near_duplicates(df, shards=2, beam=8)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == plain(*whole(df))
    assert [a["beam"] for a in audits] == [8, 16]


def pairs_apart(rng, n, cos, dim=16):
    """Pairs of that cosine in random directions."""
    u, w = rng.normal(size=(2, n, dim))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w -= (w * u).sum(axis=1)[:, None] * u
    w /= np.linalg.norm(w, axis=1)[:, None]
    return np.concatenate([u, cos * u + np.sqrt(1 - cos**2) * w])


def vectors(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_work_of_a_vector_does_not_follow_the_number_of_graphs(spark, monkeypatch, tmp_path):
    """Not every vector asks every graph, and no link is lost by it."""
    df = vectors(spark, pairs_apart(np.random.default_rng(8), 400, 0.995))
    true_ask, folder = hnsw._ask_shard, str(tmp_path)

    def ask_shard(*args):
        ask = true_ask(*args)

        def counted(key, graph, asked):
            name = "-".join(str(k.as_py()) for k in key)
            with open(f"{folder}/{name}", "w") as f:
                f.write(f"{graph.num_rows} {asked.num_rows}")
            return ask(key, graph, asked)

        return counted

    monkeypatch.setattr(hnsw, "_ask_shard", ask_shard)
    got, audits = hnsw.near_duplicates(df, shards=32)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == plain(*whole(df))
    assert len(audits) == 1
    held, asked = np.array([p.read_text().split() for p in tmp_path.iterdir()], dtype=int).T
    assert held.sum() == 800 and 0 < asked.sum() <= 4 * 800


def test_links_across_cells_are_found(spark):
    """Links at the threshold between vectors of different cells: more cells are asked, not a wider beam."""
    df = vectors(spark, pairs_apart(np.random.default_rng(9), 600, 0.903))
    got, audits = hnsw.near_duplicates(df, shards=32, probes=1)
    truth = plain(*whole(df))
    linked = [r for r in got.collect() if truth[r.vec_id][0]]
    assert audits[0]["recall"] < 0.99 <= audits[-1]["recall"] and audits[-1]["probes"] > 1
    assert {a["beam"] for a in audits} == {hnsw.BEAM}
    assert len(linked) >= 1200
    assert np.mean([truth[r.vec_id] == (r.n_links, r.component_id) for r in linked]) >= 0.99


def test_crowded_cells_are_cut_into_parts(spark):
    rng = np.random.default_rng(10)
    hot = rng.normal(size=16) + 0.02 * rng.normal(size=(300, 16))
    df = vectors(spark, np.concatenate([hot, pairs_apart(rng, 100, 0.99), rng.normal(size=(60, 16))]))
    got, _ = hnsw.near_duplicates(df, shards=2, cell_rows=10_000, shard_rows=20)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == plain(*whole(df))


def test_centres():
    rng = np.random.default_rng(11)
    x = hnsw.unit(np.repeat(np.eye(4), 50, axis=0) + 0.01 * rng.normal(size=(200, 4))).astype(np.float32)
    c = hnsw.fit_centres(x, 12)
    assert np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-5) and (x @ c.T).max(axis=1).min() > 0.99
    assert len(hnsw.fit_centres(x[:3], 12)) <= 3
    assert np.isfinite(hnsw.fit_centres(np.array([[1, 0], [-1, 0]], dtype=np.float32), 1)).all()


def test_vector_dedup_whole_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = QUERIES["op9_embedding_dedup"][0](spark, SF).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == plain(*whole(df))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vector_dedup_odd_rows(odd):
    got, _ = hnsw.near_duplicates(odd.where("vec_id is null or vec_id < 1000"), shards=2)
    rows = got.collect()
    by = {r.vec_id: r for r in rows}
    assert len(rows) == 53
    assert by[0].n_links == by[1].n_links == by[2].n_links == by[9].n_links == 3 and by[9].component_id == 0
    assert all(by[i].n_links == 0 and by[i].kept for i in (3, 4, 5, 6, 7, 8))
    assert by[51].component_id == 50 and by[120].n_links == 39 and by[120].component_id == 100
    assert hnsw.near_duplicates(odd.limit(0))[0].count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
