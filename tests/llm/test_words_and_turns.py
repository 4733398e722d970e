"""Lattice scores, spelling variants and the turn trie against plain versions."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import lattice, spelling, turn_trie
from barloom.llm.queries import PIECES, QUERIES, UNSEEN

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ lattice


@pytest.fixture(scope="module")
def vocabulary():
    return lattice.read_pieces(PIECES)


def all_splits(s):
    """Every way to cut a string, as lists of parts."""
    if not s:
        yield []
    for k in range(1, len(s) + 1):
        for rest in all_splits(s[k:]):
            yield [s[:k], *rest]


def plain_marginal(word, number, logs):
    """Sum over all segmentations, one by one, and expected uses of each piece."""
    total, uses = 0.0, defaultdict(float)
    for parts in all_splits("▁" + word):
        p, used = 1.0, []
        for at, part in enumerate(parts):
            i = number.get(part) if at == 0 or part[0] != "▁" else None
            if i is not None:
                p *= math.exp(logs[i])
                used.append(i)
            elif len(part) == 1:
                for b in part.encode():
                    p *= math.exp(logs[b])
                    used.append(b)
            else:
                p = 0.0
                break
        total += p
        for i in used if p else []:
            uses[i] += p
    return math.log(total), {i: u / total for i, u in uses.items()}


def test_marginal_equals_the_sum_over_all_segmentations(vocabulary):
    pieces, scores = vocabulary
    logs = np.log(lattice.start_weights(scores))
    model = lattice.Lattice(pieces)
    words = ["the", "reading", "ththwrest", "été", "漢字x", "🙂", "▁a▁", "a", "zzzqqq", "ÿ\u0001"]
    expect = np.zeros(len(pieces))
    got = model.forward(words, logs, expect)
    uses = defaultdict(float)
    for w, g in zip(words, got):
        want, used = plain_marginal(w, model.number, logs)
        assert g == pytest.approx(want, abs=1e-9)
        for i, u in used.items():
            uses[i] += u
    for i in np.flatnonzero(expect):
        assert expect[i] == pytest.approx(uses[int(i)], abs=1e-9)
    assert sum(uses.values()) == pytest.approx(expect.sum())


def test_long_words_go_the_same_way(vocabulary):
    pieces, scores = vocabulary
    logs = np.log(lattice.start_weights(scores))
    model = lattice.Lattice(pieces)
    words = ["thtion" * k + "é▁漢" for k in (1, 5, 9)]
    many, one = np.zeros(len(pieces)), np.zeros(len(pieces))
    wide = model._many(words, logs, many)
    assert wide == pytest.approx([model._one(w, logs, one) for w in words], abs=1e-8)
    assert many == pytest.approx(one, abs=1e-8)
    assert math.isfinite(model.forward(["ab" * 3_000], logs)[0])


def plain_scores(rows, learnt, vocabulary, rounds):
    pieces, scores = vocabulary
    start = lattice.start_weights(scores)
    model = lattice.Lattice(pieces)
    tokens = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for _, t in rows]
    counts = Counter()
    for (i, _), w in zip(rows, tokens):
        if learnt(i):
            counts.update(w)
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    weights = start
    for _ in range(rounds):
        expect = lattice.PRIOR * start
        for w in counts:
            if w is not None:
                model._one(w.decode(), np.log(weights), expect)
        weights = expect / expect.sum()
    out = {}
    for (i, _), words in zip(rows, tokens):
        base = score = 0.0
        for w in [*words, None]:
            c = counts[w]
            base += math.log10((c + 1) / (n + v + 1))
            p = c / (n + v)
            if w is not None:
                p += v / (n + v) * math.exp(model._one(w.decode(), np.log(weights), None))
            score += math.log10(p)
        out[i] = (not learnt(i), len(words) + 1, sum(counts[w] > 0 for w in [*words, None]), n, base, score)
    return out


def test_scores_equal_a_plain_model(spark, vocabulary):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = plain_scores(rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2, vocabulary, lattice.ROUNDS)
    got = lattice.score_texts(docs, PIECES, ~F.expr(UNSEEN), block=500).collect()
    assert len(got) == len(rows)
    for r in got:
        held, n, known, train, base, score = want[r.doc_id]
        assert (not r.learnt, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=1e-6)


def test_probabilities_of_words_add_up(spark):
    """Over all words of up to two of three characters and a longer rest the model stays below one."""
    docs = spark.createDataFrame([(1, "a b ab ba a"), (3, "b c")], "doc_id bigint, text string")
    words = ["".join(w) for k in (1, 2, 3) for w in itertools.product("abc", repeat=k)]
    asked = spark.createDataFrame([(100 + i, w) for i, w in enumerate(words)], "doc_id bigint, text string")
    got = lattice.score_texts(docs.unionByName(asked), PIECES, F.col("doc_id") < 100).where("doc_id >= 100")
    end = math.log10(2 / (9 + 6))  # two ends among 9 tokens of 6 kinds
    total = sum(10 ** (r.score - end) for r in got.collect())
    assert 0.5 < total + 2 / 15 <= 1.0 + 1e-9


def test_scores_of_odd_and_empty_tables(docs, no_docs):
    learn = ~F.expr(UNSEEN)
    got = lattice.score_texts(docs, PIECES, learn).collect()
    assert len(got) == docs.count() and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert sorted(r.n_tokens for r in got if r.doc_id in (4, 5)) == [1, 1]
    assert lattice.score_texts(no_docs, PIECES, learn).count() == 0
    unlearnt = lattice.score_texts(docs, PIECES, F.lit(False)).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and math.isfinite(r.score) for r in unlearnt)


def test_held_out_texts_score_above_the_word_model(spark):
    got = QUERIES["op11_lattice_score"][0](spark, "/root/testdata/sf0.01").where("held_out")
    row = got.agg(F.sum("score"), F.sum("n_tokens"), F.corr("score", "base_score")).first()
    assert row[0] / row[1] > -5.0 and row[2] > 0.99


# ----------------------------------------------------------------- spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows, least=3, shortest=5):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= shortest and c >= least}
    near = defaultdict(list)
    for a, b in itertools.combinations(sorted(n), 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def told(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def test_variants_equal_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = plain_variants(rows)
    assert len(want) > 500 and any(v[0] for v in want.values())
    assert told(spelling.variants(docs)) == want
    assert told(spelling.variants(docs, block=3)) == want  # crowded keys in many cells
    assert told(spelling.variants(docs, window=1)) == want


def test_crowded_words_lose_no_pair(spark):
    """Words over three letters: everything is near everything, at every place and length."""
    words = ["".join(w) for k in (1, 2, 3, 4, 5) for w in itertools.product("aéb", repeat=k)]
    n = {w: 1 + zlib.crc32(w.encode()) % 50 for w in words}
    frame = spark.createDataFrame(list(n.items()), "word string, n bigint")
    for window, block in ((3, 7), (1, 64), (2, 256)):
        got = {r.word: r for r in spelling.near_words(frame, window=window, block=block).collect()}
        for w in words:
            near = [x for x in words if one_edit(w, x)]
            best = min(near, key=lambda x: (-n[x], x))
            assert (got[w].n_near, got[w].form, got[w].form_n) == (len(near), best, n[best])


def test_forms_are_followed_to_the_last(spark):
    chain = [("abcde" + "f" * k, 3 * 2**k) for k in range(9)]
    text = " ".join(" ".join([w] * n) for w, n in chain)
    ids = [i for i in range(2000) if all(zlib.crc32(f"{i}:{w}".encode()) % 97 for w, _ in chain)]
    got = told(spelling.variants(spark.createDataFrame([(ids[0], text)], "doc_id bigint, text string")))
    assert got["abcde"][1] == chain[-1][0] and got[chain[-1][0]][:2] == (None, chain[-1][0])
    assert got["abcde"] == ("abcdef", chain[-1][0], 3, 1, 6)


def test_variants_of_odd_and_empty_tables(docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert told(spelling.variants(docs)) == plain_variants(rows)
    assert spelling.variants(no_docs).count() == 0


# --------------------------------------------------------------------- trie


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, seq in sorted(built.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = {}
    total = {}
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(total[k][0] for k in children[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        total[node] = (leaves, own + sum(total[k][1] for k in children[node]))
        ends = ",".join(str(c) for c in members[node] if len(built[c]) == len(node))
        out[min(members[node]), len(node)] = (
            min(members[node[:-1]]) if node else None,
            len(members[node]),
            len(children[node]),
            *total[node],
            hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def nodes(frame):
    rows = frame.collect()
    got = {
        (r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
        for r in rows
    }
    assert len(got) == len(rows)
    return got


TURNS = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("sizes", [{}, {"parts": 7, "rows": 5, "cells": 40}, {"parts": 3, "rows": 1}])
def test_trie_equals_a_plain_version(spark, sizes):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    # Repeated conversations, common beginnings, short and long ones.
    rows += [(1000 + c, t, "user", f"turn {t % 7}") for c in range(60) for t in range(c % 12)]
    rows += [(2000 + c, None if t == 2 else t, None, None) for c in range(25) for t in range(3)]
    rows += [(3001, t, "assistant", "é" * (t % 5)) for t in range(150)]
    rows += [(-7, 0, "user", "below zero")]
    frame = spark.createDataFrame(rows, TURNS)
    want = plain_trie(rows)
    assert nodes(turn_trie.prefix_trie(frame, **sizes)) == want


def test_all_equal_conversations_cross_every_border(spark):
    rows = [(5 * c, t, "user", "same") for c in range(40) for t in range(3)]
    want = plain_trie(rows)
    frame = spark.createDataFrame(rows, TURNS)
    assert nodes(turn_trie.prefix_trie(frame, parts=6, rows=4)) == want
    # Bases without turns leave conversations without any.
    rows = [(5 * c + 1, 0, "user", "only") for c in range(40)]
    want = plain_trie(rows)
    assert (1, 0) in want
    assert nodes(turn_trie.prefix_trie(spark.createDataFrame(rows, TURNS), parts=6, rows=4)) == want


def test_trie_of_odd_and_empty_tables(spark):
    rows = [(None, 1, "user", "lost"), (1, None, None, None), (1, 1, "u", "x"), (1, 1, "u", "x")]
    frame = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' AS _c", "'x' AS depth", "'x' AS _t")
    assert nodes(turn_trie.prefix_trie(frame)) == plain_trie([r for r in rows if r[0] is not None])
    assert turn_trie.prefix_trie(frame.limit(0)).count() == 0
