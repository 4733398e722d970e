"""Language-model scores by the marginal probability of a word over all its segmentations.

A word, with a start mark before it, is a lattice: every piece of an existing subword vocabulary
that fits between two positions is an arc. The forward recursion, in logarithms, adds up all paths.
Arc weights begin with the vocabulary's own scores (a merge rank ``r`` weighs ``1 / (r + 10)``) and
are then fitted to the distinct words of the training texts by expected counts, the vocabulary's own
weights staying in as ``PRIOR`` pieces. One more arc spans the whole word, weighted by its count:

    P(word) = c / (N + V) + V / (N + V) * sum over segmentations of the product of piece weights

with N training tokens and V distinct ones. Pieces with the mark begin words, all others go on, so
these probabilities add up to one over all words. The end of a text is a token of its own, which has
only the counted arc (and one that stands in where no text was ever seen).

Texts are never exploded into one row per token. Tasks cut their texts into blocks of about
``BLOCK`` tokens and number each block's distinct words; only distinct words of blocks are shuffled,
meet their counts, and come back to their block. Words are processed as padded code-point matrices.

Defined cases: null text counts as empty (one token, its end); rows with a null id are scored too;
repeated ids give one row each; words of any length; no training texts: base scores of 0 a token and
piece weights as the vocabulary has them; no texts: no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import mix64, per_worker, small_batches, text_of
from barloom.session import durable

#: Mark of the start of a word, as the vocabulary writes it (fixed value).
MARK = "▁"
#: Pieces that the vocabulary's own weights count for beside those expected in the training words.
PRIOR = 1000.0
#: Rounds of expected counts.
ROUNDS = 2
#: Tokens after which a block is closed. One text is never cut.
BLOCK = 1 << 22
#: Longer words go through the lattice one by one.
WIDE = 64
#: Cells of one code-point matrix.
CELLS = 1 << 19

_STEP = np.uint64(0x9E3779B97F4A7C15)


def read_pieces(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces that can occur inside a marked word, and their scores. The 256 byte pieces come first,
    as their numbers."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    low = min(model.get_score(i) for i in range(model.get_piece_size()) if model.get_score(i) > -1e8)
    pieces, scores = [str(b) for b in range(256)], [low] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or MARK in piece[1:]:
            continue
        pieces.append(piece)
        scores.append(max(model.get_score(i), low))
    return pieces, np.array(scores)


def start_weights(scores: np.ndarray) -> np.ndarray:
    """Probabilities of pieces from the ranks that their scores stand for."""
    w = 1.0 / (10.0 - scores)
    return w / w.sum()


class Lattice:
    """Lattices over one vocabulary; lives in a Python worker."""

    def __init__(self, pieces: list[str]):
        self.number = {p: i for i, p in enumerate(pieces) if i >= 256}
        self.longest = max((len(p) for p in self.number), default=1)
        found = {}
        for p, i in self.number.items():
            h = np.zeros(1, dtype=np.uint64)
            for c in reversed(p):
                h = self._grow(h, np.array([ord(c)], dtype=np.uint32))
            found[int(h[0])] = i
        if len(found) != len(self.number):
            raise ValueError("two pieces share a hash")
        keys = np.array(sorted(found), dtype=np.uint64)
        bits = 12
        while True:  # a table of slots with up to four places each
            slot = (keys >> np.uint64(64 - bits)).astype(np.int64)
            first = np.searchsorted(slot, slot)
            way = np.arange(len(keys)) - first
            if (1 << bits) >= 4 * len(keys) and (not len(keys) or way.max() < 4):
                break
            bits += 1
        self.shift = np.uint64(64 - bits)
        self.ways = int(way.max()) + 1 if len(keys) else 0
        self.table = np.zeros((max(self.ways, 1), 1 << bits), dtype=np.uint64)
        self.ids = np.full(self.table.shape, -1, dtype=np.int32)
        self.table[way, slot] = keys
        self.ids[way, slot] = [found[int(k)] for k in keys]

    @staticmethod
    def _grow(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Hash of a piece with one more character on its left."""
        return mix64(h * _STEP + code.astype(np.uint64) + np.uint64(1))

    def _find(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> self.shift).astype(np.int64)
        out = np.full(len(h), -1, dtype=np.int32)
        for way in range(self.ways):
            hit = (self.table[way, slot] == h) & (self.ids[way, slot] >= 0)
            out[hit] = self.ids[way, slot[hit]]
        return out

    def arcs(self, codes: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """Arcs of marked words (rows of code points, padded with 0) as (from, to, rows, pieces),
        ends ascending. A character without a piece has an arc -1 of its own."""
        out = []
        for end in range(1, codes.shape[1] + 1):
            rows = np.flatnonzero(sizes >= end)
            h = np.zeros(len(rows), dtype=np.uint64)
            for k in range(1, min(end, self.longest) + 1):
                h = self._grow(h, codes[rows, end - k])
                piece = self._find(h)
                if end - k > 0:  # a mark inside a word is an ordinary, unknown character
                    piece[codes[rows, end - k] == ord(MARK)] = -1
                hit = piece >= 0
                if k == 1:
                    out.append((end - 1, end, rows[~hit], np.full(int((~hit).sum()), -1, dtype=np.int32)))
                out.append((end - k, end, rows[hit], piece[hit]))
        return [a for a in out if len(a[2])]

    def _matrix(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        marked = [MARK + w for w in words]
        sizes = np.array([len(w) for w in marked])
        codes = np.frombuffer(
            b"".join(w.ljust(int(sizes.max()), "\0").encode("utf-32-le") for w in marked), dtype="<u4"
        )
        return codes.reshape(len(words), -1), sizes

    @staticmethod
    def _unknown(codes: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Log weight of characters by their bytes."""
        values, at = np.unique(codes, return_inverse=True)
        return np.array([sum(logs[b] for b in chr(int(v)).encode()) for v in values])[at]

    def forward(self, words: list[str], logs: np.ndarray, expect: np.ndarray | None = None) -> np.ndarray:
        """Log marginal probability of every word; adds expected piece counts to ``expect``."""
        out = np.zeros(len(words))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            if len(words[order[at]]) > WIDE:
                out[order[at]] = self._one(words[order[at]], logs, expect)
                at += 1
                continue
            stop = at + 1
            while (
                stop < len(order)
                and len(words[order[stop]]) <= WIDE
                and (stop - at) * (len(words[order[stop]]) + 1) < CELLS
            ):
                stop += 1
            rows = order[at:stop]
            out[rows] = self._many([words[i] for i in rows], logs, expect)
            at = stop
        return out

    def _many(self, words: list[str], logs: np.ndarray, expect: np.ndarray | None) -> np.ndarray:
        codes, sizes = self._matrix(words)
        alpha = np.full((codes.shape[1] + 1, len(words)), -np.inf)
        alpha[0] = 0.0
        arcs = []
        for begin, end, rows, pieces in self.arcs(codes, sizes):
            w = self._unknown(codes[rows, begin], logs) if pieces[0] < 0 else logs[pieces]
            alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[begin, rows] + w)
            if expect is not None:
                arcs.append((begin, end, rows, pieces, w))
        total = alpha[sizes, np.arange(len(words))]
        if expect is not None:
            beta = np.full_like(alpha, -np.inf)
            beta[sizes, np.arange(len(words))] = 0.0
            for begin, end, rows, pieces, w in reversed(arcs):
                ahead = beta[end, rows] + w
                beta[begin, rows] = np.logaddexp(beta[begin, rows], ahead)
                share = np.exp(alpha[begin, rows] + ahead - total[rows])
                if pieces[0] >= 0:
                    expect += np.bincount(pieces, share, minlength=len(expect))
                else:
                    for c, x in zip(codes[rows, begin], share):
                        for b in chr(int(c)).encode():
                            expect[b] += x
        return total

    def _one(self, word: str, logs: np.ndarray, expect: np.ndarray | None) -> float:
        """The same for one long word."""
        s, n = MARK + word, len(word) + 1
        arcs: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        alpha = [0.0] * (n + 1)
        for end in range(1, n + 1):
            for begin in range(max(0, end - self.longest), end):
                i = self.number.get(s[begin:end]) if begin == 0 or s[begin] != MARK else None
                if i is not None:
                    arcs[end].append((begin, i, float(logs[i])))
            if not arcs[end] or arcs[end][-1][0] != end - 1:
                arcs[end].append((end - 1, -1, float(sum(logs[b] for b in s[end - 1].encode()))))
            terms = [alpha[begin] + w for begin, _, w in arcs[end]]
            top = max(terms)
            alpha[end] = top + math.log(sum(math.exp(t - top) for t in terms))
        if expect is not None:
            beta = [-math.inf] * n + [0.0]
            for end in range(n, 0, -1):
                for begin, i, w in arcs[end]:
                    ahead = beta[end] + w
                    hi, lo = max(beta[begin], ahead), min(beta[begin], ahead)
                    beta[begin] = hi + math.log1p(math.exp(lo - hi)) if hi > -math.inf else hi
                    share = math.exp(alpha[begin] + ahead - alpha[n])
                    for b in [i] if i >= 0 else s[begin].encode():
                        expect[b] += share
        return alpha[n]


def blocks(docs: DataFrame, learn: Column, key: str, text: str, size: int) -> DataFrame:
    """Texts as numbers of their block's distinct words. Word 0 is the end of a text.

    ``_b`` block, ``_w`` its words, ``_c`` their counts in training texts; and per text ``_ids``, whether
    it is one of those (``_learn``), its tokens (``_n``) and all numbers in a row (``_seq``).
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        done = 0
        number: dict[bytes, int] = {b"": 0}
        ids, learnt, sizes, seq = [], [], [], []

        def block() -> pa.RecordBatch:
            flat = np.concatenate(seq)
            used = np.repeat(np.array(learnt, dtype=bool), sizes)
            counts = np.bincount(flat[used], minlength=len(number))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | done], pa.int64()),
                    pa.array([list(number)], pa.list_(pa.binary())),
                    pa.array([counts], pa.list_(pa.int64())),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([learnt], pa.list_(pa.bool_())),
                    pa.array([sizes], pa.list_(pa.int64())),
                    pa.array([flat.astype("<u4").tobytes()], pa.binary()),
                ],
                names=["_b", "_w", "_c", "_ids", "_learn", "_n", "_seq"],
            )

        held = 0
        for batch in batches:
            for i, used, raw in zip(*(batch.column(c) for c in ("_d", "_u", "_x"))):
                words = raw.as_py().lower().split()
                words.append(b"")
                for w in set(words).difference(number):
                    number[w] = len(number)
                ids.append(i.as_py())
                learnt.append(used.as_py())
                sizes.append(len(words))
                seq.append(np.fromiter(map(number.__getitem__, words), dtype=np.uint32, count=len(words)))
                held += len(words)
                if held >= size:
                    yield block()
                    done, held, number = done + 1, 0, {b"": 0}
                    ids, learnt, sizes, seq = [], [], [], []
        if ids:
            yield block()

    source = docs.select(
        F.col(key).cast("bigint").alias("_d"),
        F.coalesce(learn, F.lit(False)).alias("_u"),
        text_of(text).cast("binary").alias("_x"),
    )
    return source.mapInArrow(
        run,
        "_b bigint, _w array<binary>, _c array<bigint>, _ids array<bigint>, _learn array<boolean>, "
        "_n array<bigint>, _seq binary",
    )


def fit(vocabulary: DataFrame, pieces: list[str], start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Log weights of the pieces after rounds of expected counts over the distinct training words
    (``_word`` of ``vocabulary`` where ``_count > 0``). One sum per piece reaches the driver."""
    words = vocabulary.where("_count > 0 AND octet_length(_word) > 0").select("_word")
    weights = start
    for _ in range(rounds):
        logs = np.log(weights)

        def run(batches, logs=logs):
            lattice = per_worker(("lattice", len(pieces)), lambda: Lattice(pieces))
            expect = np.zeros(len(pieces))
            for b in batches:
                lattice.forward([w.decode() for w in b.column(0).to_pylist()], logs, expect)
            at = np.flatnonzero(expect)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(expect[at])], names=["p", "x"])

        sums = words.mapInArrow(run, "p bigint, x double").groupBy("p").agg(F.sum("x").alias("x"))
        expect = PRIOR * start
        for p, x in sums.collect():
            expect[p] += x
        weights = expect / expect.sum()
    return np.log(weights)


def score_texts(
    docs: DataFrame,
    path: str,
    learn: Column,
    *,
    key: str = "doc_id",
    text: str = "text",
    rounds: int = ROUNDS,
    block: int = BLOCK,
) -> DataFrame:
    """One row per text: ``key``, ``learnt`` (``learn`` held), ``n_tokens``, ``n_known`` (tokens seen in
    training), ``train_tokens``, ``base_score`` (add-one word model) and ``score``, both log10."""
    small_batches(docs.sparkSession)
    pieces, scores = read_pieces(path)
    start = start_weights(scores)
    told = durable(blocks(docs, learn, key, text, block))
    per_block = told.select("_b", F.posexplode(F.arrays_zip("_w", "_c")).alias("_p", "_z")).select(
        "_b", "_p", F.col("_z._w").alias("_word"), F.col("_z._c").alias("_c")
    )
    vocabulary = durable(per_block.groupBy("_word").agg(F.sum("_c").alias("_count")))
    n, v = vocabulary.agg(F.coalesce(F.sum("_count"), F.lit(0)), F.count_if(F.col("_count") > 0)).first()
    logs = fit(vocabulary, pieces, start, rounds)

    def weigh(batches):
        lattice = per_worker(("lattice", len(pieces)), lambda: Lattice(pieces))
        ten = math.log(10.0)
        for b in batches:
            words, c = b.column(0), b.column(1).to_numpy().astype(np.float64)
            plain = [w.decode() for w in words.to_pylist()]
            sub = lattice.forward([w for w in plain if w], logs)
            with np.errstate(divide="ignore"):
                seen = np.log(c / (n + v)) if n else np.full(len(c), -np.inf)
            rest = np.full(len(c), 0.0 if not n else -np.inf)  # the end of a text has no pieces
            rest[[bool(w) for w in plain]] = sub + (math.log(v / (n + v)) if n else 0.0)
            rest = np.where(np.isneginf(rest) & np.isneginf(seen), -math.log(n + v) if n else 0.0, rest)
            yield pa.RecordBatch.from_arrays(
                [
                    words,
                    pa.array(c > 0),
                    pa.array(np.log10((c + 1) / (n + v + 1))),
                    pa.array(np.logaddexp(seen, rest) / ten),
                ],
                names=["_word", "_known", "_base", "_score"],
            )

    weighed = vocabulary.mapInArrow(weigh, "_word binary, _known boolean, _base double, _score double")
    back = per_block.select(F.col("_b").alias("_of"), "_p", "_word").join(weighed, "_word").drop("_word")

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0] for c in left.column_names}
        seq = np.frombuffer(row["_seq"].as_py(), dtype="<u4")
        sizes = row["_n"].values.to_numpy()
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        at = right.column("_p").to_numpy()
        out = [row["_ids"].values, row["_learn"].values, row["_n"].values]
        for c, kind in (("_known", np.int64), ("_base", np.float64), ("_score", np.float64)):
            value = np.empty(len(at), dtype=kind)
            value[at] = right.column(c).to_numpy()
            out.append(pa.array(np.add.reduceat(value[seq], starts)))
        return pa.Table.from_arrays(out, names=["_d", "_learn", "_n", "_known", "_base", "_score"])

    scored = (
        told.select("_b", "_ids", "_learn", "_n", "_seq")
        .groupBy("_b")
        .cogroup(back.groupBy("_of"))
        .applyInArrow(
            add_up, "_d bigint, _learn boolean, _n bigint, _known bigint, _base double, _score double"
        )
    )
    return scored.select(
        F.col("_d").alias(key),
        F.col("_learn").alias("learnt"),
        F.col("_n").alias("n_tokens"),
        F.col("_known").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        F.col("_base").alias("base_score"),
        F.col("_score").alias("score"),
    )
